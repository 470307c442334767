"""Voice catalogue: lists and configs to rows, speakers with their sources, tiers from verdicts, files and URLs."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .checks import require_empty
from .planning import speaker_key

# Tiers, sampling weights per tier, and voices that never teach.
TIERS = ("good", "clean_robot", "natural_degraded", "excluded")
WEIGHTS = {"good": 1.0, "natural_degraded": 0.5, "clean_robot": 0.3}
NEVER_TEACH = ("de_DE-glados-medium", "sv_SE-lisa-medium", "vi_VN-vivos-x_low", "vi_VN-25hours_single-low")


def rebase(path: Column, listed_root: str, root: str) -> Column:
    """A path under the root used in the lists, moved under the real root; any other path is an error."""
    prefix = listed_root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.concat(F.lit(root.rstrip("/") + "/"), F.substr(path, F.lit(len(prefix) + 1)))).otherwise(
        F.raise_error(F.concat(path, F.lit(f" is not under {listed_root}"))))


def parse_voice_lists(lines: DataFrame, listed_root: str, root: str, line: str = "value") -> DataFrame:
    """``<name>\\t<config path>`` or ``<name>\\t<engine>:<voice code>[:<path>|<path>...]`` lines as typed rows.

    Columns: voice, kind, espeak (null for plain paths) and a map of named paths. Unknown engines fail.
    """
    raw = lines.filter(F.col(line) != "").select(
        F.split_part(F.col(line), F.lit("\t"), F.lit(1)).alias("voice"), F.split_part(F.col(line), F.lit("\t"), F.lit(2)).alias("spec"))
    parts = raw.withColumn("_p", F.split("spec", ":", 3)).withColumn(
        "_engine", F.when(F.size("_p") > 1, F.element_at("_p", 1)))
    paths = parts.withColumn("_paths", F.transform(
        F.split(F.coalesce(F.try_element_at("_p", F.lit(3)), F.when(F.col("_engine").isNull(), F.col("spec"))), r"\|"),
        lambda p: rebase(p, listed_root, root)))
    n, p = F.coalesce(F.size("_paths"), F.lit(0)), lambda i: F.try_element_at("_paths", F.lit(i))
    named = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), v)])
    strip_onnx = lambda c: F.regexp_replace(c, r"\.onnx\.json$", "")
    plain_name = F.regexp_replace("voice", "^kokoro-", "")
    e = F.col("_engine")
    paths_map = (
        F.when(e.isNull(), named(config=p(1), onnx=F.concat(strip_onnx(p(1)), F.lit(".onnx")), mnn=F.concat(strip_onnx(p(1)), F.lit(".mnn"))))
        .when((e == "kokoro") & F.col("voice").startswith("kokoro-"), named(voice=plain_name))
        .when((e == "mms") & (n == 2), named(model=p(1), tokens=p(2)))
        .when((e == "coqui") & (n == 2), named(model=p(1), config=p(2)))
        .when((e == "glowtts") & (n == 3), named(model=p(1), vocoder=p(2), lexicon=p(3)))
        .when((e == "mimic3") & (n == 1), named(config=p(1), mnn=F.concat(strip_onnx(p(1)), F.lit(".mnn"))))
        .when((e == "kokoro_ja") & (n == 1), named(voice=plain_name, dict_path=p(1)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown engine line: "), F.col("voice"), F.lit(" "), F.col("spec")))))
    return paths.select("voice", F.coalesce(e, F.lit("piper")).alias("kind"), F.try_element_at("_p", F.lit(2)).alias("espeak"),
                        paths_map.alias("paths"))


VOICE_CONFIG = (
    "phoneme_type string, audio struct<sample_rate:int>, espeak struct<voice:string>, language struct<code:string>, "
    "num_speakers int, speaker_id_map map<string,int>, phoneme_id_map map<string,array<int>>, "
    "inference struct<noise_scale:double,length_scale:double,noise_w:double>"
)


def parse_voice_configs(files: DataFrame, voice: str = "voice", json: str = "value") -> DataFrame:
    """Voice configuration JSON as typed columns with the defaults of absent keys."""
    c = files.select(voice, F.from_json(json, VOICE_CONFIG, {"mode": "FAILFAST"}).alias("c"))
    return c.select(
        voice, F.coalesce("c.phoneme_type", F.lit("espeak")).alias("phoneme_type"), F.col("c.audio.sample_rate").alias("sample_rate"),
        F.col("c.espeak.voice").alias("espeak"), F.col("c.language.code").alias("locale"), F.col("c.num_speakers").alias("num_speakers"),
        F.coalesce("c.speaker_id_map", F.create_map().cast("map<string,int>")).alias("speaker_id_map"),
        F.col("c.phoneme_id_map").alias("phoneme_id_map"), "c.inference.noise_scale", "c.inference.length_scale", "c.inference.noise_w")


def language_id(locale: Column, espeak: Column, region_language: Column) -> Column:
    """Language of the locale's region where one is listed, else the voice code."""
    return F.when(locale.isNotNull() & region_language.isNotNull(), region_language).otherwise(espeak)


def build_speakers(tiers: DataFrame, piper: DataFrame, engines: DataFrame, regions: DataFrame, strict: bool = True) -> DataFrame:
    """Tier rows with the first source that has their voice, else ``corpus``; ``problem`` says what does not fit.

    The three lists are dimension tables with one row per voice or locale; Spark broadcasts them when they are small.
    """
    p = piper.select("voice", F.lit(True).alias("_piper"), F.col("espeak").alias("_p_espeak"), "locale", "num_speakers", "speaker_id_map")
    e = engines.select("voice", F.col("kind").alias("_engine"), F.col("espeak").alias("_e_espeak"))
    r = regions.select("locale", F.col("language").alias("_region"))
    joined = tiers.join(p, "voice", "left").join(e, "voice", "left").join(r, "locale", "left")
    is_piper, is_engine = F.col("_piper").isNotNull(), F.col("_engine").isNotNull()
    many = is_piper & (F.col("num_speakers") > 1)
    sid = F.when(many, F.try_element_at("speaker_id_map", F.col("speaker")))
    name = F.when(many, F.col("speaker"))
    problem = (
        F.when(is_piper & (F.col("_p_espeak") != F.col("espeak")), "config espeak differs")
        .when(many & sid.isNull(), "speaker not in its speaker_id_map")
        .when(is_piper & ~many & (F.col("speaker") != "0"), "single-speaker voice names a speaker")
        .when(~is_piper & is_engine & (F.col("_e_espeak") != F.col("espeak")), "voice list espeak differs")
        .when(~is_piper & is_engine & (F.col("speaker") != "0"), "engine teachers are single-speaker"))
    out = joined.select(
        speaker_key(F.col("voice"), name).alias("key"), "voice", name.alias("speaker"), sid.alias("sid"),
        F.col("lang").alias("lang_group"), "espeak", language_id(F.when(is_piper, F.col("locale")), F.col("espeak"), F.col("_region")).alias("language"),
        "tier", "condition", "weight", "articulation_rate",
        F.when(is_piper, "piper").when(is_engine, F.col("_engine")).otherwise("corpus").alias("source_kind"), problem.alias("problem"))
    if strict:
        require_empty(out.filter(F.col("problem").isNotNull()).select("key", "problem"), "catalogue mismatch")
        return out.drop("problem")
    return out


def tier_of(human: Column, audio: Column) -> Column:
    """Tier of two verdicts (pass or fail)."""
    return (
        F.when((human == "pass") & (audio == "pass"), "good").when((human == "pass") & (audio == "fail"), "natural_degraded")
        .when((human == "fail") & (audio == "pass"), "clean_robot").when((human == "fail") & (audio == "fail"), "excluded")
        .otherwise(F.raise_error(F.lit("verdicts must be pass or fail"))))


def condition_of(sample_rate: Column, bandwidth_khz: Column, audio: Column) -> Column:
    return F.when(audio == "fail", "degraded").when((sample_rate < 22050) | (bandwidth_khz < 8.5), "narrow_band").otherwise("clean")


def weight_of(tier: Column) -> Column:
    value = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        value = F.when(tier == name, weight).otherwise(value)
    return value


def apply_overrides(verdicts: DataFrame, overrides: DataFrame, keys: Sequence[str] = ("voice", "speaker"),
                    columns: Sequence[str] = ("human", "audio")) -> DataFrame:
    """Verdicts with every non-empty override in place of the first answer."""
    other = overrides.select(*keys, *[F.nullif(F.col(c), F.lit("")).alias(f"_o_{c}") for c in columns])
    joined = verdicts.join(other, list(keys), "left")
    return joined.select(*[F.coalesce(f"_o_{c}", c).alias(c) if c in columns else F.col(c) for c in verdicts.columns])


def tier_rows(verdicts: DataFrame, metrics: DataFrame, manifest: DataFrame, keys: Sequence[str] = ("voice", "speaker"),
              excluded: Sequence[str] = NEVER_TEACH) -> DataFrame:
    """Tier, condition, weight and rate per speaker; a speaker without metrics counts as full band (11 kHz)."""
    joined = verdicts.join(metrics.select(*keys, "bandwidth_khz", "articulation_rate"), list(keys), "left").join(
        manifest.select(*keys, "espeak", "sample_rate").distinct(), list(keys))
    synthetic = F.col("voice").startswith("kokoro-") & ~((F.col("human") == "pass") & (F.col("audio") == "pass"))
    tier = F.when(F.col("voice").isin(*excluded) | synthetic, "excluded").otherwise(tier_of(F.col("human"), F.col("audio")))
    return joined.select(
        "lang", "espeak", *keys, "human", "audio", tier.alias("tier"),
        condition_of(F.col("sample_rate"), F.coalesce("bandwidth_khz", F.lit(11.0)), F.col("audio")).alias("condition"),
        weight_of(tier).alias("weight"), "articulation_rate")


def merge_manifests(*manifests: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), manifests)


def split_key(key: Column) -> tuple[Column, Column]:
    """Voice and speaker of a speaker key: split at the first dot, speaker ``0`` without one."""
    parts = F.split(key, r"\.", 2)
    return F.element_at(parts, 1), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("0"))


VOICE_KEY = r"^([^|]+)\|([^|]+)$"
REFERENCE_KEY = r"^([^/]+)/([^|]+)\|([^|]+)$"


def parse_voice_key(text: Column, strict: bool = True) -> Column:
    """``<voice>|<speaker>`` as a struct; anything else is an error (or null)."""
    bad = F.raise_error(F.concat(F.lit("not '<voice>|<speaker>': "), text)) if strict else F.lit(None)
    return F.when(text.rlike(VOICE_KEY), F.struct(
        F.regexp_extract(text, VOICE_KEY, 1).alias("voice"), F.regexp_extract(text, VOICE_KEY, 2).alias("speaker"))).otherwise(bad)


def parse_reference_key(text: Column, strict: bool = True) -> Column:
    bad = F.raise_error(F.concat(F.lit("not '<set>/<voice>|<speaker>': "), text)) if strict else F.lit(None)
    return F.when(text.rlike(REFERENCE_KEY), F.struct(*[
        F.regexp_extract(text, REFERENCE_KEY, i + 1).alias(n) for i, n in enumerate(("reference_set", "voice", "speaker"))])).otherwise(bad)


def format_voice_key(voice: Column, speaker: Column) -> Column:
    return F.concat_ws("|", voice, speaker)


# Host that mirrors every file at its bucket path.
PACKS = "packs map<string, struct<files:array<struct<url:string,mirrorPath:string,sizeBytes:bigint>>>>"


def url_index(source_catalog: DataFrame, mirror_catalog: DataFrame, extra: DataFrame, mirror_host: str, json: str = "value") -> DataFrame:
    """(path, urls, size): the mirror's URL first, then upstream URLs, each once; the first known size."""
    files = lambda df: df.select(F.explode(F.map_values(F.from_json(json, PACKS)["packs"])).alias("p")).select(
        F.explode("p.files").alias("f")).select("f.*")
    mirror = files(mirror_catalog).filter(F.parse_url("url", F.lit("HOST")) == mirror_host).select(
        F.ltrim(F.parse_url("url", F.lit("PATH")), F.lit("/")).alias("path"), "url", F.col("sizeBytes").alias("size"), F.lit(0).alias("turn"))
    source = files(source_catalog).filter(F.col("mirrorPath").isNotNull()).select(
        F.col("mirrorPath").alias("path"), F.col("sizeBytes").alias("size"),
        F.posexplode(F.array(F.concat(F.lit(f"https://{mirror_host}/"), F.col("mirrorPath")), F.col("url"))).alias("pos", "url")).select(
        "path", "url", "size", (F.col("pos") + 1).alias("turn"))
    more = extra.select("path", "url", F.col("size").cast("bigint").alias("size"), F.lit(3).alias("turn"))
    every = mirror.unionByName(source).unionByName(more).withColumn("size", F.nullif(F.col("size"), F.lit(0).cast("bigint")))
    once = every.groupBy("path", "url").agg(F.min("turn").alias("turn"), F.min_by("size", "turn").alias("size"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "url", "size")))
    return once.groupBy("path").agg(ordered.alias("_u")).select(
        "path", F.transform("_u", lambda u: u["url"]).alias("urls"),
        F.try_element_at(F.filter(F.transform("_u", lambda u: u["size"]), lambda s: s.isNotNull()), F.lit(1)).alias("size"))


def required_files(voices: DataFrame, sources: DataFrame, index: DataFrame, shared_voices: str) -> DataFrame:
    """Files the chosen voices need: their named paths, plus catalogued siblings of engine models (no MNN graphs)."""
    s = voices.select("voice").distinct().join(sources, "voice")
    model = lambda path: F.regexp_replace(path, r"\.[^./]+$", ".onnx")
    k = F.col("kind")
    m = lambda name: F.try_element_at("paths", F.lit(name))
    direct = (
        F.when(k == "piper", F.array(m("config"), m("onnx"), m("mnn"))).when(k == "kokoro", F.array(F.lit(shared_voices)))
        .when(k == "kokoro_ja", F.array(F.lit(shared_voices), m("dict_path"))).when(k.isin("mms", "coqui"), F.array(model(m("model"))))
        .when(k == "mimic3", F.array(model(m("mnn")))).when(k == "glowtts", F.array(model(m("model")), model(m("vocoder")), m("lexicon"))))
    named = s.select(F.explode(direct).alias("path"))
    folder = lambda path: F.regexp_replace(path, r"/?[^/]*$", "")
    engine_dirs = s.filter(k.isin("mms", "coqui", "mimic3")).select(folder(F.coalesce(m("model"), m("mnn"))).alias("_dir")).distinct()
    siblings = index.filter(~F.col("path").rlike(r"\.mnn(\.weight)?$")).withColumn("_dir", folder(F.col("path"))).join(
        engine_dirs, "_dir", "left_semi").select("path")
    return named.unionByName(siblings).distinct()


def plan_fetch(required: DataFrame, index: DataFrame) -> DataFrame:
    """Required files with their URLs; ``missing`` where no public URL is known."""
    return required.join(index, "path", "left").withColumn("missing", F.col("urls").isNull())


def choose_initial_voices(languages: DataFrame, candidates: DataFrame, nearest: DataFrame, min_score: float = 0.3) -> DataFrame:
    """Per language the best voice (good tier, clean, highest score, name), else the nearest language's choice."""
    order = F.struct((F.col("tier") != "good").alias("a"), (F.col("condition") != "clean").alias("b"), (-F.col("score")).alias("c"), F.col("voice").alias("d"))
    best = candidates.filter(F.col("score") >= min_score).groupBy("language").agg(F.min(order)["d"].alias("voice"))
    own = languages.join(best, "language", "left").join(nearest, "language", "left")
    other = best.select(F.col("language").alias("near"), F.col("voice").alias("_near_voice"))
    return own.join(other, "near", "left").select(
        "language", F.coalesce("voice", "_near_voice").alias("voice"),
        F.when(F.col("voice").isNull(), F.col("near")).alias("taken_from"))


def best_quality(voices: DataFrame, keys: Sequence[str], quality: str, order: Sequence[str]) -> DataFrame:
    """Highest of a ranked list of values per group; values outside the list are an error."""
    rank = F.array_position(F.array(*[F.lit(q) for q in order]), F.col(quality))
    checked = F.when(rank == 0, F.raise_error(F.concat(F.lit("unknown quality "), F.col(quality)))).otherwise(rank)
    return voices.groupBy(*keys).agg(F.max_by(quality, checked).alias("best"))
