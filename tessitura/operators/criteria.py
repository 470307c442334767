"""Pass criteria of a candidate model against original voices, and the listening worklist."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import fixed
from .catalog import format_voice_key, parse_reference_key
from .checks import require_empty
from .listening import VERDICT_SEPARATOR
from .scoring import common_texts, pooled_rate

RESULT = "test string, voice string, language string, measured double, reference double, threshold string, status string, note string"
STATUSES = ("pass", "fail", "not_measured", "not_applicable")


@dataclass(frozen=True)
class Limits:
    """Fixed values of the pass criteria."""

    ab_min_sentences: int = 30
    ab_max_original_preferred: float = 0.60
    cer_margin: float = 0.02
    own_speaker_similarity: float = 0.80
    own_utmos_margin: float = 0.1
    native_rating: float = 3.5
    lid_margin: float = 0.1
    cross_speaker_similarity: float = 0.70
    weak_utmos_margin: float = 0.2
    weak_per_margin: float = 0.05
    runtime_base: float = 1.10
    runtime_variant: float = 2.0
    utmos_relisten: float = 2.9


@dataclass(frozen=True)
class Inputs:
    """lineup (voice, speaker, language), languages (espeak, whisper, voxlingua), score rows of originals and candidate,
    human verdicts on originals (voice, speaker, espeak, human); None where a listening input was not given. Verdicts may
    carry ``position``, their place in the source: of several for one cell the first new and the last original counts."""

    lineup: DataFrame
    languages: DataFrame
    originals: DataFrame
    candidate: DataFrame
    original_human: DataFrame
    native_languages: tuple[str, ...]
    weak_language: str
    weak_reference: tuple[str, str]
    verdicts: DataFrame | None = None
    ab: DataFrame | None = None
    ratings: DataFrame | None = None
    runtime: DataFrame | None = None
    limits: Limits = Limits()


KEY = ["voice", "speaker"]
CELL = [*KEY, "espeak"]


def original_preferred(answer: Column, side: Column) -> Column:
    """1 for the original, 0 for the candidate, one half for a tie."""
    return F.when(answer == "tie", 0.5).when(answer == side, 1.0).otherwise(0.0)


def tagged_verdicts(rows: DataFrame, tag: str) -> DataFrame:
    """Verdicts of one checkpoint: ``<tag>~<voice>~<language>`` names only, empty answers left out."""
    parts = F.split("voice", VERDICT_SEPARATOR)
    mine = rows.filter((F.size(parts) == 3) & (F.element_at(parts, 1) == tag) & F.col("human").isNotNull() & (F.col("human") != ""))
    human = F.when(F.col("human").isin("pass", "fail"), F.col("human")).otherwise(
        F.raise_error(F.concat(F.lit("human verdict "), F.col("human"))))
    return mine.select(F.element_at(parts, 2).alias("voice"), "speaker", F.element_at(parts, 3).alias("language"), human.alias("human"),
                       *[c for c in rows.columns if c == "position"])


def judge(measured: Column, passes: Column) -> Column:
    """Not measured without a value; an undecidable comparison (no reference) fails."""
    return F.when(measured.isNull(), "not_measured").when(F.coalesce(passes, F.lit(False)), "pass").otherwise("fail")


def result(test: str, voice: Column, language: Column, measured, reference, threshold: str, status: Column, note: Column | str = "") -> Column:
    value = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(
        F.lit(test).alias("test"), voice.alias("voice"), language.alias("language"), value(measured).alias("measured"),
        value(reference).alias("reference"), F.lit(threshold).alias("threshold"), status.alias("status"),
        F.coalesce(note if isinstance(note, Column) else F.lit(note), F.lit("")).alias("note"))


def _key() -> Column:
    return format_voice_key(F.col("voice"), F.col("speaker"))


def check_reference(rows: DataFrame, message: str) -> None:
    """Similarity must have been measured against the row's own voice."""
    ref = parse_reference_key(F.col("speaker_reference"))
    wrong = rows.filter(F.col("speaker_reference").isNotNull()).filter(
        (ref["voice"] != F.col("voice")) | (ref["speaker"] != F.col("speaker")))
    require_empty(wrong.select("voice", "speaker", "path", "speaker_reference"), message)


def _at_end(rows: DataFrame, column: str, by_place, by_value) -> Column:
    """The first or last value in order of ``position`` where the rows carry one, else the smallest or largest value, so
    that the result never depends on how rows are dealt out."""
    return by_place(column, "position") if "position" in rows.columns else by_value(column)


def _shared(i: Inputs, cand: DataFrame, orig: DataFrame) -> DataFrame:
    c, o = common_texts(cand, orig, "text", CELL)
    left = c.groupBy(*CELL).agg(F.count(F.lit(1)).alias("shared"), pooled_rate("cer").alias("c_cer"), F.avg("UTMOS").alias("c_utmos"))
    right = o.groupBy(*CELL).agg(pooled_rate("cer").alias("o_cer"), F.avg("UTMOS").alias("o_utmos"))
    return left.join(right, CELL, "full_outer")


def own_language(i: Inputs, strict: bool = True) -> DataFrame:
    t = i.limits
    line = i.lineup.select(*KEY, F.col("language").alias("espeak"))
    cand, orig = i.candidate.join(line, CELL, "left_semi"), i.originals.join(line, CELL, "left_semi")
    if strict:
        require_empty(line.join(cand.select(*CELL), CELL, "left_anti"), "no candidate rows for line-up voices in their own language")
        require_empty(line.join(orig.select(*CELL), CELL, "left_anti"), "no original rows for line-up voices")
        require_empty(line.join(i.languages, "espeak", "left_anti"), "languages not in the language table")
        require_empty(line.join(i.original_human, KEY, "left_anti"), "no human verdict for line-up voices")
        check_reference(cand, "own-language rows measure similarity against another voice")
    spark = i.candidate.sparkSession
    similarity = cand.groupBy(*CELL).agg(F.avg("speaker_similarity").alias("similarity"))
    ab = i.ab if i.ab is not None else spark.createDataFrame([], "voice string, speaker string, answer string, original_side string")
    heard = ab.groupBy(*KEY).agg(F.count(F.lit(1)).alias("answers"),
                                 F.avg(original_preferred(F.col("answer"), F.col("original_side"))).alias("preferred"))
    verdicts = i.verdicts if i.verdicts is not None else spark.createDataFrame([], "voice string, speaker string, language string, human string")
    new = verdicts.groupBy(*KEY, F.col("language").alias("espeak")).agg(_at_end(verdicts, "human", F.min_by, F.min).alias("new_human"))
    human = i.original_human.groupBy(*KEY).agg(_at_end(i.original_human, "human", F.max_by, F.max).alias("old_human"))
    rows = (line.join(_shared(i, cand, orig), CELL, "left").join(similarity, CELL, "left").join(heard, KEY, "left")
            .join(new, CELL, "left").join(human, KEY, "left").join(i.languages.select("espeak", "whisper"), "espeak", "left"))
    voice, lang, c = _key(), F.col("espeak"), F.col
    n = F.coalesce("answers", F.lit(0))
    enough = n >= t.ab_min_sentences
    ab_result = F.when(n == 0, result("own: blind A/B vs original", voice, lang, None, None, f"<= {t.ab_max_original_preferred}", F.lit("not_measured"))).otherwise(
        result("own: blind A/B vs original", voice, lang, c("preferred"), None, f"<= {t.ab_max_original_preferred} over >= {t.ab_min_sentences} answers",
               F.when(~enough, "not_measured").when(c("preferred") <= t.ab_max_original_preferred, "pass").otherwise("fail"),
               F.concat(n.cast("string"), F.lit(" answers"))))
    cer = "own: Whisper CER vs original"
    cer_result = F.when(c("whisper").isNull(), result(cer, voice, lang, None, None, f"<= original + {t.cer_margin}", F.lit("not_applicable"),
                                                      "language not on the Whisper allow-list")).otherwise(
        result(cer, voice, lang, c("c_cer"), c("o_cer"), f"<= original + {t.cer_margin}", judge(c("c_cer"), c("c_cer") <= c("o_cer") + t.cer_margin),
               F.concat(F.coalesce("shared", F.lit(0)).cast("string"), F.lit(" shared sentences"))))
    similar = result("own: speaker similarity to original", voice, lang, c("similarity"), None, f">= {t.own_speaker_similarity}",
                     judge(c("similarity"), c("similarity") >= t.own_speaker_similarity))
    utmos = result("own: UTMOS vs original (recording quality only)", voice, lang, c("c_utmos"), c("o_utmos"), f">= original - {t.own_utmos_margin}",
                   judge(c("c_utmos"), c("c_utmos") >= c("o_utmos") - t.own_utmos_margin))
    failed, unheard = c("old_human") != "pass", c("new_human").isNull()
    human_result = result(
        "own: human enough (verdict page)", voice, lang, None, None, "passes if the original passed",
        F.when(failed, "pass").when(unheard, "not_measured").when(c("new_human") == "pass", "pass").otherwise("fail"),
        F.when(failed, "original failed the human pass").when(~unheard, F.concat(F.lit("new model: "), c("new_human"))))
    return rows.select(F.inline(F.array(ab_result, cer_result, similar, utmos, human_result)))


def best_original_cer(cand: DataFrame, originals: DataFrame) -> DataFrame:
    """Per candidate voice and language the original with the lowest pooled CER on the texts both have.

    Both sides are summed per voice and text before they meet on the text, so the join carries one row per pair of
    voices and text.
    """
    both = F.col("cer_edits").isNotNull() & F.col("cer_chars").isNotNull()
    per_text = lambda df: df.groupBy(*CELL, "text").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(both, F.col("cer_edits"))).alias("e"), F.sum(F.when(both, F.col("cer_chars"))).alias("u"))
    a = per_text(cand)
    b = per_text(originals).select(*[F.col(c).alias(f"o_{c}") for c in KEY], "espeak", "text", F.col("e").alias("oe"), F.col("u").alias("ou"))
    pairs = a.join(b, ["espeak", "text"]).groupBy(*CELL, "o_voice", "o_speaker").agg(
        F.sum("n").alias("shared"), F.sum("e").alias("e"), F.sum("u").alias("u"), F.sum("oe").alias("oe"), F.sum("ou").alias("ou"))
    scored = pairs.filter(F.col("ou") != 0).select(
        *CELL, "shared", F.when(F.col("u") != 0, F.col("e") / F.col("u")).alias("c_cer"), (F.col("oe") / F.col("ou")).alias("o_cer"),
        F.concat_ws("|", "o_voice", "o_speaker").alias("best"), "o_voice", "o_speaker")
    first = F.min_by(F.struct("shared", "c_cer", "o_cer", "best"), F.struct("o_cer", "o_voice", "o_speaker")).alias("b")
    return scored.groupBy(*CELL).agg(first).select(*CELL, "b.*")


def cross_language(i: Inputs, strict: bool = True) -> DataFrame:
    t, c = i.limits, F.col
    own = i.lineup.select(*KEY, F.col("language").alias("own"))
    abroad = i.candidate.join(own, KEY).filter(c("espeak") != c("own"))
    if strict:
        require_empty(i.candidate.select("espeak").distinct().join(i.languages, "espeak", "left_anti"), "languages not in the language table")
        check_reference(abroad, "cross-language rows measure similarity against another voice")
    originals = i.originals.groupBy("espeak").agg(F.avg("lid_target").alias("o_lid"))
    cells = abroad.groupBy(*CELL).agg(F.avg("lid_target").alias("c_lid")).join(originals, "espeak", "left").join(
        best_original_cer(abroad, i.originals), CELL, "left").join(i.languages, "espeak", "left")
    voice, lang = _key(), c("espeak")
    lid_test, cer_test = "cross: language-ID confidence", "cross: Whisper CER vs best original"
    lid = F.when(c("voxlingua").isNull(), result(lid_test, voice, lang, None, None, f">= originals - {t.lid_margin}", F.lit("not_applicable"),
                                                 "no VoxLingua107 label for the language")).otherwise(
        result(lid_test, voice, lang, c("c_lid"), c("o_lid"), f">= originals - {t.lid_margin}", judge(c("c_lid"), c("c_lid") >= c("o_lid") - t.lid_margin),
               F.when(c("o_lid").isNull(), "no original voices scored")))
    cer_limit = f"<= best original + {t.cer_margin}"
    cer = F.when(c("whisper").isNull(), result(cer_test, voice, lang, None, None, cer_limit, F.lit("not_applicable"), "language not on the Whisper allow-list")).when(
        c("o_cer").isNull(), result(cer_test, voice, lang, None, None, cer_limit, F.lit("not_measured"), "no original voice has CER in this language")).otherwise(
        result(cer_test, voice, lang, c("c_cer"), c("o_cer"), cer_limit, judge(c("c_cer"), c("c_cer") <= c("o_cer") + t.cer_margin),
               F.concat(F.lit("best original "), c("best"), F.lit(", "), c("shared").cast("string"), F.lit(" shared sentences"))))
    out = cells.select(F.inline(F.array(lid, cer)))

    best = lambda df, name: df.groupBy(*CELL).agg(F.avg("UTMOS").alias("m")).groupBy("espeak").agg(F.max("m").alias(name))
    passed = i.original_human.groupBy("espeak").agg(F.count_if(c("human") == "pass").alias("passed"))
    per_lang = best(i.candidate, "c_best").join(best(i.originals, "o_best"), "espeak", "left").join(passed, "espeak", "left")
    if i.verdicts is not None:
        names = F.array_join(F.array_sort(F.collect_list(F.when(c("human") == "pass", _key()))), " ")
        heard = i.verdicts.groupBy(F.col("language").alias("espeak")).agg(
            F.count(F.lit(1)).alias("heard"), F.count_if(c("human") == "pass").alias("passing"), names.alias("names"))
        per_lang = per_lang.join(heard, "espeak", "left")
    else:
        per_lang = per_lang.select("*", F.lit(None).cast("bigint").alias("heard"), F.lit(None).cast("bigint").alias("passing"), F.lit(None).cast("string").alias("names"))
    star, human_test, human_limit = F.lit("*"), "cross: some lineup voice human enough", "one passes where an original passed"
    none_passed, unheard = F.coalesce("passed", F.lit(0)) == 0, F.coalesce("heard", F.lit(0)) == 0
    human = result(human_test, star, lang, F.when(~none_passed & ~unheard, c("passing")), None, human_limit,
                   F.when(none_passed, "pass").when(unheard, "not_measured").when(c("passing") > 0, "pass").otherwise("fail"),
                   F.when(none_passed, "no original voice passed").when(~unheard, c("names")))
    utmos = result("cross: best lineup UTMOS vs best original (within language)", star, lang, c("c_best"), c("o_best"), ">= best original",
                   judge(c("c_best"), c("c_best") >= c("o_best")), F.when(c("o_best").isNull(), "no original voices scored"))
    out = out.unionByName(per_lang.select(F.inline(F.array(human, utmos))))

    similarity = abroad.groupBy(*KEY).agg(F.avg("speaker_similarity").alias("s"))
    out = out.unionByName(i.lineup.join(similarity, KEY, "left").select(F.inline(F.array(result(
        "cross: speaker similarity to own-language output", _key(), star, c("s"), None, f">= {t.cross_speaker_similarity} mean",
        judge(c("s"), c("s") >= t.cross_speaker_similarity))))))
    spark = i.candidate.sparkSession
    wanted = spark.createDataFrame([(x,) for x in sorted(i.native_languages)], "language string")
    ratings = i.ratings if i.ratings is not None else spark.createDataFrame([], "language string, score int")
    rated = ratings.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
    return out.unionByName(wanted.join(rated, "language", "left").select(F.inline(F.array(result(
        "cross: native rating", star, c("language"), c("mean"), None, f">= {t.native_rating} mean; no sound consistently wrong (read the notes)",
        judge(c("mean"), c("mean") >= t.native_rating), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" ratings")))))))


def weak_language(i: Inputs, strict: bool = True) -> DataFrame:
    t, c = i.limits, F.col
    name = "|".join(i.weak_reference)
    reference = i.originals.filter((c("voice") == i.weak_reference[0]) & (c("speaker") == i.weak_reference[1]) & (c("espeak") == i.weak_language))
    if strict and reference.isEmpty():
        raise ValueError(f"no original rows for the weak-language reference {name} in {i.weak_language}")
    weak = i.candidate.join(i.lineup.select(*KEY), KEY, "left_semi").filter(c("espeak") == i.weak_language)
    own = i.candidate.join(i.lineup.select(*KEY, F.col("language").alias("espeak")), CELL, "left_semi")
    texts = reference.select("text").distinct()
    shared = weak.join(texts, "text", "left_semi")
    counted = reference.groupBy("text").agg(*[F.sum(F.when(F.col("per_edits").isNotNull() & F.col("per_units").isNotNull(), F.col(x))).alias(x)
                                              for x in ("per_edits", "per_units")])
    ref_per = shared.select(*KEY, "text").distinct().join(counted, "text").groupBy(*KEY).agg(
        F.try_divide(F.sum("per_edits"), F.sum("per_units")).alias("r_per"))
    mine = shared.groupBy(*KEY).agg(F.count(F.lit(1)).alias("shared"), pooled_rate("per").alias("c_per"))
    utmos = weak.groupBy(*KEY).agg(F.avg("UTMOS").alias("w")).join(own.groupBy(*KEY).agg(F.avg("UTMOS").alias("o")), KEY, "full_outer")
    rows = i.lineup.select(*KEY).join(utmos, KEY, "left").join(mine, KEY, "left").join(ref_per, KEY, "left")
    lang = F.lit(i.weak_language)
    return rows.select(F.inline(F.array(
        result("weak: UTMOS vs own-language UTMOS", _key(), lang, c("w"), c("o"), f">= own language - {t.weak_utmos_margin}",
               judge(c("w"), c("w") >= c("o") - t.weak_utmos_margin)),
        result("weak: phoneme error vs reference", _key(), lang, c("c_per"), c("r_per"), f"<= {name} + {t.weak_per_margin}",
               judge(c("c_per"), c("c_per") <= c("r_per") + t.weak_per_margin),
               F.concat(F.coalesce("shared", F.lit(0)).cast("string"), F.lit(" shared sentences"))))))


def runtime(i: Inputs) -> DataFrame:
    t, test, star = i.limits, "runtime: CPU per audio second vs medium voice", F.lit("*")
    if i.runtime is None:
        return i.candidate.sparkSession.range(1).select(F.inline(F.array(
            result(test, F.lit("base"), star, None, None, f"<= {t.runtime_base}", F.lit("not_measured")))))
    ratio, base = F.col("ratio"), F.col("variant") == "base"
    one = lambda limit: result(test, F.col("variant"), star, ratio, None, f"<= {limit}", judge(ratio, ratio <= limit))
    return i.runtime.select(F.inline(F.array(F.when(base, one(t.runtime_base)).otherwise(one(t.runtime_variant)))))


def outside_lineup(candidate: DataFrame, lineup: DataFrame) -> DataFrame:
    """Candidate (voice, speaker) that the line-up does not name."""
    return candidate.select(*KEY).subtract(lineup.select(*KEY))


def evaluate(i: Inputs, strict: bool = True) -> DataFrame:
    """All criteria as one table of results; candidate voices outside the line-up are an error."""
    if strict:
        require_empty(outside_lineup(i.candidate, i.lineup), "candidate rows for voices outside the lineup")
    return own_language(i, strict).unionByName(cross_language(i, strict)).unionByName(weak_language(i, strict)).unionByName(runtime(i))


def status_counts(results: DataFrame) -> DataFrame:
    """Number of results per status, zero included."""
    every = results.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(results.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select(
        "status", F.coalesce("n", F.lit(0)).alias("n"))


#: Where a listener finds the material of each kind of task.
PLACES = {"verdict": "verdict form", "page": "listening page", "owner": "full listening", "clean": "verdict form, clean sound"}


def needs_ears(i: Inputs, results: DataFrame, places: dict[str, str] = PLACES) -> DataFrame:
    """What a listener still has to do: unmeasured tests, notes to read, carried-over faults, low-quality groups."""
    t, c = i.limits, F.col
    test = c("test")
    task = F.when(test.contains("human enough"), "human enough?").when(test.contains("A/B"), "blind A/B").when(test.contains("native rating"), "native rating")
    where = F.when(test.contains("human enough"), places["verdict"]).otherwise(places["page"])
    why = F.when(test.contains("human enough"), test).when(test.contains("A/B"), F.coalesce(F.nullif(c("note"), F.lit("")), F.lit("no answers"))).otherwise(c("note"))
    out = results.filter(c("status") == "not_measured").select(
        task.alias("task"), "voice", "language", where.alias("where"), why.alias("why")).filter(c("task").isNotNull())
    if i.ratings is not None:
        out = out.unionByName(i.ratings.filter(F.trim("note") != "").select(
            F.lit("read note: sound clearly wrong?").alias("task"), _key().alias("voice"), "language",
            F.concat(F.lit("listener "), c("listener"), F.lit(", item "), c("item")).alias("where"), c("note").alias("why")))
    out = out.unionByName(i.lineup.select(
        F.lit("carried-over narrow band or crackle?").alias("task"), _key().alias("voice"), F.lit(i.weak_language).alias("language"),
        F.lit(places["owner"]).alias("where"), F.lit("weak-language test").alias("why")))
    low = i.candidate.groupBy(*CELL).agg(F.avg("UTMOS").alias("m")).filter(c("m") < t.utmos_relisten)
    return out.unionByName(low.select(
        F.lit("re-listen: low recording quality").alias("task"), _key().alias("voice"), c("espeak").alias("language"),
        F.lit(places["clean"]).alias("where"), F.concat(F.lit("UTMOS "), fixed(c("m"), 2), F.lit(f" < {t.utmos_relisten}")).alias("why")))
