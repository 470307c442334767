"""Listening material: comparison pairs, verdict pages, blind groups, candidate speakers, scoring manifests."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hash_bucket, hex_hash, unit_hash
from .catalog import split_key
from ..session import written
from .ordering import first_after, grouped_scan, position_bucket, top_rows, value_bucket


def shuffled(df: DataFrame, keys: Sequence[str], seed, parts: Sequence[Column], rank: str) -> DataFrame:
    """Adds a 0-based place in a hashed order inside each group."""
    tagged = df.withColumn("_digest", hex_hash(seed, *parts))
    out = grouped_scan(tagged, list(keys), [F.col("_digest"), *parts], hash_bucket(F.col("_digest")), rank="_place")
    return out.drop("_digest").withColumn(rank, F.col("_place") - 1).drop("_place")


def neighbour_pairs(samples: DataFrame, group: str, sample: str, partners: int, seed: int) -> DataFrame:
    """Same-group pairs (a, b): every sample with the next ``partners`` of its group in hashed order.

    With ``partners`` at least the group size minus one this is every pair of the group; the number of rows grows
    with samples times partners, never with the square of a group.
    """
    ranked = shuffled(samples.select(group, sample), [group], seed, [F.col(sample)], "_at")
    ahead = ranked.select(group, F.col(sample).alias("a"), F.explode(F.sequence(F.col("_at") + 1, F.col("_at") + partners)).alias("_at"))
    return ahead.join(ranked.select(group, "_at", F.col(sample).alias("b")), [group, "_at"]).select(group, "a", "b")


def pair_queue(pairs: DataFrame, seed: int, repeat_share: float = 0.1) -> DataFrame:
    """Pairs with a hashed side order, a share of them again with sides swapped, all in a hashed order (``id``)."""
    swap = unit_hash(seed, "side", F.col("a"), F.col("b")) < 0.5
    base = pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"),
                        *[c for c in pairs.columns if c not in ("a", "b")]).withColumn("kind", F.lit("same language"))
    drawn = shuffled(base, [], f"{seed}:repeat", [F.col("a"), F.col("b")], "_draw")
    total = base.agg(F.floor(F.count(F.lit(1)) * F.lit(repeat_share)).alias("_repeats"))
    again = drawn.crossJoin(F.broadcast(total)).filter(F.col("_draw") < F.col("_repeats")).drop("_draw", "_repeats").select(
        F.col("b").alias("a"), F.col("a").alias("b"), *[c for c in base.columns if c not in ("a", "b", "kind")],
        F.concat("kind", F.lit(", repeat")).alias("kind"))
    return shuffled(base.unionByName(again), [], f"{seed}:queue", [F.col("a"), F.col("b"), F.col("kind")], "id")


# Rate-ratio bands (from, below) and how many pairs each contributes.
TEMPO_BANDS = ((1.25, 9.0, 8), (1.10, 1.20, 6), (1.0, 1.04, 6))


def fitting_partners(samples: DataFrame, group: str, sample: str, rate: str, bands) -> tuple[DataFrame, DataFrame]:
    """Samples in order of rate, and per sample and band the places of all faster samples that fit.

    Returns (group, ``at``, sample, rate), and (group, ``at``, ``band``, ``from``, ``n``): the partners are the ``n`` places
    from ``from`` on. A pair fits a band if the faster rate is at least ``low`` times and less than ``high`` times the slower
    one; equal rates are ordered by sample. Rates that are null or not above 0 take no part.
    """
    order = grouped_scan(samples.filter(F.col(rate) > 0).select(group, sample, rate), [group], [rate, sample], rank="at")
    order = written(order, "by-rate")
    edges = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(e).alias("edge"), F.lit(float(x)).alias("x"))
                                for b, (low, high, _) in enumerate(bands) for e, x in (("low", low), ("high", high))])).alias("e")
    asks = order.select(group, F.col(rate).alias("_rate"), "at", edges).select(
        group, (F.col("_rate") * F.col("e.x")).alias("value"), F.struct("at", "e.band", "e.edge").alias("ask"))
    places = first_after(order.select(group, F.col(rate).alias("value"), F.col("at").alias("item")), asks, [group], None, strict=False)
    edge = lambda e: F.max(F.when(F.col("ask.edge") == e, F.col("item")))
    found = places.groupBy(group, F.col("ask.at").alias("at"), F.col("ask.band").alias("band")).agg(edge("low").alias("_low"), edge("high").alias("_high"))
    past = order.groupBy(group).agg((F.max("at") + 1).alias("_past"))
    start = F.greatest("_low", F.col("at") + 1)
    return order, found.filter("_low IS NOT NULL").join(past, group).select(
        group, "at", "band", start.alias("from"), (F.coalesce("_high", "_past") - start).alias("n")).filter("n > 0")


def tempo_pairs(samples: DataFrame, group: str, sample: str, rate: str, seed: int, bands=TEMPO_BANDS) -> DataFrame:
    """Pairs spread over rate ratios: per band one pair per group, and the first N groups in hashed order.

    A group's pair is drawn from all its fitting ones: a hash picks a number below their count, the running sum of the
    samples' partner counts says whose partner it is and which. No pair but the drawn one is formed.
    """
    order, partners = fitting_partners(samples, group, sample, rate, bands)
    run = written(grouped_scan(partners, [group, "band"], ["at"], rank="_row", sums={"_upto": F.col("n")}), "partners")
    drawn = run.groupBy(group, "band").agg(F.sum("n").alias("fitting")).withColumn(
        "_draw", F.least(F.floor(unit_hash(seed, "pair", F.col("band"), F.col(group)) * F.col("fitting")), F.col("fitting") - 1))
    picked = run.join(drawn, [group, "band"]).filter((F.col("_draw") >= F.col("_upto") - F.col("n")) & (F.col("_draw") < F.col("_upto"))).select(
        group, "band", "fitting", F.col("at").alias("_slow"), (F.col("from") + F.col("_draw") - F.col("_upto") + F.col("n")).alias("_fast"))
    most = F.element_at(F.array(*[F.lit(n) for *_, n in bands]), F.col("band") + 1)
    digest = hex_hash(seed, F.col("band"), F.col(group))
    few = top_rows(picked.withColumn("_digest", digest).withColumn("_most", most), ["band"], [F.col("_digest")], F.col("_most"), F.col("_digest")).drop("_most", "_digest")
    side_of = lambda name, at: order.select(group, F.col("at").alias(at), F.col(sample).alias(name), F.col(rate).alias(f"{name}_rate"))
    pairs = few.join(side_of("slow", "_slow"), [group, "_slow"]).join(side_of("fast", "_fast"), [group, "_fast"]).withColumn(
        "ratio", F.col("fast_rate") / F.col("slow_rate"))
    side = unit_hash(seed, "side", F.col("slow"), F.col("fast")) < 0.5
    chosen = pairs.select(
        group, "band", "fitting", F.round("ratio", 2).alias("ratio"), F.when(side, F.col("slow")).otherwise(F.col("fast")).alias("a"),
        F.when(side, F.col("fast")).otherwise(F.col("slow")).alias("b"),
        F.when(F.col("ratio") < 1.04, "close").when(side, "B").otherwise("A").alias("expect"))
    return shuffled(chosen, [], f"{seed}:queue", [F.col("a"), F.col("b"), F.col("band")], "id")


def verdict_page(manifest: DataFrame, seed: int) -> DataFrame:
    """First clip of every voice: languages by falling size then name (``page``), voices in hashed order (``place``)."""
    first = manifest.filter(F.col("idx") == 0).withColumn("lang", F.element_at(F.split("espeak", "-"), 1)).withColumn(
        "key", F.concat_ws("|", "voice", "speaker"))
    sizes = first.groupBy("lang").agg(F.count(F.lit(1)).alias("voices"))
    pages = grouped_scan(sizes, [], [F.desc("voices"), F.col("lang")], -value_bucket(F.col("voices").cast("double")), rank="page")
    return shuffled(first, ["lang"], seed, [F.col("key")], "place").join(pages, "lang").select("page", "lang", "voices", "place", "key", "file")


def spaced_speakers(speakers: DataFrame, model: str, name: str, sid: str, at_most: int = 4) -> DataFrame:
    """At most four evenly spaced speakers of each model by ID; names made safe for files."""
    ranked = grouped_scan(speakers, [model], [F.col(sid)], position_bucket(F.col(sid)), rank="_rn")
    sizes = speakers.groupBy(model).agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.call_function("div", F.col("_n"), F.lit(at_most)), F.lit(1))
    picked = ranked.join(sizes, model).withColumn("_step", step).filter(
        ((F.col("_rn") - 1) % F.col("_step") == 0) & ((F.col("_rn") - 1) / F.col("_step") < at_most))
    return picked.select(model, F.regexp_replace(name, "[/ ]", "_").alias("speaker"), F.col(sid).alias("sid"))


VERDICT_SEPARATOR = "~"


def verdict_clips(rows: DataFrame, tag: str, clips: int = 3) -> DataFrame:
    """First clips of each (voice, speaker, language), renamed so that answers cannot be taken for the original's."""
    first = top_rows(rows, ["voice", "speaker", "espeak"], [F.col("idx"), F.col("path")], clips, F.col("path"), rank="_i")
    name = F.concat_ws(VERDICT_SEPARATOR, F.lit(tag), "voice", "espeak")
    place = F.col("_i") - 1
    return first.select(name.alias("voice"), "speaker", "espeak", place.alias("idx"),
                        F.concat(name, F.lit("__"), F.col("speaker"), F.lit("__"), place.cast("string"), F.lit(".wav")).alias("file"), "text")


def ab_groups(items: DataFrame, seed: int) -> DataFrame:
    """Blind trials: the original's side drawn by hash per item, items in hashed order inside each voice."""
    key = F.concat_ws("|", "voice", "speaker")
    first = unit_hash(seed, "side", key, F.col("language"), F.col("item")) < 0.5
    sided = items.select(
        "voice", "speaker", "language", "item", "text", F.concat_ws("|", F.lit("ab"), key, "language", "item").alias("id"),
        F.when(first, "A").otherwise("B").alias("original_side"),
        F.when(first, F.col("original")).otherwise(F.col("candidate")).alias("a"),
        F.when(first, F.col("candidate")).otherwise(F.col("original")).alias("b"))
    return shuffled(sided, ["voice", "speaker", "language"], seed, [F.col("item")], "place")


def rating_groups(items: DataFrame, seed: int) -> DataFrame:
    tagged = items.withColumn("id", F.concat_ws("|", F.lit("rating"), "language", "voice", "speaker", "item"))
    return shuffled(tagged, ["language"], seed, [F.col("id")], "place")


def pick_speakers(clips: DataFrame, speaker: str, group: str, score: str, length: Column, clip: str, take: int = 3,
                  per_group: int = 2, speakers: int = 3) -> DataFrame:
    """Best speakers by the mean of their top clips of usable length, at most two per group, the first few overall."""
    usable = clips.filter(length.between(4, 10))
    best = top_rows(usable, [speaker], [F.desc(score), F.col(clip)], take, F.col(clip))
    means = best.groupBy(speaker).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(score).alias("_sum"), F.min(group).alias(group)).filter(F.col("_n") == take).select(
        speaker, group, (F.col("_sum") / take).alias("mean_score"))
    order = [F.desc("mean_score"), F.desc(speaker)]
    capped = top_rows(means, [group], order, per_group, F.col(speaker))
    return top_rows(capped, [], order, speakers, F.col(speaker), rank="place")


def render_manifests(records: DataFrame, renders: DataFrame, reference_count: int) -> tuple[DataFrame, DataFrame]:
    """(student, teacher) manifests: rendered items with the teacher's clip of the same ID, after each speaker's
    first other records as references (lowest idx)."""
    wanted = renders.select("speaker").distinct()
    others = records.join(renders.select("id"), "id", "left_anti").join(wanted, "speaker", "left_semi")
    refs = top_rows(others, ["speaker"], [F.col("id")], reference_count, F.col("id"), rank="_rn")
    offset = refs.groupBy("speaker").agg(F.count(F.lit(1)).alias("_start"))
    numbered = grouped_scan(renders.select("speaker", "id", "order", F.col("path").alias("render_path")), ["speaker"],
                            [F.col("order")], position_bucket(F.col("order")), rank="_rn")
    joined = numbered.join(records.select("id", "espeak", "text", "path"), "id").join(offset, "speaker", "left").withColumn(
        "idx", F.coalesce("_start", F.lit(0)) + F.col("_rn") - 1)
    voice, speaker = split_key(F.col("speaker"))
    head = lambda df, path, idx, ref: df.select(
        voice.alias("voice"), speaker.alias("speaker"), "espeak", idx.cast("bigint").alias("idx"), F.col(path).alias("file"), "text", ref.alias("reference_voice"))
    named = F.concat(F.lit("teacher/"), voice, F.lit("|"), speaker)
    nothing = F.lit(None).cast("string")
    student = head(joined, "render_path", F.col("idx"), named)
    teacher = head(refs, "path", F.col("_rn") - 1, nothing).unionByName(head(joined, "path", F.col("idx"), named))
    return student, teacher


def evaluation_plan(records: DataFrame, held_out: DataFrame, speakers_per_language: int, sentences: int, references: int) -> tuple[DataFrame, DataFrame]:
    """(student rows to render, teacher references): first K speakers per language by name, the first held-out
    sentences of the language for each, and each speaker's first records by ID."""
    pairs = records.select("language", "speaker").distinct()
    chosen = top_rows(pairs, ["language"], [F.col("speaker")], speakers_per_language, F.col("speaker"))
    texts = top_rows(held_out, ["language"], [F.col("rank")], sentences, F.col("rank"), rank="_n").select(
        "language", "text", (F.col("_n") - 1).alias("idx"))
    student = chosen.join(texts, "language")
    refs = top_rows(records.join(chosen.select("speaker").distinct(), "speaker", "left_semi"), ["speaker"], [F.col("id")],
                    references, F.col("id"), rank="_n")
    return student, refs.select("speaker", "id", "espeak", (F.col("_n") - 1).alias("idx"))
