"""Score rows: pooled rates, means, summaries, shared texts, seed spread, system comparison."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import round_exact
from .checks import require_empty
from .ordering import exact_quantiles, top_rows

# Columns of a score row, its rates (numerator, denominator) and its mean metrics.
SCORE_SCHEMA = (
    "voice string, speaker string, espeak string, idx int, text string, path string, duration_s double, cpu_s double, "
    "transcript string, cer_edits int, cer_chars int, recognized_phones string, per_edits int, per_units int, "
    "per_seen_edits int, per_seen_units int, per_unseen_edits int, per_unseen_units int, lid_target double, "
    "lid_top string, speaker_reference string, speaker_similarity double, f0_corr double, f0_status string, "
    "UTMOS double, SIG double, BAK double, OVRL double, P808 double"
)
RATES = {
    "cer": ("cer_edits", "cer_chars"), "per": ("per_edits", "per_units"),
    "per_seen": ("per_seen_edits", "per_seen_units"), "per_unseen": ("per_unseen_edits", "per_unseen_units"),
}
MEANS = ("lid_target", "speaker_similarity", "f0_corr", "UTMOS", "SIG", "BAK", "OVRL", "P808")
GROUP = ("voice", "speaker", "espeak")


def _col(name: str, side: str = "") -> Column:
    return F.col(f"{side}.{name}") if side else F.col(name)


def row_rate(name: str, side: str = "") -> Column:
    numerator, denominator = (_col(c, side) for c in RATES[name])
    return F.when(denominator != 0, numerator / denominator)


def pooled_rate(name: str, side: str = "", where: Column | None = None) -> Column:
    """Sum of numerators over sum of denominators of the rows that have both; null if none or zero."""
    a, b = (_col(c, side) for c in RATES[name])
    both = a.isNotNull() & b.isNotNull()
    if where is not None:
        both = both & where
    total = F.sum(F.when(both, b))
    return F.when(total != 0, F.sum(F.when(both, a)) / total)


def summarize(rows: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """One line per group: rows, pooled rates, means, lowest quality score, CPU seconds per audio second."""
    timed = F.col("cpu_s").isNotNull()
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[pooled_rate(r).alias(r) for r in RATES], *[F.avg(m).alias(m) for m in MEANS],
        F.min("UTMOS").alias("UTMOS_min"),
        F.try_divide(F.sum(F.when(timed, F.col("cpu_s"))), F.sum(F.when(timed, F.col("duration_s")))).alias("cpu_s_per_audio_s"))


def clip_means(clips: DataFrame, metrics: Sequence[str], lowest: str, keys: Sequence[str] = ("voice", "speaker")) -> DataFrame:
    """Per speaker: clips, mean of each metric and the minimum of one, rounded half-even to four digits."""
    return clips.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_clips"), *[round_exact(F.avg(m), 4).alias(m) for m in metrics],
        round_exact(F.min(lowest), 4).alias(f"{lowest}_min"))


def common_texts(a: DataFrame, b: DataFrame, text: str = "text", keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Both sides restricted to the texts (within ``keys``) that the other side also has."""
    on = [*keys, text]
    shared = a.select(*on).distinct().intersect(b.select(*on).distinct())
    return a.join(shared, on, "left_semi"), b.join(shared, on, "left_semi")


def select_rows(rows: DataFrame, voice: str | None = None, speaker: str | None = None, espeak: str | None = None) -> DataFrame:
    for column, value in (("voice", voice), ("speaker", speaker), ("espeak", espeak)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def named_voices(rows: DataFrame, voices: Sequence[str], strict: bool = True) -> DataFrame:
    """Rows of the named voices; a name that no row has is an error."""
    if strict:
        asked = rows.sparkSession.createDataFrame([(v,) for v in voices], "voice string")
        require_empty(asked.join(rows.select("voice"), "voice", "left_anti"), "voices not in the manifest")
    return rows.filter(F.col("voice").isin(*voices))


SPREAD_METRICS = (*RATES, *MEANS, "duration_s")


def unmatched_keys(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Symmetric difference of the key sets, with the side that has the key."""
    a, b = first.select(*keys).distinct(), second.select(*keys).distinct()
    return a.subtract(b).withColumn("side", F.lit("first")).unionByName(b.subtract(a).withColumn("side", F.lit("second")))


def seed_spread(first: DataFrame, second: DataFrame, strict: bool = True) -> DataFrame:
    """Per voice and metric: both seeds' values, their difference, and the mean absolute difference per sentence."""
    keys = [*GROUP, "idx"]
    if strict:
        require_empty(unmatched_keys(first, second, keys), "seed renders cover different sentences")
    a, b = first.alias("a"), second.alias("b")
    condition = None
    for k in keys:
        test = _col(k, "a") == _col(k, "b")
        condition = test if condition is None else condition & test
    pairs = a.join(b, condition)
    aggregates = [F.count(F.lit(1)).alias("n")]
    for m in SPREAD_METRICS:
        value = {s: pooled_rate(m, s) if m in RATES else F.avg(_col(m, s)) for s in "ab"}
        row = {s: row_rate(m, s) if m in RATES else _col(m, s) for s in "ab"}
        aggregates.append(F.struct(
            F.lit(m).alias("metric"), value["a"].cast("double").alias("seed_a"), value["b"].cast("double").alias("seed_b"),
            F.avg(F.abs(row["a"] - row["b"])).cast("double").alias("mean_abs_sentence_diff")).alias(f"_{m}"))
    lines = pairs.groupBy(*[_col(k, "a").alias(k) for k in GROUP]).agg(*aggregates).select(
        *GROUP, "n", F.inline(F.array(*[F.col(f"_{m}") for m in SPREAD_METRICS])))
    return lines.filter(F.col("seed_a").isNotNull() & F.col("seed_b").isNotNull()).withColumn(
        "abs_diff", F.abs(F.col("seed_a") - F.col("seed_b")))


def compare_systems(student: DataFrame, teacher: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and median per metric of the student, and of the teacher on the same (voice, speaker) rows."""
    wide = student.select("voice", "speaker", *[F.col(m).alias(f"s_{m}") for m in metrics]).join(
        teacher.select("voice", "speaker", *[F.col(m).alias(f"t_{m}") for m in metrics]), ["voice", "speaker"], "left")
    long = wide.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{p}_{m}").cast("double").alias("value"), F.lit(who).alias("system"))
        for m in metrics for p, who in (("s", "student"), ("t", "teacher"))])))
    means = long.groupBy("metric", "system").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    medians = exact_quantiles(long, ["metric", "system"], "value", {"median": 0.5})
    return means.join(medians, ["metric", "system"], "left")


def share_at_least(rows: DataFrame, metric: str, limit: float) -> DataFrame:
    """Share of rows at or over a limit, a missing value counting as zero."""
    over = F.coalesce(F.col(metric), F.lit(0.0)) >= limit
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(over.cast("double")).alias("share"))


def extremes_by(rows: DataFrame, metric: str, lowest: int, highest: int, tie: Sequence[str]) -> DataFrame:
    """The lowest and highest rows by a metric (missing counts as zero), with their place."""
    valued = rows.withColumn("_value", F.coalesce(F.col(metric), F.lit(0.0)))
    spread = F.concat_ws("|", *tie)
    low = top_rows(valued, [], [F.col("_value"), *[F.col(t) for t in tie]], lowest, spread, rank="place")
    high = top_rows(valued, [], [F.desc("_value"), *[F.desc(t) for t in tie]], highest, spread, rank="place")
    return low.withColumn("end", F.lit("lowest")).unionByName(high.withColumn("end", F.lit("highest"))).drop("_value")
