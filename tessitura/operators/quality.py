"""Quality of rendered items: duration outliers, silences, drop reasons, voice metrics and flags, references."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A
from .checks import require_empty
from .ordering import exact_quantiles, top_rows


def symbol_durations(timings: DataFrame, judged: Sequence[int] | DataFrame, keys: Sequence[str] = ("teacher",)) -> DataFrame:
    """One row per judged symbol of the padded sequence with log(1 + frames) in ``x``."""
    zipped = timings.select("id", *keys, F.size("ids").alias("_n"), F.posexplode(F.arrays_zip("ids", "durations")).alias("_pos", "_z"))
    inner = zipped.filter((F.col("_pos") >= 2) & (F.col("_pos") % 2 == 0) & (F.col("_pos") < F.col("_n") - 1)).select(
        "id", *keys, F.col("_z.ids").alias("symbol"), F.log1p(F.col("_z.durations").cast("double")).alias("x"))
    if isinstance(judged, DataFrame):
        return inner.join(judged.select("symbol"), "symbol", "left_semi")
    return inner.filter(F.col("symbol").isin(*judged))


def duration_outliers(timings: DataFrame, judged, z_max: float, min_count: int, keys: Sequence[str] = ("teacher",)) -> DataFrame:
    """(id, z): renders that hold some symbol more than ``z_max`` deviations above its mean over one teacher."""
    long = symbol_durations(timings, judged, keys)
    stats = long.groupBy(*keys, "symbol").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("x").alias("_mean"), F.stddev_pop("x").alias("_sd"), F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    usable = stats.filter((F.col("_n") >= min_count) & (F.col("_lo") < F.col("_hi")) & (F.col("_sd") > 0))
    z = long.join(usable, [*keys, "symbol"]).groupBy("id").agg(F.max((F.col("x") - F.col("_mean")) / F.col("_sd")).alias("z"))
    return z.filter(F.col("z") > z_max)


def drop_reasons(items: DataFrame, outliers: DataFrame, silence: Column, max_silence_s: float) -> DataFrame:
    """Dropped items with ``reason`` and measured value: a duration outlier first, else too long a silence."""
    joined = items.withColumn("_silence", silence).join(outliers.select("id", "z"), "id", "left")
    outlier = F.col("z").isNotNull()
    return joined.select(
        "id", F.when(outlier, "duration_outlier").when(F.col("_silence") > max_silence_s, "internal_silence").alias("reason"),
        F.when(outlier, F.col("z")).otherwise(F.col("_silence")).alias("value")).filter(F.col("reason").isNotNull())


def medians(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Exact median of several metrics per group, one column each."""
    long = rows.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    q = exact_quantiles(long, [*keys, "metric"], "value", {"median": 0.5})
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("median"))).alias(m) for m in metrics])


def base_language(espeak: Column) -> Column:
    return F.element_at(F.split(espeak, "-"), 1)


def voice_flags(metrics: DataFrame, quantile: float = 0.15) -> DataFrame:
    """Adds ``flags``: low rate, narrow band, noisy or monotone against the catalogue, slow or fast in its language."""
    tagged = metrics.withColumn("_lang", base_language(F.col("espeak")))
    rates = exact_quantiles(tagged, ["_lang"], "phonemes_per_s", {"_rate": 0.5})
    noise = exact_quantiles(metrics, [], "snr_db", {"_snr": quantile})
    flat = exact_quantiles(metrics, [], "f0_range_st", {"_range": quantile})
    joined = tagged.join(rates, "_lang").crossJoin(F.broadcast(noise)).crossJoin(F.broadcast(flat))
    flags = F.array_compact(F.array(
        F.when(F.col("sample_rate") < 22050, "16 kHz").when(F.col("bandwidth_khz") < 8.5, "band-limited"),
        F.when(F.col("snr_db") < F.col("_snr"), "noisy?"), F.when(F.col("f0_range_st") < F.col("_range"), "monotone?"),
        F.when(F.col("phonemes_per_s") < 0.8 * F.col("_rate"), "slow?"), F.when(F.col("phonemes_per_s") > 1.2 * F.col("_rate"), "fast?")))
    return joined.select(*[F.col(c) for c in metrics.columns], F.array_join(flags, "; ").alias("flags"))


def mean_vectors(rows: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Element-wise mean of array rows per group, summed per position (partial aggregation), as one array."""
    per_position = rows.select(*keys, F.posexplode(vector).alias("_i", "_v")).groupBy(*keys, "_i").agg(
        F.avg(F.col("_v").cast("double")).alias("_m"))
    packed = F.array_sort(F.collect_list(F.struct("_i", "_m")))
    return per_position.groupBy(*keys).agg(packed.alias("_p")).select(*keys, F.transform("_p", lambda p: p["_m"]).alias("mean"))


def reference_vectors(rows: DataFrame, keys: Sequence[str], order: Sequence[str], vector: str, wanted: int, strict: bool = True) -> DataFrame:
    """Unit-length mean of the first ``wanted`` vectors of each group; fewer is an error."""
    first = top_rows(rows, list(keys), [F.col(o) for o in order], wanted, F.concat_ws("|", *order))
    if strict:
        short = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < wanted)
        require_empty(short, f"speaker similarity needs {wanted} utterances")
    return mean_vectors(first, keys, vector).select(*keys, A.unit(F.col("mean")).alias("reference"))
