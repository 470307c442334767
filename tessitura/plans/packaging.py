"""From rendered items to shards: duration and silence outliers dropped, reports per teacher and speaker, shards written."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.packing import assign_shards, speaker_reports, teacher_reports
from ..operators.quality import drop_reasons, duration_outliers
from ..session import written
from ..sources.readers import write_reports, write_shards


@dataclass(frozen=True)
class PackagingOptions:
    """Limits of the checks (deviations, renders of a symbol, seconds of silence), bytes of a shard, and the share of drops
    at which a teacher is flagged."""

    duration_z: float
    min_symbol_count: int
    max_silence_s: float
    shard_bytes: int
    flag_fraction: float
    seed: int


def checked(items: DataFrame, judged: Sequence[int] | DataFrame, silence: Column, options: PackagingOptions) -> tuple[DataFrame, DataFrame]:
    """(kept items, dropped: id, reason, value). Items without durations are judged by their silence alone."""
    timed = items.filter(F.col("durations").isNotNull()).select("id", "teacher", F.col("phoneme_ids").alias("ids"), "durations")
    outliers = duration_outliers(timed, judged, options.duration_z, options.min_symbol_count)
    dropped = written(drop_reasons(items, outliers, silence, options.max_silence_s), "dropped")
    return items.join(dropped.select("id"), "id", "left_anti"), dropped


def job_statistics(items: DataFrame, dropped: DataFrame) -> DataFrame:
    """Per teacher, language and speaker: rendered and kept items, kept seconds, drops by reason, items without durations."""
    marked = items.select("id", "teacher", "language", "speaker", "seconds", F.col("durations").isNull().alias("_u")).join(
        dropped.select("id", "reason"), "id", "left")
    kept = F.col("reason").isNull()
    per_reason = marked.groupBy("teacher", "language", "speaker", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(kept, F.col("seconds"))).alias("seconds"), F.count_if("_u").alias("u"))
    listed = F.collect_list(F.when(~kept, F.struct("reason", "n")))  # one entry a reason
    return per_reason.groupBy("teacher", "language", "speaker").agg(
        F.sum("n").alias("rendered"), F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("kept"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("kept_seconds"),
        F.map_from_entries(listed).alias("dropped"), F.sum("u").alias("unaligned"))


def package(items: DataFrame, judged: Sequence[int] | DataFrame, silence: Column, size: Column, options: PackagingOptions) -> dict[str, DataFrame]:
    """``items`` (record fields and ``seconds``) -> shards (kept items with ``shard``), dropped, teacher and speaker reports."""
    kept, dropped = checked(items, judged, silence, options)
    stats = written(job_statistics(items, dropped), "job-statistics")
    shards = assign_shards(kept.withColumn("_size", size.cast("bigint")), "id", "_size", options.shard_bytes, options.seed)
    return {"shards": shards.drop("_size", "shard_order"), "dropped": dropped, "teachers": teacher_reports(stats, options.flag_fraction),
            "speakers": speaker_reports(stats)}


def write_package(packed: dict[str, DataFrame], path: str) -> None:
    """``shards`` (records as JSON lines, a folder each) and ``reports`` below ``path``; existing targets are refused."""
    write_shards(packed["shards"].drop("seconds"), f"{path}/shards")
    write_reports(packed["teachers"], packed["speakers"], f"{path}/reports")
