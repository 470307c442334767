"""From valid records to the tables a training run reads: IDs, validation split, sampling plan, epoch batches."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.ids import build_id_maps, require_known
from ..operators.records import within_length
from ..operators.sampling import EpochOptions, language_report, plan_epoch
from ..operators.selection import split_by_hash


@dataclass(frozen=True)
class ViewOptions:
    sample_rate: int
    hop: int
    min_seconds: float
    max_seconds: float
    validation_items: int
    epoch: EpochOptions


def prepare(records: DataFrame, options: ViewOptions, previous: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """``records`` (record fields, ``num_samples``, ``position``) -> items, split, ID maps and the language report."""
    timed = records.withColumn("seconds", F.col("num_samples") / options.sample_rate)
    items = within_length(timed, options.min_seconds, options.max_seconds, options.hop)
    ids = build_id_maps(items, previous)
    sampled = items.select("id", F.col("language").alias("lang"), "weight", "seconds", F.size("phoneme_ids").alias("length"))
    report = language_report(sampled, ids["pairs"].select(F.col("language").alias("lang"), "speaker"))
    split = split_by_hash(sampled, "id", options.validation_items)
    return {"items": items, "split": split, "report": report, **ids}


def epoch_batches(prepared: dict[str, DataFrame], options: ViewOptions, known_pairs: DataFrame | None = None) -> DataFrame:
    """Batches of one epoch over the training part; records outside the run's ID map are refused."""
    if known_pairs is not None:
        require_known(prepared["items"], known_pairs)
    return plan_epoch(prepared["split"].filter("split = 'train'"), options.epoch).withColumn("epoch", F.lit(options.epoch.epoch))


def write_epoch(batches: DataFrame, path: str) -> None:
    """One folder per epoch and rank, so a worker reads only its own batches."""
    batches.repartition("epoch", "rank", F.pmod("step", F.lit(16))).sortWithinPartitions("step", "slot", "j").write.mode(
        "errorifexists").partitionBy("epoch", "rank").parquet(path)
