"""Incremental forms on file streams: manifest ingest, records once by ID, throughput windows, running reports."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.oplogs import throughput_windows
from ..operators.packing import teacher_reports
from ..operators.records import Vocabulary, parse_records, validated
from ..session import work_folder


def ingest_manifests(spark: SparkSession, source: str, vocab: Vocabulary, valid: str, rejected: str, checkpoint: str,
                     available_now: bool = True, batch_bytes: int = 128 * 2**20) -> StreamingQuery:
    """Validates manifest lines as files land; accepted and rejected rows go to two folders, one sub-folder per batch.

    A batch that is replayed after a failure overwrites its own folder, so every line is written once. A batch takes files of
    ``batch_bytes`` (one at least), so what is held of it between its two writes does not grow with the backlog.
    """
    lines = spark.readStream.option("maxBytesPerTrigger", str(batch_bytes)).text(source).filter(
        F.trim("value") != "").withColumn("file", F.col("_metadata.file_path"))
    parsed = parse_records(lines, vocab)

    def save(batch: DataFrame, number: int) -> None:
        # A line goes to one folder only, so of a valid one only the fields are held, of a rejected one only the text.
        passed = F.size("problems") == 0
        held = batch.withColumns({"value": F.when(~passed, F.col("value")), **{c: F.when(passed, F.col(c)) for c in ("phoneme_ids", "durations")}}).persist()
        good, bad = validated(held)
        good.drop("value").write.mode("overwrite").parquet(f"{valid}/batch={number}", compression="zstd")
        bad.select("file", "value", "problems").write.mode("overwrite").parquet(f"{rejected}/batch={number}", compression="zstd")
        held.unpersist(blocking=True)

    writer = parsed.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def once_by_id(stream: DataFrame, key: str, time: str, watermark: str) -> DataFrame:
    """First arrival of every ID; state is kept only as long as the watermark."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])


def running_teacher_report(stats: DataFrame, flag_fraction: float) -> DataFrame:
    """Drop share and flag per teacher, updated as job statistics arrive."""
    return teacher_reports(stats, flag_fraction)


def throughput(stream: DataFrame, every: str, watermark: str) -> DataFrame:
    return throughput_windows(stream, every, watermark)


class StepWindows(StatefulProcessor):
    """Per run the steps since its last full window: a window of ``every`` steps is reported and a new one begun."""

    FIELDS = "began double, steps bigint, samples double, wait double, excluded double"

    def __init__(self, every: int, run: str):
        self.every, self.run = every, run

    def init(self, handle) -> None:
        self.open = handle.getValueState("open", self.FIELDS)

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        steps = pd.concat(rows, ignore_index=True).sort_values(["t_end", "step"], kind="stable")
        ends, begins = steps["t_end"].to_numpy(float), steps["t_begin"].to_numpy(float)
        began, held, *sums = self.open.get() if self.open.exists() else (float(begins[0]), 0, 0.0, 0.0, 0.0)
        parts = [steps[c].to_numpy(float) for c in ("samples", "wait", "excluded")]
        cuts = np.arange(self.every - held, len(ends) + 1, self.every)
        out, start = [], 0
        for stop in cuts:
            count = [s + p[start:stop].sum() for s, p in zip(sums, parts)]
            out.append((key[0], began, float(ends[stop - 1]), self.every, *count))
            began, held, sums, start = float(ends[stop - 1]), 0, [0.0, 0.0, 0.0], stop
        left = [float(s + p[start:].sum()) for s, p in zip(sums, parts)]
        self.open.update((began, int(held + len(ends) - start), *left))
        yield pd.DataFrame(out, columns=[self.run, "window_start", "window_end", "steps", "samples", "wait", "excluded"])

    def close(self) -> None:
        pass


#: Settings of a stream with a stateful processor: its state is kept on disk, and a commit writes what changed.
ON_DISK = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
           "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def step_windows(stream: DataFrame, run: str, every: int) -> DataFrame:
    """Throughput of every ``every`` steps of a run, on a stream: run, window_start, window_end, steps, steps_per_s,
    samples_per_s, data_wait_share. Start it with ``run_available(..., state=ON_DISK)`` or with these settings.

    Rows are ``run``, ``step``, ``t_begin``, ``t_end`` and the sums samples, wait and excluded. A window reaches from the end
    of the one before (the run's first begin) to the end of its last step; a rest of fewer steps waits for more. Steps of a
    run arrive in order from one micro-batch to the next, in any order inside one.
    """
    fields = stream.select(F.col(run).alias(run), "step", *[F.col(c).cast("double").alias(c) for c in ("t_begin", "t_end", "samples", "wait", "excluded")])
    out = T.StructType([stream.schema[run], *T.StructType.fromDDL(
        "window_start double, window_end double, steps bigint, samples double, wait double, excluded double").fields])
    windows = fields.groupBy(run).transformWithStateInPandas(StepWindows(every, run), out, "append", "none")
    seconds = F.col("window_end") - F.col("window_start") - F.col("excluded")
    return windows.select(run, "window_start", "window_end", "steps", *[
        F.try_divide(F.col(c), seconds).alias(n) for c, n in (("steps", "steps_per_s"), ("samples", "samples_per_s"), ("wait", "data_wait_share"))])


def run_available(stream: DataFrame, name: str, mode: str, state: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns what it wrote (append: all batches, complete: the last).

    ``state`` are settings that hold for this stream alone.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in state or {}}
    folder = work_folder(spark, name)

    def save(batch: DataFrame, number: int) -> None:
        target = f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    writer = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    try:
        for k, v in (state or {}).items():
            spark.conf.set(k, v)
        started = writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    started.awaitTermination()
    written = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    return written.drop("batch") if "batch" not in stream.columns else written
