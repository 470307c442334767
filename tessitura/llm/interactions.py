"""Filter interaction audit: what each of five filters removes, alone and after the others, in every order.

All files are processed as available-now micro-batches. A text's state is the smallest id seen so far; when a smaller id arrives, the
mask that was counted for the earlier one (first of its text) is taken back from its part's counter and counted again as a copy. The
stream writes signed counts only, so the sum of what it wrote is the audit after any number of batches, in any order of files.

Texts are told apart by a 128-bit digest. Texts of state are kept in buckets, as many as rows / ``PER_BUCKET``, so that a state value
has a bounded expected size at any input; the state store is the session's (a corpus of many terabytes wants the one that keeps
state on disk). Before the shuffle a task keeps only its own smallest id of each text (a larger one is a copy whatever follows), so a
text that a third of all rows share reaches its bucket once per task.

A null text is empty, a null source the part ''. A null id is neither smaller nor larger than another: such a row is never a copy and
makes none. Rows of equal id and text are no copies of each other; a repeated id in ``labels`` counts as good (toxic) if any row says so.
No rows: no output.
"""
from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..session import work_folder
from .common import batches_of, flushed, small_batches

#: The filters in order of their bits.
FILTERS = "ABCDE"
COPY = 16
BATCHES, PER_BUCKET, HELD_TEXTS = 4, 256, 200_000

_CAPITALS, _SYMBOLS = bytes(range(0x41, 0x5B)), b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))
_MASKED = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("mask", pa.int32())])
_OPEN = pa.schema([("bucket", pa.int64()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("mask", pa.int32()), ("part", pa.string()),
                   ("good", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())])
_HELD = pa.schema(list(_OPEN)[1:])
_ROW = "digest binary, doc_id bigint, mask int, part string, good int, toxic int, n bigint"
_DELTA = "part string, mask int, good int, toxic int, delta bigint, retracted bigint"


def mask_of(text: bytes) -> int:
    """Bits of the filters A to D that a whole text fails."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUED))
    return ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 2 * points) << 2
            | (len(text.translate(None, _SYMBOLS)) < len(text)) << 3)


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, s, blake2b(t, digest_size=16).digest(), mask_of(t))
                for i, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (x.as_py() for x in b.column(2)))]
        yield batches_of(_MASKED, rows)


def _combined(buckets: int):
    """Per task: a text's smallest id stays open for the state; whatever else is settled is counted."""
    def rows_of(batches) -> Iterator[tuple]:
        held: dict[bytes, tuple[int, int, dict]] = {}
        settled: dict[tuple, int] = defaultdict(int)

        def close() -> Iterator[tuple]:
            for digest, (i, mask, who) in held.items():
                for (part, good, toxic), n in who.items():
                    yield int.from_bytes(digest[:8], "big") % buckets, digest, i, mask, part, good, toxic, n
            for k, (key, n) in enumerate(settled.items()):
                part, mask, good, toxic = key
                yield k % buckets, None, None, mask, part, good, toxic, n
            held.clear()
            settled.clear()

        for b in batches:
            for i, part, digest, mask, good, toxic in zip(*(c.to_pylist() for c in b.columns)):
                if i is None:
                    settled[part, mask, good, toxic] += 1
                    continue
                now = held.get(digest)
                if now is None or i < now[0]:
                    if now is not None:
                        for (p, g, x), n in now[2].items():
                            settled[p, mask | COPY, g, x] += n
                    held[digest] = (i, mask, {(part, good, toxic): 1})
                elif i == now[0]:
                    now[2][part, good, toxic] = now[2].get((part, good, toxic), 0) + 1
                else:
                    settled[part, mask | COPY, good, toxic] += 1
            if len(held) > HELD_TEXTS:
                yield from close()
        yield from close()

    return lambda batches: flushed(_OPEN, rows_of(batches))


def _stored(rows: list[tuple]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _HELD) as out:
        out.write_batch(batches_of(_HELD, rows))
    return sink.getvalue().to_pybytes()


def _smallest_ids(key, frames, state):
    """A bucket's state holds the rows of smallest id of each of its texts, as one Arrow stream."""
    import pandas as pd

    counts: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    fresh: list[tuple] = []
    for frame in frames:
        for row in zip(*(frame[c] for c in _HELD.names)):
            digest, i, mask, part, good, toxic, n = row
            if digest is None:
                counts[part, int(mask), int(good), int(toxic)][0] += int(n)
            else:
                fresh.append((bytes(digest), int(i), int(mask), part, int(good), int(toxic), int(n)))
    if fresh:
        held: dict[bytes, list[tuple]] = defaultdict(list)
        if state.exists:
            for batch in pa.ipc.open_stream(bytes(state.get[0])):
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    held[row[0]].append(row)
        _update(held, fresh, counts)
        state.update((_stored([r for rows in held.values() for r in rows]),))
    out = [(*k, d, r) for k, (d, r) in counts.items() if d or r]
    yield pd.DataFrame(out, columns=["part", "mask", "good", "toxic", "delta", "retracted"])


def _update(held: dict[bytes, list[tuple]], fresh: list[tuple], counts) -> None:
    """Takes new rows into the state: a smaller id takes back what was counted for the earlier one."""
    for row in fresh:
        digest, i, mask, part, good, toxic, n = row
        old = held[digest]
        if old and old[0][1] < i:
            counts[part, mask | COPY, good, toxic][0] += n
            continue
        if old and old[0][1] > i:
            for _, _, _, p, g, x, m in old:
                counts[p, mask, g, x][0] -= m
                counts[p, mask, g, x][1] += m
                counts[p, mask | COPY, g, x][0] += m
            old.clear()
        old.append(row)
        counts[part, mask, good, toxic][0] += n


def _exact(path: str) -> str:
    """A path as a pattern that only it matches: a stream takes a single file no other way."""
    head, _, name = path.rstrip("/").rpartition("/")
    return f"{head}/{{{name}}}"


def audit_stream(spark: SparkSession, documents: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Runs the stream over all files at ``documents`` (in about ``batches`` micro-batches of files) and returns the signed counts
    that it wrote: part, mask, good, toxic, delta, retracted."""
    whole = spark.read.parquet(documents)
    small_batches(whole)
    files, rows = len(whole.inputFiles()), whole.count()
    buckets = max(1, -(-rows // PER_BUCKET))
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    docs = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(_exact(documents))
    masked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                         F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(_masked, T.StructType.fromDDL(
                             "doc_id bigint, part string, digest binary, mask int"))
    # Null ids have no label; the second key keeps them from meeting in one task.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part")).otherwise(F.lit(0))
    judged = masked.withColumn("_s", spread).join(known.withColumn("_s", F.lit(0).cast("bigint")), ["doc_id", "_s"], "left").select(
        "doc_id", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    combined = judged.mapInArrow(_combined(buckets), T.StructType.fromDDL("bucket bigint, " + _ROW))
    deltas = combined.groupBy("bucket").applyInPandasWithState(
        _smallest_ids, T.StructType.fromDDL(_DELTA), T.StructType.fromDDL("texts binary"), "append", GroupStateTimeout.NoTimeout)
    out = work_folder(spark, "audit")
    deltas.writeStream.format("parquet").outputMode("append").option("path", out).option(
        "checkpointLocation", work_folder(spark, "audit-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType.fromDDL(_DELTA)).parquet(out)


def audit(deltas: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from signed counts: see ``orders``."""
    n, weight = F.sum("delta"), lambda c: F.sum(F.col("delta") * F.col(c))
    cells = deltas.groupBy("part", "mask").agg(n.alias("n"), weight("good").alias("g"), weight("toxic").alias("x"))
    return orders(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "g", "x")).alias("cells")))


def orders(parts: DataFrame) -> DataFrame:
    """All orders over parts of at most 32 counted masks each."""
    every = F.explode(F.array(*[F.lit("".join(o)) for o in itertools.permutations(FILTERS)]))
    rows = parts.withColumn("filter_order", every).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda letters: sum((F.when(letters.contains(f), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumn("bit", bits(F.substr("filter_order", F.col("step"), F.lit(1)))).withColumn(
        "before", bits(F.substr("filter_order", F.lit(1), F.col("step") - 1)))

    def total(which, value) -> Column:
        chosen = F.filter("cells", lambda c: which(c["mask"]))
        return F.aggregate(chosen, F.lit(0).cast("bigint"), lambda a, c: a + value(c))

    own, earlier = (lambda m: m.bitwiseAND(F.col("bit")) != 0), (lambda m: m.bitwiseAND(F.col("before")) != 0)
    here = lambda m: own(m) & ~earlier(m)
    orders_first = lambda c: (F.lit(120) / F.bit_count(c["mask"])).cast("bigint") * c["n"]
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total(lambda m: ~own(m) & ~earlier(m), lambda c: c["n"]).alias("kept"), total(here, lambda c: c["n"]).alias("removed"),
        total(lambda m: own(m) & earlier(m), lambda c: c["n"]).alias("redundant"),
        total(lambda m: m == F.col("bit"), lambda c: c["n"]).alias("unique_fails"), total(here, lambda c: c["g"]).alias("good_lost"),
        total(here, lambda c: c["x"]).alias("toxic_lost"), total(own, orders_first).alias("shapley"))
