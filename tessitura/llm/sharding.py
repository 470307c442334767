"""Extendible hashing into shards of bounded size."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .common import need, replacing

#: Bits of the key hash in use, and bits examined per round (a round has at most 2**STEP cells per oversized bucket).
BITS, STEP = 60, 15


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5; null hashes as the text ``null``."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, BITS // 4), 16, 10).cast("bigint")


def _leaves(cells: DataFrame, low: int, limit: int) -> DataFrame:
    """For cells (cell, n_bytes) of ``low + STEP`` bits the shortest prefix whose bucket fits; depth null if none does."""
    high = low + STEP
    depths = F.sequence(F.lit(0 if low == 0 else low + 1), F.lit(high))
    spread = cells.select("cell", "n_bytes", F.explode(depths).alias("depth")).withColumn(
        "prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    buckets = spread.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("bucket_bytes")).filter(F.col("bucket_bytes") <= limit)
    fits = spread.drop("n_bytes").join(buckets, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.join(fits, "cell", "left").select("cell", "depth")


def shard(df: DataFrame, key: str, size: Column, limit: int = 128 << 20) -> DataFrame:
    """Adds ``n_bytes``, ``shard`` and ``depth``: the bucket of an extendible hash directory over the key's hash bits.

    A bucket over ``limit`` bytes splits on its next bit, others do not, so a shard is named by the shortest hash prefix
    whose rows fit (``-`` for the empty prefix). Sizes are aggregated per cell of 15 bits before any decision; further
    bits are read only inside cells that are still too large. Rows of one hash that exceed the limit by themselves get
    numbered overflow pages by size class, each within the limit; a row larger than the limit has a page of its own.
    Null sizes count as 0, null keys as one key; all rows are kept. Columns of the added names are replaced.
    """
    need(df, key)
    sized = df.withColumn("_size", F.coalesce(size, F.lit(0)).cast("bigint"))
    df = replacing(df, "n_bytes", "shard", "depth", "_h")
    rows = sized.select(*df.columns, F.col("_size").alias("n_bytes"), key_hash(F.col(key)).alias("_h"))
    sizes = written(rows.select("_h", "n_bytes").groupBy("_h").agg(F.sum("n_bytes").alias("n_bytes")), "shard-sizes")
    directory, pending = None, None
    for low in range(0, BITS, STEP):
        high = low + STEP
        held = sizes if pending is None else sizes.join(pending, F.expr(f"shiftright(_h, {BITS - low})") == F.col("parent"), "left_semi")
        cells = held.groupBy(F.expr(f"shiftright(_h, {BITS - high})").alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"))
        leaves = written(_leaves(cells, low, limit), "shard-leaves")
        done = leaves.filter("depth IS NOT NULL").select(F.lit(high).alias("bits"), "cell", "depth")
        directory = done if directory is None else directory.unionByName(done)
        pending = leaves.filter("depth IS NULL").select(F.col("cell").alias("parent"))
        if pending.isEmpty():
            pending = None
            break
    # The directory as (cell at its round's bits) rows; a row meets exactly one of them.
    rounds = [r["bits"] for r in directory.select("bits").distinct().collect()]
    placed = None
    for bits in sorted(rounds):
        here = directory.filter(F.col("bits") == bits).select(F.col("cell").alias("_cell"), "depth")
        part = rows.join(here, F.expr(f"shiftright(_h, {BITS - bits})") == F.col("_cell")).drop("_cell")
        placed = part if placed is None else placed.unionByName(part)
    empty = F.lit("-")
    name = F.when(F.col("depth") == 0, empty).otherwise(F.substring(F.lpad(F.conv(F.col("_h").cast("string"), 10, 2), BITS, "0"), F.lit(1), F.col("depth")))
    if placed is not None:
        placed = placed.withColumn("shard", name)
    if pending is not None:
        full = rows.join(pending, F.col("_h") == F.col("parent"), "left_semi")
        paged = _overflow(written(full.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()), "shard-overflow"), limit)
        placed = paged if placed is None else placed.unionByName(paged, allowMissingColumns=False)
    if placed is None:
        placed = rows.withColumn("depth", F.lit(0)).withColumn("shard", empty)
    return placed.select(*df.columns, "n_bytes", "shard", F.col("depth").cast("int").alias("depth"))


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Pages for rows that share all hash bits: size class k holds 2**k rows of at most limit / 2**k bytes a page.

    Ranks come from counts per (hash, class, part) and a scan inside each part, so a hot key is not one task.
    """
    share = F.greatest(F.lit(1.0), F.col("n_bytes").cast("double"))
    k = F.when(F.col("n_bytes") > limit, F.lit(0)).otherwise(F.least(F.lit(30), F.floor(F.log2(F.lit(float(limit)) / share)))).cast("int")
    rows = rows.withColumn("_k", k)
    before = Window.partitionBy("_h", "_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_h", "_k", "_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_h", "_k", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy("_h", "_k", "_part").orderBy("_seq")
    ranked = rows.withColumn("_rank", F.row_number().over(local) - 1).join(offsets, ["_h", "_k", "_part"])
    page = F.expr("shiftright(_before + _rank, _k)")
    bits = F.lpad(F.conv(F.col("_h").cast("string"), 10, 2), BITS, "0")
    return ranked.withColumn("shard", F.concat(bits, F.lit("-"), F.col("_k").cast("string"), F.lit("-"), page.cast("string"))).withColumn(
        "depth", F.lit(BITS)).drop("_k", "_part", "_seq", "_rank", "_before")
