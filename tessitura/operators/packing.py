"""Packing items into size-limited shards, and the reports of a finished build."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.hashing import hash_bucket, hex_hash
from ..functions.numbers import round_exact
from ..session import written
from .ordering import grouped_scan

#: Shards of a block and blocks of a joined one; items that count like a full shard towards a block's end.
SPAN, BLOCK_ITEMS = 64, 1000


def _hops(begin: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    """Per item, the item that starts the next shard if this one starts one: the first whose end is over begin + limit, at
    least one further on. ``len(end)`` stands for none."""
    return np.maximum(np.searchsorted(end, begin + limit, side="right"), np.arange(len(end)) + 1)


def _exits(limit: int):
    """Per block: where a shard that starts at each possible entry leads out of it."""
    def of_block(key, rows):
        import pandas as pd

        rows = rows.sort_values("_rank")
        begin, end = rows["_begin"].to_numpy(np.int64), rows["_end"].to_numpy(np.int64)
        hop, last, starts = _hops(begin, end, limit), np.arange(len(end)), np.ones(len(end), np.int64)
        while (live := hop < len(end)).any():
            to = hop[live]
            last[live], starts[live], hop[live] = last[to], starts[live] + starts[to], hop[to]
        entry = begin < begin[0] + limit
        return pd.DataFrame({"_node": key[0], "_begin": begin[entry], "_end": end[entry], "_out": (begin[last] + limit)[entry], "_starts": starts[entry]})
    return of_block


def _children(rows):
    """The sub-tables of a parent's children, in order."""
    for node, part in sorted(rows.groupby("_node"), key=lambda x: x[0]):
        part = part.sort_values(["_begin", "_end"], kind="stable")
        yield int(node), *(part[c].to_numpy(np.int64) for c in ("_begin", "_end", "_out", "_starts"))


def _joined_exits(limit: int):
    """Per parent: the exits of its possible entries, through all its children."""
    def of_parent(key, rows):
        import pandas as pd

        children = list(_children(rows))
        first, out = min(c[1][0] for c in children), []
        for k, (_, begin, end, leads, starts) in enumerate(children):
            entry = begin < first + limit
            t, n = leads[entry].copy(), starts[entry].copy()
            for _, _, later, onward, more in children[k + 1:] if entry.any() else ():
                at = np.searchsorted(later, t, side="right")
                met = at < len(later)
                t[met], n[met] = onward[at[met]], n[met] + more[at[met]]
            out.append(pd.DataFrame({"_node": key[0], "_begin": begin[entry], "_end": end[entry], "_out": t, "_starts": n}))
        return pd.concat(out, ignore_index=True)
    return of_parent


def _walk(key, above, rows):
    """Follows the one true entry of a parent through its children: what each child is entered with."""
    import pandas as pd

    out = []
    if len(above) and len(rows):
        t, shards = int(above["_t"].iloc[0]), int(above["_shards"].iloc[0])
        for node, _, end, leads, starts in _children(rows):
            out.append((node, t, shards))
            at = int(np.searchsorted(end, t, side="right"))
            if at < len(end):
                t, shards = int(leads[at]), shards + int(starts[at])
    return pd.DataFrame(out, columns=["_node", "_t", "_shards"])


def _numbered(limit: int, item_id: str):
    """Numbers the shards of a block from its true entry."""
    def of_block(key, rows, above):
        rows = rows.sort_values("_rank")
        begin, end = rows["_begin"].to_numpy(np.int64), rows["_end"].to_numpy(np.int64)
        hop, starts = _hops(begin, end, limit), np.zeros(len(end), np.int64)
        at = int(np.searchsorted(end, int(above["_t"].iloc[0]), side="right"))
        while at < len(end):
            starts[at] = 1
            at = int(hop[at])
        return rows.assign(shard=int(above["_shards"].iloc[0]) + np.cumsum(starts) - 1, shard_order=rows["_rank"] - 1)[[item_id, "shard", "shard_order"]]
    return of_block


def assign_shards(items: DataFrame, item_id: str, size: str, limit: int, seed: int, span: int = SPAN, fanout: int = SPAN) -> DataFrame:
    """Adds the 0-based ``shard``: consecutive cuts of at most ``limit`` bytes of the hash order (next fit), and the 0-based
    place ``shard_order`` in that order. A larger item gets a shard of its own.

    The order is cut into blocks of about ``span`` shards (and at most ``span`` * ``BLOCK_ITEMS`` items). Where the next shard
    starts depends only on the byte at which the one before is full, so a block is summed up by the exits of the entries that
    lie within one shard of its beginning: about 1 / ``span`` of the items. ``fanout`` blocks at a time are joined into larger
    ones until one is left; then the true entries are handed down, and every block numbers its items. Items are shuffled a fixed
    number of times; only the tables of entries are worked on per level.
    """
    ordered = grouped_scan(
        items.select(item_id, F.col(size).cast("bigint").alias("_size")).withColumn("_digest", hex_hash(seed, F.col(item_id))),
        [], [F.col("_digest"), F.col(item_id)], hash_bucket(F.col("_digest")), rank="_rank", sums={"_end": F.col("_size")})
    place = F.col("_end") - F.col("_size") + (F.col("_rank") - 1) * max(1, -(-limit // BLOCK_ITEMS))
    ordered = written(ordered.select(item_id, "_rank", (F.col("_end") - F.col("_size")).alias("_begin"), "_end",
                                     F.floor(place / F.lit(span * limit)).cast("bigint").alias("_node")), "packing-order")
    entries = "_node bigint, _begin bigint, _end bigint, _out bigint, _starts bigint"
    levels = [written(ordered.groupBy("_node").applyInPandas(_exits(limit), entries), "exits")]
    parent = F.floor(F.col("_node") / fanout).cast("bigint")
    while (levels[-1].agg(F.max("_node")).first()[0] or 0) >= fanout:
        levels.append(written(levels[-1].groupBy(parent.alias("_parent")).applyInPandas(_joined_exits(limit), entries), "exits"))
    # One row above all: the first item starts shard 0.
    entered = items.sparkSession.createDataFrame([(0, -1, 0)], "_node bigint, _t bigint, _shards bigint")
    for level in reversed(levels):
        entered = entered.groupBy("_node").cogroup(level.groupBy(parent.alias("_parent"))).applyInPandas(_walk, "_node bigint, _t bigint, _shards bigint")
    numbered = ordered.groupBy("_node").cogroup(entered.groupBy("_node")).applyInPandas(
        _numbered(limit, item_id), T.StructType([ordered.schema[item_id], *T.StructType.fromDDL("shard bigint, shard_order bigint").fields]))
    return items.join(numbered, item_id)


def teacher_reports(stats: DataFrame, flag_fraction: float, reasons: Sequence[str] = ("duration_outlier", "internal_silence")) -> DataFrame:
    """Per teacher: rendered, kept, hours, drops per reason, unaligned, and whether too many were dropped."""
    rendered, kept = F.sum("rendered"), F.sum("kept")
    dropped = [F.sum(F.coalesce(F.try_element_at("dropped", F.lit(r)), F.lit(0))).cast("bigint").alias(r) for r in reasons]
    return stats.groupBy("teacher").agg(
        rendered.alias("rendered"), kept.alias("kept"), (F.sum("kept_seconds") / 3600).alias("kept_hours"), *dropped,
        F.sum("unaligned").alias("unaligned"),
        F.coalesce((rendered > 0) & ((rendered - kept) / F.nullif(rendered, F.lit(0)) > flag_fraction), F.lit(False)).alias("flagged"))


def speaker_reports(stats: DataFrame) -> DataFrame:
    return stats.groupBy("language", "speaker").agg(
        F.sum("kept").alias("kept"), (F.sum("kept_seconds") / 3600).alias("kept_hours"))


def generation_summary(results: DataFrame, keys: Sequence[str], wall: Column) -> DataFrame:
    """Utterances, audio seconds, audio seconds per wall second and mean length."""
    audio = F.sum("audio_seconds")
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("utterances"), round_exact(audio, 1).alias("audio_seconds"), round_exact(audio / 3600, 3).alias("audio_hours"),
        round_exact(audio / wall, 2).alias("audio_sec_per_wall_sec"), round_exact(F.avg("audio_seconds"), 2).alias("mean_utt_seconds"))
