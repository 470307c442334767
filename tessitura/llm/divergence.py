"""Source divergence audit: how far the term shares of every two sources of a language lie apart, and what sets a source off.

Pairs are computed in a cube of cells (group block, group block, term block): a slice of counts (one group block, one term block) is
copied to the cells of its row and column of blocks, each cell computes the partial divergences of its pairs over its terms, and the
partial sums are reduced along the term axis. Terms that no group of a cell has differ only by the groups' sizes; they are added in
one product after the reduction. All numbers are integers; languages may hold up to 9 * 10^15 counted words.

Null text, lang and source are ''. Repeated rows are documents of their own. A group without kept terms is compared like any other; a
language without kept terms has divergence 0 everywhere and no term rows. No rows: no output.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import written
from .common import flushed, need, small_batches

#: Least documents of a kept term; groups and terms of a block (a cell holds 2 * GROUPS * TERMS counts at most, on average).
MIN_DOCS, GROUPS, TERMS, TOP = 10, 32, 4096, 10
UNIT = 1_000_000_000
#: Entries and bytes of terms that a task counts before it hands them on.
HELD, HELD_BYTES = 200_000, 16 << 20
#: Byte translation: A-Z to lower case, all bytes but letters and non-ASCII to a blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
_PARTIAL = "lang string, a string, b string, part bigint, terms bigint, size_a bigint, size_b bigint, vocabulary bigint"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = defaultdict(dict)
        entries = size = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (x.as_py() for x in b.column(2))):
                group, own = held[lang, source], {}
                for w in text.translate(_LETTERS).split():
                    own[w] = own.get(w, 0) + 1
                for w, n in own.items():
                    entry = group.get(w)
                    if entry is None:
                        group[w] = [n, 1]
                        entries, size = entries + 1, size + len(w)
                    else:
                        entry[0] += n
                        entry[1] += 1
                if entries > HELD or size > HELD_BYTES:
                    yield from ((*k, w, *e) for k, g in held.items() for w, e in g.items())
                    held.clear()
                    entries = size = 0
        yield from ((*k, w, *e) for k, g in held.items() for w, e in g.items())

    yield from flushed(_COUNTED, rows())


def share(n: Column, size: Column) -> Column:
    """1 + floor(10^9 * (n + 2) / size) in three steps of 10^3, so that no product leaves 64 bits."""
    rest, value = n + 2, F.lit(1).cast("bigint")
    for unit in (UNIT // 10**3, UNIT // 10**6, 1):
        value = value + F.call_function("div", rest * 1000, size) * unit
        rest = (rest * 1000) % size
    return value


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shares(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``share`` of a matrix of counts, a row per group."""
    rest, value = n + 2, np.ones_like(n)
    for unit in (10**6, 10**3, 1):
        step, rest = np.divmod(rest * 1000, size)
        value += step * unit
    return value


def _cell(key, rows):
    """Partial divergences of the pairs of one cell over the terms that any of its groups has."""
    import pandas as pd

    lang, first, second, _ = key
    heads = rows[rows["term"].isna()].sort_values("source", kind="stable")
    index = {s: k for k, s in enumerate(heads["source"])}
    sizes, vocabulary = heads["size"].to_numpy(np.int64), int(heads["vocabulary"].iloc[0])
    body = rows[rows["term"].notna()]
    codes, terms = pd.factorize(body["term"])
    counts = np.zeros((len(index), len(terms)), np.int64)
    counts[body["source"].map(index).to_numpy(np.int64), codes] = body["n"].to_numpy(np.int64)
    p = _shares(counts, (sizes + 2 * vocabulary)[:, None]) if len(terms) else counts
    names, block = list(index), heads["block"].to_numpy()
    out = []
    for k in np.flatnonzero(block == first):
        others = np.flatnonzero(block == second)
        others = others[others > k] if first == second else others
        if len(others):
            gap = p[others] - p[k]
            parts = (gap * gap // (p[others] + p[k])).sum(axis=1) if len(terms) else np.zeros(len(others), np.int64)
            out += [(lang, names[k], names[o], int(v), len(terms), int(sizes[k]), int(sizes[o]), vocabulary) for o, v in zip(others, parts)]
    return pd.DataFrame(out, columns=["lang", "a", "b", "part", "terms", "size_a", "size_b", "vocabulary"])


def pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two groups of a language. ``counts``: lang, source, term, n of kept terms; ``groups``:
    lang, source, size, vocabulary, and the block, blocks and term_blocks of ``placed``."""
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: F.struct(
        F.least("block", c).alias("first"), F.greatest("block", c).alias("second"))))
    heads = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1))).select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("n"), "size", "vocabulary", "block", "blocks", "slice")
    body = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "size", "vocabulary", "block", "blocks", F.pmod(F.xxhash64("term"), F.col("term_blocks")).alias("slice"))
    dealt = heads.union(body).withColumn("cell", cells).select(
        "lang", F.col("cell.first").alias("first"), F.col("cell.second").alias("second"), "slice", "source", "term", "n", "size", "vocabulary", "block")
    partial = dealt.groupBy("lang", "first", "second", "slice").applyInPandas(_cell, T.StructType.fromDDL(_PARTIAL))
    sums = partial.groupBy("lang", "a", "b", "size_a", "size_b", "vocabulary").agg(F.sum("part").alias("part"), F.sum("terms").alias("terms"))
    none = F.lit(0).cast("bigint")
    empty = apart(share(none, F.col("size_a") + 2 * F.col("vocabulary")), share(none, F.col("size_b") + 2 * F.col("vocabulary")))
    value = F.when(F.col("vocabulary") > 0, F.col("part") + (F.col("vocabulary") - F.col("terms")) * empty).otherwise(none)
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", both.alias("x"), value.alias("value")).select("lang", "x.source", "x.item", "value")


def distinctive(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each group's terms of a larger share than in the language. ``counts`` also has ``total``."""
    p = share(F.col("n"), F.col("size") + 2 * F.col("vocabulary"))
    q = share(F.col("total"), F.col("all_size") + 2 * F.col("vocabulary"))
    rows = counts.filter("n > 0").join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    return rows.filter("p > q").select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, groups_of: int = GROUPS, terms_of: int = TERMS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank: see the module's head."""
    need(docs, "text", "lang", "source")
    small_batches(docs)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    texts = docs.select(*named, F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    raw = texts.mapInArrow(_counted, T.StructType.fromDDL("lang string, source string, term binary, n bigint, docs bigint"))
    every = written(raw.withColumn("term", F.col("term").cast("string")).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = every.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).filter(F.col("docs") >= min_docs)
    counts = written(every.drop("docs").join(kept.drop("docs"), ["lang", "term"]), "kept-counts")
    vocabulary = counts.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("vocabulary"), F.sum("total").alias("all_size"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = docs.select(*named).distinct()
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    whole = lambda n, of: F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col(n) / of))
    placed = written(groups.join(sources, "lang").join(vocabulary, "lang", "left").join(sizes, ["lang", "source"], "left").fillna(
        0, ["vocabulary", "all_size", "size"]).withColumn("blocks", whole("sources", groups_of)).withColumn(
        "term_blocks", whole("vocabulary", terms_of)).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))), "groups")
    return _ranked(pairs(counts.drop("total"), placed), "pair").unionByName(_ranked(distinctive(counts, placed), "term").filter(F.col("rank") <= top))
