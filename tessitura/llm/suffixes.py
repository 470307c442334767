"""Repeated passages by a sparse suffix array.

A window of 50 words that occurs twice holds, in both places, the same minimiser among the 5-word hashes of its first 35
words, and at least 20 words from there on. So only suffixes that begin at minimisers are kept (about 6 % of positions),
sorted by their next 20 words (then 50 words), and compared with their neighbours. Suffixes that agree with a neighbour
on 50 words are repeated; those that agree on 20 are extended: left and right of them every 50-word window over the
minimiser is hashed, sorted and compared in the same way. Windows are extended for a whole group of equal suffixes as
soon as one of them is not yet covered: its predecessor begins at or before the first of these windows, and the span that
begins there meets the suffix's own. So the result equals a comparison of all windows of all texts.
Words and windows are compared as 64-bit hashes.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import written
from .common import blank_words, need, replacing, small_batches

#: Words of a passage, of a hashed gram, and grams among which a minimiser is the least.
PASSAGE, GRAM, GRAMS = 50, 5, 31
RIGHT = PASSAGE - GRAMS + 1
#: An odd multiplier of the window hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Hashes:
    """Hashes of all word windows of a text."""

    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, words: list[bytes]) -> None:
        from xxhash import xxh64_intdigest

        n = len(words)
        if len(Hashes._up) < n + 1:
            size = 2 * n + 1
            with np.errstate(over="ignore"):
                one = np.ones(1, np.uint64)
                Hashes._up = np.cumprod(np.concatenate((one, np.full(size, BASE, np.uint64))), dtype=np.uint64)
                Hashes._down = np.cumprod(np.concatenate((one, np.full(size, INVERSE, np.uint64))), dtype=np.uint64)
        each = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
        self.n, self.sums = n, np.concatenate((np.zeros(1, np.uint64), np.cumsum(each * Hashes._up[:n], dtype=np.uint64)))

    def of(self, length: int) -> np.ndarray:
        """A hash per start of a window of ``length`` words, mixed so that order means nothing."""
        m = max(0, self.n - length + 1)
        x = (self.sums[length:length + m] - self.sums[:m]) * Hashes._down[:m]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))

    def minimisers(self) -> np.ndarray:
        """For every window of ``PASSAGE`` words the place of the least gram among its first ``GRAMS`` (the first of equals)."""
        m = self.n - PASSAGE + 1
        if m <= 0:
            return np.empty(0, np.int64)
        grams = self.of(GRAM)[:m + GRAMS - 1]
        out = np.empty(m, np.int64)
        for a in range(0, m, 1 << 16):
            part = grams[a:a + (1 << 16) + GRAMS - 1]
            view = np.lib.stride_tricks.sliding_window_view(part, GRAMS)[:min(1 << 16, m - a)]
            out[a:a + len(view)] = view.argmin(axis=1) + np.arange(a, a + len(view))
        return out


#: a: next 20 words, b: next 50 (if full), doc and h: the document, at: place, words from the first window it is the
#: minimiser of, and whether b counts.
SUFFIX = "a bigint, b bigint, doc bigint, h int, at bigint"
NAMES = ("a", "b", "doc", "h", "at")


def at_of(place, lead, full):
    return place << 7 | lead << 1 | full


def _keys(docs: DataFrame, key: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))).alias("doc"), F.hash(F.coalesce(F.col(text), F.lit(""))).alias("h")]


def _rows(doc, h, a, b, at) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(n, doc)), pa.array(np.full(n, h, np.int32)), pa.array(at)], names=NAMES)


def _together(parts: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += part.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def sparse_suffixes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The suffixes at minimiser positions of every whole text."""
    def of_text(doc: int, h: int, body: bytes) -> pa.RecordBatch | None:
        words = blank_words(body)
        if len(words) < PASSAGE:
            return None
        hashes = Hashes(words)
        places, first = np.unique(hashes.minimisers(), return_index=True)
        full = places <= hashes.n - PASSAGE
        b = np.zeros(len(places), np.uint64)
        b[full] = hashes.of(PASSAGE)[places[full]]
        return _rows(doc, h, hashes.of(RIGHT)[places], b, at_of(places, places - first, full.astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                for doc, h, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    part = of_text(doc, h, body.as_py())
                    if part is not None:
                        yield part
        yield from _together(parts())

    return docs.select(*_keys(docs, key, text), F.col(text).cast("binary").alias("body")).mapInArrow(run, SUFFIX)


MARKS = f"{SUFFIX}, part int, edge boolean, same_a boolean, same_b boolean"


def neighbours(suffixes: DataFrame, later_only: bool) -> DataFrame:
    """Sorts suffixes and compares neighbours: ``same_a`` where another suffix agrees on ``a``, ``same_b`` where one agrees
    on ``b`` too (``later_only``: one that sorts before, so that the first of equals is not marked). Only rows with
    ``same_a`` are returned.

    The sort key ends with the place, so a passage that stands in very many documents is cut over several tasks; the
    first and last row of each task are compared with those of other tasks afterwards. Rows that repeat count once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before, held = None, None

        def marked(rows: np.ndarray, before: np.ndarray | None, after: np.ndarray | None, first: bool) -> pa.RecordBatch | None:
            full = np.concatenate([x for x in (before, rows, after) if x is not None])
            a = full[1:, 0] == full[:-1, 0]
            b = a & (full[1:, 1] == full[:-1, 1]) & ((full[1:, 4] & full[:-1, 4] & 1) == 1)
            lo, n = int(before is not None), len(rows)
            prev = lambda x: np.concatenate(([False], x))[lo:lo + n]
            succ = lambda x: np.concatenate((x, [False]))[lo:lo + n]
            same_a, same_b = prev(a) | succ(a), prev(b) if later_only else prev(b) | succ(b)
            edge = np.zeros(n, bool)
            edge[0] |= first
            edge[-1] |= after is None
            keep = same_a | edge
            rows = rows[keep]
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[:, i].astype(np.int32) if i == 3 else np.ascontiguousarray(rows[:, i])) for i in range(5)]
                + [pa.array(np.full(len(rows), part, np.int32)), pa.array(edge[keep]), pa.array(same_a[keep]), pa.array(same_b[keep])],
                names=[*NAMES, "part", "edge", "same_a", "same_b"]) if len(rows) else None

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
            if not len(rows):
                continue
            full = rows if held is None else np.concatenate((held, rows))
            full = full[np.concatenate(([True], (full[1:] != full[:-1]).any(axis=1)))]
            if len(full) > 1:
                out = marked(full[:-1], before, full[-1:], before is None)
                if out is not None:
                    yield out
                before = full[-2:-1]
            held = full[-1:]
        if held is not None:
            out = marked(held, before, None, before is None)
            if out is not None:
                yield out

    dealt = suffixes.repartitionByRange(*NAMES).sortWithinPartitions(*NAMES)
    marks = written(dealt.mapInArrow(run, MARKS), "suffix-marks")
    edges = marks.filter("edge")  # two rows a task
    by_a = edges.groupBy("a").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    by_b = edges.filter("at & 1 = 1").groupBy("a", "b").agg(F.min("part").alias("lo_b"), F.max("part").alias("hi_b"))
    met = F.coalesce((F.col("part") > F.col("lo_b")) if later_only else (F.col("lo_b") < F.col("hi_b")), F.lit(False)) & (F.col("at").bitwiseAND(1) == 1)
    settled = edges.join(by_a, "a").join(by_b, ["a", "b"], "left").select(
        *NAMES, (F.col("same_a") | (F.col("lo") < F.col("hi"))).alias("same_a"), (F.col("same_b") | met).alias("same_b"))
    return marks.filter("NOT edge").select(*NAMES, "same_a", "same_b").unionByName(settled).filter("same_a")


def _to_extend(found: DataFrame) -> DataFrame:
    """(doc, h, places) whose windows must be compared: all of a group of equal suffixes if one is not covered already."""
    place, lead = F.shiftright("at", 7), F.shiftright("at", 1).bitwiseAND(63)
    order = Window.partitionBy("doc", "h").orderBy("at")
    rows = found.select("a", "doc", "h", place.alias("place"), (place - lead).alias("first"), "same_b",
                        F.lag(F.when(F.col("same_b"), place)).over(order).alias("previous"))
    covered = F.col("same_b") & (F.col("previous") <= F.col("first")) & (F.col("place") - F.col("previous") <= PASSAGE)
    # Written, so that both sides of the join are plain exchanges and a passage of very many documents can be split.
    open_groups = written(rows.filter(~F.coalesce(covered, F.lit(False))).select("a").distinct(), "suffix-open")
    return rows.join(open_groups, "a", "left_semi").groupBy("doc", "h").agg(F.collect_set("place").alias("places"))


def _extended(docs: DataFrame, places: DataFrame, key: str, text: str) -> DataFrame:
    """All windows whose minimiser is one of the places, as suffix rows; ``a`` is of the whole window, so ``b`` is not needed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                for doc, h, body, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "h", "body", "places"))):
                    hashes = Hashes(blank_words(body))
                    windows = np.nonzero(np.isin(hashes.minimisers(), np.array(wanted, np.int64)))[0]
                    found = hashes.of(PASSAGE)[windows]
                    yield _rows(doc, h, found, np.zeros_like(found), at_of(windows, 0, 1))
        yield from _together(parts())

    texts = docs.select(*_keys(docs, key, text), F.col(text).cast("binary").alias("body"))
    return texts.join(places, ["doc", "h"]).mapInArrow(run, SUFFIX)


def repeated_spans(docs: DataFrame, later_only: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, h, starts, ends): merged spans, in words, of every passage of at least 50 words that stands elsewhere too.

    Elsewhere is any other place of any document; with ``later_only`` a smaller key or an earlier place, so that one copy
    of every passage stays unmarked. Rows with equal key and text count as one document. Null and short texts have no
    spans; null keys come first. Texts without spans have no row.
    """
    need(docs, key, text)
    small_batches(docs)
    found = written(neighbours(written(sparse_suffixes(docs, key, text), "suffixes"), later_only), "suffix-matches")
    windows = written(_extended(docs, _to_extend(found), key, text), "suffix-windows")
    place = F.shiftright("at", 7).alias("place")
    starts = found.filter("same_b").select("doc", "h", place).unionByName(
        neighbours(windows, later_only).filter("same_b").select("doc", "h", place))
    sets = starts.groupBy("doc", "h").agg(F.array_sort(F.collect_set("place")).alias("places"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for places in batch.column("places"):
                x = np.array(places.as_py(), np.int64)
                cut = np.nonzero(np.diff(x) > PASSAGE)[0]
                spans.append((x[np.concatenate(([0], cut + 1))].tolist(), (x[np.concatenate((cut, [len(x) - 1]))] + PASSAGE).tolist()))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("h"), pa.array([s for s, _ in spans], kind), pa.array([e for _, e in spans], kind)],
                                             names=["doc", "h", "starts", "ends"])

    return sets.mapInArrow(merge, "doc bigint, h int, starts array<bigint>, ends array<bigint>")


def without_words(body: bytes, starts: list[int], ends: list[int]) -> bytes:
    """The text without the words of the spans and the white space that follows each span."""
    words = [m.start() for m in WORD.finditer(body)]
    words.append(len(body))
    out, at = [], 0
    for a, b in zip(starts, ends):
        out.append(body[at:words[a]])
        at = words[b]
    out.append(body[at:])
    return b"".join(out)


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with every passage of at least 50 words cut from all places but its first; ``cut_words`` is added (0: as it
    was, a column of that name is replaced)."""
    docs = replacing(docs, "cut_words")
    spans = repeated_spans(docs.select(key, text), True, key, text)
    others = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = [], []
            for body, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("body", "starts", "ends"))):
                texts.append(body if not starts else without_words(body.encode(), starts, ends).decode())
                cuts.append(sum(ends or ()) - sum(starts or ()))
            yield pa.RecordBatch.from_arrays([batch.column("others"), pa.array(texts, pa.string()), pa.array(cuts, pa.int64())], names=["others", "body", "cut_words"])

    rows = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("others"), F.col(text).alias("body"), *_keys(docs, key, text)).join(
        spans, ["doc", "h"], "left").select("others", "body", "starts", "ends")
    kind = T.StructType([rows.schema["others"], T.StructField("body", T.StringType()), T.StructField("cut_words", T.LongType())])
    cut = rows.mapInArrow(run, kind)
    return cut.select(*[F.col("body").alias(c) if c == text else F.col("others").getField(c).alias(c) for c in docs.columns], "cut_words")
