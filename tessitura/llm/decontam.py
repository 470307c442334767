"""Benchmark decontamination as a prefix-filtered join of item windows with document positions.

A window occurs in a document only if all its words do, so its rarest word is a sufficient prefix: windows are looked up
by that word alone, placed by its offset (positional bound), dropped where they do not fit into the document (length
bound) and then compared in full. Items are worked off in blocks of bounded size, each against all documents.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .common import letter_words, need, replacing, small_batches

WINDOW, BLOCK = 10, 200_000


def item_windows(items: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows (``window``: words joined by one blank) with the sorted ids of their items.

    An item of fewer words than ``window``, but not none, is one window. A null id is written ``null``.
    """
    need(items, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, body in zip(batch.column("item").to_pylist(), batch.column("body").to_pylist()):
                words = letter_words(body)
                if words:
                    found = sorted({b" ".join(words[i:i + window]) for i in range(max(1, len(words) - window + 1))})
                    yield pa.RecordBatch.from_pydict({"window": [w.decode() for w in found], "item": [item] * len(found)})

    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("item"), F.col(text).cast("binary").alias("body"))
    return rows.mapInArrow(run, "window string, item string").groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def word_counts(docs: DataFrame, words: set[bytes], text: str = "text") -> dict[bytes, int]:
    """Documents that hold each of the given words; partial counts per task, summed by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for body in batch.column(0):
                found.update(words.intersection(letter_words(body.as_py())))
        yield pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())}, schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    counts = docs.select(F.col(text).cast("binary").alias("body")).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counts.collect()}  # at most the words of one block


def prefix_index(windows: list[tuple[str, list[str]]], counts: dict[bytes, int]):
    """({window: items}, {rarest word: [(offset, length), ...]})."""
    full, anchors = {}, {}
    for text, items in windows:
        key = text.encode()
        words = key.split(b" ")
        full[key] = items
        at = min(range(len(words)), key=lambda i: (counts.get(words[i], 0), words[i], i))
        anchors.setdefault(words[at], set()).add((at, len(words)))
    return full, {w: sorted(places) for w, places in anchors.items()}


def found_windows(words: list[bytes], full: dict, anchors: dict) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, window) of every occurrence of a window in the words, in order of the rarest word."""
    n = len(words)
    for p in [i for i, w in enumerate(words) if w in anchors]:
        for offset, length in anchors[words[p]]:
            start = p - offset
            if start >= 0 and start + length <= n:
                key = b" ".join(words[start:start + length])
                if key in full:
                    yield start, start + length, key


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows with ``n_words``, merged hit spans (``starts``, ``ends`` in words) and the items found (sorted texts).

    Exact for any number of items: blocks of ``block`` windows are held by every task, one after the other, each with a
    pass over all documents whose hits are written before the next. Null texts have no words; repeated rows stay.
    Columns of the added names are replaced.
    """
    need(docs, text)
    docs = replacing(docs, "n_words", "starts", "ends", "items")
    small_batches(docs)
    windows = written(item_windows(items, window), "item-windows")
    blocks = max(1, -(-windows.count() // block))
    fields = docs.schema
    empty = [F.lit(0).cast("bigint").alias("n_words"), *[F.array().cast(f"array<{t}>").alias(c) for c, t in (("starts", "bigint"), ("ends", "bigint"), ("items", "string"))]]
    rows = docs.select("*", *empty)
    for b in range(blocks):
        part = windows if blocks == 1 else windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
        held = [(r["window"], list(r["items"])) for r in part.toLocalIterator()]
        vocabulary = {w for text_, _ in held for w in text_.encode().split(b" ")}
        index = prefix_index(held, word_counts(docs, vocabulary, text) if held else {})
        shared = docs.sparkSession.sparkContext.broadcast(index)
        rows = rows.mapInArrow(_scan(shared, text), rows.schema)
        if b + 1 < blocks:
            rows = written(rows, "item-hits")
    return rows.select(*[f.name for f in fields], "n_words", "starts", "ends", "items")


def _scan(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, anchors = shared.value
        for batch in batches:
            n_words, starts, ends, items = [], [], [], []
            old = [batch.column(c).to_pylist() for c in ("starts", "ends", "items")]
            for i, body in enumerate(batch.column(text)):
                body = body.as_py()
                words = letter_words(body.encode() if isinstance(body, str) else body)
                spans, names = list(zip(old[0][i], old[1][i])), set(old[2][i])
                for a, b, key in found_windows(words, full, anchors):
                    spans.append((a, b))
                    names.update(full[key])
                spans = merged(spans)
                n_words.append(len(words))
                starts.append([a for a, _ in spans])
                ends.append([b for _, b in spans])
                items.append(sorted(names))
            new = {"n_words": pa.array(n_words, pa.int64()), "starts": pa.array(starts, pa.list_(pa.int64())),
                   "ends": pa.array(ends, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], names=batch.schema.names)
    return run
