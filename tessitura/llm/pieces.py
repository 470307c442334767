"""Texts cut by the pattern of a byte-level tokenizer, and ids of distinct pieces."""
from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, functions as F


def pieces(text: Column, pattern: str) -> Column:
    """All matches of the tokenizer's pattern, in order; they concatenate to the text. Null has none.

    White space is meant in the Unicode sense, hence the flag.
    """
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def gathered_batches(batches: Iterator[pa.RecordBatch], least: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches joined to such of at least ``least`` bytes, so that a piece is looked up once for many texts."""
    held, size = [], 0
    for batch in sliced(batches):
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that number arrays per piece stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def coded(column: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct pieces, number of each occurrence among them, first occurrence of each row and the end)."""
    flat = column.flatten()
    encoded = flat.dictionary_encode()
    bounds = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), np.int64))))
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False), bounds


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of the runs ``values[starts[p]:starts[p] + lengths[p]]`` of all picks, and the end of each run."""
    size = lengths[picks]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts[picks] - (ends - size), size) + np.arange(total)], ends


class Cache:
    """Ids of pieces, kept by a Python worker over tasks: of each two generations of ``most`` entries the older goes when
    the newer is full, and what was looked up meanwhile has moved over. What is dropped is encoded again."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = 450_000) -> None:
        self.encode, self.most, self.new, self.old = encode, most, {}, {}

    def ids(self, wanted: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, start of each piece, length of each piece)."""
        new, old = self.new, self.old
        missing = [w for w in wanted if w not in new and w not in old]
        found = dict(zip(missing, self.encode(missing))) if missing else {}
        runs = [new.get(w) or old.get(w) or found.get(w, b"") for w in wanted]
        for a in range(0, len(wanted), self.most):
            if len(self.new) + min(self.most, len(wanted) - a) > self.most:
                self.old, self.new = self.new, {}
            self.new.update(zip(wanted[a:a + self.most], runs[a:a + self.most]))
        lengths = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        return np.frombuffer(b"".join(runs), "<u4"), np.cumsum(lengths) - lengths, lengths


_CACHES: dict[tuple, Cache] = {}


def added_tokens(path: str) -> list[str]:
    """Strings that the library makes one id wherever they stand, before it cuts a text by the pattern."""
    with open(path, encoding="utf-8") as f:
        return [token["content"] for token in json.load(f).get("added_tokens") or ()]


#: A character that parts the pieces of one call to the library, and how many go into one text.
MARK, TOGETHER = "\x1f", 50
#: The pre-tokenizer that only cuts by the pattern of ``pieces`` and maps bytes to characters.
PLAIN = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def library_encode(path: str) -> Callable[[list[str]], list[bytes]]:
    """Ids (little-endian, 4 bytes each) that the tokenizers library gives each text, without special tokens.

    A call for a text costs more than the merges of a short one, so texts go in groups, parted by a mark that the library
    splits off and that has an id of its own. Texts of ASCII characters, of which a piece stays one piece in every version of
    Unicode, are not cut by the pattern again. Texts with the mark or an added token go alone, and so do all where the file
    does more than this pre-tokenizer.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    plain, added = Tokenizer.from_file(path), added_tokens(path)
    alone = lambda texts: [np.array(x.ids, "<u4").tobytes() for x in plain.encode_batch_fast(texts, add_special_tokens=False)]
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    mark = plain.encode(MARK, add_special_tokens=False).ids
    if file.get("normalizer") or file.get("truncation") or file.get("padding") or file.get("pre_tokenizer") != PLAIN or len(mark) != 1:
        return alone
    grouped = {}
    for again in (False, True):
        grouped[again] = Tokenizer.from_file(path)
        grouped[again].pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(MARK, "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=again)])

    def together(texts: list[str], again: bool) -> list[bytes]:
        lines = [MARK.join(texts[k:k + TOGETHER]) + MARK for k in range(0, len(texts), TOGETHER)]
        ids = np.fromiter(chain.from_iterable(x.ids for x in grouped[again].encode_batch_fast(lines, add_special_tokens=False)), "<u4")
        ends = np.nonzero(ids == mark[0])[0]
        data = ids.tobytes()
        return [data[a:b - 4] for a, b in pairwise([0, *(4 * ends + 4).tolist()])]

    def encode(texts: list[str]) -> list[bytes]:
        kind = [2 if MARK in x or any(t in x for t in added) else 0 if x.isascii() else 1 for x in texts]
        found = [iter(f([x for x, k in zip(texts, kind) if k == n])) for n, f in enumerate((
            lambda some: together(some, False), lambda some: together(some, True), alone))]
        return [next(found[k]) for k in kind]

    return encode


def library_cache(path: str) -> Cache:
    """The worker's cache over the tokenizers library with its default settings."""
    if path not in _CACHES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _CACHES[path] = Cache(library_encode(path))
    return _CACHES[path]
