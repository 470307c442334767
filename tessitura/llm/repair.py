"""Token ids in binary shards compressed by Re-Pair grammars, with random access.

A shard (``.rpg``) holds the ids of consecutive documents. Frequent pairs of neighbouring symbols are replaced by
nonterminals, round after round, never over the end of a document; the file stores the rules (two symbols each) and
their expansion lengths, so any document or id range is decoded from its own symbols and the rules.

Layout, little-endian: ``RPG1``; symbol bytes (2 or 4), first nonterminal, documents, symbols, rules (u64 each); per
document key (i64), key present (u8), ids (u64), symbols (u64); per rule two symbols (u32 each) and expansion length
(u64); the symbols.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import work_folder, written
from .common import need, shared_file, small_batches
from .pieces import added_tokens, coded, gathered, gathered_batches, library_cache, pieces

MAGIC, HEAD = b"RPG1", struct.Struct("<4s5Q")
#: Ids after which a shard is closed, rounds, pairs replaced per round, and occurrences below which a pair is left.
SHARD_IDS, ROUNDS, PAIRS, LEAST = 4_000_000, 4, 3800, 8


class Grammar(NamedTuple):
    symbols: np.ndarray
    sizes: np.ndarray
    rules: np.ndarray
    first: int


def choose(pairs: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent pairs such that no symbol is a left one in one pair and a right one in another: their
    occurrences cannot overlap, so all are replaced in one pass."""
    left, right, taken = set(), set(), []
    for i in np.lexsort((pairs, -counts)):
        a, b = int(pairs[i]) >> 32, int(pairs[i]) & 0xFFFFFFFF
        if a != b and a not in right and b not in left:
            left.add(a)
            right.add(b)
            taken.append(pairs[i])
            if len(taken) == most:
                break
    return np.array(taken, np.int64)


def compress(ids: np.ndarray, sizes: np.ndarray, first: int, rounds: int = ROUNDS, most: int = PAIRS, least: int = LEAST) -> Grammar:
    """Re-Pair of documents that follow each other (``sizes`` ids each); nonterminals are numbered from ``first``."""
    symbols = ids.astype(np.int64)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    rules: list[np.ndarray] = []
    number = first
    for _ in range(rounds):
        if len(symbols) < 2:
            break
        inside = owner[1:] == owner[:-1]
        narrow = number <= 1 << 16  # then a pair of symbols fits 32 bits, which sort faster
        short = symbols.astype(np.uint32) if narrow else symbols
        sorting = (short[:-1] << (16 if narrow else 32) | short[1:])[inside]
        sorting.sort()
        if not len(sorting):
            break
        edge = np.concatenate(([0], np.nonzero(sorting[1:] != sorting[:-1])[0] + 1, [len(sorting)]))
        count, distinct = np.diff(edge), sorting[edge[:-1]].astype(np.int64)
        often = count >= least
        distinct, count = distinct[often], count[often]
        if narrow:
            distinct = distinct >> 16 << 32 | distinct & 0xFFFF
        if len(distinct) > 8 * most:
            cut = np.argpartition(-count, 8 * most)[:8 * most]
            distinct, count = distinct[cut], count[cut]
        taken = np.sort(choose(distinct, count, most))
        if not len(taken):
            break
        # Rule of every (left, right) pair: rows and columns only for symbols that are left or right in some rule.
        lefts, rights = np.unique(taken >> 32), np.unique(taken & 0xFFFFFFFF)
        row, column = np.zeros(number, np.int32), np.zeros(number, np.int32)
        row[lefts], column[rights] = np.arange(1, len(lefts) + 1), np.arange(1, len(rights) + 1)
        rule = np.full((len(lefts) + 1) * (len(rights) + 1), -1, np.int32)
        rule[row[taken >> 32] * (len(rights) + 1) + column[taken & 0xFFFFFFFF]] = np.arange(len(taken))
        maybe = np.nonzero((row > 0).take(symbols[:-1]) & (column > 0).take(symbols[1:]) & inside)[0]
        at = rule[row[symbols[maybe]] * (len(rights) + 1) + column[symbols[maybe + 1]]]
        hit, at = maybe[at >= 0], at[at >= 0]
        symbols[hit] = number + at
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        symbols, owner = symbols[keep], owner[keep]
        rules.append(np.stack([taken >> 32, taken & 0xFFFFFFFF], axis=1))
        number += len(taken)
    table = np.concatenate(rules) if rules else np.empty((0, 2), np.int64)
    return Grammar(symbols, np.bincount(owner, minlength=len(sizes)) if len(owner) else np.zeros(len(sizes), np.int64), table, first)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule stands for; a rule names only symbols that came before it."""
    out = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the symbols, and the end of each symbol's ids: every symbol, an id or a rule, stands for a run of ids."""
    runs: list[list[int]] = []
    for a, b in rules.tolist():
        runs.append((runs[a - first] if a >= first else [a]) + (runs[b - first] if b >= first else [b]))
    lengths = np.concatenate((np.ones(first, np.int64), np.fromiter(map(len, runs), np.int64, len(runs))))
    flat = np.concatenate((np.arange(first), np.fromiter(chain.from_iterable(runs), np.int64)))
    return gathered(flat, np.cumsum(lengths) - lengths, lengths, symbols)


def packed(keys: list[int | None], sizes: np.ndarray, grammar: Grammar) -> Iterator[bytes]:
    top = grammar.first + len(grammar.rules)
    width = 2 if top <= 1 << 16 else 4
    yield HEAD.pack(MAGIC, width, grammar.first, len(keys), len(grammar.symbols), len(grammar.rules))
    yield np.array([k or 0 for k in keys], "<i8").tobytes()
    yield np.array([k is not None for k in keys], "u1").tobytes()
    yield sizes.astype("<u8").tobytes()
    yield grammar.sizes.astype("<u8").tobytes()
    yield grammar.rules.astype("<u4").tobytes()
    yield expansion_lengths(grammar.rules, grammar.first).astype("<u8").tobytes()
    yield grammar.symbols.astype(f"<u{width}").tobytes()


class Shard:
    """Random access to an open shard: the tables are read once, symbols only where asked for."""

    def __init__(self, source) -> None:
        self.source = source
        magic, self.width, self.first, self.n_docs, self.n_symbols, n_rules = HEAD.unpack(source.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        array = lambda kind, n: np.frombuffer(source.read(np.dtype(kind).itemsize * n), kind)
        keys, present = array("<i8", self.n_docs), array("u1", self.n_docs)
        self.keys = [int(k) if p else None for k, p in zip(keys, present)]
        self.sizes, self.symbols = array("<u8", self.n_docs).astype(np.int64), array("<u8", self.n_docs).astype(np.int64)
        self.rules = array("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.lengths = array("<u8", n_rules).astype(np.int64)
        self.at = source.tell()

    def _symbols(self, start: int, n: int) -> np.ndarray:
        self.source.seek(self.at + start * self.width)
        data = self.source.read(n * self.width)
        if len(data) < n * self.width:
            raise ValueError("the shard is cut short")
        return np.frombuffer(data, f"<u{self.width}").astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        return expand(self._symbols(int(self.symbols[:i].sum()), int(self.symbols[i])), self.rules, self.first)[0]

    def span(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of a document: expansion lengths tell which symbols to open."""
        symbols = self._symbols(int(self.symbols[:i].sum()), int(self.symbols[i]))
        inner = symbols >= self.first
        size = np.where(inner, self.lengths[np.where(inner, symbols - self.first, 0)] if len(self.lengths) else 1, 1)
        ends = np.cumsum(size)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        ids, _ = expand(symbols[a:b], self.rules, self.first)
        skip = start - int(ends[a - 1] if a else 0)
        return ids[skip:skip + stop - start]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        ids, _ = expand(self._symbols(0, self.n_symbols), self.rules, self.first)
        for key, end, size in zip(self.keys, np.cumsum(self.sizes).tolist(), self.sizes.tolist()):
            yield key, ids[end - size:end]


MANIFEST = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])


def write_shards(docs: DataFrame, folder: str, tokenizer: str, pattern: str, vocabulary: int, end_id: int, key: str = "doc_id",
                 text: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes whole texts in ascending key order and writes shards of about ``shard_ids`` ids; returns the manifest with
    each shard's ``start`` (ids of all shards before).

    Nulls: a null text is empty (its end id alone), null keys come first. Equal keys follow each other by the hash of the
    text. Characters that the JVM does not know may part texts differently, and strings of added tokens are ids of their
    own, so texts with either go to the library whole.
    """
    from pyspark import TaskContext

    need(docs, key, text)
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, number = library_cache(tokenizer), TaskContext.get().partitionId(), 0
        keys, sizes, held, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal keys, sizes, held, size, number
            lengths = np.concatenate(sizes)
            grammar = compress(np.concatenate(held), lengths, vocabulary)
            system, path, name = shared_file(folder, "rpg")
            with system.open_output_stream(path, compression=None) as out:
                for data in packed(keys, lengths, grammar):
                    out.write(data)
                n_bytes = out.tell()
            row = {"part": part, "number": number, "file": name, "docs": len(keys), "ids": int(lengths.sum()), "bytes": n_bytes}
            keys, sizes, held, size, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_pylist([row], schema=MANIFEST)

        for some in gathered_batches(batches):
            distinct, occurrence, bounds = coded(some.column("pieces"))
            ids, ends = gathered(*cache.ids(distinct.to_pylist()), occurrence)
            stops = np.concatenate(([0], ends))[bounds]
            lengths = np.diff(stops) + 1
            full = np.empty(len(ids) + some.num_rows, np.int64)
            last = np.cumsum(lengths) - 1
            inner = np.ones(len(full), bool)
            inner[last] = False
            full[inner], full[last] = ids, end_id
            keys += some.column("key").to_pylist()
            sizes.append(lengths)
            held.append(full)
            size += len(full)
            if size >= shard_ids:
                yield close()
        if keys:
            yield close()

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("bigint").alias("key"), body.alias("body"), F.xxhash64(body).alias("tie"))
    ordered = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    whole = reduce(lambda a, b: a | b, [F.contains("body", F.lit(x)) for x in added_tokens(tokenizer)], F.col("body").rlike(r"\p{Cn}"))
    parts = F.when(whole, F.array("body")).otherwise(pieces(F.col("body"), pattern))
    manifest = written(ordered.select("key", parts.alias("pieces")).mapInArrow(
        run, "part bigint, number bigint, file string, docs bigint, ids bigint, bytes bigint"), "id-shards")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_shards(manifest: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids) of every document, read back from the files of the manifest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with system.open_input_file(f"{root}/{name}") as source:
                    shard = Shard(source)
                    first = start + np.cumsum(shard.sizes) - shard.sizes
                    sums, values = [], []
                    for _, found in shard.documents():
                        found = found.astype("<u4")
                        sums.append(zlib.crc32(found.tobytes()))
                        values.append(found if ids else None)
                for a in range(0, shard.n_docs, 512):
                    part = slice(a, a + 512)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.keys[part], pa.int64()), pa.array(first[part]), pa.array(shard.sizes[part]), pa.array(sums[part], pa.int64()),
                         pa.array(values[part], pa.list_(pa.int64()))], names=["key", "start", "n_tokens", "ids_crc32", "ids"])

    files = max(1, manifest.count())
    return manifest.select("file", "start").repartition(files).mapInArrow(
        run, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<bigint>")


def token_files(docs: DataFrame, tokenizer: str, pattern: str, vocabulary: int, end_id: int, ids: bool = True) -> DataFrame:
    """Writes all texts as shards in the shared folder and returns the documents read back from them."""
    folder = work_folder(docs.sparkSession, "token-ids")
    return read_shards(write_shards(docs, folder, tokenizer, pattern, vocabulary, end_id), folder, ids)
