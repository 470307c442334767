"""Byte-level BPE: ranked merges folded over the bytes of distinct words by higher-order functions, ids back to bytes.

The rank map is a table of one row that plans read by scalar subqueries: the sparse rows of a pair table (left id by right
id) laid over one another in one array, so that a look-up is one sum and two array reads, shared by every row of a task.
As a literal it would stand in the text of every plan, which the driver builds, logs and keeps again and again.
A word starts as the ids of its bytes; each step of the fold replaces the leftmost pair of least
rank, until no pair merges.
"""
from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import work_folder, written
from .common import let, need, replacing, small_batches, with_fields
from .pieces import coded, gathered, pieces, sliced
from .vocabulary import frequent

#: "No such pair" (a rank beyond all), bits of an id and of a place in a word.
NONE, ID_BITS, PLACE_BITS = 1 << 17, 18, 10
#: Pieces that tasks hold with their ids (others are folded where they stand), and bytes beyond which a piece is merged
#: with a heap instead, as the fold copies the word in each step.
DICTIONARY, LONG = 800_000, 256


class Ranks:
    """A rank file: ids of single bytes, bytes of every id, and the pairs that merge."""

    @staticmethod
    def read(path: str) -> dict[bytes, int]:
        with open(path, "rb") as lines:
            return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}

    def __init__(self, path: str) -> None:
        self.of = self.read(path)
        self.byte_ids = [self.of[bytes([b])] for b in range(256)]
        if max(self.of.values()) >= NONE:
            raise ValueError(f"ids from {NONE} do not fit the pair table")
        self.pairs = {pair: r for t, r in self.of.items() if (pair := self._last_pair(t, r)) is not None}

    def _last_pair(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two ids whose merge yields the token. Inside a token merges run as they do for the token alone, as none
        crosses its ends, so no other pair ever does; a token that its own bytes do not lead to is never made."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(self.of.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            least, i = min(found)
            if least >= rank:
                return None
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return (self.of[parts[0]], self.of[parts[1]]) if len(parts) == 2 else None

    @cached_property
    def rows(self) -> tuple[list[int], list[int]]:
        """(offset of each left id, slots): the merge of a pair stands in slot ``offset[left] + right``, with its left id.

        Each left id has a sparse row over the right ids; rows are laid over one another where none of their entries
        meet, the fullest first. A slot is 0 where nothing stands; left ids are stored plus one.
        """
        by_left: dict[int, dict[int, int]] = {}
        for (a, b), rank in self.pairs.items():
            by_left.setdefault(a, {})[b] = rank
        size, wide = max(self.of.values()) + 1, 1 << 13
        offsets, slots, free = [0] * size, [0] * (8 * size), np.ones(8 * size, bool)
        for a, row in sorted(by_left.items(), key=lambda x: (-len(x[1]), x[0])):
            rights, at = sorted(row), 0
            while True:
                fits = np.ones(wide, bool)
                for b in rights:
                    fits &= free[at + b:at + b + wide]
                if fits.any():
                    break
                at += wide
            at += int(fits.argmax())
            offsets[a] = at
            for b, rank in row.items():
                free[at + b], slots[at + b] = False, ((a + 1) << ID_BITS | rank) << PLACE_BITS
        top = len(slots)
        while top and not slots[top - 1]:
            top -= 1
        return offsets, slots[:top]


@lru_cache(maxsize=4)
def ranks(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(maxsize=1)
def _rows(path: str) -> tuple[list[int], list[int], list[int]]:
    """The rank map as offsets, slots and ids of single bytes. The driver keeps only this of a rank file."""
    book = Ranks(path)
    return (*book.rows, book.byte_ids)


def rank_table(spark: SparkSession, path: str) -> DataFrame:
    """The rank map as a struct ``ranks`` of offsets, slots and byte_ids: one row in the shared folder."""
    schema = "ranks struct<offsets: array<int>, slots: array<bigint>, byte_ids: array<int>>"
    return written(spark.createDataFrame([(_rows(path),)], schema).coalesce(1), "rank-map")


def with_ranks(rows: DataFrame, table: DataFrame, name: str, body: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """The rows with ``body`` over offsets, slots and byte ids of a rank table as column ``name``.

    A subquery may not stand inside a higher-order function, so its value is a column first. That is named once, so that
    the optimizer puts the subquery in its place and no row carries the map.
    """
    bound = lambda ranks: let(ranks["offsets"], lambda o: let(ranks["slots"], lambda s: let(ranks["byte_ids"], lambda b: body(o, s, b))))
    held = rows.select("*", table.scalar().alias("_ranks"))
    return held.select(*rows.columns, let(F.col("_ranks"), bound).alias(name))


def fold(word: Column, path: str) -> Column:
    """Ids of one word (binary), as an array of ints. The rank map stands in the plan as a literal: for small plans."""
    return _folded(word, *[F.split(F.lit(",".join(map(str, x))), ",").cast(f"array<{kind}>") for x, kind in zip(_rows(path), ("int", "bigint", "int"))])


def _folded(word: Column, offsets: Column, slots: Column, byte_ids: Column) -> Column:
    """Ids of one word (binary) by a rank map, as an array of ints."""
    none = NONE << PLACE_BITS

    def step(ids: Column) -> Column:
        """Ranks all neighbouring pairs, each with its place below the rank, and merges the least one if any merges.

        The left id above the rank is taken off by its own bits: an entry of another left id stays above ``none``.
        """
        def ranked(right: Column, i: Column) -> Column:
            left = F.get(ids, i - 1)
            entry = F.get(slots, F.get(offsets, left) + right)
            return entry.bitwiseXOR(F.shiftleft((left + 1).cast("bigint"), ID_BITS + PLACE_BITS)).bitwiseOR(i)

        def merged(least: Column) -> Column:
            right = least.bitwiseAND((1 << PLACE_BITS) - 1).cast("int")
            return F.concat(F.slice(ids, F.lit(1), right - 1), F.array(F.shiftright(least, PLACE_BITS).cast("int")), F.slice(ids, right + 2, F.size(ids)))

        best = F.coalesce(F.array_min(F.transform(ids, ranked)), F.lit(none))
        return let(best, lambda least: F.when(least < none, merged(least)).otherwise(ids))

    def from_ids(ids: Column) -> Column:
        n = F.size(ids)
        steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, ids, lambda state, _: step(state))

    places = F.when(F.octet_length(word) > 0, F.sequence(F.lit(1), F.octet_length(word))).otherwise(F.array().cast("array<int>"))
    chars = let(F.decode(word, "ISO-8859-1"), lambda w: F.transform(places, lambda i: F.get(byte_ids, F.ascii(F.substring(w, i, F.lit(1))))))
    return let(chars, from_ids)


def merged_long(piece: bytes, path: str) -> list[int]:
    """The same ids as ``fold`` for a piece of any length, in n log n steps: a heap of pairs over a linked list."""
    book = ranks(path)
    ids = [book.byte_ids[b] for b in piece]
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(ids) and (rank := book.pairs.get((ids[i], ids[j]))) is not None:
            heapq.heappush(heap, (rank, i, ids[i], ids[j]))

    for i in range(len(ids) - 1):
        offer(i)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] == a else len(ids)
        if j >= len(ids) or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[j] < len(ids):
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [x for x in ids if x >= 0]


def piece_counts(rows: DataFrame) -> DataFrame:
    """(token, n) of the pieces in the only column, an array of strings."""
    schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            distinct, occurrence, _ = coded(batch.column(0))
            counts = np.bincount(occurrence, minlength=len(distinct))
            whole = pa.RecordBatch.from_arrays([distinct.cast(pa.binary()), pa.array(counts, pa.int64())], schema=schema)
            yield from (whole.slice(i, 50_000) for i in range(0, whole.num_rows, 50_000))

    return written(rows.mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n")), "piece-counts")


def dictionary(counts: DataFrame, table: DataFrame, most: int) -> str:
    """A folder of frequent pieces in order of their 64-bit hash, with the ids that the fold gives. Python workers read it
    themselves, each once, so it never passes the driver."""
    spark = counts.sparkSession
    folder, parts = work_folder(spark, "pieces"), 4 * spark.sparkContext.defaultParallelism
    dealt = frequent(counts, most).select("token").repartition(parts).select("token", F.xxhash64("token").alias("h"))
    folded = with_ranks(dealt, table, "ids", lambda *ranks: _folded(F.col("token"), *ranks))
    written(folded, "piece-ids").repartitionByRange("h").sortWithinPartitions("h", "token").write.parquet(folder)
    return folder


def _dealt(folder: str, column: str) -> tuple[pa.Array, np.ndarray]:
    """(a column, hashes) of the dictionary in its order."""
    from pyarrow import fs, parquet

    system, root = fs.FileSystem.from_uri(folder)
    names = sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
    parts = [parquet.read_table(system.open_input_file(n), columns=[column, "h"], use_threads=False) for n in names]
    whole = pa.concat_tables(parts).combine_chunks()
    one = lambda c: pa.concat_arrays(whole.column(c).chunks) if whole.num_rows else pa.array([], whole.schema.field(c).type)
    return one(column), one("h").to_numpy(zero_copy_only=False)


@lru_cache(maxsize=1)
def _pieces_of(folder: str) -> tuple[pa.Array, np.ndarray]:
    """(pieces, hashes), held by a Python worker over its tasks."""
    pieces_, hashes = _dealt(folder, "token")
    pa.default_memory_pool().release_unused()
    return pieces_.cast(pa.binary()), hashes


@lru_cache(maxsize=1)
def _ids_of(folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat ids, start and number of each piece's), held by a Python worker over its tasks."""
    ids, _ = _dealt(folder, "ids")
    sizes = np.asarray(pa.compute.list_value_length(ids), np.uint8)
    flat = np.array(ids.flatten(), np.int32)
    del ids
    pa.default_memory_pool().release_unused()
    return flat, (np.cumsum(sizes, dtype=np.int64) - sizes).astype(np.int32), sizes


def _places(distinct: pa.Array, dealt: pa.Array, hashes: np.ndarray) -> np.ndarray:
    """Place of each piece in the dictionary, or -1; what the hash finds is compared in full."""
    own = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in distinct.to_pylist()), np.uint64, len(distinct)).view(np.int64)
    at = np.searchsorted(hashes, own)
    met = np.flatnonzero(at < len(hashes))
    met = met[hashes[at[met]] == own[met]]
    same = np.asarray(pa.compute.equal(dealt.take(pa.array(at[met])), distinct.take(pa.array(met))), bool) if len(met) else np.empty(0, bool)
    out = np.full(len(distinct), -1, np.int64)
    out[met[same]] = at[met[same]]
    return out


def encode(docs: DataFrame, path: str, pattern: str, most: int = DICTIONARY, text: str = "text", keep_text: bool = True,
           decoded: bool = False) -> DataFrame:
    """The rows with ``ids``: the whole text cut by the pattern, each piece merged by the ranks; null is empty.

    Without ``keep_text`` the text itself is not carried along. With ``decoded`` the ids are decoded again by the same
    Python worker, as by ``decode``.

    Pieces are counted over all rows; the distinct frequent ones are folded once and held by every Python worker (at most
    ``most`` of 64 bytes, read from the shared folder), all others are folded in the rows where they stand, once per row. Columns of the added names are replaced.
    """
    need(docs, text)
    docs = replacing(docs, "ids", *(["decoded"] if decoded else []), "_pieces", "_codes", "_rare", "_rare_ids")
    small_batches(docs)
    cut = docs.withColumn("_pieces", pieces(F.col(text), pattern))
    if not keep_text:
        docs, cut = docs.drop(text), cut.drop(text)
    table = rank_table(docs.sparkSession, path)
    folder = dictionary(piece_counts(cut.select("_pieces")), table, most)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt, hashes = _pieces_of(folder)
        for batch in sliced(batches):
            distinct, occurrence, bounds = coded(batch.column("_pieces"))
            codes = _places(distinct.cast(pa.binary()), dealt, hashes)[occurrence]
            rare = np.nonzero(codes < 0)[0]
            row = np.searchsorted(bounds, rare, "right") - 1
            pairs, inverse = np.unique(row * (len(distinct) + 1) + occurrence[rare], return_inverse=True)
            rows_of, pieces_of = np.divmod(pairs, len(distinct) + 1)
            first = np.searchsorted(rows_of, np.arange(batch.num_rows + 1))
            codes[rare] = -1 - (inverse - first[row])
            data = codes.astype("<i4").tobytes()
            rares = pa.ListArray.from_arrays(pa.array(first, pa.int32()), distinct.cast(pa.binary()).take(pa.array(pieces_of, pa.int64())))
            own = [batch.column(c) for c in batch.schema.names if c != "_pieces"]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array([data[4 * a:4 * b] for a, b in zip(bounds, bounds[1:])], pa.binary()), rares],
                names=[*[c for c in batch.schema.names if c != "_pieces"], "_codes", "_rare"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts, sizes = _ids_of(folder)
        for batch in sliced(batches):
            names = batch.schema.names
            words = batch.column("_rare").flatten().to_pylist()
            folded = [x if x is not None else merged_long(w, path) for w, x in zip(words, batch.column("_rare_ids").flatten().to_pylist())]
            counts = np.fromiter(map(len, folded), np.int64, len(folded))
            rare_ids = np.fromiter((i for x in folded for i in x), np.int32, int(counts.sum()))
            n_rare = np.asarray(pa.compute.list_value_length(batch.column("_rare")), np.int64)
            data = batch.column("_codes").to_pylist()
            n_pieces = np.fromiter((len(x) // 4 for x in data), np.int64, len(data))
            codes = np.frombuffer(b"".join(data), "<i4")
            known, rare = np.flatnonzero(codes >= 0), np.flatnonzero(codes < 0)
            place = codes[known]
            rare_place = np.repeat(np.cumsum(n_rare) - n_rare, n_pieces)[rare] - codes[rare] - 1
            lengths = np.zeros(len(codes), np.int64)
            lengths[known], lengths[rare] = sizes[place], counts[rare_place]
            common = np.repeat(codes >= 0, lengths)
            ids = np.empty(len(common), np.int32)
            ids[common] = gathered(flat, starts[place], lengths[known], np.arange(len(known)))[0]
            ids[~common] = gathered(rare_ids, (np.cumsum(counts) - counts)[rare_place], lengths[rare], np.arange(len(rare)))[0]
            bounds = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(n_pieces)))]
            own = [c for c in names if c not in ("_codes", "_rare", "_rare_ids")]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            more = {"ids": lists} | ({"decoded": joined_pieces(lists, path)} if decoded else {})
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *more.values()], names=[*own, *more])

    numbered = cut.mapInArrow(number, with_fields(docs, _codes=T.BinaryType(), _rare=T.ArrayType(T.BinaryType())))
    folded = with_ranks(numbered, table, "_rare_ids", lambda *ranks: F.transform("_rare", lambda w: F.when(F.octet_length(w) <= LONG, _folded(w, *ranks))))
    return folded.mapInArrow(
        assemble, with_fields(docs, ids=T.ArrayType(T.IntegerType()), **({"decoded": T.BinaryType()} if decoded else {})))


@lru_cache(maxsize=4)
def _by_id(path: str) -> pa.Array:
    names = {i: t for t, i in Ranks.read(path).items()}
    return pa.array([names.get(i) for i in range(max(names) + 1)], pa.binary())


def joined_pieces(ids: pa.ListArray, path: str) -> pa.Array:
    """The binary pieces of every row's ids, concatenated; an unknown id is an error."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(ids), 0), np.int64)
    parts = _by_id(path).take(ids.flatten())
    if parts.null_count:
        raise ValueError("an id is outside the vocabulary")
    joined = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), parts), b"")
    return pa.compute.if_else(ids.is_valid(), joined, None)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The rows with ``decoded``: the pieces of the ids, concatenated; null ids give null."""
    need(rows, ids)
    rows = replacing(rows, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, joined_pieces(batch.column(ids), path)], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, with_fields(rows, decoded=T.BinaryType()))
