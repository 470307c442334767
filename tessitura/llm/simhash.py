"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into blocks of 23, 23 and 18 bits. Of two fingerprints with at most 4 differing bits, one of
the 23-bit blocks differs in at most 1 bit, or the 18-bit block is equal (else 2 + 2 + 1 = 5 bits would differ). The
anchors of a 23-bit block are the 4096 words of the binary Golay code, which covers with radius 3: a block goes to all
anchors within 3 + 1 bits (5.3 on average), so blocks that differ in one bit share the anchor nearest to either. The
18-bit block is its own anchor (radius 0). Fingerprints that share an anchor are compared in full.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import written
from .common import blank_words, need, small_batches
from .graph import components

#: The generator of the Golay code (x^11+x^10+x^6+x^5+x^4+x^2+1), its length and its covering radius.
GENERATOR, LENGTH, RADIUS = 0xC75, 23, 3
#: Differing bits allowed, and expected fingerprints of a comparison cell.
DISTANCE, CELL = 4, 2048
#: Of near copies: word-set fingerprints per text, words of a shingle, and the similarity (a fraction) of near copies.
TABLES, SHINGLE, SIMILARITY = 8, 5, (4, 5)
#: Differing bits of the shingle fingerprints of candidates (texts of similarity 0.8 differ in 10 on average, deviation 3;
#: others in 32, deviation 4), expected texts of a cell where similarities are computed, and shingles counted together.
APART, BLOCK, COLUMNS = 24, 512, 4096


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle, repeats included; fewer words: of the whole sequence; none: empty."""
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = np.concatenate(([0], ends[:-1])), ends - 1
    m = max(1, len(words) - k + 1)
    pairs = zip(starts[:m].tolist(), stops[min(k, len(words)) - 1:].tolist())
    return np.fromiter((digest(joined[a:b], 42) for a, b in pairs), np.uint64, m)


def fingerprint(words: list[bytes], k: int) -> int:
    """The fingerprint of all k-word shingles."""
    return majority(shingle_hashes(words, k))


def majority(hashes: np.ndarray) -> int:
    """Bit set where over half of the hashes have it, as a signed 64-bit number; no hashes give 0."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 15):
        part = hashes[start:start + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, k: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) of every row, over whole texts; a null or blank text has fingerprint 0."""
    need(docs, key, text)
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(blank_words(x.as_py()), k) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("body"))
    return rows.mapInArrow(run, T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("fp", T.LongType())]))


def word_set_fingerprints(words: list[bytes], tables: int = TABLES) -> list[int]:
    """Independent fingerprints of the set of words: its hashes are mixed anew for each."""
    import xxhash

    distinct = set(words)
    each = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    return [majority(_mixed(each, table)) for table in range(tables)]


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _patterns(reach: int) -> tuple[np.ndarray, np.ndarray]:
    """By syndrome the error patterns of weight up to ``reach`` (padded with the first), and how many there are."""
    errors = np.array([sum(1 << b for b in bits) for w in range(reach + 1) for bits in combinations(range(LENGTH), w)], np.int64)
    syndromes = syndrome(errors)
    order = np.argsort(syndromes, kind="stable")
    errors, syndromes = errors[order], syndromes[order]
    count = np.bincount(syndromes, minlength=1 << 11)
    first = np.cumsum(count) - count
    table = errors[np.minimum(first[:, None] + np.arange(count.max()), len(errors) - 1)]
    return table, count


def syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of the 23-bit words as polynomials over the generator."""
    x = x.copy()
    for bit in range(LENGTH - 1, 10, -1):
        x ^= np.where((x >> bit) & 1, GENERATOR << (bit - 11), 0)
    return x


def anchors(blocks: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code word) of every anchor within the covering radius plus ``slack`` of each 23-bit block."""
    table, count = _patterns(RADIUS + slack)
    s = syndrome(blocks)
    valid = np.arange(table.shape[1])[None, :] < count[s][:, None]
    rows, columns = np.nonzero(valid)
    return rows, blocks[rows] ^ table[s[rows], columns]


def replicas(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, anchor, row) of everything a fingerprint is replicated to."""
    x = fps.view(np.uint64)
    low, mid, high = ((x >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18)))
    out = [(np.full(len(r), b, np.int32), a, r) for b, (r, a) in enumerate((anchors(low, 1), anchors(mid, 1)))]
    out.append((np.full(len(fps), 2, np.int32), high, np.arange(len(fps))))
    return tuple(np.concatenate(c) for c in zip(*out))


class Side(NamedTuple):
    """Nodes of a comparison: id, the fingerprint that placed them, and the one that confirms a link."""

    node: np.ndarray
    placed: np.ndarray
    fine: np.ndarray


def linked(left: Side, right: Side | None, fine: int, distance: int = DISTANCE) -> Iterator[tuple[int, int]]:
    """Links that connect whatever is within ``distance`` (and ``fine`` bits of the confirming fingerprints) inside
    ``left``, or between ``left`` and ``right``.

    At most one link fewer than nodes: links inside what already hangs together are left out.
    """
    every = left.node if right is None else np.concatenate((left.node, right.node))
    other, shift = (left, 0) if right is None else (right, len(left.node))
    view = lambda x: x.view(np.uint64)  # noqa: E731  bits of a signed number are counted of its absolute value
    labels = np.arange(len(every))
    step = max(1, (1 << 20) // max(1, len(other.node)))
    for start in range(0, len(left.node), step):
        near = np.bitwise_count(view(left.placed)[start:start + step, None] ^ view(other.placed)[None, :]) <= distance
        r, c = np.nonzero(near)
        sure = np.bitwise_count(view(left.fine)[start + r] ^ view(other.fine)[c]) <= fine
        if right is None:
            sure &= start + r != c
        r, c = r[sure], c[sure]
        bounds = np.searchsorted(r, np.arange(near.shape[0] + 1))
        for i in np.unique(r):
            at = c[bounds[i]:bounds[i + 1]] + shift
            own = labels[start + i]
            names, first = np.unique(labels[at], return_index=True)
            new = names != own
            if new.any():
                for k in first[new]:
                    yield int(every[start + i]), int(every[at[k]])
                labels[np.isin(labels, names)] = own


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The rows of each cell; they come sorted by cell."""
    def cut(rows: np.ndarray, whole: bool):
        change = np.nonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1))[0] + 1
        bounds = [0, *change.tolist(), *([len(rows)] if whole else [])]
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1:
                yield rows[a:b]
        return rows[bounds[-1]:]

    rest = None
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(8)], axis=1)
        if len(rows):
            rest = yield from cut(rows if rest is None else np.concatenate((rest, rows)), False)
    if rest is not None and len(rest):
        yield from cut(rest, True)


def links(nodes: DataFrame, fine: int = 64) -> DataFrame:
    """Edges (u, v) between ``nodes`` (node, prints, fine) that connect all that are within 4 bits in one of their
    ``prints`` and within ``fine`` bits in the confirming fingerprint.

    An anchor with many nodes is cut into parts of about ``CELL``; each pair of parts is a cell of its own, so no task
    holds a whole hot anchor. Per cell only links that join something are returned. The table of hot anchors is broadcast:
    it has at most one row per anchor (2 * 4096 + 2**18 for each print), however many nodes there are.
    """
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1 << 14):
                some = batch.slice(start, 1 << 14)
                node, fines = some.column(0).to_numpy(), some.column(2).to_numpy()
                prints = some.column(1).flatten().to_numpy().reshape(len(node), -1)
                for t in range(prints.shape[1]):
                    part = np.ascontiguousarray(prints[:, t])
                    block, anchor, row = replicas(part)
                    yield pa.RecordBatch.from_arrays([pa.array(3 * t + block, pa.int32()), pa.array(anchor), pa.array(node[row]), pa.array(part[row]), pa.array(fines[row])],
                                                     names=["block", "anchor", "node", "placed", "fine"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches):
            side = lambda x: Side(*(np.ascontiguousarray(x[:, c]) for c in (5, 6, 7)))
            own = rows[:, 4] == rows[0, 2]
            if rows[0, 2] == rows[0, 3]:
                found = list(linked(side(rows), None, fine))
            else:
                found = list(linked(side(rows[own]), side(rows[~own]), fine)) if own.any() and not own.all() else []
            if found:
                u, v = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    placed = nodes.select("node", "prints", "fine").mapInArrow(spread, "block int, anchor bigint, node bigint, placed bigint, fine bigint")
    hot = placed.groupBy("block", "anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL).select(
        "block", "anchor", F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
    rows = placed.join(F.broadcast(hot), ["block", "anchor"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "block", "anchor", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "placed", "fine")
    dealt = cells.repartition("block", "anchor", "i", "j").sortWithinPartitions("block", "anchor", "i", "j")
    return dealt.mapInArrow(compare, "u bigint, v bigint")


def _components(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` (key, node) with the smallest key of their component."""
    roots = components(edges)
    rooted = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rows.join(rooted.select("node", "root").join(named, "root").drop("root"), "node")


def near_duplicates(docs: DataFrame, k: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component): component is the smallest key reachable over fingerprints within 4 bits.

    Equal fingerprints collapse before any comparison, so copies cost nothing there. Blank and null texts share
    fingerprint 0 and link like others; a null key never names a component unless it has no other member.
    """
    rows = written(fingerprints(docs, k, key, text).withColumnRenamed("fp", "node"), "fingerprints")
    nodes = written(rows.groupBy("node").agg(F.min("key").alias("least")).withColumn("prints", F.array("node")).withColumn("fine", F.lit(0).cast("bigint")), "fingerprint-nodes")
    return _components(rows, nodes, links(nodes)).select(F.col("key").alias(key), F.col("node").alias("fp"), "component")


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of every two sets (sorted distinct hashes)."""
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    number = np.cumsum(often) - 1
    hit = often[column]
    rows, column = rows[hit], number[column[hit]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    total = int(often.sum())
    bounds = np.searchsorted(column, np.arange(0, total + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        part = np.zeros((len(sets), min(COLUMNS, total - k * COLUMNS)), np.float32)
        part[rows[a:b], column[a:b] - k * COLUMNS] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def similar(node: np.ndarray, sets: list[np.ndarray], side: np.ndarray, similarity: tuple[int, int]) -> Iterator[tuple[int, int]]:
    """Links that connect whatever has at least the Jaccard similarity, inside one side or, of two, between them."""
    size, (p, q) = np.array([len(x) for x in sets]), similarity
    near = (p + q) * shared(sets) >= p * (size[:, None] + size[None, :])
    near &= (side[:, None] != side[None, :]) if side.any() and not side.all() else ~np.eye(len(sets), dtype=bool)
    labels = np.arange(len(sets))
    for i in np.nonzero(near.any(axis=1))[0]:
        at = np.nonzero(near[i])[0]
        names, first = np.unique(labels[at], return_index=True)
        new = names != labels[i]
        for k in at[first[new]]:
            yield int(node[i]), int(node[k])
        labels[np.isin(labels, names)] = labels[i]


def _shingle_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell (root, i, j); they come sorted by cell."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], axis=1)
        bounds = [0, *(np.nonzero((cell[1:] != cell[:-1]).any(axis=1))[0] + 1).tolist(), len(cell)]
        for a, b in zip(bounds, bounds[1:]):
            if held and tuple(cell[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(cell[a])
    if held:
        yield pa.Table.from_batches(held)


def similar_links(members: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Edges (u, v) that connect all ``members`` (node, root, shingles) of one root with at least the Jaccard similarity.

    All pairs of a root are compared. A root with many nodes is cut into parts of about ``BLOCK``; each pair of parts is a
    cell of its own. Per cell only links that join something are returned.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _shingle_cells(batches):
            i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
            side = cell.column("part").to_numpy() != i
            if cell.num_rows > 1 and (i == j or side.any() and not side.all()):
                sets = [x.values.to_numpy().view(np.uint64) for x in cell.column("shingles")]
                found = list(similar(cell.column("node").to_numpy(), sets, side, similarity))
                if found:
                    u, v = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    large = written(members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select(
        "root", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "copy-groups")
    rows = members.join(large, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "shingles")
    return cells.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(compare, "u bigint, v bigint")


def set_node(shingles: np.ndarray) -> int:
    """The name of a set of shingles: a signed 64-bit hash."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).astype(np.int64))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", tables: int = TABLES, k: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(key, component) of near copies: texts whose sets of k-word shingles have at least the Jaccard similarity.

    Candidates are texts within 4 bits in one of several fingerprints of their word sets, which edits change less than
    those of shingles, and within ``APART`` bits in the fingerprint of the shingle set. What candidates connect is
    compared in full, by the shingle sets themselves (as 64-bit hashes), and only that decides. Texts with equal sets are
    one node, named by a 64-bit hash of the set.
    """
    need(docs, key, text)
    small_batches(docs)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, fine, node = [], [], []
            for x in batch.column(1):
                words = blank_words(x.as_py())
                shingles = np.unique(shingle_hashes(words, k))
                prints.append(word_set_fingerprints(words, tables))
                fine.append(majority(shingles))
                node.append(set_node(shingles))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.list_(pa.int64())), pa.array(fine, pa.int64()), pa.array(node, pa.int64())],
                                             names=["key", "prints", "fine", "node"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(blank_words(x.as_py()), k)) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_node(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))],
                                             names=["node", "shingles"])

    kind = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("prints", T.ArrayType(T.LongType())), T.StructField("fine", T.LongType()),
                         T.StructField("node", T.LongType())])
    found = written(rows.mapInArrow(run, kind), "word-fingerprints")
    nodes = written(found.groupBy("node").agg(F.min("key").alias("least"), F.min("prints").alias("prints"), F.min("fine").alias("fine")), "copy-nodes")
    groups = written(components(links(nodes, APART)), "copy-candidates")
    wanted = nodes.join(groups, "node").select("least")
    texts = rows.join(wanted, F.col("key").eqNullSafe(F.col("least"))).select("body")
    sets = texts.mapInArrow(again, "node bigint, shingles array<bigint>").groupBy("node").agg(F.first("shingles").alias("shingles"))
    members = written(sets.join(groups, "node").select("node", "root", "shingles"), "copy-shingles")
    return _components(found.select("key", "node"), nodes, similar_links(members, similarity)).select(F.col("key").alias(key), "component")
