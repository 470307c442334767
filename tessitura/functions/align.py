"""Alignment of two unit sequences with its operations, as Arrow-batched UDFs over array columns."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

STEP = T.ArrayType(T.StructType([
    T.StructField("op", T.StringType()), T.StructField("ref", T.IntegerType()), T.StructField("hyp", T.IntegerType())]))


OPS = ("match", "substitute", "delete", "insert")


def _row(eq: int, up: int, down: int, every: int) -> tuple[int, int, int, int]:
    """Next row of the edit cost table, one bit a column: where the cost equals that up left (``same``), where it is one above
    that of the row before (``rise``), and where it rises (``up``) and falls (``down``) along the row."""
    same = ((((eq & up) + up) ^ up) | eq | down) & every
    rise = down | (every & ~(same | up))
    fall, shifted = up & same, rise << 1 | 1
    return same, rise, (fall << 1 | (every & ~(same | shifted))) & every, shifted & same


def _steps(ref: list, hyp: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cheapest alignment, walked back preferring diagonal, then delete, then insert: operations (numbers of ``OPS``),
    reference and hypothesis places (-1 for none).

    A row of the cost table is held as its differences, a bit each, in whole numbers as long as the hypothesis. Only every k-th
    row is kept, k about the square root of the reference's length; the rows between are computed again when the walk reaches
    them.
    """
    places: dict = {}
    for j, unit in enumerate(hyp):
        places[unit] = places.get(unit, 0) | 1 << j
    eqs = [places.get(unit, 0) for unit in ref]
    n, every, k = len(ref), (1 << len(hyp)) - 1, max(1, int(len(ref) ** 0.5))
    up, down, kept = every, 0, [(every, 0)]
    for i, eq in enumerate(eqs, start=1):
        _, _, up, down = _row(eq, up, down, every)
        if i % k == 0:
            kept.append((up, down))
    i, j, ops, refs, hyps = n, len(hyp), [], [], []
    for block in range(len(kept) - 1, -1, -1):
        low, rows = block * k, []
        up, down = kept[block]
        for eq in eqs[low:i]:
            same, rise, up, down = _row(eq, up, down, every)
            rows.append((same, rise))
        while i > low and j:
            same, rise = rows[i - low - 1]
            match = ref[i - 1] == hyp[j - 1]
            if match or not same >> (j - 1) & 1:
                i, j = i - 1, j - 1
                ops.append(0 if match else 1)
                refs.append(i)
                hyps.append(j)
            elif rise >> (j - 1) & 1:
                i -= 1
                ops.append(2)
                refs.append(i)
                hyps.append(-1)
            else:
                j -= 1
                ops.append(3)
                refs.append(-1)
                hyps.append(j)
    rest = [*[(2, x, -1) for x in range(i - 1, -1, -1)], *[(3, -1, x) for x in range(j - 1, -1, -1)]]
    return tuple(np.array([*x, *[r[c] for r in rest]], t)[::-1] for c, (x, t) in enumerate(((ops, np.int8), (refs, np.int32), (hyps, np.int32))))


def _each(ref: pa.Array, hyp: pa.Array):
    """Steps of every pair, None where a side is null; units become Python objects one pair at a time."""
    for r, h in zip(ref, hyp):
        yield _steps(r.as_py(), h.as_py()) if r.is_valid and h.is_valid else None


def _lists(values: pa.Array, lengths: list[int | None]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([n or 0 for n in lengths], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([n is None for n in lengths], pa.bool_()))


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


@F.arrow_udf(STEP)
def _align(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    found = list(_each(ref, hyp))
    ops, refs, hyps = (_joined([x[c] for x in found if x is not None], t) for c, t in enumerate((np.int8, np.int32, np.int32)))
    places = [pa.array(x, pa.int32(), mask=x < 0) for x in (refs, hyps)]
    named = pa.DictionaryArray.from_arrays(pa.array(ops, pa.int8()), pa.array(OPS, pa.string())).cast(pa.string())
    steps = pa.StructArray.from_arrays([named, *places], names=["op", "ref", "hyp"])
    return _lists(steps, [None if x is None else len(x[0]) for x in found])


def align(ref: Column, hyp: Column) -> Column:
    """Array of steps (op, ref, hyp) turning the reference units into the hypothesis units."""
    return _align(ref, hyp)


def _charged(ops: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Edits by reference unit: an insertion goes to the last unit before it, before the first unit to the first."""
    owner = np.maximum(np.maximum.accumulate(refs), 0)
    return np.bincount(owner[ops > 0], minlength=int(refs.max(initial=-1)) + 1).astype(np.int32)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _unit_edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    found = [None if x is None else _charged(*x[:2]) if len(x[0]) and x[1].max() >= 0 else np.empty(0, np.int32) for x in _each(ref, hyp)]
    edits = pa.array(_joined([x for x in found if x is not None], np.int32), pa.int32())
    return _lists(edits, [None if x is None else len(x) for x in found])


def unit_edits(ref: Column, hyp: Column) -> Column:
    """Edits charged to each reference unit; an insertion goes to the unit before it, at the start to the first.

    An empty reference is an error.
    """
    return F.when(F.size(ref) == 0, F.raise_error(F.lit("phoneme error rate of an empty reference"))).otherwise(_unit_edits(ref, hyp))


def edit_count(ref: Column, hyp: Column) -> Column:
    """Struct (edits, length) of two strings by character."""
    return F.struct(F.levenshtein(ref, hyp).alias("edits"), F.char_length(ref).alias("length"))


def error_rate(edits: Column, length: Column, strict: bool = False) -> Column:
    """Edits over length; an empty reference is null, or an error when strict."""
    empty = F.raise_error(F.lit("error rate of an empty reference")) if strict else F.lit(None)
    return F.when(length == 0, empty.cast("double")).otherwise(edits / length)
