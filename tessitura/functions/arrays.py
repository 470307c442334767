"""Row-local arithmetic on array columns: signals, tracks, vectors, durations. No shuffle; each is linear in the array."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once per row: an expression named inside a lambda is computed per element."""
    return F.transform(F.array(value), body)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def unit(x: Column) -> Column:
    return let(norm(x), lambda n: F.transform(x, lambda v: v.cast("double") / n))


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y) / (norm(x) * norm(y))


def frame_samples(frame_s, rate: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.lit(float(frame_s)) * rate, 0).cast("int"))


def _frame_powers(signal: Column, frame: Column) -> Column:
    """Mean power of each whole frame."""
    def powers(x: Column) -> Column:
        n = F.floor(F.size(x) / frame).cast("int")
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.aggregate(
            F.slice(x, i * frame + 1, frame), F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) / frame)

    return F.when(signal.isNotNull(), let(signal, powers))


def frame_levels(signal: Column, frame: Column, floor: float = 1e-10) -> Column:
    """Level in dB of each whole frame: 20 log10 of the root mean square, floored."""
    return F.transform(_frame_powers(signal, frame), lambda p: F.lit(20.0) * F.log10(F.greatest(F.sqrt(p), F.lit(floor))))


def energy_levels(signal: Column, frame: Column) -> Column:
    """Level in dB from the mean power plus a small constant, as used for voice metrics."""
    return F.transform(_frame_powers(signal, frame), lambda p: F.lit(10.0) * F.log10(p + 1e-12))


def longest_inner_run(silent: Column) -> Column:
    """Longest run of true between the first and the last false; the whole length if all are true; 0 if empty."""
    start = F.struct(F.lit(False).alias("seen"), F.lit(0).alias("run"), F.lit(0).alias("best"))
    step = lambda s, quiet: F.struct(
        (s["seen"] | ~quiet).alias("seen"),
        F.when(quiet & s["seen"], s["run"] + 1).otherwise(F.lit(0)).alias("run"),
        F.when(~quiet, F.greatest(s["best"], s["run"])).otherwise(s["best"]).alias("best"))
    return F.aggregate(silent, start, step, lambda s: F.when(s["seen"], s["best"]).otherwise(F.size(silent)))


def longest_internal_silence(signal: Column, rate: Column, frame_s: float, silence_db: float) -> Column:
    """Seconds of the longest silent stretch inside the voiced part of a signal."""
    frame = frame_samples(frame_s, rate)
    silent = F.transform(frame_levels(signal, frame), lambda db: db < silence_db)
    return longest_inner_run(silent) * frame / rate


def peak_normalize(signal: Column, floor: float = 0.01) -> Column:
    peak = F.greatest(F.lit(floor), F.array_max(F.transform(signal, lambda v: F.abs(v).cast("double"))))
    return let(peak, lambda p: F.transform(signal, lambda v: (v.cast("double") / p).cast("float")))


def fit_frames(signal: Column, frames: Column, hop: int) -> Column:
    """Pads with zeros or cuts to exactly ``frames * hop`` samples; more than one hop off is an error."""
    target = frames * hop
    off = target - F.size(signal)
    fitted = F.when(off >= 0, F.concat(signal, F.array_repeat(F.lit(0.0).cast("float"), off.cast("int")))).otherwise(
        F.slice(signal, F.lit(1), target.cast("int")))
    return F.when(F.abs(off) > hop, F.raise_error(F.lit("audio and durations differ by more than one hop"))).otherwise(fitted)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _edge_steps(durations: pd.Series, rate: pd.Series, target: pd.Series) -> pd.Series:
    out = []
    for d, r, t in zip(durations, rate, target):
        if d is None or r != r:
            out.append(None)
            continue
        edges = (2 * np.cumsum(np.asarray(d, np.int64)) * int(t) + int(r)) // (2 * int(r))
        out.append(np.diff(edges, prepend=0))
    return pd.Series(out, dtype=object)


def rescale_durations(durations: Column, rate: Column, target_rate: int = 22050) -> Column:
    """Frames at ``rate`` as frames at the target rate; boundaries rounded half up, so each moves at most half a frame."""
    return _edge_steps(durations.cast("array<bigint>"), rate.cast("bigint"), F.lit(target_rate))


def ctc_collapse(ids: Column, blank: int) -> Column:
    """Repeats merged, then blanks dropped."""
    merged = let(ids, lambda x: F.filter(x, lambda v, i: (i == 0) | (v != F.get(x, i - 1))))
    return F.when(ids.isNotNull(), F.filter(merged, lambda v: v != blank))


def _quantile_of_sorted(ordered: Column, q: float) -> Column:
    n = F.size(ordered)
    h = F.lit(float(q)) * (n - 1)
    low = F.floor(h).cast("int")
    at = lambda i: F.get(ordered, i).cast("double")
    return F.when(n > 0, at(low) + (at(F.least(low + 1, n - 1)) - at(low)) * (h - low))


def array_quantile(x: Column, q: float) -> Column:
    """Linear quantile of a row's own array."""
    return let(F.array_sort(x), lambda ordered: _quantile_of_sorted(ordered, q))


def speech_mask(levels: Column, share: float = 0.4) -> Column:
    """Frames louder than quiet + share * (loud - quiet), quiet and loud being the 10th and 95th percentile."""
    def mask(x: Column) -> Column:
        def limit(ordered: Column) -> Column:
            quiet, loud = _quantile_of_sorted(ordered, 0.10), _quantile_of_sorted(ordered, 0.95)
            return quiet + F.lit(share) * (loud - quiet)

        return let(let(F.array_sort(x), limit), lambda least: F.transform(x, lambda v: v > least))

    return F.when(levels.isNotNull(), let(levels, mask))


def active_span(mask: Column) -> Column:
    """Frames from the first to the last true one."""
    n = F.size(mask)
    first, last = F.array_position(mask, True), n + 1 - F.array_position(F.reverse(mask), True)
    return F.when(first > 0, last - first + 1).otherwise(F.lit(0))


def count_true(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda v: v))


def semitones(track: Column, base: float = 100.0) -> Column:
    return F.transform(track, lambda f: F.when(~F.isnan(f), F.lit(12.0) * F.log2(f.cast("double") / base)))


def step_sizes(track: Column) -> Column:
    """Absolute differences of neighbours; a missing neighbour gives null."""
    n = F.size(track)
    return F.when(n > 1, F.zip_with(F.slice(track, F.lit(2), n - 1), F.slice(track, F.lit(1), n - 1), lambda b, a: F.abs(b - a))).otherwise(
        F.array().cast("array<double>"))


def contour_correlation(a: Column, b: Column, min_frames: int) -> Column:
    """Struct (status, correlation) over the positions that both tracks have."""
    n = F.least(F.size(a), F.size(b))
    good = lambda v: v.isNotNull() & ~F.isnan(v)
    pairs = F.filter(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(
        x.cast("double").alias("x"), y.cast("double").alias("y"))), lambda p: good(p["x"]) & good(p["y"]))

    def measured(p: Column) -> Column:
        m = F.size(p)
        mean = lambda c: F.aggregate(p, F.lit(0.0), lambda s, v: s + v[c]) / m
        moments = lambda c: F.aggregate(
            p, F.struct(F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"), F.lit(0.0).alias("xy")),
            lambda s, v: F.struct((s["xx"] + (v["x"] - c["x"]) * (v["x"] - c["x"])).alias("xx"), (s["yy"] + (v["y"] - c["y"]) * (v["y"] - c["y"])).alias("yy"),
                                  (s["xy"] + (v["x"] - c["x"]) * (v["y"] - c["y"])).alias("xy")))
        r = let(let(F.struct(mean("x").alias("x"), mean("y").alias("y")), moments), lambda s: s["xy"] / F.nullif(F.sqrt(s["xx"] * s["yy"]), F.lit(0.0)))
        few = m < min_frames
        return F.struct(F.when(few, "too_few_voiced").otherwise("ok").alias("status"), F.when(~few, r).alias("correlation"))

    return let(pairs, measured)


def f0_correlation(a: Column, b: Column, samples_a: Column, samples_b: Column, rate: int, max_mismatch_s: float, min_frames: int) -> Column:
    mismatch = F.abs(samples_a - samples_b) / rate > max_mismatch_s
    measured = contour_correlation(a, b, min_frames)
    return F.when(mismatch, F.struct(F.lit("length_mismatch").alias("status"), F.lit(None).cast("double").alias("correlation"))).otherwise(measured)


def top_label(scores: Column) -> Column:
    """Key of the largest value of a map; the first one among equals."""
    best = F.aggregate(
        F.map_entries(scores), F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value")),
        lambda s, e: F.when(s["value"].isNull() | (e["value"] > s["value"]), F.struct(
            e["key"].cast("string").alias("key"), e["value"].cast("double").alias("value"))).otherwise(s))
    return best["key"]
