"""Ranks, running sums, top rows and exact quantiles that never put one whole group into one task.

A plain window over a group sorts the group in a single task, and one language or speaker may hold a third of the
table. The operators here cut each group into buckets that follow the sort order, scan inside buckets, and add the
totals of earlier buckets, which come from a pre-aggregated table with one row per bucket. Where nothing is known of
the order's distribution, buckets are cut at splitters sampled from the rows, so they fill evenly whatever the range.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..session import written

SALTS = 64
#: Rows below which a scan is one bucket, rows above which a bucket is cut however few cores there are, samples a bucket.
BUCKET_ROWS, MOST_ROWS, SAMPLES = 10_000, 1_000_000, 24
#: Rank error of the sketch that brackets quantiles is 1 / ACCURACY of a group.
ACCURACY = 10_000


def names(keys: Sequence[str] | str) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def value_bucket(value: Column, per_unit: int = 256) -> Column:
    """A bucket that never falls when the number rises (NaN last, as it sorts); bounded size once equal values are
    pre-aggregated."""
    return F.when(F.isnan(value.cast("double")), F.lit(2**62)).otherwise(F.signum(value) * F.floor(F.log1p(F.abs(value)) * per_unit)).cast("bigint")


def position_bucket(position: Column, rows: int = 100_000) -> Column:
    return F.floor(position / F.lit(rows)).cast("bigint")


def splitters(df: DataFrame, columns: Sequence[str], buckets: int, rows: int) -> list[Row]:
    """At most ``buckets - 1`` rows of ``columns`` that cut the order by them into parts of similar size.

    The sample holds about ``SAMPLES`` rows a bucket. The cuts only balance the work: any cuts give the same ranks and sums.
    """
    if buckets < 2:
        return []
    share = min(1.0, SAMPLES * buckets / max(rows, 1))
    drawn = df.select(*columns)
    drawn = (drawn if share == 1.0 else drawn.sample(share, seed=1)).orderBy(*columns).collect()
    picked = [drawn[len(drawn) * k // buckets] for k in range(1, buckets)] if drawn else []
    return [r for k, r in enumerate(picked) if k == 0 or r != picked[k - 1]]


def split_bucket(df: DataFrame, columns: Sequence[str], cuts: Sequence[Row], name: str) -> DataFrame:
    """Adds the number of cuts at or below each row: one row of cuts goes to every task and is searched in two steps."""
    if not cuts:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    step = math.isqrt(len(cuts) - 1) + 1
    parts = [list(cuts[k:k + step]) for k in range(0, len(cuts), step)]
    one = df.select(F.array(F.array(F.struct(*columns))).alias("_cuts")).schema
    held = df.sparkSession.createDataFrame([(parts,)], one)
    own = F.struct(*columns)
    coarse = F.size(F.filter("_cuts", lambda part: part[0] <= own))
    fine = F.size(F.filter(F.get("_cuts", F.col("_coarse") - 1), lambda cut: cut <= own))
    return df.crossJoin(F.broadcast(held)).withColumn("_coarse", coarse).withColumn(
        name, F.when(F.col("_coarse") == 0, 0).otherwise((F.col("_coarse") - 1) * step + fine).cast("bigint")).drop("_cuts", "_coarse")


def grouped_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column | None = None,
    rank: str | None = None,
    sums: dict[str, Column] | None = None,
    totals: bool = False,
) -> DataFrame:
    """Adds a 1-based rank and/or inclusive running sums over ``order`` within ``keys``; with ``totals`` also each sum over the
    whole group, as ``<name>_all``.

    ``bucket`` must not fall along ``order``; rows of one (keys, bucket) meet in one task, whole groups never do. Without it
    ``order`` names ascending columns: the rows are written once, counted, and cut at splitters over keys and order, so that
    large groups get many buckets and ties are cut by the last column. Rows and bucket totals are joined on the value that
    both are already partitioned by, so the rows are shuffled once.
    """
    keys, sums = list(keys), sums or {}
    if bucket is None:
        columns, out_columns = [*keys, *order], df.columns
        for name, value in sums.items():
            df = df.withColumn(f"_in_{name}", value)
        df = written(df, "scan")
        rows, cores = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(min(cores, rows // BUCKET_ROWS), rows // MOST_ROWS)
        tagged = split_bucket(df, columns, splitters(df, columns, buckets, rows), "_bucket")
    else:
        out_columns, tagged = df.columns, df.withColumn("_bucket", bucket)
        for name, value in sums.items():
            tagged = tagged.withColumn(f"_in_{name}", value)
    # A struct is never null, so groups of null keys join by plain equality.
    tagged = tagged.withColumn("_cell", F.struct(*[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)], F.col("_bucket").alias("b")))
    per_bucket = tagged.groupBy("_cell").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(f"_in_{n}").alias(f"_total_{n}") for n in sums])
    before = Window.partitionBy(*[F.col(f"_cell.k{n}") for n in range(len(keys))]).orderBy("_cell.b").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*[F.col(f"_cell.k{n}") for n in range(len(keys))])
    offsets = per_bucket.select(
        "_cell", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        *[F.sum(f"_total_{n}").over(group).alias(f"_all_{n}") for n in sums if totals],
        *[F.coalesce(F.sum(f"_total_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    local = Window.partitionBy("_cell").orderBy(*order)
    running = local.rowsBetween(Window.unboundedPreceding, 0)
    scanned = tagged.withColumn("_rank", F.row_number().over(local))
    for name in sums:
        scanned = scanned.withColumn(f"_run_{name}", F.sum(f"_in_{name}").over(running))
    out = [F.col(c) for c in out_columns]
    if rank:
        out.append((F.col("_before") + F.col("_rank")).cast("bigint").alias(rank))
    out += [(F.col(f"_before_{n}") + F.col(f"_run_{n}")).alias(n) for n in sums]
    out += [F.col(f"_all_{n}").alias(f"{n}_all") for n in sums if totals]
    return scanned.join(offsets, "_cell").select(*out)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | Column, spread: Column,
             rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group: first per salt, then over the at most ``SALTS * n`` survivors of a group.

    For a constant ``n`` both steps also limit before their shuffle (window group limit).
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    limit = F.lit(n) if isinstance(n, int) else n
    kept = (
        salted.withColumn("_first", F.row_number().over(first)).filter(F.col("_first") <= limit).drop("_first", "_salt")
        .withColumn("_final", F.row_number().over(final)).filter(F.col("_final") <= limit)
    )
    return kept.withColumnRenamed("_final", rank) if rank else kept.drop("_final")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each group that sorts first, by partial aggregation: a hot group shrinks before the shuffle."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(packed).select(
        *[F.col(k) if k in keys else F.col(f"_first.{k}").alias(k) for k in df.columns])


def value_counts(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column] | None = None,
                 rank: str | None = None) -> DataFrame:
    """Distinct values of each group with ``n`` (rows) and, cumulated in value order, ``upto`` rows.

    ``sums`` adds further per-value totals and their cumulated ``upto_<name>``, ``rank`` the place of the value among the
    group's. Null values are left out.
    """
    sums = sums or {}
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in sums.items()])
    return grouped_scan(counted, keys, [value], rank=rank, sums={"upto": F.col("n"), **{f"upto_{k}": F.col(k) for k in sums}})


def _position(rule: str, q: float, n: Column) -> tuple[Column, Column]:
    """0-based lower index and the weight of the next value for a quantile rule."""
    if rule == "linear":
        h = F.lit(float(q)) * (n - 1)
        low = F.floor(h)
        return low.cast("bigint"), h - low
    if rule == "nearest":
        index = F.least(n - 1, F.bround(F.lit(float(q)) * (n - 1), 0).cast("bigint"))
        return index.cast("bigint"), F.lit(0.0)
    if rule == "truncated":
        return F.least(n - 1, F.floor(n * F.lit(float(q)))).cast("bigint"), F.lit(0.0)
    raise ValueError(f"unknown quantile rule {rule!r}")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float],
                    rule: str = "linear") -> DataFrame:
    """Exact quantiles per group in two passes, one column per entry of ``quantiles``; null values are left out.

    ``linear`` interpolates, ``nearest`` takes the half-even rounded index, ``truncated`` the floor of ``n * q``.

    The first pass brackets every quantile by a sketch whose rank error is known (a group of fewer rows than ``ACCURACY`` is
    its own bracket). The second counts the rows below each bracket and, per distinct value, those inside; only the latter,
    some ``8 / ACCURACY`` of a group, are put in order. Without keys there is one row, of nulls for no values.
    """
    keys, places = list(keys), list(quantiles.items())
    x, lowest, highest = F.col("_x"), F.lit(float("-inf")), F.lit(float("nan"))  # NaN sorts last
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    margin = 3 / ACCURACY
    asked = F.array(*[F.lit(min(1.0, max(0.0, q + d))) for _, q in places for d in (-margin, margin)])
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", asked, ACCURACY).alias("_near"))
    brackets = F.array(*[F.struct(
        F.lit(k).alias("i"),
        (lowest if q <= margin else F.when(F.col("_n") < ACCURACY, lowest).otherwise(F.col("_near")[2 * k])).alias("low"),
        (highest if q >= 1 - margin else F.when(F.col("_n") < ACCURACY, highest).otherwise(F.col("_near")[2 * k + 1])).alias("high"))
        for k, (_, q) in enumerate(places)])
    bounds = sketch.select(*keys, "_n", brackets.alias("_b"))
    met = rows.join(bounds, keys) if keys else rows.crossJoin(F.broadcast(bounds))
    counted = met.select(*keys, "_n", "_x", F.explode(F.filter("_b", lambda b: F.col("_x") <= b["high"])).alias("b")).select(
        *keys, "_n", F.col("b.i").alias("_i"), F.when(x >= F.col("b.low"), x).alias("_x")).groupBy(*keys, "_i", "_n", "_x").agg(
        F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_x")))
    ordered = counted.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))
    found = F.when(x.isNull(), F.raise_error(F.lit("a sketch missed its error bound"))).otherwise(x)
    outputs = []
    for k, (name, q) in enumerate(places):
        low, weight = _position(rule, q, F.col("_n"))
        high = F.least(low + 1, F.col("_n") - 1)
        holds = lambda at: (F.col("_i") == k) & (at >= F.col("_from")) & (at < F.col("_to"))
        outputs += [F.max(F.when(holds(low), found)).alias(f"_lo_{name}"), F.max(F.when(holds(high), found)).alias(f"_hi_{name}"),
                    F.max(F.when(F.col("_i") == k, weight)).alias(f"_w_{name}")]
    lo, hi, w = ((lambda n, p=p: F.col(f"_{p}_{n}")) for p in ("lo", "hi", "w"))
    return ordered.groupBy(*keys).agg(*outputs).select(*keys, *[
        F.when((w(n) == 0) | (lo(n) == hi(n)), lo(n)).otherwise(lo(n) + (hi(n) - lo(n)) * w(n)).alias(n) for n in quantiles])


def first_after(events: DataFrame, targets: DataFrame, keys: Sequence[str], bucket: Callable[[Column], Column] | None,
                strict: bool) -> DataFrame:
    """For each target (keys, value, ask) the event (keys, value, item) with the smallest value over (or at) it.

    Equal values take the smallest item; targets past the last event of their group get no row. Events and targets
    meet in buckets of the value, so no group is sorted in one task; a target past the last event of its bucket takes
    the first event of the group's next filled bucket. Without ``bucket`` both are written and cut at splitters.
    """
    keys = list(keys)
    both = events.select(*keys, "value", F.col("item"), F.lit(None).alias("ask"), F.lit(0).alias("_asks")).unionByName(
        targets.select(*keys, "value", F.lit(None).alias("item"), F.col("ask"), F.lit(1).alias("_asks"))
    )
    if bucket is None:
        both = written(both, "look-ups")
        rows = both.count()
        buckets = max(min(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // BUCKET_ROWS), rows // MOST_ROWS)
        both = split_bucket(both, [*keys, "value"], splitters(both, [*keys, "value"], buckets, rows), "_b")
    else:
        both = both.withColumn("_b", bucket(F.col("value")))
    tie = F.desc("_asks") if strict else F.col("_asks")
    falling = Window.partitionBy(*keys, "_b").orderBy(F.desc("value"), tie, F.desc("item")).rowsBetween(Window.unboundedPreceding, 0)
    answers = both.withColumn("_inside", F.last("item", ignorenulls=True).over(falling)).filter(F.col("_asks") == 1)
    later = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = both.groupBy(*keys, "_b").agg(F.min(
        F.when(F.col("_asks") == 0, F.struct("value", "item"))).alias("_first")).select(
        *keys, "_b", F.last(F.col("_first.item"), ignorenulls=True).over(later).alias("_after"))
    joined = answers.join(buckets, [*keys, "_b"]).select(*keys, "ask", F.coalesce("_inside", "_after").alias("item"))
    return joined.filter(F.col("item").isNotNull())
