import math
import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import ordering as O


@pytest.fixture(scope="module")
def values():
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.6 else rng.choice("abc"), round(rng.uniform(-50, 400), rng.choice([0, 1, 3]))) for i in range(900)]
    return rows + [(1000 + i, "hot", 7.0) for i in range(80)]


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_grouped_scan(spark, values, parts):
    df = spark.createDataFrame(values, "i int, g string, v double").repartition(parts)
    got = O.grouped_scan(df, ["g"], [F.col("v"), F.col("i")], O.value_bucket(F.col("v")), rank="r", sums={"s": F.col("i")}).collect()
    want, run = {}, {}
    for i, g, v in sorted(values, key=lambda x: (x[1], x[2], x[0])):
        n, s = run.get(g, (0, 0))
        run[g] = (n + 1, s + i)
        want[i] = run[g]
    assert {r["i"]: (r["r"], r["s"]) for r in got} == want


def test_quantile_rules(spark, values):
    df = spark.createDataFrame(values, "i int, g string, v double")
    by = {}
    for _, g, v in values:
        by.setdefault(g, []).append(v)
    qs = {"a": 0.1, "b": 0.5, "c": 0.975}
    for rule in ("linear", "nearest", "truncated"):
        for r in O.exact_quantiles(df, ["g"], "v", qs, rule).collect():
            s = sorted(by[r["g"]])
            n = len(s)
            for name, q in qs.items():
                want = {"linear": float(np.percentile(s, 100 * q)), "nearest": s[min(n - 1, round(q * (n - 1)))], "truncated": s[min(n - 1, int(n * q))]}[rule]
                assert r[name] == pytest.approx(want, abs=1e-9)
    assert O.exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(median(v for *_, v in values))


def test_quantiles_narrowed_by_a_coarse_sketch(spark, monkeypatch):
    monkeypatch.setattr(O, "ACCURACY", 40)
    rng = random.Random(4)
    rows = [("hot", rng.choice([rng.random(), 0.5, round(rng.random(), 1), -1e300, 1e300])) for _ in range(3000)] + [("few", float(i)) for i in range(7)]
    rows += [("odd", x) for x in [float("nan")] * 90 + [float("inf")] * 3 + [float("-inf")] * 60 + [0.25] * 80] + [("none", None)] * 3
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = {"a": 0.0, "b": 0.03, "c": 0.5, "d": 0.75, "e": 1.0}
    got = {r["g"]: r for r in O.exact_quantiles(df, ["g"], "v", qs, "nearest").collect()}
    assert set(got) == {"hot", "few", "odd"}
    for g in got:
        s = sorted((v for k, v in rows if k == g), key=lambda x: (math.isnan(x), x))
        for name, q in qs.items():
            want = s[min(len(s) - 1, round(q * (len(s) - 1)))]
            assert got[g][name] == want or math.isnan(got[g][name]) and math.isnan(want)
    assert O.exact_quantiles(df.limit(0), [], "v", {"m": 0.5}).collect()[0]["m"] is None


@pytest.fixture
def many_buckets(monkeypatch):
    monkeypatch.setattr(O, "BUCKET_ROWS", 20)
    monkeypatch.setattr(O, "MOST_ROWS", 60)


def test_scan_by_splitters(spark, many_buckets):
    rng = random.Random(9)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, rng.random(), 0.25, 0.5, float("nan"), 1e9 + rng.random()]), f"t{i:04d}") for i in range(900)]
    df = spark.createDataFrame(rows, "i int, g string, v double, t string").repartition(4)
    got = O.grouped_scan(df, ["g"], ["v", "t"], rank="r", sums={"s": F.col("i")}).collect()
    want, run = {}, {}
    for i, g, v, t in sorted(rows, key=lambda x: (x[1] or "", x[2] is not None, x[2] is not None and math.isnan(x[2]), 0.0 if x[2] is None or math.isnan(x[2]) else x[2], x[3])):
        n, s = run.get(g, (0, 0))
        run[g] = want[i] = (n + 1, s + i)
    assert {r["i"]: (r["r"], r["s"]) for r in got} == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_splitters_fill_buckets_and_shuffle_once(spark, many_buckets):
    """A metric between 0 and 1 with many ties: no bucket far above the mean, one shuffle of the rows, none to one task."""
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(1)).alias("m"), F.when(F.col("id") % 10 < 8, "hot").otherwise("x").alias("g"))
    cuts = O.splitters(df, ["g", "m", "id"], 50, 6000)
    sizes = [r["count"] for r in O.split_bucket(df, ["g", "m", "id"], cuts, "_b").groupBy("_b").count().collect()]
    assert len(sizes) == 50 and max(sizes) < 3 * 6000 / 50
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(before, ("-1", "false")):
            spark.conf.set(k, v)
        plan = plan_of(O.grouped_scan(df, ["g"], ["m", "id"], rank="r"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    exchanges = [line for line in plan.splitlines() if "Exchange " in line and "Broadcast" not in line]
    of_rows = [line for line in exchanges if "ENSURE_REQUIREMENTS" in line and "_cell" in line]
    assert "SinglePartition" not in plan and len(exchanges) == 4 and len(of_rows) == 3  # rows, bucket totals twice, totals by group


def test_top_rows(spark, values):
    df = spark.createDataFrame(values, "i int, g string, v double")
    got = O.top_rows(df, ["g"], [F.desc("v"), F.col("i")], 5, F.col("i"), rank="r").collect()
    for g in {x[1] for x in values}:
        want = [i for i, *_ in sorted((x for x in values if x[1] == g), key=lambda x: (-x[2], x[0]))[:5]]
        assert [r["i"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["r"])] == want


@pytest.mark.parametrize("strict", [True, False])
def test_first_after(spark, strict):
    rng = random.Random(5)
    events = [("g" if rng.random() < 0.8 else "h", float(rng.choice([rng.randint(0, 30), rng.randint(0, 900)])), i) for i in range(120)]
    asks = [(rng.choice("gh"), float(rng.randint(-5, 950)), i) for i in range(200)]
    got = O.first_after(spark.createDataFrame(events, "k string, value double, item int"), spark.createDataFrame(asks, "k string, value double, ask int"),
                        ["k"], lambda v: F.floor(v / 50).cast("bigint"), strict).collect()
    found = {r["ask"]: r["item"] for r in got}
    for k, t, a in asks:
        ok = [(v, i) for g, v, i in events if g == k and (v > t if strict else v >= t)]
        assert found.get(a) == (min(ok)[1] if ok else None)


def test_first_per_group(spark, values):
    df = spark.createDataFrame(values, "i int, g string, v double")
    got = {r["g"]: r["i"] for r in O.first_per_group(df, ["g"], ["v", "i"]).collect()}
    assert got == {g: min((v, i) for i, gg, v in values if gg == g)[1] for g in got}
