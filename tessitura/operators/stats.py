"""Metric against verdict: language z-scores, rank-based AUC, bootstrap intervals, extremes, disagreements, strengths."""
from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import ensure_checkpoint_dir, written
from .checks import require_empty
from .ordering import exact_quantiles, grouped_scan, top_rows, value_counts

EXTREME_FRACTION = 0.15
FANOUT = 256  # children of a node of the tree that bootstrap counts are dealt down
BROADCAST_ROWS = 100_000  # a strengths table up to this many rows is sent to every task
LINK_ROWS = 200_000  # games that a task of a round of strengths reads


def join_verdicts(verdicts: DataFrame, scores: DataFrame, keys: Sequence[str], strict: bool = True) -> DataFrame:
    """Verdicts with their scores; a verdict without a score is an error."""
    if strict:
        require_empty(verdicts.join(scores, list(keys), "left_anti").select(*keys), "verdicts without scores")
    return verdicts.join(scores, list(keys))


def with_language_z(rows: DataFrame, metrics: Sequence[str], lang: str = "lang") -> DataFrame:
    """Adds ``<metric>_langz``: the metric standardized inside its language, 0 where it does not vary.

    Means and spreads come from one partial aggregation joined back, not from a window over a whole language.
    """
    stats = rows.groupBy(lang).agg(*[e for m in metrics for e in (
        F.avg(m).alias(f"_mean_{m}"), F.stddev_pop(m).alias(f"_sd_{m}"), F.min(m).alias(f"_lo_{m}"), F.max(m).alias(f"_hi_{m}"))])
    z = lambda m: F.when(
        (F.col(f"_lo_{m}") == F.col(f"_hi_{m}")) | (F.col(f"_sd_{m}") == 0), F.lit(0.0)
    ).otherwise((F.col(m) - F.col(f"_mean_{m}")) / F.col(f"_sd_{m}"))
    return rows.join(stats, lang).select(*[F.col(c) for c in rows.columns], *[z(m).alias(f"{m}_langz") for m in metrics])


def unpivot_metrics(rows: DataFrame, keep: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return rows.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))


def pooled_auc(rows: DataFrame, keys: Sequence[str], strata: Sequence[str], value: str, passed: Column) -> DataFrame:
    """Share of (pass, fail) pairs of a stratum that the metric orders right, ties half, pooled over strata per ``keys``.

    Pairs are never formed: a pass with value v wins against the fails below v, read from cumulated value counts.
    """
    marked = rows.withColumn("_p", passed.cast("bigint")).withColumn("_f", 1 - F.col("_p"))
    groups = list(dict.fromkeys([*keys, *strata]))
    counts = value_counts(marked, groups, value, sums={"p": F.col("_p"), "f": F.col("_f")})
    below = F.col("upto_f") - F.col("f")
    wins = counts.groupBy(*groups).agg(
        F.sum(F.col("p") * (below * 2 + F.col("f"))).alias("_twice"), F.sum("p").alias("_np"), F.sum("f").alias("_nf"))
    total = wins.groupBy(*keys).agg(
        F.sum("_twice").alias("_twice"), F.sum(F.col("_np") * F.col("_nf")).alias("pairs"))
    return total.select(*keys, "pairs", F.try_divide(F.col("_twice") / 2.0, F.col("pairs")).alias("auc"))


def groups_with_both(rows: DataFrame, group: str, verdict: str) -> DataFrame:
    return rows.groupBy(group).agg(F.min(verdict).alias("_a"), F.max(verdict).alias("_b")).filter("_a <> _b").select(group)


def _drawn(total: np.ndarray, weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Per draw (column), ``total`` dealt out over the rows of ``weights`` in proportion to them."""
    whole = weights.sum()
    return rng.multinomial(total, weights / whole).T if whole else np.zeros((len(weights), len(total)), np.int64)


def _generator(seed: int, *place) -> np.random.Generator:
    digest = hashlib.sha256(":".join(map(str, (seed, *place))).encode()).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest[:16], "big")))


def bootstrap_auc(rows: DataFrame, keys: Sequence[str], stratum: Sequence[str], value: str, passed: Column,
                  draws: int, seed: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Interval of the pooled AUC over ``draws`` resamples; each stratum is redrawn with replacement to its own size.

    A resample is known by how often each (value, verdict) is drawn, which is multinomial over their counts. These counts
    are dealt out down a tree over the ordered distinct values (``FANOUT`` children a node, all draws at once as one array a
    node), from generators seeded by (seed, stratum, node); so the work is draws x distinct values however many rows there
    are, no task holds more than ``FANOUT`` x draws counts, and a result does not depend on partitions. Null values are left out.
    """
    import pandas as pd

    groups = list(dict.fromkeys([*keys, *stratum]))
    won = passed.cast("bigint")
    marked = rows.withColumn("_p", won).withColumn("_f", 1 - won)
    cells = written(value_counts(marked, groups, value, sums={"_np": F.col("_p"), "_nf": F.col("_f")}, rank="_node").select(
        *groups, (F.col("_node") - 1).alias("_node"), F.col("_np").alias("p"), F.col("_nf").alias("f")), "cells")
    widest = cells.agg(F.max("_node")).first()[0] or 0
    depth = 1
    while widest >= FANOUT**depth:
        depth += 1
    schema = lambda fields: T.StructType([*[cells.schema[g] for g in groups], *T.StructType.fromDDL(fields).fields])
    arrays, root = "p array<bigint>, f array<bigint>, earlier array<bigint>", [*groups, "_node"]
    plain = lambda v: v.item() if hasattr(v, "item") else v

    def start(frames):
        for frame in frames:
            out = []
            for *group, p, f in frame.itertuples(index=False, name=None):
                rng = _generator(seed, *map(plain, group), "root")
                pass_counts = rng.binomial(p + f, p / (p + f), draws)
                out.append((*group, 0, pass_counts, p + f - pass_counts, np.zeros(draws, np.int64)))
            yield pd.DataFrame(out, columns=[*root, "p", "f", "earlier"])

    def deal(level):
        def split(key, above, below):
            if above.empty or below.empty:
                return pd.DataFrame(columns=[*root, "p", "f", "earlier"] if level else [*groups, "twice"])
            below, rng = below.sort_values("_node"), _generator(seed, *map(plain, key), level)
            p, f = (_drawn(np.asarray(above[c].iloc[0]), below[c].to_numpy(np.int64), rng) for c in "pf")
            earlier = np.asarray(above["earlier"].iloc[0]) + np.cumsum(f, axis=0) - f
            if level:
                return pd.DataFrame([(*key[:-1], n, *a) for n, *a in zip(below["_node"], p, f, earlier)], columns=[*root, "p", "f", "earlier"])
            return pd.DataFrame([(*key[:-1], (p * (2.0 * earlier + f)).sum(axis=0))], columns=[*groups, "twice"])
        return split

    tops = cells.groupBy(*groups).agg(F.sum("p").alias("p"), F.sum("f").alias("f"))
    nodes = tops.mapInPandas(start, schema(f"_node bigint, {arrays}"))
    tops = nodes = written(nodes, "draws")
    for level in range(depth - 1, -1, -1):
        parent = [*groups, F.floor(F.col("_node") / FANOUT).cast("bigint").alias("_parent")]
        weights = cells.groupBy(*groups, F.floor(F.col("_node") / FANOUT**level).cast("bigint").alias("_node")).agg(
            F.sum("p").alias("p"), F.sum("f").alias("f"))
        nodes = nodes.groupBy(*groups, F.col("_node").alias("_parent")).cogroup(weights.groupBy(*parent)).applyInPandas(
            deal(level), schema(f"_node bigint, {arrays}" if level else "twice array<double>"))
    wins = nodes.select(*groups, F.posexplode("twice").alias("draw", "_t")).groupBy("draw", *groups).agg(F.sum("_t").alias("_twice"))
    sizes = tops.select(*groups, F.posexplode(F.zip_with("p", "f", lambda a, b: a.cast("double") * b)).alias("draw", "_pairs"))
    total = lambda df, c: df.groupBy("draw", *keys).agg(F.sum(c).alias(c))
    stats = total(wins, "_twice").join(total(sizes, "_pairs"), ["draw", *keys]).select(
        *keys, F.try_divide(F.col("_twice") / 2.0, F.col("_pairs")).alias("auc"))
    return exact_quantiles(stats, list(keys), "auc", {"ci_lo": low, "ci_hi": high})


def _ranked(rows: DataFrame, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """Rank by value then tie inside ``keys``, with the group's rows; equal values are cut by the tie."""
    ranked = written(grouped_scan(rows, list(keys), [value, tie], rank="rank"), "ranked")
    sizes = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"))
    return ranked.join(sizes, list(keys)) if keys else ranked.crossJoin(F.broadcast(sizes))


def extremes(rows: DataFrame, keys: Sequence[str], value: str, tie: str, passed: Column) -> DataFrame:
    """Pass rate of the highest and fail rate of the lowest 15 % (at least one row, half-even count)."""
    ranked = _ranked(rows, keys, value, tie).withColumn(
        "extreme_n", F.greatest(F.lit(1), F.bround(F.lit(EXTREME_FRACTION) * F.col("group_rows"), 0)).cast("bigint"))
    top, bottom = F.col("rank") > F.col("group_rows") - F.col("extreme_n"), F.col("rank") <= F.col("extreme_n")
    one = passed.cast("double")
    return ranked.groupBy(*keys).agg(
        F.avg(F.when(top, one)).alias("top_pass_rate"), F.avg(F.when(bottom, 1.0 - one)).alias("bottom_fail_rate"),
        F.max("extreme_n").alias("extreme_n"))


def disagreements(rows: DataFrame, value: str, z: str, tie: str, verdict: str, n: int, min_group: int = 3,
                  lang: str = "lang") -> DataFrame:
    """Fails the metric ranks highest and passes it ranks lowest by language z, in languages of at least ``min_group``."""
    ranked = _ranked(rows, [], value, tie).withColumn(
        "global_percentile", (F.col("rank") - 1) / (F.col("group_rows") - 1)).drop("group_rows", "rank")
    sizes = rows.groupBy(lang).agg(F.count(F.lit(1)).alias("lang_rows"))
    rankable = ranked.join(sizes, lang).filter(F.col("lang_rows") >= min_group)
    fails = top_rows(rankable.filter(F.col(verdict) == "fail"), [], [F.desc(z), F.col(tie)], n, F.col(tie), rank="place")
    passes = top_rows(rankable.filter(F.col(verdict) == "pass"), [], [F.col(z), F.col(tie)], n, F.col(tie), rank="place")
    return fails.withColumn("kind", F.lit("model_high_verdict_fail")).unionByName(
        passes.withColumn("kind", F.lit("model_low_verdict_pass")))


def evaluate(rows: DataFrame, metrics: Sequence[str], row_id: str, draws: int, seed: int = 0) -> DataFrame:
    """Every metric (raw and language z) against human and audio verdicts, as in the evaluation report."""
    scored = with_language_z(rows, metrics)
    every = [*metrics, *[f"{m}_langz" for m in metrics]]
    long = unpivot_metrics(scored, ["lang", row_id, "human", "audio"], every)
    views = F.array(
        F.struct(F.lit("all").alias("subset"), F.lit("human").alias("target"), F.col("human").alias("verdict")),
        F.struct(F.lit("audio_pass").alias("subset"), F.lit("human").alias("target"),
                 F.when(F.col("audio") == "pass", F.col("human")).alias("verdict")),
        F.struct(F.lit("all").alias("subset"), F.lit("audio").alias("target"), F.col("audio").alias("verdict")))
    cases = long.select("lang", row_id, "metric", "value", F.inline(views)).filter(F.col("verdict").isNotNull())
    cases = written(cases, "cases")  # read by seven statistics
    keys, passed = ["subset", "target", "metric"], F.col("verdict") == "pass"
    both = cases.groupBy(*keys, "lang").agg(F.min("verdict").alias("_a"), F.max("verdict").alias("_b")).filter("_a <> _b").select(*keys, "lang")
    inside = cases.join(both, [*keys, "lang"], "left_semi")
    named = lambda df, prefix: df.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in keys])
    parts = [
        named(pooled_auc(cases, keys, [], "value", passed), "global"),
        named(bootstrap_auc(cases, keys, [], "value", passed, draws, seed), "global"),
        named(pooled_auc(inside, keys, ["lang"], "value", passed), "within"),
        named(bootstrap_auc(inside, keys, ["lang"], "value", passed, draws, seed), "within"),
        both.groupBy(*keys).agg(F.count(F.lit(1)).alias("within_langs")),
        cases.groupBy(*keys).agg(F.avg(passed.cast("double")).alias("base_pass_rate")),
        extremes(cases, keys, "value", row_id, passed),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys, "left")
    return out


def preference_strengths(answers: DataFrame, iterations: int = 200, tolerance: float = 0.0) -> DataFrame:
    """Log strengths from pairwise answers (a, b, answer in A/B/tie), by the fixed-point update with a 0.1 prior.

    Wins and games are aggregated once. The update keeps ratios when all strengths are scaled, so the geometric mean
    is taken out once at the end instead of in every round. A round is one pass over the kept games table, cut into a task
    per ``LINK_ROWS`` links (rounds are many and short, so tasks without rows would cost most), and one checkpoint, so plans
    and lineage stay short; a positive ``tolerance`` stops once no ratio of strengths moves more.
    """
    ensure_checkpoint_dir(answers.sparkSession)
    score = F.when(F.col("answer") == "A", 1.0).when(F.col("answer") == "B", 0.0).otherwise(0.5)
    sides = answers.select(F.inline(F.array(
        F.struct(F.col("a").alias("key"), F.col("b").alias("other"), score.alias("won")),
        F.struct(F.col("b").alias("key"), F.col("a").alias("other"), (1.0 - score).alias("won")))))
    games = written(sides.groupBy("key", "other").agg(F.count(F.lit(1)).alias("games"), F.sum("won").alias("won")), "games")
    tasks = games.count() // LINK_ROWS + 1
    totals = games.groupBy("key").agg(F.sum("won").alias("wins"), F.sum("games").alias("played"))
    state = totals.withColumn("s", F.lit(1.0)).coalesce(tasks).checkpoint()
    small = state.count() <= BROADCAST_ROWS
    links = games.select("key", "other", "games").join(totals, "key").repartition(tasks, "key").persist(StorageLevel.MEMORY_AND_DISK)
    sent = F.broadcast if small else (lambda df: df)  # size known; larger tables are shuffled
    for step in range(1, iterations + 1):
        now = state.select("key", "s")
        load = links.join(sent(now.toDF("other", "so")), "other").join(sent(now), "key").groupBy("key", "wins", "played", "s").agg(
            F.sum(F.col("games") / (F.col("s") + F.col("so"))).alias("load"))
        moved = load.select("key", "wins", "played", F.col("s").alias("was"), (
            (F.col("wins") + 0.1) / (F.col("load") + F.lit(0.2) / F.col("s"))).alias("s")).persist(StorageLevel.MEMORY_AND_DISK)
        state = moved.checkpoint()  # of kept rows, as a checkpoint alone would hand down what is known of every earlier round
        moved.unpersist()
        change = F.ln("s") - F.ln("was")
        if tolerance and step % 10 == 0 and state.agg(F.max(change) - F.min(change)).first()[0] < tolerance:
            break
    links.unpersist()
    mean = state.agg(F.avg(F.ln("s")).alias("m"))
    return state.crossJoin(F.broadcast(mean)).select("key", (F.ln("s") - F.col("m")).alias("strength"), "played")


def listener_consistency(answers: DataFrame) -> DataFrame:
    """How many repeated pairs got the same winner every time."""
    winner = F.when(F.col("answer") == "tie", "tie").when(F.col("answer") == "A", F.col("a")).otherwise(F.col("b"))
    pairs = answers.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(
        F.count(F.lit(1)).alias("n"), F.min(winner).alias("first"), F.max(winner).alias("last"))
    repeated = pairs.filter("n > 1")
    return repeated.agg(F.count(F.lit(1)).alias("repeated"), F.count_if(F.col("first") == F.col("last")).alias("agree"))


def metric_agreement(answers: DataFrame) -> DataFrame:
    """Answers against the expected side: agreement on clear pairs, ties heard on close ones."""
    judged, close = F.col("expect").isNotNull(), F.col("expect") == "close"
    return answers.agg(
        F.count_if(judged & ~close).alias("clear"), F.count_if(judged & ~close & (F.col("answer") == F.col("expect"))).alias("agree"),
        F.count_if(judged & close).alias("close"), F.count_if(judged & close & (F.col("answer") == "tie")).alias("heard_tie"))
