"""URL filters by association rules: listed rules decide first, mined rules decide the rest.

Column functions, DataFrame operations and Spark's FP-growth only. A url is cut into a set of tokens (host labels, path segments with
digit runs as ``#``, query names). FP-growth mines the sets of labelled urls together with their label; rules ``tokens -> label`` of
enough support and confidence are kept unless a rule with one token less says the same with no less confidence. Rules are posted under
their rarest token; every distinct set of tokens is looked up once.

A null url, or one without ``://``, has an empty host and path and no tokens; a url that no rule fits is allowed. Repeated rows keep a
row each. Columns named like an added one are replaced.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from .common import lower_ascii, need, replacing

BLOCK, ALLOW = "block", "allow"
SALTS = 64


@dataclass(frozen=True)
class Rule:
    """A listed rule: ``where`` is a host and the beginning of a path (``net/``)."""
    verdict: str
    where: str

    @property
    def host(self) -> str:
        return self.where.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.where.split("/", 1)[1]


@dataclass(frozen=True)
class Mining:
    """Least share of labelled urls that a rule's tokens and label must have together, and least confidence."""
    min_support: float = 0.01
    min_confidence: float = 0.9


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The sorted distinct tokens of a url."""
    query = F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1), F.lit(""))

    def named(mark: str, parts: Column, form=lambda x: x) -> Column:
        return F.transform(F.filter(F.transform(parts, form), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    return F.array_sort(F.array_distinct(F.concat(
        named("host:", F.split(host_of(url), r"\.", -1)),
        named("path:", F.split(path_of(url), "/", -1), lambda x: F.regexp_replace(x, "[0-9]+", "#")),
        named("query:", F.split(query, "&", -1), lambda x: F.substring_index(x, "=", 1)))))


def listed(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, else nulls. The list is a parameter of the caller, of hundreds at most."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda x: (len(x.where), x.where)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.where).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def mine(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """Rules (``antecedent`` sorted, ``verdict``, ``confidence``, ``n``: urls with tokens and label, ``rarest``) from all rows of
    (tokens, verdict). A label that is neither block nor allow is not mined."""
    marks = F.array(F.concat(F.lit("label:"), "verdict"))
    baskets = labelled.filter(F.col("verdict").isin(BLOCK, ALLOW)).select(F.concat("tokens", marks).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=mining.min_support, minConfidence=mining.min_confidence).fit(baskets)
    sets = written(model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n")), "itemsets")
    label = F.filter("items", lambda x: x.startswith("label:"))
    both = sets.filter((F.size(label) == 1) & (F.size("items") > 1)).select(
        F.filter("items", lambda x: ~x.startswith("label:")).alias("antecedent"), F.substr(label[0], F.lit(7)).alias("verdict"), "n")
    rules = both.join(sets.select(F.col("items").alias("antecedent"), F.col("n").alias("n_tokens")), "antecedent").select(
        "antecedent", "verdict", "n", (F.col("n").cast("double") / F.col("n_tokens")).alias("confidence")).filter(
        F.col("confidence") >= mining.min_confidence)
    return _posted(written(_pruned(rules), "url-rules"), sets)


def _pruned(rules: DataFrame) -> DataFrame:
    """Without rules that say no more than one with a token less: such a rule never wins against the shorter one."""
    fewer = rules.filter(F.size("antecedent") > 1).withColumn("dropped", F.explode("antecedent")).select(
        F.col("antecedent").alias("whole"), F.array_remove("antecedent", F.col("dropped")).alias("antecedent"), "verdict",
        F.col("confidence").alias("own"))
    idle = fewer.join(rules.select("antecedent", "verdict", "confidence"), ["antecedent", "verdict"]).filter(
        F.col("confidence") >= F.col("own")).select(F.col("whole").alias("antecedent"), "verdict").distinct()
    return rules.join(idle, ["antecedent", "verdict"], "left_anti")


def _posted(rules: DataFrame, sets: DataFrame) -> DataFrame:
    """The inverted index: each rule once, under its token of fewest urls (ties: first in order)."""
    single = sets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("n").alias("n_token"))
    each = rules.withColumn("token", F.explode("antecedent")).join(single, "token")
    return each.groupBy("antecedent", "verdict", "confidence", "n").agg(F.min(F.struct("n_token", "token"))["token"].alias("rarest"))


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(known, verdict, mined) for distinct sets ``known`` that a rule fits: the rule of most confidence, then urls, then fewest
    tokens, then the first in order."""
    posted = sets.withColumn("rarest", F.explode("known")).join(rules, "rarest").filter(
        F.size(F.array_except("antecedent", "known")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("n")).alias("n"), F.size("antecedent").alias("k"),
                          F.array_join("antecedent", " ").alias("mined"), F.col("verdict").alias("said")))
    return posted.groupBy("known").agg(best.alias("b")).select("known", F.col("b.said").alias("said"), F.col("b.mined").alias("mined"))


def judge(pages: DataFrame, rules: Sequence[Rule], labels: DataFrame | None = None, mining: Mining = Mining(), url: str = "url") -> DataFrame:
    """The rows with ``host``, ``path``, ``rule`` (listed, else null), ``verdict`` and ``mined`` (the tokens of the mined rule that
    decided, else null).

    ``labels``: rows of (url, verdict) to mine; without them, the urls that listed rules decide are the labels.
    """
    need(pages, url)
    pages = replacing(pages, "host", "path", "rule", "verdict", "mined", "_said", "_known", "_salt")
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, said = listed(host, path, rules)
    rows = pages.select("*", host.alias("host"), path.alias("path"), rule.alias("rule"), said.alias("_said"))
    if labels is None:
        labelled = rows.filter("_said IS NOT NULL").select(tokens_of(F.col(url)).alias("tokens"), F.col("_said").alias("verdict"))
    else:
        labelled = labels.select(tokens_of(F.col("url")).alias("tokens"), "verdict")
    mined = written(mine(labelled, mining), "url-index")
    # Tokens of rules are frequent ones, at most (tokens of a url) / min_support of them: one row that every task may hold.
    used = mined.select(F.explode("antecedent").alias("t")).agg(F.array_sort(F.collect_set("t")).alias("_used"))
    open_ = F.when(F.col("_said").isNull(), F.array_intersect(tokens_of(F.col(url)), "_used"))
    salt = F.pmod(F.xxhash64(F.col(url), F.monotonically_increasing_id()), F.lit(SALTS))
    rows = rows.crossJoin(F.broadcast(used)).withColumn("_known", open_).withColumn("_salt", salt).drop("_used")
    found = match(rows.filter("_known IS NOT NULL").select(F.col("_known").alias("known")).distinct(), mined)
    spread = found.select(F.col("known").alias("_known"), "said", "mined", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("_salt"))
    return rows.join(spread, ["_known", "_salt"], "left").select(
        *pages.columns, "host", "path", "rule", F.coalesce("_said", "said", F.lit(ALLOW)).alias("verdict"), "mined")
