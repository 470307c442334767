"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations only read the bits.

Column functions only. A null text has no words; all measurements cover the whole text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, need, replacing

BLANKS = r"[\x20\x09-\x0D]+"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words")

#: Rules in bit order; each is true where the text fails. New rules go to the end, so that stored bits keep their sense.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 10 * n_words",
    "few_letters": "100 * n_letter_words < 80 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
}
BASE = ("few_words", "repeated_windows")

#: Policies by version: the rules that reject.
POLICIES = {"base": BASE, "v1": tuple(RULES)}


def mask(rules) -> int:
    order = list(RULES)
    return sum(1 << order.index(r) for r in rules)


def _repeated(words: Column, n: Column) -> Column:
    """Words inside 3-word windows found twice or more: sort window hashes (64 bits) with positions, keep equal neighbours."""
    grams = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(
        F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("p")))

    def covered(g: Column) -> Column:
        twice = F.filter(g, lambda x, i: (x["h"] == F.get(g, i - 1)["h"]) | (x["h"] == F.get(g, i + 1)["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

    return F.when(n < 4, F.lit(0)).otherwise(let(F.array_sort(grams), covered))


def measures(text: Column) -> Column:
    """A struct of all measurements of a text."""
    def of_words(w: Column) -> Column:
        n = F.size(w)
        return F.struct(
            n.cast("bigint").alias("n_words"), F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _repeated(w, n).cast("bigint").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.rlike(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"))).cast("bigint").alias("n_letter_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("bigint").alias("n_lines"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"))

    words = let(F.filter(F.split(text, BLANKS, -1), lambda x: x != ""), of_words)
    lines = let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines)
    symbols = F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint")
    return F.struct(words.alias("w"), lines.alias("l"), symbols.alias("n_symbols"))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with all measurements and ``fail_bits``: bit k is 1 where rule k of ``RULES`` fails.

    Repeated rows and null or empty texts keep a row each (the latter fail ``few_words`` and have all measurements 0).
    Columns named like a measurement are replaced.
    """
    need(docs, text)
    docs = replacing(docs, *MEASURES, "fail_bits", "_m")
    measured = docs.withColumn("_m", F.explode(F.array(measures(F.coalesce(F.col(text), F.lit("")).cast("string")))))
    parts = {"n_symbols": "_m.n_symbols", **{k: f"_m.l.{k}" for k in ("n_lines", "n_dup_lines")},
             **{k: f"_m.w.{k}" for k in ("n_words", "word_chars", "n_repeat_words", "n_letter_words")}}
    flat = measured.select(*docs.columns, *[F.col(parts[k]).alias(k) for k in MEASURES])
    bits = F.lit(0)
    for k, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)))
    return flat.withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, version: str = "v1", into: str = "kept") -> DataFrame:
    """Adds whether no rule of the policy failed, from the stored bits alone."""
    return rows.withColumn(into, F.col("fail_bits").bitwiseAND(mask(POLICIES[version])) == 0)


def ablations(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Per rule of a policy: rows that fail it, and rows that only it rejects (kept if the rule were dropped)."""
    inside = mask(POLICIES[version])
    spectrum = rows.groupBy(F.col("fail_bits").bitwiseAND(inside).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    table = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << k).alias("bit"))
                                for k, r in enumerate(RULES) if r in POLICIES[version]])).alias("r")
    hit = F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)
    only = F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)
    return spectrum.select("bits", "n", table).groupBy("r.rule").agg(
        F.sum(hit).cast("bigint").alias("n_failed"), F.sum(only).cast("bigint").alias("n_only"))
