"""Symbol statistics per run, pooled mass, rare symbols, map differences and greedy language cover."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import symbols as Y
from ..session import ensure_checkpoint_dir


def piece_counts(texts: DataFrame, run: str, text: str) -> DataFrame:
    """(run, piece, n): distinct space-terminated pieces. Everything below works on them, weighted by ``n``."""
    return texts.select(F.col(run).alias("run"), F.explode(Y.pieces(F.col(text))).alias("piece")).filter(
        F.col("piece") != "").groupBy("run", "piece").agg(F.count(F.lit(1)).alias("n"))


def _known(piece: Column, reference: Sequence[str]) -> Column:
    return F.regexp_replace(piece, f"[^{Y.char_class(reference)}]", "")


def symbol_counts(pieces: DataFrame, reference: Sequence[str]) -> DataFrame:
    """(run, symbol, known, n): every character, and whether the reference alphabet has it."""
    known = F.col("symbol").rlike(f"^[{Y.char_class(reference)}]$")
    return pieces.select("run", "n", F.explode(Y.characters(F.col("piece"))).alias("symbol")).groupBy("run", "symbol").agg(
        F.sum("n").alias("n")).withColumn("known", known)


def with_category(counts: DataFrame) -> DataFrame:
    return counts.withColumn("category", Y.category(F.col("symbol"), F.col("run")))


def shares(counts: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """Adds ``share`` of the count inside ``keys``."""
    totals = counts.groupBy(*keys).agg(F.sum(n).alias("_total"))
    return counts.join(totals, list(keys)).withColumn("share", F.col(n) / F.col("_total")).drop("_total")


def bigram_counts(pieces: DataFrame, reference: Sequence[str]) -> DataFrame:
    """(run, first, second, n): adjacent phonemes of a word, marks skipped, spaces and punctuation breaking it."""
    tone = (F.col("run").isin(*Y.TONE_EPSILON_RUNS))
    keep = lambda c: c.rlike(r"^[\p{L}&&[^\p{Lm}]]$") & ~(tone & (c == Y.TONE_EPSILON))
    breaks = lambda c: c.rlike(r"^[\p{P}\p{Z}\p{S}]$") & ~c.rlike("^[↑↓]$")
    pairs = Y.adjacent_pairs(Y.characters(_known(F.col("piece"), reference)), keep, breaks)
    return pieces.select("run", "n", F.inline(pairs)).groupBy("run", "first", "second").agg(F.sum("n").alias("n"))


def inword_markers(pieces: DataFrame, reference: Sequence[str]) -> DataFrame:
    """(run, symbol, n): reference punctuation used inside a word."""
    marker = lambda c: c.rlike(f"^[{Y.char_class(reference)}]$") & c.rlike(r"^[\p{P}\p{Z}\p{S}]$") & ~c.rlike(r"^[\^$_↑↓]$")
    return pieces.select("run", "n", F.explode(Y.inner_markers(Y.characters(F.col("piece")), marker)).alias("symbol")).groupBy(
        "run", "symbol").agg(F.sum("n").alias("n"))


def pooled_mass(shares_: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over all runs of each run's share: every run weighs the same."""
    total = runs.select("run").distinct().agg(F.count(F.lit(1)).alias("_runs"))
    return shares_.groupBy(*keys).agg(F.sum("share").alias("_sum")).crossJoin(F.broadcast(total)).select(
        *keys, (F.col("_sum") / F.col("_runs")).alias("mass"))


def run_table(texts: DataFrame, run: str, categorized: DataFrame, dropped: DataFrame, bigrams: DataFrame) -> DataFrame:
    """One row per run: sentences, tokens, types, tones, specials, dropped characters, bigram types."""
    is_ = lambda name: F.col("category") == name
    n_if = lambda test, name: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias(name)
    sizes = texts.groupBy(F.col(run).alias("run")).agg(F.count(F.lit(1)).alias("sentences"))
    kinds = categorized.groupBy("run").agg(
        n_if(is_("phoneme"), "phoneme_tokens"), F.count_if(is_("phoneme")).alias("phoneme_types"),
        F.count_if(is_("supra_diacritic")).alias("supra_types"), n_if(is_("tone_digit"), "tone_mark_tokens"),
        n_if(F.col("symbol").isin("^", "$", "_"), "bos_eos_pad_tokens"))
    lost = dropped.groupBy("run").agg(F.sum("n").alias("dropped_chars"))
    pairs = bigrams.groupBy("run").agg(F.count(F.lit(1)).alias("phoneme_bigram_types"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in (
        "phoneme_tokens", "phoneme_types", "supra_types", "tone_mark_tokens", "bos_eos_pad_tokens", "dropped_chars", "phoneme_bigram_types")]
    return sizes.join(kinds, "run", "left").join(lost, "run", "left").join(pairs, "run", "left").select("run", "sentences", *zero)


def rare_symbols(categorized: DataFrame, main_runs: Column, limit: int = 2) -> DataFrame:
    """Phonemes and marks used by at most ``limit`` runs of either universe, with their runs by falling count."""
    used = categorized.filter(F.col("category").isin("phoneme", "supra_diacritic"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("run"))))
    grouped = used.groupBy("symbol").agg(
        F.count_if(main_runs).alias("n_main_runs"), F.count(F.lit(1)).alias("n_all_runs"), listed.alias("_l"))
    return grouped.filter((F.col("n_main_runs") <= limit) | (F.col("n_all_runs") <= limit)).select(
        "symbol", Y.code_point(F.col("symbol")).alias("codepoint"), Y.category(F.col("symbol")).alias("category"), "n_main_runs", "n_all_runs",
        F.array_join(F.transform("_l", lambda x: F.concat(x["run"], F.lit(":"), (-x["m"]).cast("string"))), " ").alias("runs_with_counts"))


def symbol_table(maps: DataFrame, reference: DataFrame) -> DataFrame:
    """Union of all voice maps (voice, symbol, id): code point, category, reference ID, voices that have it."""
    union = maps.select("voice", "symbol").distinct().groupBy("symbol").agg(F.count(F.lit(1)).alias("voices_with_symbol"))
    return union.join(reference.select("symbol", "id"), "symbol", "left").select(
        "symbol", Y.code_point(F.col("symbol")).alias("codepoint"), Y.category(F.col("symbol")).alias("category"), "id",
        F.col("id").isNotNull().alias("in_reference"), "voices_with_symbol")


def map_differences(maps: DataFrame, reference: DataFrame) -> DataFrame:
    """Per voice: symbols beyond the reference, missing from it, and with another ID, each as a sorted list.

    A voice's own symbols are one array (an alphabet), the reference travels as one row of arrays.
    """
    known = maps.select("voice", "symbol", "id").join(reference.select("symbol", F.col("id").alias("ref_id")), "symbol", "left")
    voices = known.groupBy("voice").agg(
        F.collect_list("symbol").alias("_all"), F.collect_list(F.when(F.col("ref_id").isNull(), F.col("symbol"))).alias("_extra"),
        F.collect_list(F.when(F.col("id") != F.col("ref_id"), F.col("symbol"))).alias("_other"))
    whole = reference.agg(F.collect_list("symbol").alias("_reference"))
    missing = F.array_except("_reference", "_all")
    shown = lambda x: F.array_join(F.array_sort(x), " ")
    return voices.crossJoin(F.broadcast(whole)).select(
        "voice", F.size("_all").cast("bigint").alias("n_symbols"), (F.size(F.concat("_extra", "_other", missing)) == 0).alias("same_as_reference"),
        shown(F.col("_extra")).alias("extra_vs_reference"), shown(missing).alias("missing_vs_reference"), shown(F.col("_other")).alias("id_conflicts"))


def greedy_cover(types: DataFrame, pairs: DataFrame, marks: DataFrame, objective: str = "types") -> DataFrame:
    """Order in which runs cover the phoneme inventory, and what is covered after each step.

    ``types`` (run, symbol, share), ``pairs`` (run, symbol, share) and ``marks`` (run, symbol, share) are aggregated
    tables: runs times alphabet. Each step is one aggregation; the driver sees one row per remaining run.
    """
    spark = types.sparkSession
    ensure_checkpoint_dir(spark)
    runs = types.select("run").distinct()
    tables = {}
    for name, table in (("types", types), ("pairs", pairs), ("marks", marks)):
        table = table.join(runs, "run", "left_semi")
        mass = pooled_mass(table, runs, ["symbol"])
        tables[name] = table.select("run", "symbol").join(mass, "symbol").checkpoint()
    remaining = {r[0] for r in runs.collect()}
    picked: list[str] = []
    while remaining:
        def open_(name: str) -> DataFrame:
            table = tables[name].filter(F.col("run").isin(*remaining))
            return table.join(tables[name].filter(F.col("run").isin(*picked)).select("symbol"), "symbol", "left_anti") if picked else table
        gain = open_("types").groupBy("run").agg(F.count(F.lit(1)).alias("new"), F.sum("mass").alias("mass"))
        pair_gain = open_("pairs").groupBy("run").agg(F.sum("mass").alias("pair_mass"))
        rows = {r["run"]: r for r in gain.join(pair_gain, "run", "full_outer").collect()}

        def worth(run: str) -> tuple:
            row = rows.get(run)
            new, mass, pair = ((row[c] or 0) for c in ("new", "mass", "pair_mass")) if row else (0, 0.0, 0.0)
            return (new, round(mass, 12), round(pair, 12), run) if objective == "types" else (round(mass, 12), new, round(pair, 12), run)
        best = max(remaining, key=worth)
        remaining.discard(best)
        picked.append(best)
    order = spark.createDataFrame([(i + 1, r) for i, r in enumerate(picked)], "k int, run string")
    out, steps = order, Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    for name in tables:
        first = tables[name].join(order, "run").groupBy("symbol").agg(F.min("k").alias("k"), F.first("mass").alias("mass"))
        total = first.agg(F.count(F.lit(1)).alias("_all"))
        added = first.groupBy("k").agg(F.count(F.lit(1)).alias("_new"), F.sum("mass").alias("_mass"))
        part = order.join(added, "k", "left").crossJoin(F.broadcast(total)).select(
            "k", F.coalesce("_new", F.lit(0)).alias(f"new_{name}"), F.try_divide(F.sum(F.coalesce("_new", F.lit(0))).over(steps), F.col("_all")).alias(f"{name}_cov"),
            F.sum(F.coalesce("_mass", F.lit(0.0))).over(steps).alias(f"{name}_mass_cov"))
        out = out.join(part, "k")
    return out


def steps_to_reach(steps: DataFrame, measure: str, thresholds: Sequence[float]) -> DataFrame:
    """First step at which a coverage measure reaches each threshold."""
    return steps.select(F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"), "k", measure).filter(
        F.col(measure) >= F.col("threshold") - 1e-12).groupBy("threshold").agg(F.min("k").alias("k")).withColumn("measure", F.lit(measure))
