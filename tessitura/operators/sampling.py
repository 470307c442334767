"""Language-balanced sampling plans and epochs of length-bucketed batches."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.hashing import hash_bucket, hex_hash, unit_hash
from ..session import written
from .checks import require_empty
from .ordering import first_after, grouped_scan

MICRO = 1_000_000  # weights and seconds are summed as whole millionths, so sums do not depend on their order


@dataclass(frozen=True)
class EpochOptions:
    batch_size: int
    batches: int
    bucket_batches: int
    languages_per_batch: int
    seed: int
    epoch: int = 0
    world_size: int = 1


def language_mass(items: DataFrame, strict: bool = True) -> DataFrame:
    """(lang, items, hours, mass, weight): mass proportional to the square root of the hours."""
    if strict:
        bad = items.filter(F.col("weight").isNull() | F.col("seconds").isNull() | (F.col("weight") <= 0) | (F.col("seconds") <= 0))
        require_empty(bad.select("id"), "weights and durations must be positive")
    whole = lambda c: F.sum(F.round(F.col(c) * MICRO).cast("bigint")) / float(MICRO)
    per = items.groupBy("lang").agg(
        F.count(F.lit(1)).alias("items"), (whole("seconds") / 3600.0).alias("hours"), whole("weight").alias("weight_sum"))
    # One row a language: added up in their order, so that masses, and with them the draws, never differ by a rounding.
    roots = F.transform(F.array_sort(F.collect_list(F.struct("lang", "hours"))), lambda x: F.sqrt(x["hours"]))
    total = per.agg(F.aggregate(roots, F.lit(0.0), lambda a, x: a + x).alias("_root"))
    return per.crossJoin(F.broadcast(total)).select("lang", "items", "hours", "weight_sum", (F.sqrt("hours") / F.col("_root")).alias("mass"))


def item_probabilities(items: DataFrame, strict: bool = True) -> DataFrame:
    """(id, lang, mass, p_within, p): marginal probability when one language is drawn per item."""
    mass = language_mass(items, strict)
    within = F.col("weight") / F.col("weight_sum")
    return items.join(mass, "lang").select("id", "lang", "mass", within.alias("p_within"), (F.col("mass") * within).alias("p"))


def chosen_languages(mass: DataFrame, o: EpochOptions) -> DataFrame:
    """(batch, slot, lang): ``languages_per_batch`` distinct languages per batch, drawn by mass without replacement.

    The smallest exponential keys -ln(u)/mass win (Efraimidis and Spirakis 2006). The language list travels as one
    array row; nothing is crossed with the batches.
    """
    spark = mass.sparkSession
    listed = mass.agg(F.array_sort(F.collect_list(F.struct("lang", "mass"))).alias("langs"))
    enough = F.when(F.size("langs") < o.languages_per_batch, F.raise_error(F.lit("fewer languages than languages_per_batch"))).otherwise(F.col("langs"))
    batches = spark.range(o.batches).select(F.col("id").alias("batch")).crossJoin(F.broadcast(listed.select(enough.alias("langs"))))
    keyed = F.transform("langs", lambda x: F.struct(
        (-F.ln(F.greatest(unit_hash(o.seed, o.epoch, "language", F.col("batch"), x["lang"]), F.lit(1e-300))) / x["mass"]).alias("k"), x["lang"].alias("lang")))
    return batches.select("batch", F.posexplode(F.slice(F.array_sort(keyed), 1, o.languages_per_batch)).alias("slot", "_x")).select(
        "batch", "slot", F.col("_x.lang").alias("lang"))


def draw_items(items: DataFrame, slots: DataFrame, o: EpochOptions) -> DataFrame:
    """(batch, slot, j, lang, id, length): items of each slot's language drawn by weight with replacement.

    A draw is a point on the language's cumulated weight; draws and items meet in buckets of that weight.
    """
    base, extra = divmod(o.batch_size, o.languages_per_batch)
    size = F.lit(base) + F.when(F.col("slot") < extra, 1).otherwise(0)
    draws = slots.select("batch", "slot", "lang", F.explode(F.sequence(F.lit(0), size - 1)).alias("j"))
    micro = F.round(F.col("weight") * MICRO).cast("bigint")
    weighted = items.select("id", "lang", "length", micro.alias("_w")).withColumn("_digest", hex_hash(o.seed, "item", F.col("id")))
    # Read three times below: once for all, or every plan that uses the draws would hold the whole scan as often.
    run = written(grouped_scan(weighted, ["lang"], [F.col("_digest"), F.col("id")], hash_bucket(F.col("_digest")), rank="item", sums={"value": F.col("_w")}).select(
        "lang", "value", "item", "id", "length"), "weights")
    totals = weighted.groupBy("lang").agg(F.sum("_w").alias("_total"))
    u = unit_hash(o.seed, o.epoch, "item", F.col("batch"), F.col("slot"), F.col("j"))
    targets = draws.join(totals, "lang").select(
        "lang", F.least(F.floor(u * F.col("_total")).cast("bigint"), F.col("_total") - 1).alias("value"), F.struct("batch", "slot", "j").alias("ask"))
    width = MICRO * 20_000
    found = first_after(run.select("lang", "value", "item"), targets, ["lang"], lambda v: F.floor(v / width).cast("bigint"), strict=True)
    return found.join(run.select("lang", "item", "id", "length"), ["lang", "item"]).select("ask.*", "lang", "id", "length")


def deal_by_length(drawn: DataFrame, o: EpochOptions) -> DataFrame:
    """Inside a group of batches each language's draws are sorted by length and dealt to its slots in batch order.

    A (group, language) holds at most ``bucket_batches * batch_size`` rows, so plain windows are enough here.
    """
    grouped = drawn.withColumn("grp", F.floor(F.col("batch") / o.bucket_batches))
    part = Window.partitionBy("grp", "lang")
    by_length = grouped.select("grp", "lang", "id", "length", F.row_number().over(
        part.orderBy("length", hex_hash(o.seed, o.epoch, "tie", F.col("batch"), F.col("slot"), F.col("j")))).alias("_n"))
    seats = grouped.select("grp", "lang", "batch", "slot", "j", F.row_number().over(part.orderBy("batch", "slot", "j")).alias("_n"))
    return seats.join(by_length, ["grp", "lang", "_n"]).select("grp", "batch", "slot", "j", "lang", "id", "length")


def plan_epoch(items: DataFrame, o: EpochOptions) -> DataFrame:
    """One row per drawn item: (rank, step, batch, slot, j, lang, id, length), a function of (seed, epoch) alone."""
    if not 1 <= o.languages_per_batch <= o.batch_size:
        raise ValueError(f"languages_per_batch {o.languages_per_batch} must be within 1..{o.batch_size}")
    slots = chosen_languages(language_mass(items), o)
    dealt = deal_by_length(written(draw_items(items, slots, o), "drawn"), o)
    batches = items.sparkSession.range(o.batches).select(F.col("id").alias("batch")).withColumn(
        "_digest", hex_hash(o.seed, o.epoch, "order", F.col("batch")))
    order = grouped_scan(batches, [], [F.col("_digest")], hash_bucket(F.col("_digest")), rank="_n").select(
        "batch", ((F.col("_n") - 1) % o.world_size).alias("rank"), F.floor((F.col("_n") - 1) / o.world_size).alias("step"))
    return dealt.join(order, "batch").select("rank", "step", "batch", "slot", "j", "lang", "id", "length")


def collate(rows: DataFrame, batch: str, order: str) -> DataFrame:
    """Padded layout of each batch: ID and duration arrays padded with 0, lengths, rows with and without durations,
    and the rows of every language. A batch is small by construction."""
    packed = rows.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(order, "lang", "phoneme_ids", "durations"))).alias("e"))
    width = F.array_max(F.transform("e", lambda e: F.size(e["phoneme_ids"])))
    pad = lambda x: F.concat(F.coalesce(x, F.array().cast("array<int>")), F.array_repeat(F.lit(0), F.col("w") - F.coalesce(F.size(x), F.lit(0))))
    sized = packed.withColumn("w", width)
    places = F.sequence(F.lit(0), F.size("e") - 1)
    rows_where = lambda test: F.filter(places, lambda i: test(F.try_element_at("e", i + 1)))
    langs = F.array_sort(F.array_distinct(F.transform("e", lambda e: e["lang"])))
    return sized.select(
        batch, F.transform("e", lambda e: F.size(e["phoneme_ids"])).alias("phoneme_lengths"),
        F.transform("e", lambda e: pad(e["phoneme_ids"])).alias("phoneme_ids"),
        F.transform("e", lambda e: F.when(e["durations"].isNull(), F.array_repeat(F.lit(0), F.col("w"))).otherwise(pad(e["durations"]))).alias("durations"),
        rows_where(lambda e: e["durations"].isNotNull()).alias("teacher_rows"), rows_where(lambda e: e["durations"].isNull()).alias("searched_rows"),
        F.transform(langs, lambda l: F.struct(l.alias("lang"), F.filter(places, lambda i: F.try_element_at("e", i + 1)["lang"] == l).alias("rows"))).alias("language_rows"))


def language_report(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hours, sampled share and number of speakers per language."""
    speakers = pairs.select("lang", "speaker").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("speakers"))
    return language_mass(items).join(speakers, "lang").select("lang", "hours", F.col("mass").alias("sampled"), "speakers")
