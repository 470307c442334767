"""Sentence selection: class filter, duplicates, hash hold-out, leak guard, coverage order, per-language counts."""
from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as X
from ..functions.hashing import hash_bucket
from ..session import ensure_checkpoint_dir
from .ordering import first_per_group, grouped_scan, top_rows


def word_limits(lang: Column, limits: X.WordLimits, max_by_language: dict[str, int] | None = None) -> tuple[Column, Column]:
    """Minimum and maximum words, the maximum overridden per language by a small configured map."""
    highest = F.lit(limits.max_words)
    if max_by_language:
        table = F.create_map(*[F.lit(x) for item in max_by_language.items() for x in item])
        highest = F.coalesce(F.try_element_at(table, lang), highest)
    return F.lit(limits.min_words), highest


def classify(sentences: DataFrame, limits: X.WordLimits = X.WordLimits(),
             max_by_language: dict[str, int] | None = None) -> DataFrame:
    """Adds ``reason``: why the collapsed sentence is rejected, null if it is kept."""
    low, high = word_limits(F.col("lang"), limits, max_by_language)
    return sentences.withColumn("reason", X.reject_reason(F.col("sentence"), low, high))


def keep_first(classified: DataFrame, order: Sequence[str] = ("doc_id", "pos")) -> DataFrame:
    """Accepted sentences, the first of several equal ones in input order, with their ``hash``."""
    accepted = classified.filter(F.col("reason").isNull()).drop("reason").withColumn("hash", X.text_hash(F.col("sentence"), True))
    return first_per_group(accepted, ["lang", "hash"], list(order))


def reject_counts(classified: DataFrame) -> DataFrame:
    """Rejects per language and reason. Duplicates are accepted rows minus distinct texts, so no row is flagged and the
    sentences are read once."""
    accepted = F.col("reason").isNull()
    per_text = classified.groupBy(
        "lang", "reason", X.text_hash(F.when(accepted, F.col("sentence")), True).alias("hash")).agg(F.count(F.lit(1)).alias("copies"))
    n = F.sum(F.when(accepted, F.col("copies") - 1).otherwise(F.col("copies")))
    return per_text.groupBy("lang", "reason").agg(n.alias("n")).filter("n > 0").select(
        "lang", F.coalesce("reason", F.lit(X.DUPLICATE)).alias("reason"), "n")


def held_out(pool: DataFrame, n: int, keys: Sequence[str] = ("lang",)) -> DataFrame:
    """The ``n`` texts of each group whose hash is smallest: the same draw wherever the same text occurs."""
    return top_rows(pool, list(keys), [F.col("hash")], n, spread=F.col("hash"))


def leak_guard(pool: DataFrame, *never_train: DataFrame) -> DataFrame:
    """Drops every text that any language holds out (or that another list forbids), by normalized text."""
    blocked = never_train[0].select("hash")
    for other in never_train[1:]:
        blocked = blocked.unionByName(other.select("hash"))
    return pool.join(blocked.distinct(), "hash", "left_anti")


def split_by_hash(items: DataFrame, item_id: str, count: int) -> DataFrame:
    """Adds ``split``: the ``count`` rows whose ID hashes lowest are ``validation``, whatever the shard order."""
    hashed = items.withColumn("_digest", F.sha1(F.col(item_id).cast("string").cast("binary")))
    held = top_rows(hashed.select(item_id, "_digest"), [], [F.col("_digest")], count, spread=F.col(item_id)).select(
        item_id, F.lit("validation").alias("split"))
    return hashed.drop("_digest").join(held, item_id, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def selection_counts(pool: DataFrame, held: DataFrame, blocked: DataFrame, train: int) -> DataFrame:
    """Per language: texts without symbols (not ``usable``), held out, left to train on, and taken."""
    flagged = (
        pool.select("lang", "hash", "usable")
        .join(held.select("lang", "hash", F.lit(True).alias("held")), ["lang", "hash"], "left")
        .join(blocked.select("hash").distinct().withColumn("blocked", F.lit(True)), "hash", "left")
    )
    open_row = F.col("usable") & F.col("blocked").isNull()
    return flagged.groupBy("lang").agg(
        F.count_if(~F.col("usable")).alias("untokenizable"), F.count_if(F.col("held").isNotNull()).alias("held_out"),
        F.count_if(open_row).alias("train_pool"),
    ).withColumn("train", F.least("train_pool", F.lit(train)).cast("bigint"))


def length_rank(sentences: DataFrame, keys: Sequence[str], length: Column, position: Sequence[str]) -> DataFrame:
    """1-based ``rank`` of every row by length, then position, inside its group (sizes in ``group_rows``)."""
    tagged = sentences.withColumn("_length", length)
    ranked = grouped_scan(
        tagged, list(keys), [F.col("_length"), *[F.col(p) for p in position]],
        F.format_string("%012d-%012d", F.col("_length").cast("bigint"),
                        F.floor(F.col(position[0]) / F.lit(10_000)).cast("bigint")), rank="rank")
    sizes = sentences.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"))
    return ranked.drop("_length").join(sizes, list(keys))


def from_lower_quartile(sentences: DataFrame, keys: Sequence[str], length: Column, position: Sequence[str]) -> DataFrame:
    """Rows from the lower length quartile up, in length order (``rank`` starts at 1 after the skipped quarter)."""
    ranked = length_rank(sentences, keys, length, position)
    skipped = F.floor(F.col("group_rows") / 4)
    return ranked.filter(F.col("rank") > skipped).withColumn("rank", (F.col("rank") - skipped).cast("bigint")).drop("group_rows")


# Voice codes whose sentences are listed under another run name.
RUN_NAMES = {"zh": "cmn"}


def run_of_voice(voices: DataFrame, sentences: DataFrame) -> DataFrame:
    """(espeak, lang): the run whose sentences a voice reads: its own, else its base language's; none, no row."""
    named = F.col("espeak")
    for code, run in RUN_NAMES.items():
        named = F.when(F.col("espeak") == code, run).otherwise(named)
    asked = voices.select("espeak").distinct().withColumn("_own", named).withColumn("_base", F.element_at(F.split("_own", "-"), 1))
    runs = sentences.select("lang").distinct()
    own = asked.join(runs.select(F.col("lang").alias("_own"), F.col("lang").alias("_a")), "_own", "left")
    both = own.join(runs.select(F.col("lang").alias("_base"), F.col("lang").alias("_b")), "_base", "left")
    return both.select("espeak", F.coalesce("_a", "_b").alias("lang")).filter(F.col("lang").isNotNull())


def _gain(symbols: Column, counts: Column) -> Column:
    one = F.lit(1.0)
    return F.aggregate(symbols, F.lit(0.0), lambda acc, s: acc + one / (one + F.coalesce(F.try_element_at(counts, s), F.lit(0))))


def greedy_order(pool: DataFrame, n: int, block: int = 2000, key: str = "lang") -> DataFrame:
    """Coverage order: repeatedly the text whose symbols are rarest among those taken, worth the sum of 1/(1+count).

    A worth only falls as counts rise, so a worth computed earlier bounds it from above. Each pass scores the whole
    pool with the current counts in Spark and brings the best ``block`` rows of each group, plus the key of the next
    one as limit; rows are taken from them while the best up-to-date key stays within the limit. The result equals
    taking one row at a time over the whole pool; the driver holds ``block`` rows and ``n`` hashes per group.
    """
    spark = pool.sparkSession
    ensure_checkpoint_dir(spark)
    ready = pool.filter(F.col("symbols").isNotNull()).select(
        key, "hash", F.array_sort(F.array_distinct("symbols")).alias("symbols"))
    ready = ready.persist(StorageLevel.MEMORY_AND_DISK)
    counts: dict[str, dict[int, int]] = {r[0]: {} for r in ready.select(key).distinct().collect()}
    taken: dict[str, list[str]] = {k: [] for k in counts}
    open_keys = set(counts)
    count_schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("counts", T.MapType(T.IntegerType(), T.IntegerType()))])
    done_schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("hash", T.StringType())])
    while open_keys:
        now = spark.createDataFrame([(k, counts[k]) for k in open_keys], count_schema)
        done = spark.createDataFrame([(k, h) for k in open_keys for h in taken[k]], done_schema)
        scored = ready.join(F.broadcast(now), key).join(done, [key, "hash"], "left_anti").withColumn(
            "gain", _gain(F.col("symbols"), F.col("counts"))).drop("counts")
        best = top_rows(scored, [key], [F.desc("gain"), F.col("hash")], block + 1, spread=F.col("hash"))
        rows: dict[str, list] = {k: [] for k in open_keys}
        for r in best.collect():
            rows[r[key]].append((-r["gain"], r["hash"], r["symbols"]))
        for k in list(open_keys):
            heap = sorted(rows[k], key=lambda x: x[:2])
            limit = heap.pop()[:2] if len(heap) > block else None
            seen = counts[k]
            while heap and len(taken[k]) < n:
                _, digest, symbols = heapq.heappop(heap)
                gain = 0.0
                for s in symbols:
                    gain += 1.0 / (1.0 + seen.get(s, 0))
                fresh = (-gain, digest)
                if heap and fresh > heap[0][:2]:
                    heapq.heappush(heap, (*fresh, symbols))
                    continue
                if limit is not None and fresh > limit:
                    break
                taken[k].append(digest)
                for s in symbols:
                    seen[s] = seen.get(s, 0) + 1
            if len(taken[k]) >= n or (limit is None and not heap):
                open_keys.discard(k)
    ready.unpersist()
    schema = T.StructType([*done_schema, T.StructField("rank", T.IntegerType())])
    return spark.createDataFrame([(k, h, i + 1) for k in taken for i, h in enumerate(taken[k])], schema)


def hash_ordered(df: DataFrame, keys: Sequence[str], digest: str, rank: str) -> DataFrame:
    """Adds the rank along a hex digest column inside each group; buckets come from the digest's leading digits."""
    return grouped_scan(df, list(keys), [F.col(digest)], hash_bucket(F.col(digest)), rank=rank)
