"""The corpus pipeline: quality rules, near copies, repeated passages, benchmark leaks, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return its columns. Columns
beyond doc_id, text and n_chars are carried along, whatever their names; null, empty and repeated rows are rows like any.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessitura.llm import bpe, decontam, rules, simhash, suffixes
from tessitura.session import written
from tessitura.sources.tables import read_table

#: SQL cannot express SimHash and byte-pair merges; the stages are held against brute force in tests.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and text beside ``others`` (every other column), so that no operator meets a column of its own names."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("others"))


def _unpacked(rows: DataFrame, docs: DataFrame, **replaced) -> DataFrame:
    return rows.select(*[replaced[c] if c in replaced else F.col(c) if c in ("doc_id", "text") else F.col("others").getField(c).alias(c)
                         for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v1 rejects; a null or blank text has too few words."""
    judged = rules.apply_policy(rules.ledger(_packed(docs)), "v1")
    return _unpacked(judged.filter("kept"), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest doc_id (of equal ids, the smallest hash of the text).

    Rows that repeat id and text are copies too: the one whose columns come first as JSON stays. Null ids come first.
    """
    key = F.struct(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    groups = written(simhash.near_copies(docs.select(key.alias("key"), "text"), key="key"), "near-copies")
    stays = groups.filter(F.col("key").eqNullSafe(F.col("component"))).groupBy("key").agg(F.count(F.lit(1)).alias("times")).select(
        F.col("key.doc_id").alias("id"), F.col("key.h").alias("hash"), "times")
    rows = docs.select(key.alias("key"), F.struct(*docs.columns).alias("row"))
    met = rows.join(stays, F.col("key.doc_id").eqNullSafe(F.col("id")) & (F.col("key.h") == F.col("hash"))).select("key", "row", "times")
    once = met.filter("times = 1").select("row").unionByName(
        met.filter("times > 1").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return once.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that stand in a document of smaller id or earlier in the same one.

    n_chars is that of the new text where words were cut; a document of which nothing is left goes.
    """
    cut = suffixes.drop_repeats(_packed(docs))
    left = cut.filter((F.col("cut_words") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = {"n_chars": F.when(F.col("cut_words") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(
        F.col("others").getField("n_chars")).alias("n_chars")} if "n_chars" in docs.columns else {}
    return _unpacked(left, docs, **n_chars)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of 10 words of a benchmark item (an item of fewer words is one window)."""
    rows = decontam.contamination(_packed(docs), read_table(spark, sf_dir, "benchmark"))
    return _unpacked(rows.filter(F.size("starts") == 0), docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): byte-level BPE ids of every text, and the digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, keep_text=False, decoded=True)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_copies), ("suffix_array_dedup", repeated_passages),
          ("benchmark_decontamination", benchmark_leaks), ("byte_level_bpe", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again as the next one's docs."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
