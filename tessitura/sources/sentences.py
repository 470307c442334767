"""Sentence sources: a tab table keyed by language, and per-language text files mapped through a code table."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLE_SCHEMA = "espeak string, app_lang string, text string"


def _place(name: str) -> list:
    return [F.col(f"_metadata.{name}").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]


def read_sentence_table(spark: SparkSession, path: str) -> DataFrame:
    """``<voice>\\t<language>\\t<text>`` lines with their place: ``file``, the byte where their ``block`` of the file begins,
    and ``line``, which rises inside a block. Ordered by the three, rows stand as in the files."""
    raw = spark.read.schema(TABLE_SCHEMA).option("sep", "\t").option("quote", "").option("mode", "FAILFAST").csv(path)
    return raw.select(F.col("espeak").alias("lang"), "text", *_place("file_path"))


def read_parallel_texts(spark: SparkSession, folder: str, codes: DataFrame, parts: tuple[str, ...] = ("dev", "devtest")) -> DataFrame:
    """``<folder>/<part>/<code>.<part>`` line files of the languages that ``codes`` (lang, code) names."""
    lines = spark.read.text([f"{folder.rstrip('/')}/{p}" for p in parts]).select(
        F.col("value").alias("text"), *_place("file_name"))
    named = lines.withColumn("code", F.substring_index("file", ".", 1))
    return named.join(codes.select("lang", "code"), "code").select("lang", "text", "file", "block", "line")


def merge_sources(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sources)


def write_selection(lists: DataFrame, counts: DataFrame, path: str) -> None:
    """One folder per language and list, and one JSON statistics row per language."""
    lists.select("lang", "list", "sentence").repartition("lang", "list", F.pmod(F.xxhash64("sentence"), F.lit(32))).write.mode(
        "errorifexists").partitionBy("lang", "list").text(f"{path.rstrip('/')}/lists")
    counts.write.mode("errorifexists").json(f"{path.rstrip('/')}/stats")
