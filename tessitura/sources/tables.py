"""Driver tables, and the sentence table most text operators start from."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import collapse

# Where a document is cut into sentences.
SENTENCE_BREAK = r"[.!?]\s+|\n"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def balanced(df: DataFrame) -> DataFrame:
    """Spreads an input of fewer splits than cores (one small file) before per-row text work; else unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def split_sentences(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per non-empty sentence of the whole text, with its position and collapsed form in ``sentence``.

    The form is computed inside the generator, so that later filters on it do not evaluate it again.
    """
    others = [c for c in df.columns if c != text]
    parts = F.transform(F.split(F.col(text), SENTENCE_BREAK, -1), collapse)
    return balanced(df).select(*others, F.posexplode(parts).alias("pos", "sentence")).filter(F.col("sentence") != "")
