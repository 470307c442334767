"""Token counts of a corpus, and the bounded part of them that every task may hold."""
from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written

#: Distinct tokens that a task counts before it hands its partial counts on.
HELD = 400_000


def token_counts(rows: DataFrame, tokens: Callable[[pa.Array], Iterator[list[bytes]]], name: str) -> DataFrame:
    """(token, n) over all values of the only column; partial counts per task, summed by Spark, written once."""
    schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for words in tokens(batch.column(0)):
                found.update(words)
                if len(found) >= HELD:
                    yield from _parts(found, schema)
                    found = Counter()
        yield from _parts(found, schema)

    return written(rows.mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n")), name)


def _parts(found: Counter, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    keys, values = list(found), list(found.values())
    for i in range(0, len(keys), 50_000):
        yield pa.RecordBatch.from_pydict({"token": keys[i:i + 50_000], "n": values[i:i + 50_000]}, schema=schema)


def frequent(counts: DataFrame, most: int, most_bytes: int = 64) -> DataFrame:
    """Tokens of at most ``most_bytes`` bytes that occur often enough that no more than ``most`` qualify.

    The least count is read from a table of counts of counts, so the selection is a filter and does not depend on order.
    Its size is bounded by ``most * most_bytes`` bytes, whatever the corpus; other tokens need an exact way of their own.
    """
    short = counts.filter(F.octet_length("token") <= most_bytes)
    kinds = short.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count(F.lit(1)).alias("tokens")).collect()
    total, least = 0, (1 << 16) + 1
    for row in sorted(kinds, key=lambda r: -r["n"]):
        total += row["tokens"]
        if total > most:
            break
        least = row["n"]
    if total > most and least > 1 << 16:  # more than `most` tokens reach the last step of the table
        return short.orderBy(F.desc("n"), "token").limit(most)
    return short.filter(F.col("n") >= least)
