"""Rows with everything awkward in them, for all operators."""
from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeéñ") for _ in range(1 + int(w ** 0.4))) + str(w % 7) * (w % 3)
                    for w in (int(vocabulary * rng.random() ** 2) for _ in range(n)))


def table(spark, rows, partitions: int = 3, extra=()):
    """``rows`` of (doc_id, text); further columns have the names that operators add."""
    full = [(i, t, "xx", f"s{k % 2}", None if t is None else len(t), *[f"kept {k}"] * len(extra)) for k, (i, t) in enumerate(rows)]
    kind = T.StructType([*SCHEMA.fields, *[T.StructField(c, T.StringType()) for c in extra]])
    return spark.createDataFrame(full, kind).repartition(partitions)


CLASH = ("n_words", "fail_bits", "kept", "starts", "ends", "items", "found", "ids", "decoded", "n_bytes", "shard", "depth", "cut_words", "others",
         "doc", "h", "key", "fp", "component", "node", "row", "body", "place", "_key", "_n")


def awkward() -> list[tuple[int | None, str | None]]:
    same = prose(7, 90)
    return [(1, None), (2, ""), (3, " \n\t  "), (4, "One"), (5, "Alpha beta alpha beta"), (6, same), (7, same), (7, same), (7, same), (None, same),
            (8, prose(8, 30_000)), (9, "#" * 300 + " x" * 80), (10, "Ünï çödé 日本語 !! '' 's'store don't x y\r\n\r\n  z \U0001f600"), (None, None),
            (11, "\n".join(["same line here"] * 60)), (12, prose(12, 60) + " " + same + " " + prose(13, 60)), (-5, "x" * 5000), (13, "all rights reserved all rights reserved " * 30)]
