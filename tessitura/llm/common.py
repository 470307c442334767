"""Helpers that several operators share: byte words, marked files in the shared folder, checks of the input columns."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Upper-case ASCII letters to lower case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Byte translation that lower-cases A-Z and turns every byte outside digits, letters and non-ASCII into a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b in _ALNUM else 32 for b in range(256))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def blank_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, over the UTF-8 bytes; null has none."""
    return text.lower().split() if text else []


def letter_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words of ASCII digits, letters and any non-ASCII character; null has none."""
    return text.translate(LETTERS).split() if text else []


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def small_batches(df: DataFrame, rows: int = 500) -> None:
    """Whole texts go to Python in Arrow batches of ``rows`` rows where the session has left Spark's default of 10,000:
    a batch is held several times over (JVM, worker, results), and texts have no bounded length."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def replacing(df: DataFrame, *added: str) -> DataFrame:
    """The rows without columns of the names that an operator is about to add: its own take their place."""
    names = {a.lower() for a in added}
    return df.drop(*[c for c in df.columns if c.lower() in names])


def with_fields(df: DataFrame, **added: T.DataType) -> T.StructType:
    """The schema of the rows plus further columns."""
    return T.StructType([*df.schema.fields, *[T.StructField(k, v) for k, v in added.items()]])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once per row, however often the body names it (also inside lambdas)."""
    return F.transform(F.array(value), body)[0]


def batches_of(schema: pa.Schema, rows: Sequence[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def flushed(schema: pa.Schema, rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batches_of(schema, held)
            held = []
    if held:
        yield batches_of(schema, held)


def shared_file(folder: str, kind: str):
    """(file system, path, name) of a new file in ``folder``; its name is never used twice, so attempts cannot clash.

    Which files count is told by the manifest that the writing job returns: Spark commits one attempt per task.
    """
    from pyarrow import fs
    from pyspark import TaskContext

    system, root = fs.FileSystem.from_uri(folder)
    context = TaskContext.get()
    name = f"part-{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex}.{kind}"
    system.create_dir(root, recursive=True)
    return system, f"{root}/{name}", name
