"""Import from and export to SQLite files, the interchange format of knowledge-graph databases."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_TASK = 100_000


def read(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A table of a file that every executor can open, in ranges of row ids, one task each."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    if low is None:
        return spark.createDataFrame([], schema)
    tasks = max(1, -(-(high - low + 1) // ROWS_PER_TASK))
    starts = spark.range(low, high + 1, ROWS_PER_TASK, numPartitions=tasks)
    empty = spark.createDataFrame([], schema)
    names = empty.columns
    types = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in empty.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ", ".join(f'"{n}"' for n in names)
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for batch in batches:
                for start in batch.column(0).to_pylist():
                    rows = db.execute(f'SELECT {columns} FROM "{table}" WHERE rowid >= ? AND rowid < ?', (start, start + ROWS_PER_TASK))
                    while part := rows.fetchmany(10_000):
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in part], types)

    return starts.mapInArrow(run, empty.schema)


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}[kind]


def vector(blob: str = "embedding") -> F.Column:
    """A base64 text of little-endian 32-bit floats as an array; an incomplete last number is dropped, and a text that is
    no base64 counts as the bytes themselves."""
    raw = F.coalesce(F.try_to_binary(F.col(blob), F.lit("base64")), F.col(blob).cast("binary"))
    n = F.floor(F.octet_length(raw) / 4)

    @F.pandas_udf("array<float>")
    def decode(column):  # noqa: ANN001, ANN202
        import numpy as np

        return column.map(lambda b: None if b is None else np.frombuffer(bytes(b)[: len(b) // 4 * 4], dtype="<f4"))

    return F.when(n > 0, decode(raw))


def encoded(vector: str = "embedding") -> F.Column:
    """A vector as base64 of little-endian 32-bit floats; null stays null."""

    @F.pandas_udf("binary")
    def encode(column):  # noqa: ANN001, ANN202
        import numpy as np

        return column.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return F.base64(encode(F.col(vector).cast("array<float>")))


def write(df: DataFrame, path: str, table: str) -> int:
    """Rows of scalar columns into a table, replacing rows of the same first column; one partition after another."""
    names = df.columns
    n = 0
    with sqlite3.connect(path) as db:
        columns = ", ".join(f'"{c}"' for c in names)
        db.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({columns}, PRIMARY KEY ("{names[0]}"))')
        marks = ", ".join("?" * len(names))
        for row in df.toLocalIterator():
            db.execute(f'INSERT OR REPLACE INTO "{table}" ({columns}) VALUES ({marks})', tuple(row))
            n += 1
    return n
