"""What the training-data operators share: tables, the shared folder, row packing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

ROW = "__engramite_row"
#: Largest estimated size in bytes of a side that is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20
#: Rows with texts that are read, or sent to Python, at a time.
TEXT_ROWS = 512
_READ_ROWS, _SENT_ROWS = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def removed(spark: SparkSession, *folders: str) -> None:
    """Deletes written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether any path matches."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``; only a local session may lack that setting."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="engramite-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/engramite-{uuid.uuid4().hex}"


def stored(writer: DataFrameWriter, spark: SparkSession, folder: str) -> None:
    """Writes Parquet; the shuffles of the write are dropped with it."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(folder)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder."""
    folder = folder or shared_dir(df.sparkSession)
    stored(df.write.mode("overwrite"), df.sparkSession, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """For small iterated tables: a reliable checkpoint, removed by Spark once it isn't referenced."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared_dir(df.sparkSession)
    return df.checkpoint()


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same rows in a copy of their session, in which fewer rows are read, and sent to Python, at a time; what is made of them stays in it.

    Rows with whole texts are some kilobytes each, so that Spark's own numbers of rows are buffers of 16 to 64 MB in every task.
    """
    copy = SparkSession(df.sparkSession.sparkContext, df.sparkSession._jsparkSession.cloneSession())
    for key in (_READ_ROWS, _SENT_ROWS):
        copy.conf.set(key, min(int(copy.conf.get(key)), TEXT_ROWS) or TEXT_ROWS)
    return DataFrame(copy.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(copy._jsparkSession, df._jdf.queryExecution().analyzed()), copy)


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def ident(name: str) -> Column:
    """An id column as whole numbers; an id that is no whole number counts as null."""
    return col(name).try_cast("long")


def string(name: str) -> Column:
    return col(name).cast("string")


def spread(rows: DataFrame) -> DataFrame:
    """The same rows for work that is heavy on the CPU: an input of fewer partitions than cores is dealt out to all of them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """All columns of each row in one struct beside computed ones, so that no name can clash."""
    return df.select(F.struct(*[col(c) for c in df.columns]).alias(ROW), *[c.alias(n) for n, c in extra.items()])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")


def is_small(df: DataFrame) -> bool:
    """Whether Catalyst's estimate allows a broadcast."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= BROADCAST_BYTES
