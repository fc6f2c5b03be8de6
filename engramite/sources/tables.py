"""Durable tables: an append-only log of versioned rows, compacted into snapshots by pointer swap.

A table is a folder with ``log/`` (Parquet batches of rows, patches and tombstones, each with a
sequence number) and ``snapshots/v=N`` (one row for a key).  ``CURRENT-n`` names the snapshot in use
and the last sequence number that it includes, so a reader merges the snapshot with the rest of the
log, and a job that dies while compacting leaves only an unused folder behind.  A state is a new file with
the next number, which appears by a rename onto a free name; no file is replaced, so a writer that dies between any
two steps leaves the last state as it was.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramite.schema import TABLES

SEQ, OP, SET = "__seq", "__op", "__set"
UPSERT, PATCH, DELETE = "upsert", "patch", "delete"
#: Batches of the log after which a table is compacted.
COMPACT_AFTER = 64


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


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    if not df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        shared_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder, whose size tells Catalyst how to join."""
    folder = shared_dir(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def latest_per_key(log: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last row of every key; of equal sequence numbers any one, as they are the same write."""
    last = Window.partitionBy(key).orderBy(F.desc(seq))
    return log.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")


def without(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Deletion: rows whose key isn't among ``ids``; unknown ids do nothing and nothing cascades."""
    return df.join(ids.select(key), key, "left_anti").select(*df.columns)


def touched(nodes: DataFrame, accesses: DataFrame, as_of_us: int) -> DataFrame:
    """Access counts raised by the number of accesses of each id; touched nodes count as updated."""
    hits = accesses.groupBy("id").agg(F.count(F.lit(1)).alias("__hits"))
    out = nodes.join(hits, "id", "left")
    out = out.withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("__hits", F.lit(0)))
    return out.withColumn("updated_us", F.when(F.col("__hits").isNotNull(), F.lit(as_of_us)).otherwise(F.col("updated_us"))).select(*nodes.columns)


def patched(rows: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """Partial update: a patch's columns replace those that its list column ``__set`` names, nulls included."""
    fields = [c for c in patches.columns if c not in (key, SET)]
    p = patches.select(F.col(key), F.col(SET), *[F.col(c).alias(f"__new_{c}") for c in fields])
    out = rows.join(p, key, "left")
    for c in fields:
        out = out.withColumn(c, F.when(F.array_contains(SET, c), F.col(f"__new_{c}")).otherwise(F.col(c)))
    return out.select(*rows.columns)


class Files:
    """Small files on whatever file system holds a table."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def states(self, name: str) -> list[int]:
        """The numbers of the states of a file, in order."""
        found = self.fs.globStatus(self.path(f"{name}-*")) or []
        return sorted(int(n) for s in found if (n := s.getPath().getName().rpartition("-")[2]).isdigit())

    def read(self, name: str) -> str | None:
        """The last state; None if there is none."""
        numbers = self.states(name)
        if not numbers:
            return None
        stream = self.fs.open(self.path(f"{name}-{numbers[-1]:012d}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Adds a state; of the earlier ones the last stays for readers that have just listed it."""
        numbers = self.states(name)
        temporary = self.path(f".{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(temporary, self.path(f"{name}-{numbers[-1] + 1 if numbers else 1:012d}")):
            raise RuntimeError(f"{self.root}/{name}: another writer was faster")
        for n in numbers[:-1]:
            self.fs.delete(self.path(f"{name}-{n:012d}"), False)


class Table:
    """One entity table.  Writers take sequence numbers from ``CURRENT``; there is one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str = "id") -> None:
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        self.files = Files(spark, self.root)

    @property
    def state(self) -> dict:
        return json.loads(self.files.read("CURRENT") or '{"version": 0, "included": 0, "seq": 0}')

    @property
    def log_schema(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField(SEQ, T.LongType()), T.StructField(OP, T.StringType()), T.StructField(SET, T.ArrayType(T.StringType()))])

    def append(self, rows: DataFrame, op: str = UPSERT, fields: list[str] | None = None) -> int:
        """Adds a batch to the log and gives its sequence number; a failed write is never seen, as ``CURRENT`` moves last.

        Of rows of one batch with the same key, one has to be chosen by the caller beforehand.
        Missing columns are null.  A patch sets the columns in ``fields`` only.
        """
        state = self.state
        seq = state["seq"] + 1
        names = set(rows.columns)
        columns = [(F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]
        marks = [F.lit(seq).cast("long").alias(SEQ), F.lit(op).alias(OP), (F.array(*map(F.lit, fields)) if fields else F.lit(None)).cast("array<string>").alias(SET)]
        rows.select(*columns, *marks).write.mode("overwrite").parquet(f"{self.root}/log/batch={seq}")
        self.files.replace("CURRENT", json.dumps(state | {"seq": seq}))
        if seq - state["included"] >= COMPACT_AFTER:
            self.compact()
        return seq

    def read(self) -> DataFrame:
        """The rows as of now."""
        state = self.state
        parts = []
        if state["version"]:
            snapshot = self.spark.read.schema(self.schema).parquet(f"{self.root}/snapshots/v={state['version']}")
            parts.append(snapshot.select("*", F.lit(state["included"]).cast("long").alias(SEQ), F.lit(UPSERT).alias(OP), F.lit(None).cast("array<string>").alias(SET)))
        new = [f"{self.root}/log/batch={n}" for n in range(state["included"] + 1, state["seq"] + 1)]
        if new:
            parts.append(self.spark.read.schema(self.log_schema).parquet(*new))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if not new:
            return every.select(*self.schema.names)
        # a field is what the last upsert or the last patch naming it says, whichever came later
        base = F.max(F.when(F.col(OP) != PATCH, F.struct(SEQ, OP)))
        aggregates = [base.alias("__base")]
        for f in self.schema:
            if f.name != self.key:
                sets = (F.col(OP) == UPSERT) | F.array_contains(SET, f.name)
                aggregates.append(F.max_by(F.struct(F.col(f.name).alias("v")), F.when(sets, F.col(SEQ))).alias(f.name))
        merged = every.groupBy(self.key).agg(*aggregates).where(F.col(f"__base.{OP}") == UPSERT)
        return merged.select(*[F.col(n) if n == self.key else F.col(f"{n}.v").alias(n) for n in self.schema.names])

    def create(self) -> None:
        """Makes an empty table where there is none."""
        if self.files.read("CURRENT") is None:
            self.files.replace("CURRENT", json.dumps(self.state))

    def compact(self) -> int:
        """Writes a snapshot of everything and makes it current; earlier ones stay for readers that still use them."""
        state = self.state
        version = state["version"] + 1
        self.read().write.mode("overwrite").parquet(f"{self.root}/snapshots/v={version}")
        self.files.replace("CURRENT", json.dumps(state | {"version": version, "included": state["seq"]}))
        return version


#: Migrations in order: id and what it does to a database.
MIGRATIONS: tuple[tuple[str, str], ...] = (("0001_entities", "create the entity tables"), ("0002_goal_reviews", "goals know when they were reviewed last"))


class Database:
    """The four tables of a knowledge graph in one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = {name: Table(spark, f"{self.root}/{name}", schema) for name, schema in TABLES.items()}

    def __getattr__(self, name: str) -> Table:
        tables = self.__dict__.get("tables", {})
        if name in tables:
            return tables[name]
        raise AttributeError(name)

    def migrate(self) -> list[str]:
        """Runs the migrations that aren't recorded yet, records each and gives their ids; twice in a row does nothing."""
        files = Files(self.spark, self.root)
        done = json.loads(files.read("MIGRATIONS") or "[]")
        pending = [m for m, _ in MIGRATIONS if m not in done]
        for name in pending:
            self._run(name)
            done.append(name)
            files.replace("MIGRATIONS", json.dumps(done))
        return pending

    def _run(self, name: str) -> None:
        if name == "0001_entities":
            for t in self.tables.values():
                t.create()
        elif name == "0002_goal_reviews":
            # goals written before the column was there get it as a null by a new snapshot in the present schema
            if self.tables["goals"].state["seq"]:
                self.tables["goals"].compact()

    def counts(self) -> dict[str, int]:
        return {name: t.read().count() for name, t in self.tables.items()}

    def ping(self) -> str:
        return "pong" if self.spark.range(1).count() == 1 else "down"
