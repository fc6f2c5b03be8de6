"""The corpus pipeline: documents in, packed training windows out.

Every stage keeps the columns of ``documents`` but the last, takes all rows that its predecessor
kept, and is written as Parquet before the next one reads it.  Empty tables, null texts and extra
columns pass through every stage; see the operators' docstrings for what each does with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engramite.llm import decontaminate, minhash, packing, quality, secrets
from engramite.llm.common import in_small_batches, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.kept(in_small_batches(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return minhash.deduplicate(in_small_batches(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts; ``n_chars`` follows."""
    return decontaminate.decontaminate(in_small_batches(docs), table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the names of their rules; ``n_chars`` follows."""
    return secrets.redact(in_small_batches(docs))


def packing_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most 4096 tokens over all that is left."""
    return packing.pack(in_small_batches(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing_windows),
]

#: Near-duplicate search and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
