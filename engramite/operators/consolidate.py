"""Decay and pruning of nodes, for one cycle or many, and the report of similar pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramite.functions.normalize import clamp
from engramite.operators.similarity import search
from engramite.schema import ConsolidationConfig


def fates(nodes: DataFrame, config: ConsolidationConfig = ConsolidationConfig(), cycles: int = 1) -> DataFrame:  # noqa: B008
    """(id, old_confidence, new_confidence, delta, fate) after so many cycles: pruned, unchanged or decayed.

    Confidence never rises, so a node survives all cycles exactly if it survives the last.
    """
    old = clamp(F.coalesce("confidence", F.lit(0.5)))
    new = old * F.lit((1.0 - config.decay_rate) ** cycles)
    out = nodes.select("id", old.alias("old_confidence"), new.alias("new_confidence"), (new - old).alias("delta"))
    fate = F.when(F.col("new_confidence") < config.prune_threshold, "pruned").when(F.abs("delta") <= 1e-12, "unchanged").otherwise("decayed")
    return out.withColumn("fate", fate)


def consolidated(nodes: DataFrame, config: ConsolidationConfig = ConsolidationConfig(), cycles: int = 1, as_of_us: int | None = None) -> DataFrame:  # noqa: B008
    """What is left of the nodes; decayed ones count as updated at ``as_of_us``."""
    old = clamp(F.coalesce("confidence", F.lit(0.5)))
    new = old * F.lit((1.0 - config.decay_rate) ** cycles)
    changed = F.abs(new - old) > 1e-12
    out = nodes.where(new >= config.prune_threshold)
    if as_of_us is not None and "updated_us" in nodes.columns:
        out = out.withColumn("updated_us", F.when(changed, F.lit(as_of_us)).otherwise(F.col("updated_us")))
    return out.withColumn("confidence", F.when(changed, new).otherwise(F.col("confidence")))


def tallies(fated: DataFrame) -> DataFrame:
    return fated.groupBy("fate").agg(F.count(F.lit(1)).alias("n"))


def similar_pairs(nodes: DataFrame, threshold: float, k: int) -> DataFrame:
    """Extension: pairs (a, b, similarity) of nodes of at least a cosine, from the k nearest of every node."""
    every = nodes.where(F.col("embedding").isNotNull())
    hits = search(every.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), every.withColumn("confidence", F.lit(1.0)), k)
    close = hits.where((F.col("similarity") >= threshold) & (F.col("query_id") != F.col("id")))
    return close.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), "similarity").distinct()
