"""Learning from outcomes: exponential moving averages of confidence, for one outcome or all of them at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramite.functions.normalize import clamp, enum, probability, string_list
from engramite.functions.scoring import ema, learning_target
from engramite.schema import LEARNING_RATE, OUTCOME_STATUSES


#: Stretches of time that a node's outcomes are split into.
RANGES = 16


def causes(outcomes: DataFrame) -> DataFrame:
    """One row for an outcome and distinct cause, from a list column ``causal_node_ids``."""
    return outcomes.withColumn("causal_node_id", F.explode(string_list(F.col("causal_node_ids")))).drop("causal_node_ids")


def _target() -> Column:
    return learning_target(enum(F.col("status"), OUTCOME_STATUSES, "failure"), probability(F.col("confidence")))


def updates(nodes: DataFrame, outcomes: DataFrame, rate: float = LEARNING_RATE) -> DataFrame:
    """Each outcome on its own against the nodes as they are: (action_id, node_id, result, old, new, delta)."""
    told = outcomes.select("action_id", F.col("causal_node_id").alias("node_id"), _target().alias("target"))
    held = nodes.select(F.col("id").alias("node_id"), clamp(F.coalesce("confidence", F.lit(0.5))).alias("old_confidence"))
    joined = told.join(held, "node_id", "left")
    new = ema(F.col("old_confidence"), F.col("target"), rate)
    return joined.select(
        "action_id", "node_id", F.when(F.col("old_confidence").isNull(), "skipped_not_found").otherwise("updated").alias("result"), "old_confidence", new.alias("new_confidence"), (new - F.col("old_confidence")).alias("delta")
    )


def tallies(updated: DataFrame) -> DataFrame:
    """For each action: causes processed, updated and skipped."""
    one = lambda name: F.sum(F.when(F.col("result") == name, 1).otherwise(0))
    return updated.groupBy("action_id").agg(F.count(F.lit(1)).alias("processed"), one("updated").alias("updated"), one("skipped_not_found").alias("skipped"))


def learn(nodes: DataFrame, outcomes: DataFrame, rate: float = LEARNING_RATE) -> DataFrame:
    """All outcomes in order of ``seq``, folded in closed form: (node_id, old, new, delta, feedback_count).

    n steps of c := c (1 - r) + t r give c (1 - r)^n + sum of r t_i (1 - r)^(n - i); with targets, rate and
    confidence within 0 and 1 no step leaves that range.  Equal ``seq`` of a node are ordered by action.
    The power of a step needs its place from the end alone.  Steps compose, so ``RANGES`` stretches of ``seq`` are folded on
    their own, each by a window and an aggregation over one shuffle, and then those of a node: a node with a third of
    all outcomes is work for many tasks.
    """
    told = outcomes.select(F.col("causal_node_id").alias("node_id"), "seq", "action_id", _target().alias("target"))
    held = nodes.select(F.col("id").alias("node_id"), clamp(F.coalesce("confidence", F.lit(0.5))).alias("old_confidence"))
    told = told.join(held.select("node_id"), "node_id", "left_semi")
    low, high = outcomes.agg(F.min("seq"), F.max("seq")).first()
    stretch = F.coalesce(F.floor((F.col("seq") - F.lit(low)) / F.lit(((high or 0) - (low or 0)) / RANGES + 1)), F.lit(-1))
    behind = F.row_number().over(Window.partitionBy("node_id", "stretch").orderBy(F.desc("seq"), F.desc("action_id"))) - 1
    keep = lambda n: F.pow(F.lit(1.0 - rate), n)
    parts = told.withColumn("stretch", stretch).withColumn("behind", behind).groupBy("node_id", "stretch").agg(F.sum(F.lit(rate) * F.col("target") * keep(F.col("behind"))).alias("pulled"), F.count(F.lit(1)).alias("n"))
    later = F.coalesce(F.sum("n").over(Window.partitionBy("node_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    folded = parts.withColumn("later", later).groupBy("node_id").agg(F.sum(F.col("pulled") * keep(F.col("later"))).alias("pulled"), F.sum("n").alias("feedback_count"))
    new = clamp(F.col("old_confidence") * F.pow(F.lit(1.0 - rate), F.col("feedback_count")) + F.col("pulled"))
    return folded.join(held, "node_id").select("node_id", "old_confidence", new.alias("new_confidence"), (new - F.col("old_confidence")).alias("delta"), "feedback_count")


def skipped(nodes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Causes that are no nodes, each with its number of outcomes."""
    ids = nodes.select(F.col("id").alias("causal_node_id"))
    return outcomes.join(ids, "causal_node_id", "left_anti").groupBy(F.col("causal_node_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_outcomes"))


def applied(nodes: DataFrame, learned: DataFrame) -> DataFrame:
    """Nodes with their new confidences; the others unchanged."""
    new = learned.select(F.col("node_id").alias("id"), "new_confidence")
    return nodes.join(new, "id", "left").withColumn("confidence", F.coalesce("new_confidence", "confidence")).select(*nodes.columns)
