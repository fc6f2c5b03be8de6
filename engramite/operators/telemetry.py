"""Events of learning and consolidation as rows, for a metrics table that grows with the graph rather than a driver-side log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("event", "subject", "measure", "value")


def _event(df: DataFrame, name: str, subject: Column, **measures: Column) -> DataFrame:
    """(event, subject, measure, value), one row for each measure."""
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value")) for k, v in measures.items()])
    out = df.select(F.lit(name).alias("event"), subject.cast("string").alias("subject"), F.explode(pairs).alias("m"))
    return out.select("event", "subject", "m.measure", "m.value")


def outcome_events(tallied: DataFrame) -> DataFrame:
    """What each action did, from the tallies of ``learn.tallies``."""
    return _event(tallied, "outcome_processed", F.col("action_id"), processed=F.col("processed"), updated=F.col("updated"), skipped=F.col("skipped"))


def confidence_events(learned: DataFrame) -> DataFrame:
    """How far each node moved, from ``learn.learn`` or the updated rows of ``learn.updates``."""
    moved = learned.where(F.col("new_confidence").isNotNull())
    return _event(moved, "confidence_updated", F.col("node_id"), old=F.col("old_confidence"), new=F.col("new_confidence"), delta=F.col("delta"))


def fate_events(fated: DataFrame) -> DataFrame:
    """Decayed and pruned nodes, from ``consolidate.fates``; unchanged ones have none."""
    measures = {"old": F.col("old_confidence"), "new": F.col("new_confidence")}
    decayed, pruned = (_event(fated.where(F.col("fate") == f), f"node_{f}", F.col("id"), **measures) for f in ("decayed", "pruned"))
    return decayed.unionByName(pruned)


def cycle_events(fated: DataFrame) -> DataFrame:
    """One cycle in numbers: nodes of each fate."""
    one = lambda name: F.coalesce(F.sum(F.when(F.col("fate") == name, 1).otherwise(0)), F.lit(0))
    counted = fated.agg(one("decayed").alias("decayed"), one("pruned").alias("pruned"), one("unchanged").alias("unchanged"))
    return _event(counted, "consolidation_cycle", F.lit("all"), decayed=F.col("decayed"), pruned=F.col("pruned"), unchanged=F.col("unchanged"))
