"""Filters, listings, lookups, adjacency and neighbour ranking over nodes, edges, outcomes and goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramite.functions.normalize import clamp, unit


def filter_nodes(nodes: DataFrame, node_type: str | None = None, min_confidence: object = None) -> DataFrame:
    """Nodes of a type with at least a confidence; None turns a condition off, and what is no number counts as 0."""
    if node_type is not None:
        nodes = nodes.where(F.col("node_type") == node_type)
    return nodes if min_confidence is None else nodes.where(F.col("confidence") >= unit(min_confidence, 0.0))


def latest(df: DataFrame, limit: int | None = None, by: str = "updated_us", key: str = "id") -> DataFrame:
    """Newest first, ties by key; a limit makes it a top-k without a full sort."""
    df = df.orderBy(F.desc_nulls_last(by), F.asc(key))
    return df if limit is None else df.limit(limit)


def lookup(keys: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Each distinct key with its row; ``found`` tells hits from misses."""
    hit = rows.withColumn("found", F.lit(True))
    return keys.select(key).distinct().join(hit, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def adjacency(edges: DataFrame) -> DataFrame:
    """Every edge from both ends as (src, dst, weight, edge_id, edge_type); a self-loop counts once."""
    both = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), clamp(F.coalesce("weight", F.lit(0.5))).alias("weight"), F.col("id").alias("edge_id"), "edge_type")
    back = both.where(~F.col("src").eqNullSafe(F.col("dst"))).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "edge_id", "edge_type")
    return both.unionByName(back)


def edges_for_nodes(ids: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """(node_id, edge_id, other, edge_type, weight) for every given node and edge at either of its ends."""
    wanted = ids.select(F.col(key).alias("node_id")).distinct()
    adj = adjacency(edges)
    return wanted.join(adj, F.col("node_id") == F.col("src")).select("node_id", "edge_id", F.col("dst").alias("other"), "edge_type", "weight")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected degree of every node, 0 for isolated ones; counted before the join so that little is shuffled."""
    counted = adjacency(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(counted, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("id").distinct()
    ends = edges.select(F.col("id").alias("edge_id"), F.explode(F.array("source_id", "target_id")).alias("end"))
    lost = ends.join(ids, ends["end"] == ids["id"], "left_anti").select("edge_id").distinct()
    return edges.join(lost, edges["id"] == lost["edge_id"], "left_semi")


def parallel_edges(edges: DataFrame) -> DataFrame:
    """Unordered pairs with more than one edge: how many, and the largest weight."""
    a, b = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    return edges.groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n_edges"), F.max("weight").alias("max_weight")).where("n_edges > 1")


def top_neighbors(edges: DataFrame, k: int, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight, rank): the k heaviest distinct neighbours of every source.

    Of parallel edges the heaviest counts; ties go to the smaller id.  A self-loop takes a place
    here and is dropped by whoever expands.  ``sources`` (column src) limits the work to those.
    """
    adj = adjacency(edges).select("src", "dst", "weight")
    if sources is not None:
        adj = adj.join(sources.select("src").distinct(), "src", "left_semi")
    best = adj.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def filter_goals(goals: DataFrame, status: str | None = None, priority: str | None = None, owner: str | None = None, tag: str | None = None, min_progress: float | None = None) -> DataFrame:
    """The store's own conditions on goals; None turns one off."""
    for name, value in (("status", status), ("priority", priority), ("owner", owner)):
        if value is not None:
            goals = goals.where(F.col(name) == value)
    if tag is not None:
        goals = goals.where(F.array_contains("tags", tag))
    return goals if min_progress is None else goals.where(F.col("progress") >= float(min_progress))


def list_goals(goals: DataFrame, limit: int | None = None, timescale: str | None = None, parent_goal_id: str | None = None, include_abandoned: bool = True, strict_limit: bool = False, **store_filters) -> DataFrame:
    """Goals, newest first.

    The limit comes before the conditions on timescale, parent and abandonment, and so may leave
    fewer rows than there are; ``strict_limit`` applies it after them.
    """
    out = filter_goals(goals, **store_filters)
    if limit is not None and not strict_limit:
        out = latest(out, limit)
    if timescale is not None:
        out = out.where(F.col("timescale") == timescale)
    if parent_goal_id is not None:
        out = out.where(F.col("parent_goal_id") == parent_goal_id)
    if not include_abandoned:
        out = out.where(F.col("status") != "abandoned")
    return latest(out, limit)


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def overdue(goals: DataFrame, as_of_us: int) -> DataFrame:
    """Open goals whose due time has passed."""
    return goals.where(F.col("status").isin("proposed", "active", "blocked") & (F.col("due_us") < as_of_us))


def iso_time(us: Column) -> Column:
    """ISO-8601 in UTC with microseconds, from epoch microseconds."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
