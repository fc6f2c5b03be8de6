"""Context retrieval: similarity seeds, hop-decayed expansion over edges, best merge, final ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramite.functions.scoring import hop_score
from engramite.operators.relations import top_neighbors
from engramite.operators.similarity import is_few, search
from engramite.schema import SCORE_DIGITS, RetrievalConfig

_KEY = ("query_id", "node_id")


def _stable(score: Column) -> Column:
    """Rounded for comparison; halves go up even if float noise has them just below."""
    return F.round(score + 1e-10, SCORE_DIGITS)


def seeds(queries: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    """The hits of similarity search as entries: (query_id, node_id, similarity, score, raw_score)."""
    return search(queries, nodes, limit).select("query_id", F.col("id").alias("node_id"), "similarity", "score", "raw_score")


def arrivals(frontier: DataFrame, neighbors: DataFrame, nodes: DataFrame, hop: int, decay: float) -> DataFrame:
    """What one hop reaches: (query_id, node_id, score, via), the best parent of each node, ties to the smaller id.

    Neighbours that are no nodes, and the parent itself, drop out after the cap on neighbours.
    """
    step = frontier.join(neighbors, frontier["node_id"] == neighbors["src"]).where(F.col("src") != F.col("dst"))
    child = step.select("query_id", F.col("dst").alias("node_id"), hop_score(F.col("score"), F.col("weight"), decay, hop).alias("score"), F.col("src").alias("via"))
    child = child.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    first = Window.partitionBy(*_KEY).orderBy(F.round("score", 12).desc(), "via")
    return child.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def entries(queries: DataFrame, nodes: DataFrame, edges: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:  # noqa: B008
    """Seeds and everything within the hops, one row for a query and node.

    A path with a higher score than the seed's own raises the score and names the parent in ``via``,
    and lifts a negative similarity to 0; hops and source stay the seed's.  A node that isn't a seed
    takes its hop and ``via`` from the lowest hop that reached it, and the best score of any hop.
    The hops are few, so the plan is unrolled rather than iterated.  Of many queries, the seeds and what each hop but
    the last reaches are tables in the shared folder, since each is read more than once.
    """
    from engramite.sources.tables import kept

    held = (lambda df: df) if is_few(queries) else kept
    first = held(seeds(queries, nodes, config.similarity_limit))
    parts = [first.select(*_KEY, F.lit(0).alias("hop"), "similarity", "score", F.lit(None).cast("string").alias("via"))]
    frontier = first.select(*_KEY, F.col("raw_score").alias("score"))
    for hop in range(1, config.expansion_hops + 1):
        near = top_neighbors(edges, config.neighbors_per_node, frontier.select(F.col("node_id").alias("src")))
        reached = arrivals(frontier, near, nodes, hop, config.hop_decay)
        if hop < config.expansion_hops:
            reached = held(reached)
        parts.append(reached.select(*_KEY, F.lit(hop).alias("hop"), F.lit(0.0).alias("similarity"), "score", "via"))
        frontier = reached.select(*_KEY, "score")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)

    own = Window.partitionBy(*_KEY)
    seed_score = F.max(F.when(F.col("hop") == 0, _stable(F.col("score")))).over(own)
    every = every.withColumn("seed_score", seed_score)
    better: Column = F.col("seed_score").isNull() | (_stable(F.col("score")) > F.col("seed_score"))
    way = F.when((F.col("hop") > 0) & better, F.struct("hop", "via"))
    seed_similarity = F.max(F.when(F.col("hop") == 0, F.col("similarity")))
    merged = every.groupBy(*_KEY).agg(
        _stable(F.max("score")).alias("score"),
        F.min("hop").alias("hops"),
        F.when(F.min(way).isNotNull(), F.greatest(F.coalesce(seed_similarity, F.lit(0.0)), F.lit(0.0))).otherwise(seed_similarity).alias("similarity"),
        F.min(way)["via"].alias("via"),
    )
    return merged.withColumn("source", F.when(F.col("hops") == 0, "seed").otherwise("neighbor"))


def retrieve(queries: DataFrame, nodes: DataFrame, edges: DataFrame, config: RetrievalConfig = RetrievalConfig(), min_score: float | None = None, node_type: str | None = None) -> DataFrame:  # noqa: B008
    """The ``final_limit`` best entries of every query, ranked by score and id, with their nodes.

    ``min_score`` and ``node_type`` come after the limit, so fewer rows may be left; ranks are then
    counted again.
    """
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    rank = F.row_number().over(by_score)
    top = entries(queries, nodes, edges, config).withColumn("rank", rank).where(F.col("rank") <= config.final_limit)
    facts = nodes.select(F.col("id").alias("node_id"), "content", "node_type", F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    out = top.join(facts, "node_id")
    if min_score is not None:
        out = out.where(F.col("score") >= float(min_score))
    if node_type is not None:
        out = out.where(F.col("node_type") == node_type)
    if min_score is not None or node_type is not None:
        out = out.withColumn("rank", rank)
    return out.select("query_id", "rank", "node_id", "content", "node_type", "confidence", "similarity", "score", "source", "hops", "via")


def stats(queries: DataFrame, nodes: DataFrame, edges: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:  # noqa: B008
    """For every query: seeds, entries beyond them, and entries returned."""
    counted = entries(queries, nodes, edges, config).groupBy("query_id").agg(F.sum(F.when(F.col("hops") == 0, 1).otherwise(0)).alias("seed_count"), F.count(F.lit(1)).alias("n"))
    return counted.select("query_id", "seed_count", F.greatest(F.col("n") - F.col("seed_count"), F.lit(0)).alias("expanded_count"), F.least("n", F.lit(config.final_limit)).alias("returned"))
