"""Queries over nodes, edges and outcomes as relations, similarity and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramite.operators import relations, retrieve, similarity
from engramite.plans.collect import registrar
from engramite.plans.views import oracle, table, view
from engramite.schema import RetrievalConfig

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

_ADJ = """adj AS (
  SELECT source_id AS src, target_id AS dst, least(greatest(weight, 0), 1) AS weight, id AS edge_id, edge_type FROM edges
  UNION ALL SELECT target_id, source_id, least(greatest(weight, 0), 1), id, edge_type FROM edges WHERE source_id <> target_id)"""


@query(oracle("SELECT id, node_type, confidence, source, access_count, updated_us FROM nodes WHERE node_type = 'semantic' AND confidence >= CAST(0.5 AS DOUBLE)", "nodes"))
def nodes_list_filtered(spark: SparkSession, sf: str) -> DataFrame:
    out = relations.filter_nodes(view(spark, sf, "nodes"), "semantic", 0.5)
    return out.select("id", "node_type", "confidence", "source", "access_count", "updated_us")


@query(oracle("SELECT id, node_type, confidence, updated_us FROM nodes ORDER BY updated_us DESC, id LIMIT 100", "nodes"))
def nodes_top_recent(spark: SparkSession, sf: str) -> DataFrame:
    return relations.latest(view(spark, sf, "nodes").select("id", "node_type", "confidence", "updated_us"), 100)


@query(oracle("SELECT k.id, node_type, confidence, n.id IS NOT NULL AS found FROM (SELECT DISTINCT causal_node_id AS id FROM outcomes) k LEFT JOIN nodes n ON n.id = k.id", "nodes", "outcomes"))
def node_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every node that an outcome names, found or not."""
    keys = view(spark, sf, "outcomes").select(F.col("causal_node_id").alias("id"))
    return relations.lookup(keys, view(spark, sf, "nodes").select("id", "node_type", "confidence"))


@query(oracle(f"WITH {_ADJ} SELECT n.id AS node_id, edge_id, dst AS other, edge_type, weight FROM nodes n JOIN adj ON src = n.id", "nodes", "edges"))
def edges_for_node(spark: SparkSession, sf: str) -> DataFrame:
    """The edges at every node."""
    return relations.edges_for_nodes(view(spark, sf, "nodes"), view(spark, sf, "edges"))


@query(oracle(f"WITH {_ADJ} SELECT * FROM adj", "edges"))
def adjacency_undirected(spark: SparkSession, sf: str) -> DataFrame:
    return relations.adjacency(view(spark, sf, "edges"))


@query(oracle(f"WITH {_ADJ} SELECT n.id, count(src) AS degree FROM nodes n LEFT JOIN adj ON src = n.id GROUP BY n.id", "nodes", "edges"))
def node_degree(spark: SparkSession, sf: str) -> DataFrame:
    return relations.degrees(view(spark, sf, "nodes"), view(spark, sf, "edges"))


@query(oracle("SELECT id, source_id, target_id FROM edges WHERE source_id NOT IN (SELECT id FROM nodes) OR target_id NOT IN (SELECT id FROM nodes)", "nodes", "edges"))
def dangling_edges_anti(spark: SparkSession, sf: str) -> DataFrame:
    return relations.dangling_edges(view(spark, sf, "nodes"), view(spark, sf, "edges")).select("id", "source_id", "target_id")


@query(oracle("SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, count(*) AS n_edges, max(weight) AS max_weight FROM edges GROUP BY 1, 2 HAVING count(*) > 1", "edges"))
def parallel_edges_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return relations.parallel_edges(view(spark, sf, "edges"))


@query(oracle("SELECT action_id, status, confidence, seq FROM outcomes ORDER BY seq DESC, action_id LIMIT 100", "outcomes"))
def outcomes_recent(spark: SparkSession, sf: str) -> DataFrame:
    return relations.latest(view(spark, sf, "outcomes").select("action_id", "status", "confidence", "seq"), 100, "seq", "action_id")


@query(oracle("SELECT status, count(*) AS n FROM outcomes GROUP BY status", "outcomes"))
def outcomes_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return relations.count_by(view(spark, sf, "outcomes"), "status")


@query(oracle("SELECT 'nodes' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'outcomes', count(*) FROM outcomes UNION ALL SELECT 'goals', count(*) FROM goals", "nodes", "edges", "outcomes", "goals"))
def health_counts(spark: SparkSession, sf: str) -> DataFrame:
    parts = [view(spark, sf, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name in ("nodes", "edges", "outcomes", "goals")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def first_vector(spark: SparkSession, sf: str) -> DataFrame:
    """One query vector for the reports of a single query: the feature is one query against all nodes."""
    return vectors(spark, sf).where("query_id = 0")


def _hits(k: int, where: str = "") -> str:
    """CTEs up to ``hits``: the k best of every query."""
    return f"""q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings {where}),
m AS (SELECT id, confidence, updated_us, CAST(embedding AS DOUBLE[]) AS v FROM nodes),
s AS (SELECT query_id, id, confidence, updated_us, CASE WHEN v IS NULL THEN 0.0 ELSE coalesce(list_cosine_similarity(vector, v), 0.0) END AS similarity FROM q, m),
t AS (SELECT query_id, id, confidence, updated_us, round(similarity, 6) AS similarity, round(similarity * confidence, 6) AS score, similarity * confidence AS raw_score FROM s),
hits AS (SELECT query_id, id, confidence, similarity, score, raw_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, updated_us DESC, id) AS rank FROM t
  QUALIFY rank <= {k})"""


_HIT = "query_id, id, confidence, similarity + 0.0 AS similarity, score + 0.0 AS score, CAST(rank AS INTEGER) AS rank"


@query(oracle(f"WITH {_hits(10, 'WHERE vec_id = 0')} SELECT {_HIT} FROM hits", "nodes"))
def similarity_topk_single(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.search(first_vector(spark, sf), view(spark, sf, "nodes"), 10).drop("raw_score")


@query(oracle(f"WITH {_hits(10)} SELECT {_HIT} FROM hits", "nodes"))
def similarity_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as a query."""
    return similarity.search(vectors(spark, sf), view(spark, sf, "nodes"), 10).drop("raw_score")


@query(oracle(f"WITH {_hits(100000000, 'WHERE vec_id = 0')} SELECT {_HIT} FROM hits WHERE id IN (SELECT id FROM nodes WHERE embedding IS NULL)", "nodes"))
def similarity_null_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Where nodes without a vector come in the ranking of all nodes."""
    nodes = view(spark, sf, "nodes")
    ranked = similarity.search(first_vector(spark, sf), nodes, 100_000_000).drop("raw_score")
    return ranked.join(nodes.where("embedding IS NULL").select("id"), "id", "left_semi")


@query(oracle(f"WITH {_hits(2**63 - 1)} SELECT {_HIT} FROM hits WHERE id IN (SELECT id FROM nodes WHERE embedding IS NULL)", "nodes"))
def similarity_null_embedding_all(spark: SparkSession, sf: str) -> DataFrame:
    """The same for every vector as a query."""
    return similarity.without_vectors(vectors(spark, sf), view(spark, sf, "nodes"))


@query(oracle(f"""WITH {_ADJ}, best AS (SELECT src, dst, max(weight) AS weight FROM adj GROUP BY src, dst)
SELECT src, dst, weight, CAST(row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS INTEGER) AS rank FROM best QUALIFY rank <= 5""", "edges"))
def neighbor_topk_by_weight(spark: SparkSession, sf: str) -> DataFrame:
    return relations.top_neighbors(view(spark, sf, "edges"), 5)


def _retrieval(hops: int, decay: float = 0.85, limit: int = 10) -> str:
    """CTEs up to ``merged``: seeds, the hops, and the best merge."""
    ctes = f"""{_hits(limit)},
{_ADJ}, pair AS (SELECT src, dst, max(weight) AS weight FROM adj GROUP BY src, dst),
near AS (SELECT src, dst, weight FROM pair QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 5),
r0 AS (SELECT query_id, id AS node_id, score, raw_score, CAST(NULL AS VARCHAR) AS via, similarity FROM hits)"""
    for h in range(1, hops + 1):
        ctes += f""",
c{h} AS (SELECT f.query_id, dst AS node_id, greatest(f.{'raw_score' if h == 1 else 'score'} * weight * CAST({decay**h!r} AS DOUBLE), 0) AS score, src AS via FROM r{h - 1} f JOIN near ON src = f.node_id WHERE src <> dst AND dst IN (SELECT id FROM nodes)),
r{h} AS (SELECT * FROM c{h} QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY round(score, 12) DESC, via) = 1)"""
    arrived = " UNION ALL ".join(f"SELECT query_id, node_id, {h} AS hop, score, via FROM r{h}" for h in range(1, hops + 1))
    return f"""{ctes},
arrived AS ({arrived}),
every AS (SELECT a.*, s.score AS seed_score, s.similarity FROM arrived a LEFT JOIN r0 s USING (query_id, node_id)),
ways AS (SELECT query_id, node_id, max(score) AS score, min(hop) AS hop, arg_min(CASE WHEN seed_score IS NULL OR round(score + 1e-10, 6) > round(seed_score + 1e-10, 6) THEN via END, CASE WHEN seed_score IS NULL OR round(score + 1e-10, 6) > round(seed_score + 1e-10, 6) THEN hop END) AS via FROM every GROUP BY query_id, node_id),
merged AS (SELECT coalesce(s.query_id, w.query_id) AS query_id, coalesce(s.node_id, w.node_id) AS node_id, round(greatest(coalesce(s.score, w.score), coalesce(w.score, s.score)) + 1e-10, 6) + 0.0 AS score,
  CASE WHEN s.node_id IS NULL THEN w.hop ELSE 0 END AS hops,
  CASE WHEN s.node_id IS NULL THEN 0.0 WHEN w.via IS NOT NULL THEN greatest(s.similarity, 0.0) ELSE s.similarity END + 0.0 AS similarity, w.via AS via
  FROM r0 s FULL OUTER JOIN ways w ON s.query_id = w.query_id AND s.node_id = w.node_id)"""


def _ranked(hops: int, limit: int, decay: float = 0.85) -> str:
    return f"""WITH {_retrieval(hops, decay)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM merged QUALIFY rank <= {limit}),
full_rows AS (SELECT query_id, rank, node_id, content, node_type, confidence, similarity, score, CASE WHEN hops = 0 THEN 'seed' ELSE 'neighbor' END AS source, hops, via FROM ranked JOIN nodes ON id = node_id)"""


_OUT = "query_id, CAST(rank AS INTEGER) AS rank, node_id, node_type, confidence, similarity, score, source, CAST(hops AS INTEGER) AS hops, via"


def _retrieved(spark: SparkSession, sf: str, config: RetrievalConfig, **filters) -> DataFrame:
    """Context of every vector."""
    return retrieve.retrieve(vectors(spark, sf), view(spark, sf, "nodes"), view(spark, sf, "edges"), config, **filters).drop("content")


@query(oracle(f"WITH {_hits(10)} SELECT query_id, id AS node_id, similarity + 0.0 AS similarity, score + 0.0 AS score FROM hits", "nodes"))
def retrieve_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.seeds(vectors(spark, sf), view(spark, sf, "nodes")).drop("raw_score")


@query(oracle(f"{_ranked(1, 20)} SELECT {_OUT} FROM full_rows", "nodes", "edges"))
def retrieve_context_1hop(spark: SparkSession, sf: str) -> DataFrame:
    return _retrieved(spark, sf, RetrievalConfig())


@query(oracle(f"{_ranked(2, 200, 1.0)} SELECT {_OUT} FROM full_rows", "nodes", "edges"))
def retrieve_context_2hop(spark: SparkSession, sf: str) -> DataFrame:
    return _retrieved(spark, sf, RetrievalConfig(expansion_hops=2, hop_decay=1.0, final_limit=200))


@query(oracle(f"{_ranked(1, 20)} SELECT {_OUT.replace('CAST(rank AS INTEGER) AS rank', 'CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS INTEGER) AS rank')} FROM full_rows WHERE score >= CAST(0.1 AS DOUBLE) AND node_type = 'semantic'", "nodes", "edges"))
def retrieve_min_score_postfilter(spark: SparkSession, sf: str) -> DataFrame:
    return _retrieved(spark, sf, RetrievalConfig(), min_score=0.1, node_type="semantic")


@query(oracle(f"WITH {_retrieval(1)} SELECT query_id, sum(CASE WHEN hops = 0 THEN 1 ELSE 0 END)::BIGINT AS seed_count, sum(CASE WHEN hops > 0 THEN 1 ELSE 0 END)::BIGINT AS expanded_count, least(count(*), 20)::BIGINT AS returned FROM merged GROUP BY query_id", "nodes", "edges"))
def retrieve_stats(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.stats(vectors(spark, sf), view(spark, sf, "nodes"), view(spark, sf, "edges"))
