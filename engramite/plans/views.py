"""The knowledge graph as views over the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: 2024-04-01 in epoch microseconds: the fixed "now" of every query.
AS_OF_US = 1_711_929_600_000_000

_STATUS = "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'click' THEN 'partial_success' WHEN 'view' THEN 'timeout' ELSE 'failure' END AS status"
_UNIT = "LEAST(GREATEST(value / 200, 0), 1) AS confidence"
_N = "CROSS JOIN (SELECT count(*) AS n FROM {documents}) c"

#: Name of a view: the tables that it reads, and its text with their names in braces.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "nodes": (("documents", "embeddings"), """
        SELECT concat('node_', CAST(d.doc_id AS VARCHAR(20))) AS id, d.doc_id AS nid, d.text AS content,
         CASE d.doc_id % 3 WHEN 0 THEN 'episodic' WHEN 1 THEN 'semantic' ELSE 'procedural' END AS node_type,
         CAST(d.doc_id % 101 AS DOUBLE) / 100 AS confidence, e.embedding AS embedding, d.source AS source,
         d.n_chars % 10 AS access_count, 1704067200000000 + d.doc_id * 3600000000 AS updated_us
         FROM {documents} d LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id"""),
    "edges": (("orders", "documents"), f"""
        SELECT concat('edge_', CAST(o_orderkey AS VARCHAR(20))) AS id, concat('node_', CAST(o_orderkey % n AS VARCHAR(20))) AS source_id,
         concat('node_', CAST((o_custkey * 7) % (n + 5) AS VARCHAR(20))) AS target_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'causal' WHEN '2-HIGH' THEN 'supports' WHEN '4-NOT SPECIFIED' THEN 'derived_from' WHEN '5-LOW' THEN 'contradicts' ELSE 'related' END AS edge_type,
         CAST(o_orderkey % 97 AS DOUBLE) / 96 AS weight
         FROM {{orders}} {_N}""".replace("{{", "{").replace("}}", "}")),
    "outcomes": (("events", "documents"), f"""
        SELECT concat('action_', CAST(event_id AS VARCHAR(20))) AS action_id, event_id AS seq, {_STATUS}, {_UNIT},
         concat('node_', CAST(CASE WHEN event_id % 10 = 0 THEN event_id % (n + 50) ELSE user_id % n END AS VARCHAR(20))) AS causal_node_id
         FROM {{events}} {_N}""".replace("{{", "{").replace("}}", "}")),
    "goals": (("customer", "nation"), """
        SELECT concat('goal_', CAST(c_custkey AS VARCHAR(20))) AS id, c_name AS title,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'active' WHEN 'AUTOMOBILE' THEN 'blocked' WHEN 'MACHINERY' THEN 'completed' WHEN 'HOUSEHOLD' THEN 'abandoned' ELSE 'proposed' END AS status,
         CASE c_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'normal' WHEN 2 THEN 'high' ELSE 'critical' END AS priority,
         CASE c_custkey % 5 WHEN 0 THEN 'immediate' WHEN 1 THEN 'medium_term' WHEN 2 THEN 'long_term' ELSE 'short_term' END AS timescale,
         LEAST(GREATEST(c_acctbal / 10000, 0), 1) AS progress, n_name AS owner, lower(c_mktsegment) AS tag1, concat('tier_', CAST(c_custkey % 3 AS VARCHAR(20))) AS tag2,
         CASE WHEN c_custkey > 0 THEN concat('goal_', CAST(CAST((c_custkey - c_custkey % 10) / 10 AS BIGINT) AS VARCHAR(20))) END AS parent_goal_id,
         1704067200000000 + c_custkey * 60000000 AS updated_us,
         CASE WHEN c_custkey % 6 <> 0 THEN 1704067200000000 + (c_custkey % 180) * 86400000000 END AS due_us
         FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey"""),
    "signal_nodes": (("customer", "orders", "documents"), f"""
        SELECT concat('sig_', CAST(c_custkey AS VARCHAR(20))) AS signal_id, concat('node_', CAST(o_orderkey % n AS VARCHAR(20))) AS node_id,
         CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 101 AS DOUBLE) / 100 END AS score, CAST(o_custkey % 89 AS DOUBLE) / 88 AS confidence,
         CAST(o_orderkey % 53 AS DOUBLE) / 52 AS similarity, o_orderkey % 6 AS edge_count,
         CASE WHEN o_orderkey % 11 <> 0 THEN 1704067200000000 + (o_orderkey % 720) * 3600000000 END AS updated_us
         FROM {{customer}} JOIN {{orders}} ON o_custkey = c_custkey {_N}""".replace("{{", "{").replace("}}", "}")),
    "signal_outcomes": (("events",), f"SELECT concat('sig_', CAST(user_id AS VARCHAR(20))) AS signal_id, event_id AS seq, {_STATUS}, {_UNIT} FROM {{events}}"),
    "signal_scalars": (("customer",), """
        SELECT concat('sig_', CAST(c_custkey AS VARCHAR(20))) AS signal_id, c_custkey % 7 AS contradictions,
         CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 13 AS DOUBLE) END AS graph_support, CAST(c_custkey % 10 AS DOUBLE) / 10 AS known_unknowns,
         CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 11 AS DOUBLE) / 10 END AS goal_criticality FROM {customer}"""),
    "snap_old": (("pages",), "SELECT url AS path, CAST(length(html) AS BIGINT) AS size, md5(html) AS sig FROM {pages} WHERE page_id % 7 <> 0"),
    "snap_new": (("pages",), "SELECT url AS path, CAST(length(html) AS BIGINT) AS size, md5(CASE WHEN page_id % 3 = 0 THEN concat(html, 'x') ELSE html END) AS sig FROM {pages} WHERE page_id % 5 <> 0"),
    "goal_deps": (("customer",), """
        SELECT concat('goal_', CAST(c_custkey AS VARCHAR(20))) AS goal_id, concat('goal_', CAST(CAST((c_custkey - c_custkey % 2) / 2 AS BIGINT) AS VARCHAR(20))) AS dependency_goal_id FROM {customer} WHERE c_custkey > 0
        UNION ALL SELECT concat('goal_', CAST(c_custkey AS VARCHAR(20))), concat('goal_', CAST(CAST((c_custkey - c_custkey % 3) / 3 AS BIGINT) AS VARCHAR(20))) FROM {customer} WHERE c_custkey > 2"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables in ``sf_dir``; no name is registered in the session's catalog."""
    tables, text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


def oracle(body: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL of ``body`` over the named views."""
    ctes = []
    for name in names:
        tables, text = VIEWS[name]
        ctes.append(f"{name} AS ({text.format(**{t: t for t in tables})})")
    body = body.strip()
    if body[:5].upper() == "WITH " and ctes:
        body = ", " + body[5:]
    head = "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(ctes) if ctes else ""
    return f"{head}\n{body}"
