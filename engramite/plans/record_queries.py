"""Queries over records on their way in and out: normalised inserts, upserts, patches, serialised rows, files and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramite.functions import normalize as N
from engramite.functions import scoring
from engramite.operators import consolidate, coverage, goals, learn, records, relations
from engramite.plans.collect import registrar
from engramite.plans.goal_queries import _EVALUATED, _SIGNALS, _evaluated, _goals
from engramite.plans.memory_queries import _DIFF, _TARGET, _UPDATES
from engramite.plans.views import AS_OF_US, oracle, table, view
from engramite.schema import EDGE_TYPES, GOAL_STATUSES, NODE_TYPES, OUTCOME_STATUSES, PRIORITIES, SOURCE_TYPES, TIMESCALES, CoverageConfig
from engramite.sources import filesystem, sqlite, tables

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

_RAW = {
    # raw records as callers give them: odd case, blanks, numbers in text, unknown names
    "raw_nodes": (("documents",), """SELECT concat('node_', CAST(doc_id AS VARCHAR(20))) AS id, CASE doc_id % 5 WHEN 0 THEN ' Episodic ' WHEN 1 THEN 'PROCEDURAL' WHEN 2 THEN 'semantic' WHEN 3 THEN 'unknown' END AS node_type,
      CASE doc_id % 6 WHEN 0 THEN '0.25' WHEN 1 THEN '1.5e0xyz' WHEN 2 THEN '-3' WHEN 3 THEN 'much' WHEN 4 THEN '0.75abc' END AS confidence, CASE doc_id % 3 WHEN 0 THEN concat('  ', source, ' ') WHEN 1 THEN '   ' END AS source,
      CASE doc_id % 4 WHEN 0 THEN '{{"a":1}}' WHEN 1 THEN '[1]' WHEN 2 THEN 'broken' END AS metadata FROM {documents}"""),
    "raw_edges": (("orders",), """SELECT concat('edge_', CAST(o_custkey AS VARCHAR(20))) AS id, o_orderkey AS seq, CASE o_orderkey % 7 WHEN 0 THEN 'CAUSAL' WHEN 1 THEN ' supports' WHEN 2 THEN 'contradicts' WHEN 3 THEN 'derived_from ' WHEN 4 THEN 'nothing' END AS edge_type,
      CASE o_orderkey % 5 WHEN 0 THEN '0.9' WHEN 1 THEN '7' WHEN 2 THEN 'x' WHEN 3 THEN '-0.5' END AS weight FROM {orders}"""),
    "raw_outcomes": (("events",), """SELECT concat('action_', CAST(event_id AS VARCHAR(20))) AS action_id, CASE event_id % 6 WHEN 0 THEN 'Success' WHEN 1 THEN ' timeout ' WHEN 2 THEN 'PARTIAL_SUCCESS' WHEN 3 THEN 'odd' WHEN 4 THEN 'failure' END AS status,
      CASE event_id % 4 WHEN 0 THEN '0.5' WHEN 1 THEN '2' WHEN 2 THEN 'none' END AS confidence, concat('n', CAST(user_id % 50 AS VARCHAR(20))) AS a, concat(' n', CAST(event_id % 9 AS VARCHAR(20)), ' ') AS b, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('n', CAST(user_id % 50 AS VARCHAR(20))) ELSE 'n7' END AS c FROM {events}"""),
    "raw_goals": (("customer",), """SELECT concat('goal_', CAST(c_custkey AS VARCHAR(20))) AS id, concat('  ', c_name, CASE c_custkey % 4 WHEN 0 THEN '' ELSE ' ' END) AS title, CASE c_custkey % 7 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN ' blocked' WHEN 2 THEN 'completed ' WHEN 3 THEN 'odd' WHEN 4 THEN 'abandoned' WHEN 5 THEN 'proposed' END AS status,
      CASE c_custkey % 6 WHEN 0 THEN 'Immediate' WHEN 1 THEN 'medium_term' WHEN 2 THEN ' LONG_TERM' WHEN 3 THEN 'some day' END AS timescale, CASE c_custkey % 5 WHEN 0 THEN 'system' WHEN 1 THEN 'Inferred' WHEN 2 THEN 'policy ' WHEN 3 THEN '?' END AS source_type, CASE c_custkey % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'critical' WHEN 2 THEN ' high ' WHEN 3 THEN '9' END AS priority,
      CASE c_custkey % 4 WHEN 0 THEN ' 0.4 ' WHEN 1 THEN 'all' WHEN 2 THEN '1.5' END AS progress, CASE c_custkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN concat(' ', c_mktsegment) END AS owner, lower(c_mktsegment) AS tag1, concat(' ', lower(c_mktsegment), ' ') AS tag2, CASE c_custkey % 2 WHEN 0 THEN ' ' ELSE 'x' END AS tag3 FROM {customer}"""),
}


def _raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    names, text = _RAW[name]
    return spark.sql(text, **{t: table(spark, sf, t) for t in names})


def _sql(body: str, *names: str) -> str:
    """DuckDB SQL over raw records and views."""
    raw = ", ".join(f"{n} AS ({_RAW[n][1].format(**{t: t for t in _RAW[n][0]})})" for n in names if n in _RAW)
    rest = oracle(body, *[n for n in names if n not in _RAW]).strip()
    return f"WITH {raw}, {rest[5:]}" if rest[:5].upper() == "WITH " else f"WITH {raw} {rest}"


def _enum(column: str, allowed: tuple[str, ...], default: str) -> str:
    known = ", ".join(f"'{a}'" for a in allowed)
    return f"CASE WHEN lower(trim({column})) IN ({known}) THEN lower(trim({column})) ELSE '{default}' END AS {column}"


def _prob(column: str, default: float, trim: bool = False) -> str:
    text = f"trim({column})" if trim else column
    return f"least(greatest(coalesce(TRY_CAST(nullif(regexp_extract({text}, '^[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?'), '') AS DOUBLE), CAST({default} AS DOUBLE)), 0), 1) AS {column}"


@query(_sql(f"SELECT id, {_enum('node_type', NODE_TYPES, 'semantic')}, {_prob('confidence', 0.5)}, nullif(trim(source), '') AS source, CASE WHEN metadata LIKE '{{%' THEN metadata ELSE '{{}}' END AS metadata FROM raw_nodes", "raw_nodes"))
def node_insert_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return records.nodes(_raw(spark, sf, "raw_nodes"))


@query(_sql(f"SELECT id, arg_max(edge_type, seq) AS edge_type, arg_max(weight, seq) AS weight, max(seq) AS seq FROM (SELECT id, seq, {_enum('edge_type', EDGE_TYPES, 'related')}, {_prob('weight', 0.5)} FROM raw_edges) GROUP BY id", "raw_edges"))
def edge_upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Edges written again and again: the last normalised write of each id."""
    return tables.latest_per_key(records.edges(_raw(spark, sf, "raw_edges")))


@query(_sql(f"SELECT action_id, {_enum('status', OUTCOME_STATUSES, 'failure')}, {_prob('confidence', 0.5)}, array_to_string(list_filter([trim(a), CASE WHEN trim(b) <> trim(a) THEN trim(b) END, CASE WHEN trim(c) <> '' AND trim(c) <> trim(a) AND trim(c) <> trim(b) THEN trim(c) END], lambda x: x IS NOT NULL), '|') AS causes FROM raw_outcomes", "raw_outcomes"))
def outcome_insert_normalised(spark: SparkSession, sf: str) -> DataFrame:
    raw = _raw(spark, sf, "raw_outcomes").withColumn("causal_node_ids", F.array("a", "b", "c"))
    return records.outcomes(raw).select("action_id", "status", "confidence", F.concat_ws("|", "causal_node_ids").alias("causes"))


@query(_sql("SELECT action_id, x AS causal_node_id FROM raw_outcomes, (VALUES (1), (2), (3)) k(i), LATERAL (SELECT CASE i WHEN 1 THEN trim(a) WHEN 2 THEN CASE WHEN trim(b) <> trim(a) THEN trim(b) END ELSE CASE WHEN trim(c) <> '' AND trim(c) <> trim(a) AND trim(c) <> trim(b) THEN trim(c) END END AS x) WHERE x IS NOT NULL", "raw_outcomes"))
def outcome_causes(spark: SparkSession, sf: str) -> DataFrame:
    """One row for an outcome and distinct cause."""
    raw = _raw(spark, sf, "raw_outcomes").withColumn("causal_node_ids", F.array("a", "b", "c"))
    return learn.causes(raw).select("action_id", "causal_node_id")


_GOAL = f"""SELECT id, trim(title) AS title, {_enum('status', GOAL_STATUSES, 'proposed')}, {_enum('timescale', TIMESCALES, 'short_term')}, {_enum('source_type', SOURCE_TYPES, 'user')}, {_enum('priority', PRIORITIES, 'normal')},
 {_prob('progress', 0.0, True)}, nullif(trim(owner), '') AS owner, CASE WHEN trim(tag3) = '' THEN tag1 ELSE tag1 || '|x' END AS tags FROM raw_goals"""


@query(_sql(f"WITH g AS ({_GOAL}) SELECT * REPLACE (CASE WHEN status = 'completed' THEN 1.0 ELSE progress END AS progress), CASE WHEN status = 'completed' THEN {AS_OF_US} END AS completed_us FROM g", "raw_goals"))
def goal_insert_normalised(spark: SparkSession, sf: str) -> DataFrame:
    raw = _raw(spark, sf, "raw_goals").withColumn("tags", F.array("tag1", "tag2", "tag3"))
    return records.goals(raw, AS_OF_US).withColumn("tags", F.concat_ws("|", "tags"))


@query(_sql(f"WITH p AS ({_GOAL}) SELECT g.id, p.title, p.priority, g.status, g.owner FROM goals g JOIN p ON p.id = g.id", "raw_goals", "goals"))
def goal_partial_update(spark: SparkSession, sf: str) -> DataFrame:
    """Patches that set title and priority only."""
    new = records.goals(_raw(spark, sf, "raw_goals").withColumn("tags", F.array("tag1")), AS_OF_US)
    patches = new.select("id", "title", "priority", F.array(F.lit("title"), F.lit("priority")).alias(tables.SET))
    return tables.patched(_goals(spark, sf).select("id", "title", "priority", "status", "owner"), patches)


@query(_sql(f"SELECT id, confidence FROM (SELECT id, {_prob('confidence', 0.0)} FROM raw_nodes) WHERE confidence >= CAST(0.2 AS DOUBLE)", "raw_nodes"))
def nodes_list_lenient(spark: SparkSession, sf: str) -> DataFrame:
    """Confidences in whatever form against a least one in whatever form: a bad number counts as 0."""
    raw = _raw(spark, sf, "raw_nodes").select("id", N.probability(F.col("confidence"), 0.0).alias("confidence"))
    return relations.filter_nodes(raw, min_confidence=" 0.2x")


@query(oracle("SELECT s.signal_id, s.node_id, CASE WHEN n.id IS NULL THEN 0.0 END::DOUBLE AS score, n.confidence, n.updated_us FROM signal_nodes s LEFT JOIN nodes n ON n.id = s.node_id || CASE WHEN length(s.signal_id) % 2 = 0 THEN '' ELSE 'x' END", "signal_nodes", "nodes"))
def coverage_resolved_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Signals that give ids only; those of every other length of signal name are unknown."""
    given = view(spark, sf, "signal_nodes").select("signal_id", "node_id", F.when(F.length("signal_id") % 2 == 0, F.col("node_id")).otherwise(F.concat("node_id", F.lit("x"))).alias("asked"))
    out = coverage.resolved(given.select("signal_id", F.col("asked").alias("node_id")), view(spark, sf, "nodes"))
    return out.select("signal_id", F.regexp_replace("node_id", "x$", "").alias("node_id"), "score", "confidence", "updated_us")


_T = CoverageConfig().thresholds
_F3 = lambda x: f"printf('%.3f', round({x} + 1e-10, 3))"
_LIMITS = f"thresholds: act(cov>={_T['act_coverage']:.3f}, unc<={_T['act_max_uncertainty']:.3f}, risk<={_T['act_max_risk']:.3f}) learn(cov>={_T['learn_coverage']:.3f}, unc<={_T['learn_max_uncertainty']:.3f}, risk<={_T['learn_max_risk']:.3f})"


@query(oracle(f"""WITH {_EVALUATED} SELECT signal_id, 'coverage=' || {_F3('coverage')} || ' uncertainty=' || {_F3('uncertainty')} || ' risk=' || {_F3('risk')} || ' decision=' || decision AS line1,
 'semantic=' || {_F3('semantic_coverage')} || ' consistency=' || {_F3('consistency')} || ' freshness=' || {_F3('freshness')} || ' graph_support=' || {_F3('graph_support')} || ' outcomes=' || {_F3('outcome_reliability')} AS line2, '{_LIMITS}' AS line3 FROM evaluated""", *_SIGNALS))
def coverage_rationale(spark: SparkSession, sf: str) -> DataFrame:
    r = coverage.recommend(_evaluated(spark, sf))
    return r.select("signal_id", *[r["rationale"][k].alias(f"line{k + 1}") for k in range(3)])


@query(oracle(f"""WITH {_EVALUATED}, top AS (SELECT signal_id, string_agg(printf('%.6f', round(s + 1e-10, 6)), '|' ORDER BY s DESC) FILTER (place <= 8) AS top_node_scores FROM np GROUP BY signal_id), oc AS (SELECT signal_id, count(*) AS n FROM signal_outcomes GROUP BY signal_id)
SELECT x.signal_id, coalesce(p.n_nodes, 0) AS node_count, coalesce(oc.n, 0) AS outcome_count, x.contradictions AS contradiction_count, p.known_unknowns, p.criticality AS goal_criticality, coalesce(top_node_scores, '') AS top_node_scores
FROM signal_scalars x JOIN parts p ON p.signal_id = x.signal_id LEFT JOIN top ON top.signal_id = x.signal_id LEFT JOIN oc ON oc.signal_id = x.signal_id""", *_SIGNALS))
def coverage_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    out = coverage.diagnostics(*[view(spark, sf, n) for n in ("signal_scalars", "signal_nodes", "signal_outcomes")])
    return out.withColumn("top_node_scores", F.concat_ws("|", F.transform("top_node_scores", lambda s: F.format_string("%.6f", F.round(s + 1e-10, 6)))))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS position, round(CASE WHEN i <= len(embedding) AND norm > 1e-12 THEN embedding[i]::DOUBLE / norm ELSE 0 END, 6) + 0.0 AS value FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding[1:48], lambda x: x::DOUBLE * x))) AS norm FROM embeddings), unnest(generate_series(1, 48)) AS u(i)")
def vectors_fitted(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector cut or padded to 48 numbers and scaled to length 1."""
    fitted = table(spark, sf, "embeddings").select("vec_id", F.posexplode(scoring.fit_dimension(F.col("embedding"), 48)).alias("position", "x"))
    return fitted.select("vec_id", "position", (F.round("x", 6) + 0.0).alias("value"))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS position, CAST(embedding[i] AS FLOAT) AS value FROM embeddings, unnest(generate_series(1, len(embedding))) AS u(i)")
def vectors_base64_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as base64 of little-endian floats and back."""
    held = table(spark, sf, "embeddings").select("vec_id", sqlite.encoded("embedding").alias("blob"))
    return held.select("vec_id", F.posexplode(sqlite.vector("blob")).alias("position", "value"))


@query("SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST([0.5e0, -0.25e0, 1.0e0] || list_transform(generate_series(4, len(embedding)), lambda i: 0.0e0) AS DOUBLE[])), 6) + 0.0 AS similarity FROM embeddings WHERE len(embedding) > 3")
def cosine_expression(spark: SparkSession, sf: str) -> DataFrame:
    """The cosine of every vector and a given one, padded to its length, inside the JVM."""
    padded = F.concat(F.array(F.lit(0.5), F.lit(-0.25), F.lit(1.0)), F.array_repeat(F.lit(0.0), F.size("embedding") - 3))
    return table(spark, sf, "embeddings").where(F.size("embedding") > 3).select("vec_id", (F.round(scoring.cosine(F.col("embedding"), padded), 6) + 0.0).alias("similarity"))


@query(oracle("""SELECT id, '{"id":"' || id || '","title":"' || title || '","status":"' || status || '","priority":"' || priority || '","tags":["' || tag1 || '","' || tag2 || '"],"updated_at":"' || strftime(make_timestamp(updated_us), '%Y-%m-%dT%H:%M:%S.%fZ') || '","due_at":' || CASE WHEN due_us IS NULL THEN 'null' ELSE '"' || strftime(make_timestamp(due_us), '%Y-%m-%dT%H:%M:%S.%fZ') || '"' END || '}' AS line FROM goals""", "goals"))
def goals_as_json(spark: SparkSession, sf: str) -> DataFrame:
    """A line of JSON for every goal, times in ISO-8601."""
    g = _goals(spark, sf).select("id", "title", "status", "priority", "tags", F.col("updated_us").alias("updated_at"), F.col("due_us").alias("due_at"))
    return records.json_lines(g, "id", times=("updated_at", "due_at"))


@query(oracle("""SELECT id, '{"id":"' || id || '","source_id":"' || source_id || '","target_id":"' || target_id || '","edge_type":"' || edge_type || '","weight":' || printf('%.3f', round(weight + 1e-10, 3)) || '}' AS line FROM edges""", "edges"))
def edges_as_json(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "edges").select("id", "source_id", "target_id", "edge_type", F.round(F.col("weight") + 1e-10, 3).cast("decimal(6,3)").alias("weight"))
    return records.json_lines(e, "id")


@query(oracle(f"""WITH {_UPDATES}, t AS (SELECT node_id, count(*) AS feedback_count, arg_max(u.action_id, o.seq) AS action_id FROM updates u JOIN outcomes o USING (action_id) WHERE result = 'updated' GROUP BY node_id)
SELECT t.node_id, feedback_count, t.action_id, status, round(confidence, 6) AS confidence FROM t JOIN outcomes o ON o.action_id = t.action_id""", "nodes", "outcomes"))
def learn_feedback_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """What the metadata of every node that learned says afterwards."""
    told = records.feedback_metadata(view(spark, sf, "nodes").withColumn("metadata", F.lit('{"kept":true}')), view(spark, sf, "outcomes"))
    m = F.from_json("metadata", "feedback_count long, last_feedback struct<action_id:string,status:string,confidence:double>, kept boolean")
    return told.select("node_id", m.alias("m")).where("m.kept").select("node_id", "m.feedback_count", "m.last_feedback.action_id", "m.last_feedback.status", F.round("m.last_feedback.confidence", 6).alias("confidence"))


@query(oracle("SELECT id, CASE WHEN status = 'blocked' THEN 'blocked>active' WHEN status = 'proposed' THEN 'proposed>active' WHEN status = 'abandoned' THEN 'abandoned>active' WHEN status = 'active' THEN 'active>active' END || ',start>' || status AS history FROM goals WHERE status <> 'completed'", "goals"))
def goal_transition_history(spark: SparkSession, sf: str) -> DataFrame:
    """Every goal asked to become active: its history, newest first."""
    held = _goals(spark, sf).withColumn("metadata", F.concat(F.lit('{"transitions":[{"from":"start","to":"'), "status", F.lit('"}]}')))
    out = records.transition_history(held, F.lit("active"), AS_OF_US)
    past = F.from_json(F.get_json_object("metadata", "$.transitions"), "array<struct<`from`:string,`to`:string>>")
    return out.select("id", F.concat_ws(",", F.transform(past, lambda t: F.concat(t["from"], F.lit(">"), t["to"]))).alias("history"))


@query(oracle("SELECT goal_id, dependency_goal_id FROM goal_deps EXCEPT SELECT id, parent_goal_id FROM goals", "goal_deps", "goals"))
def goal_dependencies_removed(spark: SparkSession, sf: str) -> DataFrame:
    """The dependencies without those on a goal's parent."""
    gone = _goals(spark, sf).select(F.col("id").alias("goal_id"), F.col("parent_goal_id").alias("dependency_goal_id"))
    return goals.remove_dependencies(view(spark, sf, "goal_deps"), gone).distinct()


@query(oracle("""WITH v AS (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM nodes WHERE embedding IS NOT NULL),
s AS (SELECT a.id AS q, b.id AS n, round(coalesce(list_cosine_similarity(a.e, b.e), 0.0), 6) AS similarity, row_number() OVER (PARTITION BY a.id ORDER BY round(coalesce(list_cosine_similarity(a.e, b.e), 0.0), 6) DESC, t.updated_us DESC, b.id) AS place FROM v a, v b JOIN nodes t ON t.id = b.id QUALIFY place <= 6)
SELECT DISTINCT least(q, n) AS a, greatest(q, n) AS b, similarity + 0.0 AS similarity FROM s WHERE q <> n AND similarity >= 0.2e0""", "nodes"))
def similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of similar nodes, from the six nearest of every node."""
    return consolidate.similar_pairs(view(spark, sf, "nodes"), 0.2, 6)


@query(oracle("SELECT type, count(*) AS n FROM (" + _DIFF + ") GROUP BY type", "snap_old", "snap_new"))
def watch_tallies(spark: SparkSession, sf: str) -> DataFrame:
    return relations.count_by(filesystem.diff(view(spark, sf, "snap_old"), view(spark, sf, "snap_new")), "type")


@query("SELECT count(*) AS files_discovered, count(*) FILTER (page_id % 7 <> 3 AND html IS NOT NULL) AS files_ingested, count(*) FILTER (page_id % 7 = 3 OR html IS NULL) AS files_failed FROM pages")
def scan_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The tallies of a scan in which some files can't be read."""
    pages = table(spark, sf, "pages").select(F.col("url").alias("path"), F.when((F.col("page_id") % 7 == 3) | F.col("html").isNull(), "enoent").alias("reason"))
    return filesystem.summary(pages)


_REL = "regexp_replace(url, '^[a-z]+://', '')"


@query(f"SELECT '/' || {_REL} AS path, CASE WHEN regexp_matches({_REL}, '(^|/)[^/]*11(/|$)') THEN false WHEN regexp_matches({_REL}, '^page/[^/]*1$') THEN true WHEN regexp_matches({_REL}, '(^|/)[^/]*\\.log(/|$)') THEN true ELSE false END AS ignored FROM pages")
def gitignore_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The URLs as paths, and whether a few ignore rules drop them."""
    rules = tuple(r for line in ("*.log", "/page/*1", "tmp/", "!*11") if (r := filesystem.parse_rule(line, "/")))
    path = F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://", ""))
    return table(spark, sf, "pages").select(path.alias("path"), filesystem.ignored_files(path, rules).alias("ignored"))


@query("SELECT url AS path, lower(regexp_extract(url, '[^/](\\.[^./]*)$', 1)) AS extension, lower(regexp_extract(url, '[^/](\\.[^./]*)$', 1)) IN ('.html', '.txt') AS wanted FROM pages")
def file_extensions(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("url")
    return table(spark, sf, "pages").select(path.alias("path"), filesystem.extension(path).alias("extension"), filesystem.has_extension(path, ["html", " .TXT "]).alias("wanted"))


@query(_sql("""SELECT x.name, x.n, CASE WHEN x.n > 0 THEN 'up' ELSE 'down' END AS state FROM (SELECT 'graph' AS name, (SELECT count(*) FROM nodes) + (SELECT count(*) FROM edges) AS n UNION ALL SELECT 'learner', (SELECT count(*) FROM outcomes) UNION ALL SELECT 'goal_graph', (SELECT count(*) FROM goals)) x""", "raw_nodes", "nodes", "edges", "outcomes", "goals"))
def health_by_service(spark: SparkSession, sf: str) -> DataFrame:
    """Each service's rows and whether its tables can be read."""
    n = {name: view(spark, sf, name).agg(F.count(F.lit(1)).alias("n")) for name in ("nodes", "edges", "outcomes", "goals")}
    graph = n["nodes"].unionByName(n["edges"]).agg(F.sum("n").alias("n"))
    parts = [d.select(F.lit(name).alias("name"), "n") for name, d in (("graph", graph), ("learner", n["outcomes"]), ("goal_graph", n["goals"]))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("state", F.when(F.col("n") > 0, "up").otherwise("down"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) WHEN event_id % 3 = 1 THEN epoch_us(ts) - 3600000000 ELSE 0 END AS us FROM (SELECT event_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(event_id AS BIGINT)) AS ts FROM events)")
def times_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Times in ISO-8601 with an offset; a time without one falls back."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("event_id"))
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(iso, F.lit("Z"))).when(F.col("event_id") % 3 == 1, F.concat(iso, F.lit("+01:00"))).otherwise(iso)
    return table(spark, sf, "events").select("event_id", F.unix_micros(N.timestamp(text, F.timestamp_seconds(F.lit(0)))).alias("us"))


@query(_sql(f"SELECT id, {_prob('score', 0.5, True)} FROM (SELECT id, confidence || ' ' AS score FROM raw_nodes)", "raw_nodes"))
def numbers_with_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in text: the longest numeric prefix after trimming counts."""
    return _raw(spark, sf, "raw_nodes").select("id", N.probability(F.concat("confidence", F.lit(" ")), 0.5, trim=True).alias("score"))


@query(oracle(f"SELECT n.id, CASE WHEN t.n IS NULL THEN round(n.confidence, 9) ELSE round(n.confidence * power(CAST(0.8 AS DOUBLE), t.n) + t.pulled, 9) END AS confidence FROM nodes n LEFT JOIN (SELECT node_id, count(*) AS n, sum(CAST(0.2 AS DOUBLE) * target * power(CAST(0.8 AS DOUBLE), behind)) AS pulled FROM (SELECT causal_node_id AS node_id, {_TARGET} AS target, row_number() OVER (PARTITION BY causal_node_id ORDER BY seq DESC, action_id DESC) - 1 AS behind FROM outcomes) GROUP BY node_id) t ON t.node_id = n.id", "nodes", "outcomes"))
def learn_applied(spark: SparkSession, sf: str) -> DataFrame:
    """All nodes after all outcomes."""
    nodes = view(spark, sf, "nodes").select("id", "confidence")
    return learn.applied(nodes, learn.learn(nodes, view(spark, sf, "outcomes"))).withColumn("confidence", F.round("confidence", 9))


@query(oracle(f"SELECT id, round(confidence * CAST(0.98 AS DOUBLE), 9) AS confidence, CASE WHEN abs(confidence * CAST(0.98 AS DOUBLE) - confidence) > 1e-12 THEN {AS_OF_US} ELSE updated_us END AS updated_us FROM nodes WHERE confidence * CAST(0.98 AS DOUBLE) >= CAST(0.1 AS DOUBLE)", "nodes"))
def consolidate_applied(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes that a cycle leaves."""
    return consolidate.consolidated(view(spark, sf, "nodes").select("id", "confidence", "updated_us"), as_of_us=AS_OF_US).withColumn("confidence", F.round("confidence", 9))
