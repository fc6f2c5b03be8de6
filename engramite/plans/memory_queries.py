"""Queries over learning, consolidation, embedding, stored tables and file snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramite.functions import text
from engramite.operators import consolidate, learn, telemetry
from engramite.plans.collect import registrar
from engramite.plans.views import AS_OF_US, oracle, table, view
from engramite.sources import filesystem, tables

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

#: Confidences here are decimals of up to eight digits, so that six would round exact halves.
DIGITS = 9

_TARGET = "least(greatest((CASE status WHEN 'success' THEN 1.0 WHEN 'partial_success' THEN 0.4 WHEN 'timeout' THEN -0.25 ELSE -0.5 END::DOUBLE * confidence + 1) / 2, 0), 1)"
_UPDATES = f"""told AS (SELECT action_id, causal_node_id AS node_id, seq, {_TARGET} AS target FROM outcomes),
updates AS (SELECT action_id, node_id, CASE WHEN n.id IS NULL THEN 'skipped_not_found' ELSE 'updated' END AS result, n.confidence AS old_confidence,
  n.confidence * CAST(0.8 AS DOUBLE) + target * CAST(0.2 AS DOUBLE) AS new_confidence FROM told LEFT JOIN nodes n ON n.id = node_id)"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, DIGITS) for n in names})


def _updates(spark: SparkSession, sf: str) -> DataFrame:
    return learn.updates(view(spark, sf, "nodes"), view(spark, sf, "outcomes"))


@query(oracle(f"WITH {_UPDATES} SELECT action_id, node_id, result, round(old_confidence, 9) AS old_confidence, round(new_confidence, 9) AS new_confidence, round(new_confidence - old_confidence, 9) + 0.0 AS delta FROM updates", "nodes", "outcomes"))
def learn_updates_single(spark: SparkSession, sf: str) -> DataFrame:
    """Every outcome on its own."""
    return _rounded(_updates(spark, sf), "old_confidence", "new_confidence", "delta").withColumn("delta", F.col("delta") + 0.0)


@query(oracle(f"""WITH told AS (SELECT causal_node_id AS node_id, {_TARGET} AS target, row_number() OVER (PARTITION BY causal_node_id ORDER BY seq DESC, action_id DESC) - 1 AS behind FROM outcomes),
folded AS (SELECT node_id, sum(CAST(0.2 AS DOUBLE) * target * power(CAST(0.8 AS DOUBLE), behind)) AS pulled, count(*) AS feedback_count FROM told GROUP BY node_id)
SELECT node_id, round(confidence, 9) AS old_confidence, round(confidence * power(CAST(0.8 AS DOUBLE), feedback_count) + pulled, 9) AS new_confidence,
  round(confidence * power(CAST(0.8 AS DOUBLE), feedback_count) + pulled - confidence, 9) + 0.0 AS delta, feedback_count FROM folded JOIN nodes ON id = node_id""", "nodes", "outcomes"))
def learn_closed_form(spark: SparkSession, sf: str) -> DataFrame:
    """All outcomes folded into their nodes."""
    out = learn.learn(view(spark, sf, "nodes"), view(spark, sf, "outcomes"))
    return _rounded(out, "old_confidence", "new_confidence", "delta").withColumn("delta", F.col("delta") + 0.0)


@query(oracle("SELECT causal_node_id AS node_id, count(*) AS n_outcomes FROM outcomes WHERE causal_node_id NOT IN (SELECT id FROM nodes) GROUP BY 1", "nodes", "outcomes"))
def learn_skipped_missing(spark: SparkSession, sf: str) -> DataFrame:
    return learn.skipped(view(spark, sf, "nodes"), view(spark, sf, "outcomes"))


@query(oracle("SELECT id AS node_id, count(*) AS feedback_count FROM nodes JOIN outcomes ON id = causal_node_id GROUP BY id", "nodes", "outcomes"))
def learn_feedback_count(spark: SparkSession, sf: str) -> DataFrame:
    return learn.learn(view(spark, sf, "nodes"), view(spark, sf, "outcomes")).select("node_id", "feedback_count")


@query(oracle(f"WITH {_UPDATES} SELECT action_id, count(*) AS processed, sum(CASE WHEN result = 'updated' THEN 1 ELSE 0 END)::BIGINT AS updated, sum(CASE WHEN result <> 'updated' THEN 1 ELSE 0 END)::BIGINT AS skipped FROM updates GROUP BY action_id", "nodes", "outcomes"))
def learn_tallies(spark: SparkSession, sf: str) -> DataFrame:
    return learn.tallies(_updates(spark, sf))


def _fates(k: int) -> str:
    factor = repr(0.98**k)
    return f"""fates AS (SELECT id, confidence AS old_confidence, confidence * CAST({factor} AS DOUBLE) AS new_confidence FROM nodes),
fated AS (SELECT *, CASE WHEN new_confidence < CAST(0.1 AS DOUBLE) THEN 'pruned' WHEN abs(new_confidence - old_confidence) <= 1e-12 THEN 'unchanged' ELSE 'decayed' END AS fate FROM fates)"""


_FATE = "id, round(old_confidence, 9) AS old_confidence, round(new_confidence, 9) AS new_confidence, round(new_confidence - old_confidence, 9) + 0.0 AS delta, fate"


def _fated(spark: SparkSession, sf: str, cycles: int) -> DataFrame:
    return _rounded(consolidate.fates(view(spark, sf, "nodes"), cycles=cycles), "old_confidence", "new_confidence", "delta").withColumn("delta", F.col("delta") + 0.0)


@query(oracle(f"WITH {_fates(1)} SELECT {_FATE} FROM fated", "nodes"))
def consolidate_fates(spark: SparkSession, sf: str) -> DataFrame:
    return _fated(spark, sf, 1)


@query(oracle(f"WITH {_fates(25)} SELECT {_FATE} FROM fated", "nodes"))
def consolidate_k_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return _fated(spark, sf, 25)


@query(oracle(f"WITH {_fates(1)} SELECT fate, count(*) AS n FROM fated GROUP BY fate", "nodes"))
def consolidate_tallies(spark: SparkSession, sf: str) -> DataFrame:
    return consolidate.tallies(consolidate.fates(view(spark, sf, "nodes")))


#: A document's tokens; a text without letters and digits is one token, an empty or null one ``_empty_``.
_TOKS = "SELECT doc_id, CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}]') THEN regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') ELSE [coalesce(nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ''), '_empty_')] END AS toks FROM documents"


@query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, toks[i] AS token FROM ({_TOKS}), unnest(generate_series(1, len(toks))) AS u(i)")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(text.tokens(F.col("text"))).alias("position", "token"))


@query(f"""WITH w AS (SELECT DISTINCT unnest(toks) AS token FROM ({_TOKS}))
SELECT token, CAST(i - 1 AS INTEGER) AS position, CASE WHEN length(token) < 3 THEN token ELSE substring(token, i, 3) END AS trigram FROM w, unnest(generate_series(1, greatest(length(token) - 2, 1))) AS u(i)""")
def trigrams(spark: SparkSession, sf: str) -> DataFrame:
    """The trigrams of every distinct token."""
    words = table(spark, sf, "documents").select(F.explode(text.tokens(F.col("text"))).alias("token")).distinct()
    return words.select("token", F.posexplode(text.trigrams(F.col("token"))).alias("position", "trigram"))


@query(f"""WITH t AS ({_TOKS}),
w AS (SELECT doc_id, toks[i] AS tok, i FROM t, unnest(generate_series(1, len(toks))) AS u(i)),
f AS (SELECT doc_id, tok AS feature, i, CAST(1 AS DOUBLE) AS scale FROM w UNION ALL
  SELECT doc_id, 'tri:' || CASE WHEN length(tok) < 3 THEN tok ELSE substring(tok, j, 3) END, i, 0.5 FROM w, unnest(generate_series(1, greatest(length(tok) - 2, 1))) AS v(j)),
b AS (SELECT doc_id, ('0x' || substr(md5('tok:' || feature), 1, 8))::BIGINT % 384 AS bucket,
  sum(CASE WHEN ('0x' || substr(md5('sgn:' || feature), 1, 8))::BIGINT % 2 = 1 THEN -1 ELSE 1 END * (1 + ln(1 + strlen(feature))) / i * scale) AS value FROM f GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(value * value)) AS norm FROM b GROUP BY doc_id)
SELECT doc_id, bucket, round(value / norm, 6) + 0.0 AS value FROM b JOIN n USING (doc_id) WHERE round(value / norm, 6) <> 0""")
def hashing_embed(spark: SparkSession, sf: str) -> DataFrame:
    """The buckets of every document's vector, without those that round to 0."""
    return text.bucket_weights(table(spark, sf, "documents"), "doc_id", "text", digits=6)


@query(oracle("SELECT causal_node_id AS id, arg_max(status, seq) AS status, round(arg_max(confidence, seq), 6) AS confidence, max(seq) AS seq FROM outcomes GROUP BY causal_node_id", "outcomes"))
def node_upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The outcomes as a log of writes to nodes: the last write of each key."""
    log = view(spark, sf, "outcomes").select(F.col("causal_node_id").alias("id"), "status", F.round("confidence", 6).alias("confidence"), "seq")
    return tables.latest_per_key(log)


@query(oracle("SELECT id, node_type, confidence FROM nodes WHERE id NOT IN (SELECT causal_node_id FROM outcomes WHERE status = 'failure')", "nodes", "outcomes"))
def node_delete_anti(spark: SparkSession, sf: str) -> DataFrame:
    """What is left after deleting every node that a failure names."""
    doomed = view(spark, sf, "outcomes").where("status = 'failure'").select(F.col("causal_node_id").alias("id"))
    return tables.without(view(spark, sf, "nodes").select("id", "node_type", "confidence"), doomed)


@query(oracle(f"SELECT n.id, n.access_count + coalesce(h.n, 0) AS access_count, CASE WHEN h.n IS NOT NULL THEN {AS_OF_US} ELSE updated_us END AS updated_us FROM nodes n LEFT JOIN (SELECT causal_node_id AS id, count(*) AS n FROM outcomes GROUP BY 1) h ON h.id = n.id", "nodes", "outcomes"))
def node_access_touch(spark: SparkSession, sf: str) -> DataFrame:
    nodes = view(spark, sf, "nodes").select("id", "access_count", "updated_us")
    return tables.touched(nodes, view(spark, sf, "outcomes").select(F.col("causal_node_id").alias("id")), AS_OF_US)


@query(oracle("SELECT n.id, CASE WHEN p.confidence IS NOT NULL THEN p.confidence ELSE round(n.confidence, 6) END AS confidence, n.source FROM nodes n LEFT JOIN (SELECT causal_node_id AS id, round(arg_max(confidence, seq), 6) AS confidence FROM outcomes GROUP BY 1) p ON p.id = n.id", "nodes", "outcomes"))
def node_partial_update(spark: SparkSession, sf: str) -> DataFrame:
    """Patches that set the confidence only."""
    patches = node_upsert_latest(spark, sf).select("id", "confidence", F.array(F.lit("confidence")).alias(tables.SET))
    return tables.patched(view(spark, sf, "nodes").select("id", F.round("confidence", 6).alias("confidence"), "source"), patches)


_DIFF = "SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS type FROM snap_old o FULL OUTER JOIN snap_new n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.sig <> n.sig OR o.size <> n.size"


@query(oracle(_DIFF, "snap_old", "snap_new"))
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return filesystem.diff(view(spark, sf, "snap_old"), view(spark, sf, "snap_new"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(F.col("url").alias("path"), F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")).cast("binary").alias("content"))
    changes = snapshot_diff(spark, sf).join(pages, "path", "left")
    removed = F.col("type") == "removed"
    return changes.select("path", "type", F.col("path").alias("relative_path"), F.when(~removed, F.octet_length("content")).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_us"), F.when(~removed, F.col("content")).alias("content"))


_STATE = "CASE WHEN strlen(body) > 2000 THEN 'too_large' ELSE 'ok' END"


@query(oracle(f"""WITH d AS ({_DIFF}), c AS (SELECT d.path, type, CASE WHEN page_id % 3 = 0 THEN concat(html, 'x') ELSE html END AS body FROM d JOIN pages p ON p.url = d.path)
SELECT path, type, CASE WHEN type = 'removed' OR strlen(body) > 2000 THEN '[filesystem ' || type || '] ' || path ELSE '[filesystem ' || type || '] ' || path || chr(10) || chr(10) || regexp_replace(body, '^\\s+|\\s+$', '', 'g') END AS content,
 CASE type WHEN 'added' THEN 0.65 WHEN 'modified' THEN 0.70 ELSE 0.60 END::DOUBLE AS confidence, CASE WHEN type = 'removed' THEN 'removed' ELSE {_STATE} END AS read_state FROM c""", "snap_old", "snap_new"))
def snapshot_ingest_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The changes as nodes, where files over 2,000 bytes are too large."""
    out = filesystem.event_nodes(_events(spark, sf), max_bytes=2000)
    about = F.from_json("metadata", "path string, event_type string")
    return out.select(about["path"].alias("path"), about["event_type"].alias("type"), "content", "confidence", "read_state")


@query("SELECT url AS path, CASE WHEN strlen(html) > 2000 THEN 'too_large' ELSE 'ok' END AS state, CASE WHEN strlen(html) > 2000 THEN '' ELSE regexp_replace(html, '^\\s+|\\s+$', '', 'g') END AS preview FROM pages")
def file_preview_state(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.col("html").cast("binary")
    shown = filesystem.preview(raw, F.octet_length(raw), 2000)
    return table(spark, sf, "pages").select(F.col("url").alias("path"), shown.alias("p")).select("path", F.col("p.state").alias("state"), F.col("p.text").alias("preview"))


@query(None)
def snapshot_ingest_nodes_full(spark: SparkSession, sf: str) -> DataFrame:
    """The changes as nodes within the operator's own limits; tests compare it with brute force."""
    out = filesystem.event_nodes(_events(spark, sf))
    about = F.from_json("metadata", "path string, event_type string")
    return out.select(about["path"].alias("path"), about["event_type"].alias("type"), "content", "confidence", "read_state")


@query(None)
def file_preview_state_full(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's preview within the operator's own limits; tests compare it with brute force."""
    raw = F.col("html").cast("binary")
    shown = filesystem.preview(raw, F.octet_length(raw))
    return table(spark, sf, "pages").select(F.col("url").alias("path"), shown.alias("p")).select("path", F.col("p.state").alias("state"), F.col("p.text").alias("preview"))


@query(oracle(f"""WITH {_UPDATES}, {_fates(1)},
t AS (SELECT action_id, count(*) AS processed, sum(CASE WHEN result = 'updated' THEN 1 ELSE 0 END) AS updated, sum(CASE WHEN result <> 'updated' THEN 1 ELSE 0 END) AS skipped FROM updates GROUP BY action_id)
SELECT 'outcome_processed' AS event, action_id AS subject, m.measure, m.value::DOUBLE AS value FROM t, LATERAL (VALUES ('processed', processed), ('updated', updated), ('skipped', skipped)) m(measure, value)
UNION ALL SELECT 'node_' || fate, id, m.measure, round(m.value, 9) FROM fated, LATERAL (VALUES ('old', old_confidence), ('new', new_confidence)) m(measure, value) WHERE fate <> 'unchanged'
UNION ALL SELECT 'consolidation_cycle', 'all', f.fate, (SELECT count(*) FROM fated x WHERE x.fate = f.fate)::DOUBLE FROM (VALUES ('decayed'), ('pruned'), ('unchanged')) f(fate)""", "nodes", "outcomes"))
def telemetry_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of all outcomes and of one cycle of consolidation."""
    fated = consolidate.fates(view(spark, sf, "nodes"))
    parts = telemetry.outcome_events(learn_tallies(spark, sf)), telemetry.fate_events(fated), telemetry.cycle_events(fated)
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("value", F.round("value", DIGITS))
