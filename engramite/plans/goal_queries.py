"""Queries over goals and coverage signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramite.operators import coverage, goals, relations
from engramite.plans.collect import registrar
from engramite.plans.views import AS_OF_US, oracle, view
from engramite.schema import GOAL_STATUSES, TRANSITIONS, CoverageConfig

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

_GOAL = "id, title, status, priority, timescale, round(progress, 6) AS progress, owner, parent_goal_id, updated_us"


def _goals(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "goals").withColumn("tags", F.array("tag1", "tag2"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", "title", "status", "priority", "timescale", F.round("progress", 6).alias("progress"), "owner", "parent_goal_id", "updated_us")


@query(oracle(f"SELECT {_GOAL} FROM goals WHERE status = 'active' AND priority = 'high' AND progress >= CAST(0.1 AS DOUBLE)", "goals"))
def goals_filter_status_priority(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(relations.filter_goals(_goals(spark, sf), status="active", priority="high", min_progress=0.1))


@query(oracle(f"SELECT {_GOAL} FROM goals WHERE list_contains([tag1, tag2], 'tier_1')", "goals"))
def goals_filter_tag(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(relations.filter_goals(_goals(spark, sf), tag="tier_1"))


@query(oracle(f"WITH first AS (SELECT * FROM goals ORDER BY updated_us DESC, id LIMIT 100) SELECT {_GOAL} FROM first WHERE timescale = 'short_term' AND status <> 'abandoned' ORDER BY updated_us DESC, id LIMIT 100", "goals"))
def goals_list_limit_then_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The newest hundred, of which those of a timescale that aren't abandoned."""
    return _shown(relations.list_goals(_goals(spark, sf), limit=100, timescale="short_term", include_abandoned=False))


@query(oracle("SELECT status, count(*) AS n FROM goals GROUP BY status", "goals"))
def goals_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return relations.count_by(_goals(spark, sf), "status")


@query(oracle(f"SELECT id, status, due_us FROM goals WHERE status IN ('proposed', 'active', 'blocked') AND due_us < {AS_OF_US}", "goals"))
def goals_overdue(spark: SparkSession, sf: str) -> DataFrame:
    return relations.overdue(_goals(spark, sf), AS_OF_US).select("id", "status", "due_us")


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in TRANSITIONS)
_ALL = ", ".join(f"('{s}')" for s in GOAL_STATUSES)


def _all_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every goal asked to go to every status."""
    return _goals(spark, sf).select(F.col("id").alias("goal_id"), F.explode(F.array(*map(F.lit, GOAL_STATUSES))).alias("to_status"))


@query(oracle(f"SELECT id AS goal_id, status AS from_status, s.to_status, status = s.to_status OR (status, s.to_status) IN ({_PAIRS}) AS legal FROM goals, (VALUES {_ALL}) s(to_status)", "goals"))
def goal_transition_validate(spark: SparkSession, sf: str) -> DataFrame:
    out = _all_requests(spark, sf).join(_goals(spark, sf).select(F.col("id").alias("goal_id"), F.col("status").alias("from_status")), "goal_id")
    return out.select("goal_id", "from_status", "to_status", goals.is_legal(F.col("from_status"), F.col("to_status")).alias("legal"))


@query(oracle(f"""WITH r AS (SELECT id AS goal_id, status AS from_status, s.to_status, round(progress, 6) AS progress, status = s.to_status OR (status, s.to_status) IN ({_PAIRS}) AS legal FROM goals, (VALUES {_ALL}) s(to_status))
SELECT goal_id, from_status, to_status, CASE WHEN legal THEN 'applied' ELSE 'invalid_transition' END AS result, CASE WHEN legal THEN to_status ELSE from_status END AS status,
 CASE WHEN legal AND to_status = 'completed' THEN 1.0 ELSE progress END::DOUBLE AS progress, CASE WHEN legal AND to_status = 'completed' THEN {AS_OF_US} END AS completed_us FROM r""", "goals"))
def goal_transition_apply(spark: SparkSession, sf: str) -> DataFrame:
    return goals.transition(_goals(spark, sf), _all_requests(spark, sf), AS_OF_US).withColumn("progress", F.round("progress", 6))


@query(oracle(f"""WITH p AS (SELECT id AS goal_id, status AS old, least(greatest(progress * 2, 0), 1) AS progress FROM goals)
SELECT goal_id, CASE WHEN progress >= 1 THEN 'completed' ELSE old END AS status, round(progress, 6) AS progress, CASE WHEN progress >= 1 THEN {AS_OF_US} END AS completed_us FROM p""", "goals"))
def goal_set_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Progress of every goal doubled."""
    held = _goals(spark, sf)
    wanted = held.select(F.col("id").alias("goal_id"), (F.col("progress") * 2).alias("value"))
    return goals.set_progress(held, wanted, AS_OF_US).withColumn("progress", F.round("progress", 6))


_LINKS = "[tag1, tag2, '', lower(owner)]"


@query(oracle("SELECT id, CASE WHEN lower(owner) IN (tag1, tag2) THEN concat_ws('|', tag1, tag2) ELSE concat_ws('|', tag1, tag2, lower(owner)) END AS linked FROM goals", "goals"))
def goal_link_union(spark: SparkSession, sf: str) -> DataFrame:
    """Each goal's tags joined with its owner and its own first tag again."""
    added = F.array(F.col("tag1"), F.lit(" "), F.lower("owner"))
    return _goals(spark, sf).select("id", F.concat_ws("|", goals.linked(F.col("tags"), added)).alias("linked"))


@query(oracle("SELECT id, tag2 AS linked FROM goals", "goals"))
def goal_unlink_except(spark: SparkSession, sf: str) -> DataFrame:
    return _goals(spark, sf).select("id", F.concat_ws("|", goals.unlinked(F.col("tags"), F.array("tag1"))).alias("linked"))


_EXTRA = "SELECT id AS goal_id, parent_goal_id AS dependency_goal_id FROM goals WHERE parent_goal_id IS NOT NULL UNION ALL SELECT id, concat(id, '_gone') FROM goals"


@query(oracle(f"SELECT goal_id, dependency_goal_id FROM goal_deps UNION SELECT goal_id, dependency_goal_id FROM ({_EXTRA}) WHERE goal_id IN (SELECT id FROM goals) AND dependency_goal_id IN (SELECT id FROM goals)", "goals", "goal_deps"))
def goal_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Dependencies on parents added; those on goals that don't exist are refused."""
    held = _goals(spark, sf)
    up = held.where("parent_goal_id IS NOT NULL").select(F.col("id").alias("goal_id"), F.col("parent_goal_id").alias("dependency_goal_id"))
    gone = held.select(F.col("id").alias("goal_id"), F.concat("id", F.lit("_gone")).alias("dependency_goal_id"))
    return goals.add_dependencies(view(spark, sf, "goal_deps"), up.unionByName(gone), held)


@query(oracle("WITH reach AS (SELECT DISTINCT goal_id, dependency_goal_id FROM goal_deps UNION SELECT r.goal_id, d.dependency_goal_id FROM reach r JOIN goal_deps d ON d.goal_id = r.dependency_goal_id) SELECT goal_id, dependency_goal_id FROM reach", "goal_deps", recursive=True))
def goal_dependency_closure(spark: SparkSession, sf: str) -> DataFrame:
    return goals.dependency_closure(view(spark, sf, "goal_deps"))


_C = CoverageConfig()
_EVALUATED = f"""ns AS (SELECT signal_id, least(greatest(coalesce(score, least(greatest(coalesce(confidence, 0.5), 0), 1) * least(greatest(coalesce(similarity, 0.5), 0), 1)), 0), 1) AS s,
  coalesce(exp(-(greatest(floor(({AS_OF_US} - updated_us) / CAST(1000000 AS DOUBLE)), 0) / CAST(3600 AS DOUBLE)) / CAST(168 AS DOUBLE)), CAST(0.5 AS DOUBLE)) AS fresh, coalesce(edge_count, 0) AS edge_count FROM signal_nodes),
np AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY s DESC) AS place FROM ns),
nn AS (SELECT signal_id, avg(CASE WHEN place <= 8 THEN s END) AS semantic, stddev_pop(s) AS spread, avg(fresh) AS fresh, sum(edge_count) AS edge_sum, count(*) AS n_nodes FROM np GROUP BY signal_id),
oo AS (SELECT signal_id,
  avg(CASE status WHEN 'success' THEN 1.0 WHEN 'partial_success' THEN 0.75 WHEN 'timeout' THEN 0.10 ELSE 0.25 END::DOUBLE * confidence + (1 - confidence) * CAST(0.5 AS DOUBLE)) AS reliable,
  avg(CASE status WHEN 'failure' THEN confidence WHEN 'timeout' THEN confidence * CAST(0.7 AS DOUBLE) ELSE 0 END) AS conflict,
  avg(CASE status WHEN 'success' THEN 0 WHEN 'partial_success' THEN confidence * CAST(0.35 AS DOUBLE) WHEN 'timeout' THEN confidence * CAST(0.8 AS DOUBLE) ELSE confidence END) AS failing FROM signal_outcomes GROUP BY signal_id),
parts AS (SELECT x.signal_id, coalesce(semantic, 0) AS semantic_coverage, 1 - (least(contradictions / CAST(5 AS DOUBLE), 1) * CAST(0.6 AS DOUBLE) + coalesce(conflict, 0) * CAST(0.4 AS DOUBLE)) AS consistency, coalesce(nn.fresh, 0) AS freshness,
  1 - exp(-greatest(coalesce(graph_support, edge_sum, 0), 0) / CAST(6 AS DOUBLE)) AS graph_support, coalesce(reliable, 0.5) AS outcome_reliability, least(coalesce(spread, 0), 1) AS spread, coalesce(failing, 0) AS failing,
  coalesce(n_nodes, 0) AS n_nodes, least(greatest(known_unknowns, 0), 1) AS known_unknowns, coalesce(goal_criticality, 0.5) AS criticality
  FROM signal_scalars x LEFT JOIN nn ON nn.signal_id = x.signal_id LEFT JOIN oo ON oo.signal_id = x.signal_id),
scored AS (SELECT signal_id, semantic_coverage, consistency, freshness, graph_support, outcome_reliability,
  round(semantic_coverage * 0.4e0 + consistency * 0.2e0 + freshness * 0.15e0 + graph_support * 0.15e0 + outcome_reliability * 0.1e0 + 1e-10, 6) AS coverage,
  round(least((1 - semantic_coverage) * 0.45e0 + spread * 0.25e0 + least(greatest((3 - n_nodes) / 3e0, 0), 1) * 0.2e0 + known_unknowns * 0.1e0, 1) + 1e-10, 6) AS uncertainty,
  round(least(failing * 0.45e0 + (1 - consistency) * 0.25e0 + (1 - freshness) * 0.15e0 + criticality * 0.15e0, 1) + 1e-10, 6) AS risk FROM parts),
decided AS (SELECT *, CASE WHEN coverage >= 0.72e0 AND uncertainty <= 0.35e0 AND risk <= 0.45e0 THEN 'act' WHEN coverage >= 0.45e0 AND uncertainty <= 0.7e0 AND risk <= 0.75e0 THEN 'learn' ELSE 'escalate' END AS decision FROM scored),
evaluated AS (SELECT *, round(CASE decision WHEN 'act' THEN (coverage + (1 - uncertainty) + (1 - risk)) / 3 WHEN 'learn' THEN coverage * 0.6e0 + (1 - uncertainty) * 0.4e0 ELSE greatest(uncertainty, risk) END, 6) AS decision_confidence FROM decided)"""
_SIGNALS = ("signal_nodes", "signal_outcomes", "signal_scalars")


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.evaluate(*[view(spark, sf, n) for n in ("signal_scalars", "signal_nodes", "signal_outcomes")], AS_OF_US)


@query(oracle(f"WITH {_EVALUATED} SELECT signal_id, round(semantic_coverage + 1e-10, 6) AS semantic_coverage, round(consistency + 1e-10, 6) AS consistency, round(freshness + 1e-10, 6) AS freshness, round(graph_support + 1e-10, 6) AS graph_support, round(outcome_reliability + 1e-10, 6) AS outcome_reliability FROM parts", *_SIGNALS))
def coverage_components(spark: SparkSession, sf: str) -> DataFrame:
    out = coverage.components(*[view(spark, sf, n) for n in ("signal_scalars", "signal_nodes", "signal_outcomes")], AS_OF_US)
    return out.select("signal_id", *[F.round(F.col(c) + 1e-10, 6).alias(c) for c in coverage.COMPONENTS])


@query(oracle(f"WITH {_EVALUATED} SELECT signal_id, decision, decision_confidence, coverage, uncertainty, risk FROM evaluated", *_SIGNALS))
def coverage_decision(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(spark, sf).select("signal_id", "decision", "decision_confidence", "coverage", "uncertainty", "risk")


@query(oracle(f"""WITH {_EVALUATED}, r AS (SELECT g.id AS goal_id, decision, decision_confidence, status AS from_status, CASE decision WHEN 'act' THEN 'active' WHEN 'learn' THEN 'proposed' ELSE 'blocked' END AS to_status FROM goals g JOIN evaluated e ON e.signal_id = replace(g.id, 'goal_', 'sig_'))
SELECT *, from_status <> to_status AND (from_status, to_status) IN ({_PAIRS}) AS applied, CASE WHEN from_status = to_status THEN 'already_in_target_status' WHEN (from_status, to_status) NOT IN ({_PAIRS}) THEN 'invalid_transition' END AS reason FROM r""", "goals", *_SIGNALS))
def goal_review_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Every goal reviewed by the signal of the same number."""
    reviews = _evaluated(spark, sf).select(F.replace("signal_id", F.lit("sig_"), F.lit("goal_")).alias("goal_id"), "decision", "decision_confidence")
    return goals.review_policy(_goals(spark, sf), reviews)
