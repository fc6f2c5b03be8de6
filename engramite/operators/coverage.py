"""Coverage scoring of many signals at once: five components, three scores, one decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramite.functions.normalize import clamp, enum
from engramite.functions.scoring import freshness, saturation, three_decimals
from engramite.schema import OUTCOME_STATUSES, SCORE_DIGITS, CoverageConfig

COMPONENTS = ("semantic_coverage", "consistency", "freshness", "graph_support", "outcome_reliability")


def node_score() -> Column:
    """The explicit score, or confidence times similarity, each 0.5 where it is missing."""
    product = clamp(F.coalesce("confidence", F.lit(0.5))) * clamp(F.coalesce("similarity", F.lit(0.5)))
    return clamp(F.coalesce(F.col("score").cast("double"), product))


def resolved(signal_ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Signals that give node ids only, as signal nodes; an unknown id scores 0."""
    known = nodes.select(F.col("id").alias("node_id"), "confidence", "updated_us", F.lit(True).alias("known"))
    out = signal_ids.select("signal_id", "node_id").join(known, "node_id", "left")
    return out.select("signal_id", "node_id", F.when(F.col("known").isNull(), 0.0).alias("score"), "confidence", F.lit(None).cast("double").alias("similarity"), F.lit(0).cast("long").alias("edge_count"), "updated_us")


def components(signals: DataFrame, signal_nodes: DataFrame, signal_outcomes: DataFrame, as_of_us: int, config: CoverageConfig = CoverageConfig()) -> DataFrame:  # noqa: B008
    """One row for a signal: the components, and what the scores need besides.

    The three tables meet on signal_id; nodes and outcomes are aggregated before they are joined.
    """
    scored = signal_nodes.select("signal_id", node_score().alias("s"), freshness(F.col("updated_us"), as_of_us, config.freshness_half_life_hours).alias("fresh"), F.coalesce("edge_count", F.lit(0)).alias("edge_count"))
    place = F.row_number().over(Window.partitionBy("signal_id").orderBy(F.desc("s")))
    by_nodes = (
        scored.withColumn("place", place)
        .groupBy("signal_id")
        .agg(F.avg(F.when(F.col("place") <= config.top_k, F.col("s"))).alias("semantic"), F.stddev_pop("s").alias("spread"), F.avg("fresh").alias("fresh"), F.sum("edge_count").alias("edge_sum"), F.count(F.lit(1)).alias("n_nodes"))
    )
    c, status = clamp(F.coalesce("confidence", F.lit(0.5))), enum(F.col("status"), OUTCOME_STATUSES, "failure")
    is_ = lambda name: status == name
    base = F.when(is_("success"), 1.0).when(is_("partial_success"), 0.75).when(is_("timeout"), 0.10).otherwise(0.25)
    conflict = F.when(is_("failure"), c).when(is_("timeout"), c * 0.7).otherwise(0.0)
    failing = F.when(is_("success"), 0.0).when(is_("partial_success"), c * 0.35).when(is_("timeout"), c * 0.8).otherwise(c)
    by_outcomes = signal_outcomes.groupBy("signal_id").agg(F.avg(base * c + (F.lit(1.0) - c) * 0.5).alias("reliable"), F.avg(conflict).alias("conflict"), F.avg(failing).alias("failing"))

    zero = lambda name: F.coalesce(name, F.lit(0.0))
    penalty = clamp(F.greatest(F.coalesce("contradictions", F.lit(0)), F.lit(0)) / 5.0)
    return (
        signals.join(by_nodes, "signal_id", "left")
        .join(by_outcomes, "signal_id", "left")
        .select(
            "signal_id",
            clamp(zero("semantic")).alias("semantic_coverage"),
            clamp(F.lit(1.0) - (penalty * 0.60 + zero("conflict") * 0.40)).alias("consistency"),
            clamp(zero("fresh")).alias("freshness"),
            clamp(saturation(F.coalesce(F.col("graph_support").cast("double"), zero("edge_sum")), config.graph_support_target)).alias("graph_support"),
            clamp(F.coalesce("reliable", F.lit(0.5))).alias("outcome_reliability"),
            F.least(zero("spread"), F.lit(1.0)).alias("spread"),
            zero("failing").alias("failing"),
            F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"),
            clamp(zero("known_unknowns")).alias("known_unknowns"),
            clamp(F.coalesce("goal_criticality", F.lit(0.5))).alias("criticality"),
        )
    )


def evaluate(signals: DataFrame, signal_nodes: DataFrame, signal_outcomes: DataFrame, as_of_us: int, config: CoverageConfig = CoverageConfig()) -> DataFrame:  # noqa: B008
    """(signal_id, decision, decision_confidence, coverage, uncertainty, risk, the components).

    Scores are compared with thresholds after rounding to SCORE_DIGITS; halves go up even if float
    noise has them just below.
    """
    w, t, least = config.weights, config.thresholds, float(config.min_context_nodes)
    parts = components(signals, signal_nodes, signal_outcomes, as_of_us, config)
    coverage = sum((F.col(c) * w[c] for c in COMPONENTS), F.lit(0.0))
    few = clamp((F.lit(least) - F.col("n_nodes")) / max(least, 1.0))
    uncertainty = clamp((F.lit(1.0) - F.col("semantic_coverage")) * 0.45 + F.col("spread") * 0.25 + few * 0.20 + F.col("known_unknowns") * 0.10)
    risk = clamp(F.col("failing") * 0.45 + (F.lit(1.0) - F.col("consistency")) * 0.25 + (F.lit(1.0) - F.col("freshness")) * 0.15 + F.col("criticality") * 0.15)
    scored = parts.select("signal_id", *COMPONENTS, *[F.round(x + 1e-10, SCORE_DIGITS).alias(n) for n, x in (("raw_coverage", coverage), ("uncertainty", uncertainty), ("risk", risk))])
    c, u, r = F.col("raw_coverage"), F.col("uncertainty"), F.col("risk")
    decision = (
        F.when((c >= t["act_coverage"]) & (u <= t["act_max_uncertainty"]) & (r <= t["act_max_risk"]), "act")
        .when((c >= t["learn_coverage"]) & (u <= t["learn_max_uncertainty"]) & (r <= t["learn_max_risk"]), "learn")
        .otherwise("escalate")
    )
    sure = F.when(F.col("decision") == "act", (c + (F.lit(1.0) - u) + (F.lit(1.0) - r)) / 3.0).when(F.col("decision") == "learn", c * 0.6 + (F.lit(1.0) - u) * 0.4).otherwise(F.greatest(u, r))
    return (
        scored.withColumn("decision", decision)
        .withColumn("decision_confidence", F.round(clamp(sure), SCORE_DIGITS))
        .select("signal_id", "decision", "decision_confidence", clamp(c).alias("coverage"), "uncertainty", "risk", *COMPONENTS)
    )


def recommend(evaluated: DataFrame, config: CoverageConfig = CoverageConfig()) -> DataFrame:  # noqa: B008
    """The decision, its confidence and its rationale: three lines for the scores, the components and the thresholds."""
    words = lambda names: F.concat_ws(" ", *[F.concat(F.lit(f"{shown}="), three_decimals(F.col(n))) for n, shown in names.items()])
    scores = F.concat(words({n: n for n in ("coverage", "uncertainty", "risk")}), F.lit(" decision="), F.col("decision"))
    parts = words(dict(zip(COMPONENTS, ("semantic", "consistency", "freshness", "graph_support", "outcomes"), strict=True)))
    limit = lambda kind: f"{kind}(cov>={config.thresholds[f'{kind}_coverage']:.3f}, unc<={config.thresholds[f'{kind}_max_uncertainty']:.3f}, risk<={config.thresholds[f'{kind}_max_risk']:.3f})"
    return evaluated.select("signal_id", "decision", "decision_confidence", F.array(scores, parts, F.lit(f"thresholds: {limit('act')} {limit('learn')}")).alias("rationale"))


def diagnostics(signals: DataFrame, signal_nodes: DataFrame, signal_outcomes: DataFrame, config: CoverageConfig = CoverageConfig()) -> DataFrame:  # noqa: B008
    """(signal_id, the counts that an evaluation rests on, top_node_scores): best scores first, as many as count."""
    scored = signal_nodes.select("signal_id", node_score().alias("s"))
    place = F.row_number().over(Window.partitionBy("signal_id").orderBy(F.desc("s")))
    best = F.sort_array(F.collect_list(F.when(F.col("place") <= config.top_k, F.col("s"))), asc=False)
    by_nodes = scored.withColumn("place", place).groupBy("signal_id").agg(F.count(F.lit(1)).alias("node_count"), best.alias("top_node_scores"))
    by_outcomes = signal_outcomes.groupBy("signal_id").agg(F.count(F.lit(1)).alias("outcome_count"))
    out = signals.join(by_nodes, "signal_id", "left").join(by_outcomes, "signal_id", "left")
    zero = lambda name: F.coalesce(name, F.lit(0))
    return out.select(
        "signal_id", zero("node_count").alias("node_count"), zero("outcome_count").alias("outcome_count"), F.greatest(zero("contradictions"), F.lit(0)).alias("contradiction_count"),
        clamp(F.coalesce("known_unknowns", F.lit(0.0))).alias("known_unknowns"), clamp(F.coalesce("goal_criticality", F.lit(0.5))).alias("goal_criticality"), F.coalesce("top_node_scores", F.array().cast("array<double>")).alias("top_node_scores"),
    )
