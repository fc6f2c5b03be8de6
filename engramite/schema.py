"""Entity schemas, enumerations and defaults of the knowledge graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

NODE_TYPES = ("episodic", "semantic", "procedural")
EDGE_TYPES = ("causal", "related", "contradicts", "supports", "derived_from")
OUTCOME_STATUSES = ("success", "partial_success", "failure", "timeout")
GOAL_STATUSES = ("proposed", "active", "blocked", "completed", "abandoned")
TIMESCALES = ("immediate", "short_term", "medium_term", "long_term")
SOURCE_TYPES = ("user", "system", "inferred", "policy")
PRIORITIES = ("low", "normal", "high", "critical")

#: Legal changes of a goal's status; staying in a status is legal too.
TRANSITIONS = (
    ("proposed", "active"), ("proposed", "blocked"), ("proposed", "abandoned"),
    ("active", "blocked"), ("active", "completed"), ("active", "abandoned"),
    ("blocked", "active"), ("blocked", "abandoned"), ("blocked", "proposed"),
    ("abandoned", "proposed"), ("abandoned", "active"),
)


def _struct(**fields: str) -> T.StructType:
    kinds = {
        "string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "time": T.TimestampType(),
        "vector": T.ArrayType(T.FloatType()), "strings": T.ArrayType(T.StringType()),
    }
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields.items()])


NODES = _struct(
    id="string", content="string", node_type="string", confidence="double", embedding="vector", metadata="string",
    source="string", access_count="long", created_at="time", updated_at="time", last_accessed_at="time",
)
EDGES = _struct(
    id="string", source_id="string", target_id="string", edge_type="string", weight="double", metadata="string",
    created_at="time", last_activated_at="time",
)
OUTCOMES = _struct(
    id="string", action_id="string", status="string", confidence="double", causal_node_ids="strings", evidence="string",
    retrieval_trace_id="string", decision_trace_id="string", action_linkage="string", grounding="string",
    observed_at="time", processed_at="time",
)
GOALS = _struct(
    id="string", title="string", description="string", status="string", timescale="string", source_type="string",
    priority="string", confidence="double", progress="double", owner="string", tags="strings", constraints="string",
    success_criteria="string", metadata="string", linked_node_ids="strings", parent_goal_id="string",
    created_at="time", updated_at="time", due_at="time", completed_at="time", last_reviewed_at="time",
)
TABLES = {"nodes": NODES, "edges": EDGES, "outcomes": OUTCOMES, "goals": GOALS}


@dataclass(frozen=True)
class RetrievalConfig:
    """Limits of context retrieval; ``hop_decay`` is kept within 0.1 and 1."""

    similarity_limit: int = 10
    final_limit: int = 20
    expansion_hops: int = 1
    neighbors_per_node: int = 5
    hop_decay: float = 0.85

    def __post_init__(self) -> None:
        object.__setattr__(self, "hop_decay", min(max(float(self.hop_decay), 0.1), 1.0))


@dataclass(frozen=True)
class ConsolidationConfig:
    """One cycle multiplies confidences by 1 - ``decay_rate`` and removes nodes below ``prune_threshold``."""

    decay_rate: float = 0.02
    prune_threshold: float = 0.1
    #: Least cosine of nodes that :func:`engramite.operators.consolidate.similar_pairs` reports; no cycle merges nodes.
    merge_similarity: float = 0.95
    interval_ms: int = 300_000

    def __post_init__(self) -> None:
        object.__setattr__(self, "interval_ms", max(1000, int(self.interval_ms)))


@dataclass(frozen=True)
class CoverageConfig:
    """Weights, thresholds and targets of coverage scoring."""

    weights: dict[str, float] = field(
        default_factory=lambda: {"outcome_reliability": 0.10, "graph_support": 0.15, "freshness": 0.15, "consistency": 0.20, "semantic_coverage": 0.40}
    )
    thresholds: dict[str, float] = field(
        default_factory=lambda: {"act_max_risk": 0.45, "learn_max_risk": 0.75, "act_max_uncertainty": 0.35, "learn_max_uncertainty": 0.70, "act_coverage": 0.72, "learn_coverage": 0.45}
    )
    top_k: int = 8
    min_context_nodes: int = 3
    #: An e-folding time in spite of the name that callers know it by.
    freshness_half_life_hours: float = 168.0
    graph_support_target: float = 6.0

    @classmethod
    def of(cls, weights: dict | None = None, thresholds: dict | None = None, **options) -> CoverageConfig:
        """Defaults overridden by known keys with numeric values; all else in the two dictionaries is ignored."""
        base = cls(**{k: int(v) if k in ("top_k", "min_context_nodes") else float(v) for k, v in options.items() if v is not None})

        def merged(default: dict[str, float], given: dict | None) -> dict[str, float]:
            return default | {str(k): float(v) for k, v in (given or {}).items() if str(k) in default and isinstance(v, (int, float)) and not isinstance(v, bool)}

        return cls(merged(base.weights, weights), merged(base.thresholds, thresholds), base.top_k, base.min_context_nodes, base.freshness_half_life_hours, base.graph_support_target)


LEARNING_RATE = 0.2
EMBEDDING_DIM = 384
#: Digits to which scores are rounded before they are compared or ranked, so that the order of additions can't flip ties.
SCORE_DIGITS = 6
