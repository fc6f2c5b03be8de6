"""The engine as one object over a folder of tables: nodes, edges, outcomes, goals and what is done with them.

Single-record calls take and give plain dictionaries, as an agent's tools do; everything set-at-a-time is
in ``engramite.operators`` and works on the DataFrames that :attr:`Engine.db` reads.
"""

from __future__ import annotations

import json
import math
import uuid
import warnings
from collections.abc import Callable
from dataclasses import asdict
from datetime import UTC, datetime
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramite import schema
from engramite.functions import normalize as N
from engramite.functions.scoring import TINY
from engramite.functions.text import hashed_vector
from engramite.operators import consolidate, coverage, goals, learn, relations, retrieve, similarity
from engramite.schema import ConsolidationConfig, CoverageConfig, RetrievalConfig
from engramite.sources.tables import DELETE, PATCH, Database


class NotFound(KeyError):
    """No record has the id."""


class Invalid(ValueError):
    """An argument that strict validation refuses."""


def now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def _us(at: datetime) -> int:
    return int(at.replace(tzinfo=UTC).timestamp() * 1_000_000)


def _strings(values: object) -> list[str]:
    found = [str(v).strip() for v in values] if isinstance(values, (list, tuple, set)) else []
    return list(dict.fromkeys(v for v in found if v))


def _object(value: object) -> str:
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            value = None
    return json.dumps(value if isinstance(value, dict) else {}, sort_keys=True, default=str)


def _pick(value: object, allowed: tuple[str, ...], default: str) -> str:
    return N.choice(value, allowed) or default


class Engine:
    """A knowledge graph in ``root``; ``dim`` is the length of the vectors of new content.

    ``embedder`` is a model's function; where there is none, or it fails on a text, the hashing embedder steps in.
    """

    def __init__(self, spark: SparkSession, root: str, dim: int = schema.EMBEDDING_DIM, learning_rate: float = schema.LEARNING_RATE, consolidation: ConsolidationConfig = ConsolidationConfig(), embedder: Callable[[str], list[float]] | None = None) -> None:  # noqa: B008
        self.embedder, self.failures, self.cycles, self.last_cycle = embedder, 0, 0, None
        self.spark, self.dim, self.rate, self.consolidation = spark, dim, learning_rate, consolidation
        self.db = Database(spark, root)
        self.db.migrate()

    # records

    def _put(self, table: str, row: dict) -> dict:
        self.db.tables[table].append(self.spark.createDataFrame([row], schema.TABLES[table]))
        return row

    def _get(self, table: str, key: str) -> dict:
        row = self.db.tables[table].read().where(F.col("id") == key).first()
        if row is None:
            raise NotFound(key)
        return row.asDict()

    def _patch(self, table: str, key: str, fields: dict) -> dict:
        kind = schema.TABLES[table]
        row = {f.name: None for f in kind} | {"id": key} | fields
        self.db.tables[table].append(self.spark.createDataFrame([row], kind), PATCH, list(fields))
        return self._get(table, key)

    def _delete(self, table: str, key: str) -> None:
        """Unknown ids are fine; nothing that refers to the record changes."""
        row = {f.name: None for f in schema.TABLES[table]} | {"id": key}
        self.db.tables[table].append(self.spark.createDataFrame([row], schema.TABLES[table]), DELETE)

    # nodes and edges

    def embed(self, text: str) -> list[float]:
        if self.embedder:
            try:
                made = [float(x) for x in self.embedder(text)][: self.dim]
                made += [0.0] * (self.dim - len(made))
                norm = math.sqrt(sum(x * x for x in made))
                return made if norm <= TINY else [x / norm for x in made]
            except Exception as failed:
                self.failures += 1
                warnings.warn(f"the embedder failed, a hashed vector is used: {failed}", stacklevel=2)
        return hashed_vector(text, self.dim).tolist()

    def store_node(self, content: str, node_type: str = "semantic", confidence: float = 0.5, embedding: list[float] | None = None, metadata: dict | None = None, source: str | None = None, id: str | None = None) -> dict:  # noqa: A002
        at = now()
        vector = embedding if embedding is not None else self.embed(content) if (content or "").strip() else None
        return self._put("nodes", {
            "id": (id or "").strip() or f"node_{uuid.uuid4().hex}", "content": content or "", "node_type": _pick(node_type, schema.NODE_TYPES, "semantic"), "confidence": N.unit(confidence, 0.5),
            "embedding": vector, "metadata": _object(metadata), "source": source, "access_count": 0, "created_at": at, "updated_at": at, "last_accessed_at": at,
        })

    def get_node(self, id: str) -> dict:  # noqa: A002
        return self._get("nodes", id)

    def list_nodes(self, node_type: str | None = None, min_confidence: object = None, limit: object = 10) -> DataFrame:
        out = relations.filter_nodes(self._nodes(), N.choice(node_type, schema.NODE_TYPES), min_confidence)
        return relations.latest(out, N.graph_limit(limit)).drop("embedding", "updated_us")

    def update_node(self, id: str, **attrs: Any) -> dict:  # noqa: A002
        """Changes the given fields only; new content has a new vector unless one is given."""
        self.get_node(id)
        clean: dict = {k: v for k, v in attrs.items() if k in ("content", "source", "embedding")}
        if "node_type" in attrs:
            clean["node_type"] = _pick(attrs["node_type"], schema.NODE_TYPES, "semantic")
        if "confidence" in attrs:
            clean["confidence"] = N.unit(attrs["confidence"], 0.5)
        if "metadata" in attrs:
            clean["metadata"] = _object(attrs["metadata"])
        if clean.get("content", "").strip() and "embedding" not in clean:
            clean["embedding"] = self.embed(clean["content"])
        return self._patch("nodes", id, clean | {"updated_at": now()})

    def touch_node(self, id: str) -> dict:  # noqa: A002
        node, at = self.get_node(id), now()
        return self._patch("nodes", id, {"access_count": (node["access_count"] or 0) + 1, "last_accessed_at": at, "updated_at": at})

    def delete_node(self, id: str) -> None:  # noqa: A002
        self._delete("nodes", id)

    def link_nodes(self, source_id: str, target_id: str, edge_type: str = "related", weight: float = 0.5, metadata: dict | None = None, id: str | None = None) -> dict:  # noqa: A002
        at = now()
        return self._put("edges", {"id": (id or "").strip() or f"edge_{uuid.uuid4().hex}", "source_id": source_id, "target_id": target_id, "edge_type": _pick(edge_type, schema.EDGE_TYPES, "related"), "weight": N.unit(weight, 0.5), "metadata": _object(metadata), "created_at": at, "last_activated_at": at})

    def get_edges_for_node(self, id: str) -> DataFrame:  # noqa: A002
        return self.db.edges.read().where((F.col("source_id") == id) | (F.col("target_id") == id))

    def _nodes(self) -> DataFrame:
        return self.db.nodes.read().withColumn("updated_us", F.unix_micros(F.to_timestamp("updated_at")))

    # queries

    def _query(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, self.embed(text))], "query_id long, vector array<double>")

    def retrieve_similar(self, text: str, limit: object = 10) -> DataFrame:
        hits = similarity.search(self._query(text), self._nodes(), N.graph_limit(limit))
        facts = self.db.nodes.read().select("id", "content", "node_type")
        return hits.join(facts, "id").orderBy("rank").select(F.col("id").alias("node_id"), "content", "node_type", "confidence", "similarity", "score")

    def query_graph(self, operation: str = "list_nodes", **params: Any) -> Any:
        """list_nodes (also for unknown names), get_node, get_edges or similarity_search."""
        name = str(operation or "").strip().lower()
        if name in ("get_node", "get"):
            return self.get_node(params["node_id"])
        if name in ("get_edges", "edges"):
            return self.get_edges_for_node(params["node_id"])
        if name in ("similarity_search", "retrieve_context"):
            return self.retrieve_similar(params["query"], params.get("limit", 10))
        return self.list_nodes(params.get("node_type"), params.get("min_confidence"), params.get("limit", 10))

    def retrieve_context(self, query: str, limit: object = None, min_score: float | None = None, node_type: str | None = None, **options: Any) -> dict:
        """Ranked results, their ids in order, and the counts; ``limit`` sets both limits."""
        if limit is not None:
            options |= {"similarity_limit": N.graph_limit(limit), "final_limit": N.graph_limit(limit)}
        config = RetrievalConfig(**options)
        q, nodes, edges = self._query(query), self._nodes(), self.db.edges.read()
        rows = [r.asDict() for r in retrieve.retrieve(q, nodes, edges, config, min_score, N.choice(node_type, schema.NODE_TYPES)).orderBy("rank").drop("query_id").collect()]
        counted = retrieve.stats(q, nodes, edges, config).first()
        stats = {"seed_count": counted.seed_count if counted else 0, "expanded_count": counted.expanded_count if counted else 0, "returned": len(rows)}
        return {"results": rows, "causal_context": [r["node_id"] for r in rows], "stats": stats}

    # learning and consolidation

    def learn_from_outcome(self, action_id: str, status: str, confidence: float = 0.5, causal_node_ids: list[str] | None = None, strict: bool = True, **extra: Any) -> dict:
        """Records an outcome and moves its causes' confidences; the outcome stays even if no cause is known."""
        if strict and (N.choice(status, schema.OUTCOME_STATUSES) is None or isinstance(confidence, bool) or not isinstance(confidence, (int, float)) or not str(action_id or "").strip()):
            raise Invalid("action_id, a known status and a numeric confidence are required")
        status, confidence, ids, at = _pick(status, schema.OUTCOME_STATUSES, "failure"), N.unit(confidence, 0.5), _strings(causal_node_ids), now()
        self._put("outcomes", {
            "id": f"outcome_{uuid.uuid4().hex}", "action_id": action_id, "status": status, "confidence": confidence, "causal_node_ids": ids, "evidence": _object(extra.get("evidence")),
            "retrieval_trace_id": extra.get("retrieval_trace_id"), "decision_trace_id": extra.get("decision_trace_id"), "action_linkage": _object(extra.get("action_linkage")), "grounding": _object(extra.get("grounding")), "observed_at": at, "processed_at": None,
        })
        told = self.spark.createDataFrame([(action_id, status, confidence, i) for i in ids], "action_id string, status string, confidence double, causal_node_id string")
        nodes = self.db.nodes.read()
        rows = {r.node_id: r.asDict() for r in learn.updates(nodes.select("id", "confidence"), told, self.rate).collect()}
        changed = [r for r in rows.values() if r["result"] == "updated"]
        if changed:
            held = {r.id: json.loads(r.metadata or "{}") for r in nodes.where(F.col("id").isin([r["node_id"] for r in changed])).select("id", "metadata").collect()}
            patches = []
            for r in changed:
                meta = held[r["node_id"]]
                count = meta.get("feedback_count")
                meta["feedback_count"] = count + 1 if isinstance(count, int) else 1
                meta["last_feedback"] = {"action_id": action_id, "status": status, "confidence": confidence, "delta": r["delta"], "at": at.isoformat()}
                patches.append({f.name: None for f in schema.NODES} | {"id": r["node_id"], "confidence": r["new_confidence"], "metadata": _object(meta), "updated_at": at})
            self.db.nodes.append(self.spark.createDataFrame(patches, schema.NODES), PATCH, ["confidence", "metadata", "updated_at"])
        return {"action_id": action_id, "processed": len(ids), "updated": len(changed), "skipped": len(ids) - len(changed), "updates": [rows[i] for i in ids]}

    def run_consolidation(self) -> dict:
        """One cycle of decay and pruning over all nodes, and its tallies."""
        nodes = self.db.nodes.read()
        fated = consolidate.fates(nodes, self.consolidation).cache()
        try:
            tallies = {r.fate: r.n for r in consolidate.tallies(fated).collect()}
            decayed = fated.where("fate = 'decayed'").select("id", F.col("new_confidence").alias("confidence"), F.lit(now()).alias("updated_at"))
            self.db.nodes.append(decayed, PATCH, ["confidence", "updated_at"])
            self.db.nodes.append(fated.where("fate = 'pruned'").select("id"), DELETE)
        finally:
            fated.unpersist()
        self.cycles, self.last_cycle = self.cycles + 1, {k: tallies.get(k, 0) for k in ("decayed", "pruned", "unchanged")}
        return self.last_cycle | {"merge_similarity": self.consolidation.merge_similarity}

    # coverage and goals

    def evaluate_coverage(self, signal: dict, options: dict | None = None) -> dict:
        """Scores one signal; nodes may be given as ids, which are looked up first."""
        config = CoverageConfig.of(**(options or {}))
        given = [n for n in signal.get("retrieved_nodes") or [] if isinstance(n, (dict, str))]
        ids = [n for n in given if isinstance(n, str)]
        known = {r.id: r for r in self._nodes().where(F.col("id").isin(ids)).select("id", "confidence", "updated_us").collect()} if ids else {}
        rows = []
        for n in given:
            if isinstance(n, str):
                hit = known.get(n)
                rows.append(("s", None if hit else 0.0, hit.confidence if hit else None, None, 0, hit.updated_us if hit else None))
            else:
                at = n.get("updated_at") or n.get("created_at")
                at = datetime.fromisoformat(at.replace("Z", "+00:00")) if isinstance(at, str) else at
                us = None if at is None else int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1_000_000)
                number = lambda k, n=n: None if n.get(k) is None else float(n[k])
                rows.append(("s", number("score"), number("confidence"), number("similarity"), int(n.get("edge_count") or 0), us))
        nodes = self.spark.createDataFrame(rows, "signal_id string, score double, confidence double, similarity double, edge_count long, updated_us long")
        outcomes = self.spark.createDataFrame([("s", str(o.get("status", "failure")), N.unit(o.get("confidence", 0.5), 0.5)) for o in signal.get("outcomes") or []], "signal_id string, status string, confidence double")
        against = signal.get("contradictions", 0)
        against = len(against) if isinstance(against, list) else against if isinstance(against, int) else 0
        scalar = lambda k: None if signal.get(k) is None else float(signal[k])
        signals = self.spark.createDataFrame([("s", against, scalar("graph_support"), scalar("known_unknowns"), scalar("goal_criticality"))], "signal_id string, contradictions long, graph_support double, known_unknowns double, goal_criticality double")
        out = coverage.evaluate(signals, nodes, outcomes, _us(now()), config)
        row = out.join(coverage.recommend(out, config).select("signal_id", "rationale"), "signal_id").first().asDict()
        row.pop("signal_id")
        about = coverage.diagnostics(signals, nodes, outcomes, config).first().asDict()
        about.pop("signal_id")
        about |= {"component_weights": config.weights, "component_values": {c: row[c] for c in coverage.COMPONENTS}}
        return row | {"thresholds": config.thresholds, "diagnostics": about}

    def create_goal(self, title: str, **attrs: Any) -> dict:
        if not (title or "").strip():
            raise Invalid("title required")
        at = now()
        status = _pick(attrs.get("status"), schema.GOAL_STATUSES, "proposed")
        done = status == "completed"
        return self._put("goals", {
            "id": (attrs.get("id") or "").strip() or f"goal_{uuid.uuid4().hex}", "title": title.strip(), "description": attrs.get("description"), "status": status, "timescale": _pick(attrs.get("timescale"), schema.TIMESCALES, "short_term"),
            "source_type": _pick(attrs.get("source_type"), schema.SOURCE_TYPES, "user"), "priority": _pick(attrs.get("priority"), schema.PRIORITIES, "normal"), "confidence": N.unit(attrs.get("confidence", 0.5), 0.0),
            "progress": 1.0 if done else N.unit(attrs.get("progress", 0.0), 0.0), "owner": attrs.get("owner"), "tags": _strings(attrs.get("tags")), "constraints": _object(attrs.get("constraints")), "success_criteria": _object(attrs.get("success_criteria")),
            "metadata": _object(attrs.get("metadata")), "linked_node_ids": _strings(attrs.get("linked_node_ids")), "parent_goal_id": attrs.get("parent_goal_id"), "created_at": at, "updated_at": at, "due_at": attrs.get("due_at"), "completed_at": at if done else None, "last_reviewed_at": None,
        })

    def get_goal(self, id: str) -> dict:  # noqa: A002
        return self._get("goals", id)

    def list_goals(self, **filters: Any) -> DataFrame:
        held = self.db.goals.read().withColumn("updated_us", F.unix_micros(F.to_timestamp("updated_at")))
        return relations.list_goals(held, **({"include_abandoned": False} | filters)).drop("updated_us")

    def update_goal(self, id: str, **attrs: Any) -> dict:  # noqa: A002
        """Changes the given fields; a status given here is set without regard to the legal transitions."""
        self.get_goal(id)
        kinds = {"status": (schema.GOAL_STATUSES, "proposed"), "timescale": (schema.TIMESCALES, "short_term"), "source_type": (schema.SOURCE_TYPES, "user"), "priority": (schema.PRIORITIES, "normal")}
        clean: dict = {}
        for k, v in attrs.items():
            if k == "title" and not (v or "").strip():
                raise Invalid("title required")
            if k in kinds:
                clean[k] = _pick(v, *kinds[k])
            elif k in ("confidence", "progress"):
                clean[k] = N.unit(v, 0.0)
            elif k in ("tags", "linked_node_ids"):
                clean[k] = _strings(v)
            elif k in ("constraints", "success_criteria", "metadata"):
                clean[k] = _object(v)
            elif k in schema.GOALS.names and k not in ("id", "created_at", "updated_at"):
                clean[k] = v.strip() or None if isinstance(v, str) else v
        return self._patch("goals", id, clean | {"updated_at": now()})

    def delete_goal(self, id: str) -> None:  # noqa: A002
        self._delete("goals", id)

    def transition_goal(self, id: str, to_status: str, metadata: dict | None = None) -> dict:  # noqa: A002
        goal, at = self.get_goal(id), now()
        target = _pick(to_status, schema.GOAL_STATUSES, "proposed")
        if target != goal["status"] and (goal["status"], target) not in schema.TRANSITIONS:
            raise Invalid(f"invalid transition from {goal['status']} to {target}")
        meta = json.loads(goal["metadata"] or "{}")
        past = meta.get("transitions")
        meta["transitions"] = [{"from": goal["status"], "to": target, "at": at.isoformat()}, *(past if isinstance(past, list) else [])]
        fields: dict = {"status": target, "metadata": _object(meta | (metadata or {})), "updated_at": at}
        if target == "completed":
            fields |= {"completed_at": at, "progress": 1.0}
        return self._patch("goals", id, fields)

    def set_goal_progress(self, id: str, progress: object) -> dict:  # noqa: A002
        self.get_goal(id)
        at, p = now(), N.unit(progress, 0.0)
        return self._patch("goals", id, {"progress": p, "updated_at": at} | ({"status": "completed", "completed_at": at} if p >= 1 else {}))

    def link_goal_nodes(self, id: str, node_ids: list[str]) -> dict:  # noqa: A002
        return self.update_goal(id, linked_node_ids=_strings([*(self.get_goal(id)["linked_node_ids"] or []), *node_ids]))

    def unlink_goal_nodes(self, id: str, node_ids: list[str]) -> dict:  # noqa: A002
        gone = set(_strings(node_ids))
        return self.update_goal(id, linked_node_ids=[x for x in self.get_goal(id)["linked_node_ids"] or [] if x not in gone])

    def _dependencies(self, id: str, change) -> dict:  # noqa: A002, ANN001
        constraints = json.loads(self.get_goal(id)["constraints"] or "{}")
        constraints["dependency_goal_ids"] = change(_strings(constraints.get("dependency_goal_ids")))
        return self.update_goal(id, constraints=constraints)

    def add_dependency(self, id: str, dependency_id: str) -> dict:  # noqa: A002
        self.get_goal(dependency_id)
        return self._dependencies(id, lambda held: _strings([*held, dependency_id]))

    def remove_dependency(self, id: str, dependency_id: str) -> dict:  # noqa: A002
        return self._dependencies(id, lambda held: [x for x in held if x != dependency_id])

    def review_goal(self, id: str, signal: dict, options: dict | None = None, apply: bool = True) -> dict:  # noqa: A002
        """Scores a goal's signal, records the review, and moves the goal where the decision aims."""
        evaluation, at = self.evaluate_coverage(signal, options), now()
        goal = self.get_goal(id)
        meta = json.loads(goal["metadata"] or "{}")
        meta["last_coverage_review"] = {k: evaluation[k] for k in ("decision", "decision_confidence", "coverage", "uncertainty", "risk", "rationale")} | {"computed_at": at.isoformat()}
        goal = self._patch("goals", id, {"metadata": _object(meta), "last_reviewed_at": at, "updated_at": at})
        target = {"act": "active", "learn": "proposed", "escalate": "blocked"}[evaluation["decision"]]
        moved: dict = {"attempted": apply, "applied": False, "from_status": goal["status"], "to_status": target}
        if not apply:
            moved["reason"] = "disabled"
        elif goal["status"] == target:
            moved["reason"] = "already_in_target_status"
        else:
            try:
                goal = self.transition_goal(id, target, {"policy": "coverage_decision", "decision": evaluation["decision"]})
                moved["applied"] = True
            except Invalid as refused:
                moved["reason"] = str(refused)
        return {"goal": goal, "evaluation": evaluation, "transition": moved}

    def manage_goal(self, operation: str, **params: Any) -> Any:
        """Dispatches by name to the goal operations."""
        table = {
            "create_goal": self.create_goal, "get_goal": self.get_goal, "list_goals": self.list_goals, "update_goal": self.update_goal, "delete_goal": self.delete_goal, "transition_goal": self.transition_goal,
            "link_nodes": self.link_goal_nodes, "unlink_nodes": self.unlink_goal_nodes, "set_progress": self.set_goal_progress, "review_goal": self.review_goal,
        }
        if operation not in table:
            raise Invalid(f"unknown operation {operation}")
        return table[operation](**params)

    # service

    def goals_snapshot(self, limit: int = 10_000) -> dict:
        rows = [r.asDict() for r in self.list_goals(limit=limit, include_abandoned=True).collect()]
        by_status: dict[str, int] = {}
        for r in rows:
            by_status[r["status"]] = by_status.get(r["status"], 0) + 1
        return {"total": len(rows), "by_status": by_status, "goals": rows}

    def health(self) -> dict:
        """Whether Spark answers, how many records there are, and the state of each service: up if what it needs can be read."""
        needs = {"graph": ("nodes", "edges"), "retriever": ("nodes", "edges"), "learner": ("nodes", "outcomes"), "goal_graph": ("goals",), "consolidator": ("nodes",)}
        counts: dict[str, int] = {}
        for name, held in self.db.tables.items():
            try:
                counts[name] = held.read().count()
            except PySparkException:  # its services are down
                continue
        services = {s: "up" if all(n in counts for n in names) else "down" for s, names in needs.items()}
        return {"status": "ok" if self.db.ping() == "pong" and "down" not in services.values() else "down", "counts": counts, "services": services}

    def embedder_info(self) -> dict:
        return {"backend": "model" if self.embedder else "hashing", "fallback": "hashing", "dimension": self.dim, "failures": self.failures}

    def consolidator_info(self) -> dict:
        return {**asdict(self.consolidation), "cycles": self.cycles, "last_result": self.last_cycle}

    def refresh(self) -> None:
        """Drops whatever Spark holds of the tables, so that the next read sees the files."""
        for t in self.db.tables.values():
            self.spark.catalog.refreshByPath(t.root)
