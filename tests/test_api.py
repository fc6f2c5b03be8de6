import io
import json

import pytest

from engramite import cli
from engramite.api import Engine, Invalid, NotFound


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, "file://" + str(tmp_path_factory.mktemp("db")), dim=64)


def test_memory_flow(engine):
    a = engine.store_node("postgres uses mvcc snapshots", confidence=0.92)
    b = engine.store_node("postgres vacuum removes dead rows", confidence=0.35, node_type="procedural")
    c = engine.store_node("bananas are yellow", confidence=0.99)
    engine.link_nodes(a["id"], c["id"], "causal", 0.9)
    found = engine.retrieve_context("postgres mvcc snapshots", similarity_limit=2, neighbors_per_node=5)
    assert found["causal_context"][0] == a["id"] and c["id"] in found["causal_context"]
    assert found["stats"]["returned"] == len(found["results"])
    assert len(engine.query_graph("edges", node_id=c["id"]).collect()) == 1
    assert engine.query_graph("similarity_search", query="postgres vacuum", limit=1).count() == 1
    assert {r.id for r in engine.query_graph("whatever", node_type="procedural").collect()} == {b["id"]}
    out = engine.learn_from_outcome("act-1", "success", 1.0, [a["id"], "missing", a["id"]])
    assert (out["processed"], out["updated"], out["skipped"]) == (2, 1, 1)
    assert engine.get_node(a["id"])["confidence"] == pytest.approx(0.936)
    assert json.loads(engine.get_node(a["id"])["metadata"])["feedback_count"] == 1
    with pytest.raises(Invalid):
        engine.learn_from_outcome("act-2", "great", 1.0, [])
    renamed = engine.update_node(b["id"], content="vacuum")
    assert renamed["confidence"] == 0.35 and renamed["node_type"] == "procedural" and renamed["embedding"] != b["embedding"]
    assert engine.touch_node(b["id"])["access_count"] == 1
    engine.delete_node(c["id"])
    engine.delete_node(c["id"])
    with pytest.raises(NotFound):
        engine.get_node(c["id"])
    tallies = engine.run_consolidation()
    assert tallies["decayed"] == 2 and engine.get_node(b["id"])["confidence"] == pytest.approx(0.343)
    assert engine.health()["counts"]["nodes"] == 2


def test_goal_flow(engine):
    with pytest.raises(Invalid):
        engine.create_goal("  ")
    g = engine.create_goal(" ship ", priority="HIGH", tags=["a", " a", ""])
    h = engine.create_goal("later", status="completed")
    assert g["priority"] == "high" and g["tags"] == ["a"] and h["progress"] == 1.0
    with pytest.raises(Invalid):
        engine.transition_goal(h["id"], "active")
    moved = engine.transition_goal(g["id"], "active", {"why": "test"})
    assert moved["status"] == "active" and json.loads(moved["metadata"])["transitions"][0]["from"] == "proposed"
    assert engine.link_goal_nodes(g["id"], ["n1", "n2", "n1"])["linked_node_ids"] == ["n1", "n2"]
    assert engine.unlink_goal_nodes(g["id"], ["n1"])["linked_node_ids"] == ["n2"]
    assert json.loads(engine.add_dependency(g["id"], h["id"])["constraints"]) == {"dependency_goal_ids": [h["id"]]}
    with pytest.raises(NotFound):
        engine.add_dependency(g["id"], "nobody")
    assert json.loads(engine.remove_dependency(g["id"], h["id"])["constraints"]) == {"dependency_goal_ids": []}
    review = engine.review_goal(g["id"], {"retrieved_nodes": ["nobody"], "outcomes": [{"status": "failure", "confidence": 1.0}], "contradictions": ["x", "y"]})
    assert review["evaluation"]["decision"] == "escalate" and review["transition"]["applied"] and review["goal"]["status"] == "blocked"
    again = engine.review_goal(g["id"], {}, apply=True)
    assert again["transition"]["reason"] == "already_in_target_status"
    assert engine.set_goal_progress(g["id"], "1.5")["status"] == "completed"
    assert engine.goals_snapshot()["by_status"] == {"completed": 2}
    assert engine.manage_goal("get_goal", id=g["id"])["title"] == "ship"
    with pytest.raises(Invalid):
        engine.manage_goal("explode")
    engine.delete_goal(h["id"])
    assert engine.list_goals().count() == 1


def test_tool_calls_over_lines(engine):
    calls = [{"tool": "store_node", "arguments": {"content": "x"}}, {"tool": "query_graph", "arguments": {"operation": "list_nodes", "limit": 1}}, {"tool": "rm"}, "junk"]
    out = io.StringIO()
    cli.serve(engine, io.StringIO("\n".join(json.dumps(c) if isinstance(c, dict) else c for c in calls)), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["ok"] for r in replies] == [True, True, False, False]
    assert "embedding" not in replies[0]["result"] and len(replies[1]["result"]) == 1


def test_arguments():
    args = cli.parser().parse_args(["scan", "/x", "--extensions", "md,txt"])
    assert args.extensions == ["md", "txt"] and args.action == "scan"
    assert cli.main(["--decay-rate", "3", "serve"]) == 2


def test_embedding_backends(spark, tmp_path):
    model = Engine(spark, f"file://{tmp_path}/a", dim=3, embedder=lambda text: [3.0, 4.0])
    assert model.embed("x") == [0.6, 0.8, 0.0]
    broken = Engine(spark, f"file://{tmp_path}/b", dim=64, embedder=lambda text: 1 / 0)
    with pytest.warns(UserWarning, match="hashed"):
        assert broken.embed("some words") == Engine(spark, f"file://{tmp_path}/c", dim=64).embed("some words")
