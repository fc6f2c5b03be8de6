import logging

from engramite.api import Engine
from engramite.sources import filesystem, sqlite
from engramite.streaming.watch import Watch


def test_failed_files_are_in_the_summary(spark, tmp_path, monkeypatch):
    for name in ("a.md", "b.md"):
        (tmp_path / name).write_text(name)
    real = filesystem._unreadable
    monkeypatch.setattr(filesystem, "_unreadable", lambda p: "eacces" if p.endswith("b.md") else real(p))
    nodes, summary = filesystem.scan_directory(spark, str(tmp_path))
    assert nodes.count() == summary["files_ingested"] == 1
    assert summary["errors"] == [{"path": str(tmp_path / "b.md"), "reason": "eacces"}] and summary["files_discovered"] == 2
    assert real(str(tmp_path / "none")) == "enoent"


def test_watch_logs_or_ignores_errors(spark, tmp_path, caplog):
    for mode, logged in (("log", True), ("ignore", False)):
        caplog.clear()
        watch = Watch(spark, str(tmp_path), lambda events: 1 / 0, on_error=mode, poll_ms=-5)
        (tmp_path / f"{mode}.txt").write_text("x")
        with caplog.at_level(logging.ERROR):
            assert watch.cycle()["failed"] == 1
        assert bool(caplog.records) == logged and watch.poll_ms == 1000


def test_infos_health_and_lenient_filters(spark, tmp_path):
    def broken(text):
        raise RuntimeError("no model")

    engine = Engine(spark, f"file://{tmp_path}/db", dim=16, embedder=broken)
    engine.store_node("one", confidence=0.9)
    assert engine.embedder_info() == {"backend": "model", "fallback": "hashing", "dimension": 16, "failures": 1}
    health = engine.health()
    assert health["status"] == "ok" and set(health["services"].values()) == {"up"} and len(health["services"]) == 5
    assert engine.list_nodes(min_confidence="much").count() == 1 and engine.list_nodes(min_confidence="0.95x").count() == 0
    engine.run_consolidation()
    assert engine.consolidator_info()["cycles"] == 1 and engine.consolidator_info()["last_result"]["decayed"] == 1
    out = engine.evaluate_coverage({"retrieved_nodes": [{"score": 0.9}, {"score": 0.4}], "contradictions": 2})
    assert len(out["rationale"]) == 3 and out["diagnostics"]["node_count"] == 2 and out["diagnostics"]["top_node_scores"] == [0.9, 0.4]


def test_base64_that_is_none_counts_as_its_bytes(spark):
    rows = spark.createDataFrame([("AACAPw==",), ("!!!!",), (None,)], "embedding string")
    got = [r.v for r in rows.select(sqlite.vector().alias("v")).collect()]
    assert got[0] == [1.0] and len(got[1]) == 1 and got[2] is None
