import os
import re
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from engramite.schema import NODES
from engramite.sources import filesystem, sqlite, tables


def node_rows(spark, *rows):
    names = ("id", "content", "confidence")
    return spark.createDataFrame([dict(zip(names, r, strict=True)) for r in rows], "id string, content string, confidence double")


def read(table):
    return {r.id: (r.content, r.confidence) for r in table.read().collect()}


def test_table_upserts_patches_deletes_and_compacts(spark, tmp_path):
    t = tables.Table(spark, f"file://{tmp_path}/nodes", NODES)
    assert read(t) == {}
    t.append(node_rows(spark, ("a", "one", 0.1), ("b", "two", 0.2)))
    t.append(node_rows(spark, ("a", "uno", 0.5)))
    t.append(node_rows(spark, ("b", None, 0.9)), tables.PATCH, ["confidence"])
    assert read(t) == {"a": ("uno", 0.5), "b": ("two", 0.9)}
    t.append(node_rows(spark, ("b", None, 0.0)), tables.PATCH, ["content"])
    assert read(t)["b"] == (None, 0.9)
    assert t.compact() == 1
    t.append(node_rows(spark, ("a", None, None)), tables.DELETE)
    t.append(node_rows(spark, ("nobody", None, None)), tables.DELETE)
    assert read(t) == {"b": (None, 0.9)}
    t.append(node_rows(spark, ("a", "again", 0.3)))
    t.compact()
    assert read(t) == {"b": (None, 0.9), "a": ("again", 0.3)}


def test_a_write_that_never_finished_is_not_seen(spark, tmp_path):
    t = tables.Table(spark, f"file://{tmp_path}/nodes", NODES)
    t.append(node_rows(spark, ("a", "one", 0.1)))
    node_rows(spark, ("z", "lost", 0.1)).write.parquet(f"file://{tmp_path}/nodes/log/batch=2")
    assert set(read(t)) == {"a"}
    t.append(node_rows(spark, ("b", "two", 0.1)))
    assert set(read(t)) == {"a", "b"}


def test_migrations_run_once(spark, tmp_path):
    db = tables.Database(spark, f"file://{tmp_path}/db")
    assert len(db.migrate()) == len(tables.MIGRATIONS)
    assert db.migrate() == []
    assert db.counts() == {"nodes": 0, "edges": 0, "outcomes": 0, "goals": 0} and db.ping() == "pong"


def test_sqlite_round_trip(spark, tmp_path):
    path = str(tmp_path / "x.db")
    df = spark.createDataFrame([("a", 0.5, 1), ("b", None, 2)], "id string, confidence double, n long")
    assert sqlite.write(df, path, "nodes") == 2 and sqlite.write(df.where("id = 'a'"), path, "nodes") == 1
    back = sqlite.read(spark, path, "nodes", "id string, confidence double, n bigint")
    assert sorted(map(tuple, back.collect())) == [("a", 0.5, 1), ("b", None, 2)]
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE empty (id)")
    assert sqlite.read(spark, path, "empty", "id string").count() == 0
    blob = spark.createDataFrame([("AACAPwAAAEA=",), ("AACAPwA=",), (None,)], "embedding string").select(sqlite.vector().alias("v"))
    assert [r.v for r in blob.collect()] == [[1.0, 2.0], [1.0], None]


@pytest.fixture
def tree(tmp_path):
    def put(name, text="x"):
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())

    put(".gitignore", "# rules\nignored_dir/\n*.log\n!important.log\nnested/*.tmp\n/top.txt\n")
    for name in ("keep.md", "a.log", "important.log", "ignored_dir/in.md", "nested/x.tmp", "nested/deep/y.tmp", "nested/y.md", "top.txt", "nested/top.txt", ".hidden", ".git/config"):
        put(name)
    return tmp_path / "tree", put


def names(root, **options):
    return [os.path.relpath(p, root) for p in filesystem.list_files(str(root), **options)]


def test_listing_respects_rules(tree):
    root, _ = tree
    assert names(root) == ["important.log", "keep.md", "nested/deep/y.tmp", "nested/top.txt", "nested/y.md"]
    assert names(root, extensions=["MD"]) == ["keep.md", "nested/y.md"]
    assert ".hidden" in names(root, include_hidden=True) and "a.log" in names(root, respect_gitignore=False)
    os.symlink(root, root / "loop")
    assert names(root, follow_symlinks=True) == names(root)
    with pytest.raises(NotADirectoryError):
        filesystem.list_files(str(root / "nowhere"))


def test_scan_makes_nodes(spark, tree):
    root, put = tree
    put("big.md", "z" * 500)
    put("bin.md", b"\xff\xfe")
    put("with space+%.md", "  body  ")
    nodes, summary = filesystem.scan_directory(spark, str(root), extensions=["md"])
    assert summary == {"files_discovered": 5, "files_ingested": 5, "files_failed": 0, "errors": []}
    shot = filesystem.snapshot(spark, str(root), extensions=["md"]).withColumn("type", F.lit("added"))
    rows = {r.content.split("\n")[0]: r for r in filesystem.event_nodes(shot, max_bytes=400).collect()}
    assert rows["[filesystem added] big.md"].read_state == "too_large"
    assert rows["[filesystem added] bin.md"].read_state == "binary"
    assert rows["[filesystem added] with space+%.md"].content.endswith("\n\nbody")
    assert {r.confidence for r in nodes.collect()} == {0.65}


def test_watch_sees_changes_and_survives_failures(spark, tree):
    from engramite.streaming.watch import Watch

    root, put = tree
    seen, fail = [], []

    def ingest(events):
        if fail:
            raise RuntimeError
        seen.extend((r.type, r.relative_path) for r in events.select("type", "relative_path").collect())

    watch = Watch(spark, str(root), ingest, on_cycle=lambda stats: 1 / 0)
    put("new.md", "1")
    watch.cycle()
    put("new.md", "22")
    fail.append(1)
    assert watch.cycle()["failed"] == 1
    fail.clear()
    watch.cycle()
    (root / "new.md").unlink()
    stats = watch.cycle()
    assert seen == [("added", "new.md"), ("modified", "new.md"), ("removed", "new.md")]
    assert (stats["added"], stats["modified"], stats["removed"]) == (1, 1, 1)
    watch.poll_ms = 10
    watch.start()
    time.sleep(0.1)
    assert watch.stop()["cycles"] >= 4


def test_streamed_events_become_nodes(spark, tmp_path):
    from engramite.streaming.watch import ingest_stream

    schema = "type string, path string, relative_path string, size long, mtime_us long, content binary"
    rows = [("added", "/r/a", "a", 2, 1, bytearray(b"hi")), ("removed", "/r/b", "b", None, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events")
    table = tables.Table(spark, f"file://{tmp_path}/nodes", NODES)
    stream = ingest_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/events"), table.append, f"{tmp_path}/checkpoint")
    stream.awaitTermination(60)
    assert sorted(r.content for r in table.read().collect()) == ["[filesystem added] a\n\nhi", "[filesystem removed] b"]


def test_consolidation_timer(spark):
    from engramite.schema import ConsolidationConfig
    from engramite.streaming.watch import consolidation_timer

    state = [spark.createDataFrame([("a", 0.5), ("b", 0.102)], "id string, confidence double")]
    assert consolidation_timer(lambda: state[-1], state.append, ConsolidationConfig(), cycles=1) == 1
    assert [(r.id, round(r.confidence, 6)) for r in state[-1].collect()] == [("a", 0.49)]


def _previewed(html):
    raw = html.encode()
    if len(raw) > 1_000_000:
        return "too_large", ""
    try:
        return "ok", re.sub(r"^\s+|\s+$", "", raw[:16_384].decode(), flags=re.ASCII)
    except UnicodeDecodeError:
        return "binary", ""


def test_preview_queries_use_the_default_limits(spark, tmp_path):
    from engramite.plans import memory_queries as q

    html = [" small ", "a" * 2001, " b" * 30_000, "c" * 16_383 + "é", "d" * 16_382 + "é tail", "e" * 1_000_000, "f" * 1_000_001, ""]
    spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.path: (r.state, r.preview) for r in q.file_preview_state_full(spark, str(tmp_path)).collect()}
    assert got == {f"u{i}": _previewed(h) for i, h in enumerate(html)}
    assert {s for s, _ in got.values()} == {"ok", "binary", "too_large"}


def test_ingest_query_uses_the_default_limits(spark):
    from engramite.plans import memory_queries as q

    sf = "/root/testdata/sf0.001"
    pages = {r.url: r.html + "x" * (r.page_id % 3 == 0) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    want = {}
    for r in q.snapshot_diff(spark, sf).collect():
        state, text = ("removed", "") if r.type == "removed" else _previewed(pages[r.path])
        want[r.path] = (r.type, f"[filesystem {r.type}] {r.path}" + ("\n\n" + text if text else ""), state)
    got = {r.path: (r.type, r.content, r.read_state) for r in q.snapshot_ingest_nodes_full(spark, sf).collect()}
    assert got == want and any(len(c) > 2100 for _, c, _ in got.values())
