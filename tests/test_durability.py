import pytest

from engramite.schema import NODES
from engramite.sources import tables
from tests.test_sources import node_rows, read


def test_a_writer_that_dies_between_any_two_steps_changes_nothing(spark, tmp_path):
    t = tables.Table(spark, f"file://{tmp_path}/nodes", NODES)
    t.append(node_rows(spark, ("a", "one", 0.1)))

    class Dies:
        """A file system that fails at the n-th call of those that change something."""

        def __init__(self, fs, n):
            self.fs, self.n = fs, n

        def __getattr__(self, name):
            found = getattr(self.fs, name)
            if name not in ("create", "rename", "delete"):
                return found

            def call(*args):
                self.n -= 1
                if self.n < 0:
                    raise RuntimeError("died")
                return found(*args)

            return call

    fs, written = t.files.fs, {"a"}
    for n in range(3):
        t.files.fs = Dies(fs, n)
        try:
            t.append(node_rows(spark, (f"b{n}", "two", 0.1)))
            written.add(f"b{n}")
        except RuntimeError:
            # the rename is what makes a write count; what is tidied up after it doesn't
            if n > 1:
                written.add(f"b{n}")
        t.files.fs = fs
        assert set(read(t)) == written
    t.append(node_rows(spark, ("c", "three", 0.1)))
    assert set(read(t)) == written | {"c"}
    assert len(t.files.states("CURRENT")) <= 3


def test_tables_are_compacted_by_themselves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "COMPACT_AFTER", 3)
    t = tables.Table(spark, f"file://{tmp_path}/nodes", NODES)
    for k in range(4):
        t.append(node_rows(spark, (f"n{k}", "x", 0.1)))
    assert t.state["version"] == 1 and t.state["included"] == 3 and len(read(t)) == 4


def test_migrations_make_tables(spark, tmp_path):
    db = tables.Database(spark, f"file://{tmp_path}/db")
    db.migrate()
    assert all(t.files.states("CURRENT") for t in db.tables.values())


def test_a_second_writer_is_refused(spark, tmp_path):
    t = tables.Table(spark, f"file://{tmp_path}/nodes", NODES)
    t.append(node_rows(spark, ("a", "one", 0.1)))
    t.files.states = lambda name: []
    with pytest.raises(RuntimeError, match="another writer"):
        t.files.replace("CURRENT", "{}")
