import subprocess
import sys
from pathlib import Path

import __spark_entry__
from engramite.plans import registry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.queries()) <= set(__spark_entry__.queries())


def test_entry_has_a_stable_schema(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "rank", "node_id", "node_type", "confidence", "similarity", "score", "source", "hops", "via"]


def test_imports_without_the_optional_subpackage():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert int(out.stdout) == len(registry.queries())


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "engramite").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "engramite.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
