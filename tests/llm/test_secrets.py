import re

import pytest

from engramite.llm import secrets
from tests.llm.frames import clashing, docs, prose

KEY = "AKIA" + "ABCDEFGH12345678"
TOKEN = "ghp_" + "a1B2" * 9


def found(df):
    return sorted((r.doc_id, r.rule, r.start, r.end) for r in df.collect())


def brute(texts):
    return sorted((i, r.name, m.start(), m.end()) for i, t in enumerate(texts) if t for r in secrets.RULES for m in re.finditer(r.pattern, t))


def test_scan_matches_brute_force(spark):
    texts = [f"é {KEY} and {TOKEN}", prose(1, 50), None, "", f"password = 'abcdefgh12345678xyz' {KEY}", prose(2, 20_000) + " " + KEY, "https://me:pw@host/x", f"é {KEY} and {TOKEN}"]
    assert found(secrets.scan(docs(spark, texts))) == brute(texts)


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    ledger = "file://" + str(tmp_path / "ledger")
    one = [f"x {KEY}", "plain"]
    assert len(found(secrets.scan(docs(spark, one), ledger))) == 1
    first = spark.read.parquet(f"{ledger}/scanned/*").count()
    # an old blob under another path, and a new one
    again = secrets.scan(docs(spark, [*one, f"y {TOKEN}"], [7, 8, 9]), ledger)
    assert [f[0] for f in found(again)] == [7, 9]
    assert spark.read.parquet(f"{ledger}/scanned/*").count() == first + 1
    # a new version of one rule brings every blob back, for that rule only
    newer = tuple(secrets.Rule(r.name, 2, r.pattern, r.anchors) if r.name == "aws_access_key" else r for r in secrets.RULES)
    assert [f[0] for f in found(secrets.scan(docs(spark, one, [7, 8]), ledger, rules=newer))] == [7]
    last = spark.read.parquet(f"{ledger}/scanned/*").where("array_contains(tags, 'aws_access_key@2')")
    assert {tuple(r.tags) for r in last.collect()} == {("aws_access_key@2",)}


def test_a_run_that_died_counts_for_nothing(spark, tmp_path):
    ledger = "file://" + str(tmp_path / "ledger")
    table = docs(spark, [f"x {KEY}"])
    secrets.scan(table, ledger).collect()
    for p in (tmp_path / "ledger" / "scanned").iterdir():
        p.rename(tmp_path / "lost")
    assert len(found(secrets.scan(table, ledger))) == 1


def test_redact(spark):
    table = clashing(docs(spark, [f"x {KEY} y", None, "", "plain", f"x {KEY} y"], [1, 2, 3, 4, None]))
    out = secrets.redact(table)
    assert out.columns == table.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    text = "x [aws_access_key] y"
    assert got == {1: (text, len(text)), 2: (None, None), 3: ("", 0), 4: ("plain", 5), None: (text, len(text))}


def test_letters_that_fold_to_an_anchor(spark):
    texts = ['\u017fecret = "abcdefghijklmnop1234"', 'TO\u212aEN: "abcdefghijklmnop1234"']
    assert found(secrets.scan(docs(spark, texts))) == brute(texts) != []


def test_an_unreadable_ledger_is_an_error(spark, tmp_path):
    (tmp_path / "scanned").mkdir()
    (tmp_path / "scanned" / "x").mkdir()
    (tmp_path / "scanned" / "x" / "part.parquet").write_text("broken")
    with pytest.raises(Exception, match="(?i)parquet"):
        secrets.scan(docs(spark, [KEY]), f"file://{tmp_path}").collect()


def test_the_ledger_may_be_large(spark, tmp_path, monkeypatch):
    from engramite.llm import common

    ledger = f"file://{tmp_path}/ledger"
    texts = [f"x {KEY}", "plain", None]
    secrets.scan(docs(spark, texts), ledger).collect()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert found(secrets.scan(docs(spark, [*texts, f"y {TOKEN}"]), ledger)) == brute([*texts, f"y {TOKEN}"])


def test_empty_table(spark):
    assert secrets.scan(docs(spark, [])).count() == 0
    assert secrets.redact(docs(spark, [])).count() == 0


def test_long_tokens(spark):
    pat = "github_pat_" + "a1" * 11 + "_" + "Z" * 59
    url = f"https://{'u' * 80}:{'x' * 200}@host"
    got = found(secrets.scan(docs(spark, [f"a {url}/x", f"b {pat} c", f"https://me:{pat}@host"])))
    assert [f[:2] for f in got] == [(0, "url_password"), (1, "github_fine_grained_token"), (2, "github_fine_grained_token"), (2, "url_password")]
    text = " ".join(r.text for r in secrets.redact(docs(spark, [f"a {url}/x", f"b {pat} c", f"https://me:{pat}@host"])).collect())
    assert "xxx" not in text and "ZZZ" not in text
