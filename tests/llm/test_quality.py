from engramite.llm import quality
from tests.llm.frames import clashing, docs, prose
from tests.oracles import connect, rows

GOOD = [prose(k, 80) for k in range(5)]
BAD = {"blank": " \n", "symbols": "### $$$ %%% code {} " * 10, "shouting": "LOUD WORDS ONLY HERE NOW " * 8, "digits": "12345 67890 " * 40, "word_length": "x" * 400, "duplicate_lines": "same\n" * 10, "repeated_words": "go go go go go go go go go go", "few_words": "alpha beta " * 60}


def test_each_rule_rejects_its_case_and_keeps_prose(spark):
    table = docs(spark, [*GOOD, *BAD.values(), None])
    assert sorted(r.doc_id for r in quality.kept(table).collect()) == list(range(5))
    for rule in quality.RULES:
        out = quality.kept(docs(spark, [BAD[rule.name]]), rules=[rule]).count() if rule.name in BAD else 0
        assert out == 0


def test_order_never_changes_what_is_kept(spark):
    table = docs(spark, [*GOOD, *BAD.values(), None] * 3)
    a = quality.kept(table, rules=quality.RULES)
    b = quality.kept(table, rules=quality.RULES[::-1])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_cheap_rules_that_reject_much_come_first(spark):
    dear = quality.Rule("dear", "t LIKE '%a%'", work="100 * length(t)")
    cheap = quality.Rule("cheap", "length(t) < 1000000", work="1")
    idle = quality.Rule("idle", "length(t) < 0", work="1")
    for rules in ([dear, idle, cheap], [cheap, dear, idle]):
        # what the cheap rule leaves gives the others nothing to reject, so they come by cost
        assert [r.name for r in quality.ordered(docs(spark, GOOD * 4), rules=rules)] == ["cheap", "idle", "dear"]


def test_the_order_is_the_same_each_time(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    orders = [[r.name for r in quality.ordered(table)] for _ in range(3)]
    assert orders[0] == orders[1] == orders[2] and sorted(orders[0]) == sorted(r.name for r in quality.RULES)


def test_matches_duckdb(spark):
    sf = "/root/testdata/sf0.001"
    cursor = connect(sf).execute(quality.oracle())
    got = quality.kept(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "lang", "source", "n_chars")
    assert rows(got.columns, map(tuple, got.collect())) == rows([d[0] for d in cursor.description], cursor.fetchall())


def test_cases(spark):
    table = clashing(docs(spark, [GOOD[0], GOOD[0], prose(1, 50_000), None, ""], [None, None, 1, 2, 3]))
    out = quality.kept(table)
    assert out.columns == table.columns and out.count() == 3
    assert quality.kept(docs(spark, [])).count() == 0
