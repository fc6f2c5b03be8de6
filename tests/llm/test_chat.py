import json

from engramite.llm import chat, queries
from tests.oracles import compare

ROWS = "conv_id long, turn long, role string, text string"


def call(id_, name="search", arguments='{"query": "x"}', after=None):
    return {"id": id_, "name": name, "arguments": arguments, "after": after}


def asks(*calls):
    return json.dumps({"content": "let me see", "tool_calls": list(calls)})


def answers(id_, content="found"):
    return json.dumps({"tool_call_id": id_, "content": content})


def run(spark, rows):
    return {r.conv_id: r for r in chat.formatted(spark.createDataFrame(rows, ROWS)).collect()}


def test_links_orders_and_validates(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "tool", answers("a")), (1, 2, "assistant", asks(call("a"))),
        (2, 0, "assistant", asks(call("a", arguments='{"limit": 0}'))), (2, 1, "tool", answers("b")),
        (3, 0, "assistant", asks(call("a", "nosuch"), call("a"))), (3, 1, "tool", answers("a")),
    ]
    out = run(spark, rows)
    one = json.loads(out[1].chat)["messages"]
    assert [m["role"] for m in one] == ["user", "assistant", "tool"] and out[1].problems == "" and out[1].n_calls == 1
    assert out[2].problems.split(" | ") == ["a: $.limit: below minimum", "a: $.query: missing", "a: no result", "b: no call"]
    assert out[3].problems.split(" | ") == ["a: called twice", "a: no tool nosuch"]


def test_a_call_that_needs_a_result_comes_after_it(spark):
    needs = json.dumps({"query": {"$ref": "a"}})
    rows = [(1, 0, "assistant", asks(call("b", arguments=needs))), (1, 1, "tool", answers("b")), (1, 2, "assistant", asks(call("a"))), (1, 3, "tool", answers("a"))]
    out = run(spark, rows)[1]
    ids = [m.get("tool_call_id") or m["tool_calls"][0]["id"] for m in json.loads(out.chat)["messages"]]
    assert ids == ["a", "a", "b", "b"] and out.problems == ""
    loop = json.dumps({"query": {"$ref": "b"}})
    rows = [(1, 0, "assistant", asks(call("a", arguments=loop))), (1, 1, "tool", answers("a")), (1, 2, "assistant", asks(call("b", arguments=needs))), (1, 3, "tool", answers("b"))]
    out = run(spark, rows)[1]
    assert out.problems.count("in a cycle") == 4 and len(json.loads(out.chat)["messages"]) == 4


def test_canonical_json_does_not_depend_on_key_order(spark):
    a, b = '{"query": "x", "limit": 3}', '{"limit":3,"query":"x"}'
    out = run(spark, [(1, 0, "assistant", asks(call("a", arguments=a))), (2, 0, "assistant", asks(call("a", arguments=b)))])
    assert out[1].chat == out[2].chat


def test_cases(spark):
    rows = [(1, 0, "user", "same"), (1, 0, "user", "same"), (2, 0, "assistant", '{"tool_calls": broken'), (3, 0, "tool", '{"tool_call_id": null}'), (4, 0, "assistant", asks(call(None, None, None))), (5, 0, "user", "w " * 50_000), (6, 0, "assistant", asks(call("a", arguments="not json")))]
    out = run(spark, rows)
    assert out[1].n_messages == 2 and out[2].n_calls == 0 and out[4].n_calls == 1
    assert json.loads(out[5].chat)["messages"][0]["content"] == "w " * 50_000
    assert "a: $: not object" in out[6].problems and "a: arguments aren't JSON" in out[6].problems


def test_rows_without_a_conversation_are_conversations_of_their_own(spark):
    rows = [(None, None, None, None), (None, 1, "user", ""), (None, 1, "user", ""), (None, 2, "assistant", asks(call("a")))]
    out = chat.formatted(spark.createDataFrame(rows, ROWS)).collect()
    assert [r.conv_id for r in out] == [None] * 4 and all(r.n_messages == 1 for r in out)
    assert sorted(r.problems for r in out) == ["", "", "", "a: no result"]


def test_extreme_arguments_stay_text(spark):
    cases = {1: '{"limit": ' + "9" * 400 + ', "query": "x"}', 2: "[" * 5_000, 3: '{"query": "\\ud800"}', 4: '{"query": NaN}', 5: '{"limit": 1e999}', 6: '{"query": "[[["}', 7: '{"\\ud800": 1}', 8: '{"query": ' + '{"a":' * 300 + "1" + "}" * 301}
    out = run(spark, [(k, 0, "assistant", asks(call("a", arguments=a))) for k, a in cases.items()])
    for k, a in cases.items():
        made = json.loads(out[k].chat, parse_constant=lambda c: 1 / 0)["messages"][0]["tool_calls"][0]["arguments"]
        assert made == (a if k in (2, 4, 5, 8) else json.loads(a))
        assert ("a: arguments aren't JSON" in out[k].problems) == (k in (2, 4, 5, 8))


def test_linked_calls_match_duckdb(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(queries.op8_chat_tool_calls(spark, sf), chat.CALLED_ORACLE, sf) is None


def test_clashing_columns_are_ignored(spark):
    table = spark.createDataFrame([("doc-17", 0, "user", "hi")], "`a.id` string, turn long, role string, text string").selectExpr("*", "1 AS calls", "2 AS links", "3 AS lone", "4 AS id")
    assert [(r.conv_id, r.n_messages) for r in chat.formatted(table, conv_col="a.id").collect()] == [(None, 1)]
    table = spark.createDataFrame([(1, 0, "user", "x", 1, "y", 2)], ROWS + ", calls int, result string, links int")
    assert chat.formatted(table).count() == 1
    assert chat.formatted(spark.createDataFrame([], ROWS)).count() == 0


def test_matches_duckdb(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(queries.op8_chat_format(spark, sf), chat.ORACLE, sf) is None
