"""Chat formatting with linked tool calls.

An assistant message may be a JSON object ``{"content": ..., "tool_calls": [{"id", "name",
"arguments", "after": [ids]}]}`` and a tool message one with ``tool_call_id`` and ``content``;
anything else is plain text.  Calls and results are hash-joined by (conversation, call id).  Within
a conversation messages keep their turns, except that a result comes after its call and a call after the
results it needs (its ``after`` and any ``{"$ref": id}`` in its arguments): the order is topological
with turns as priority.  Arguments are validated against the tool's schema, and the conversation
is serialised as canonical JSON: sorted keys, no blanks, UTF-8, a lone surrogate as its escape.

Cases: a row with a null conversation id is a conversation of its own, and an id that is no whole number counts as null; null turns come last;
equal turns are ordered by role, then text, nulls last; repeated rows are repeated messages; null texts stay null;
a call without a result, a result without a call and a call id used twice are reported in ``problems``; what is in a
cycle keeps its turn order at the end and is reported; malformed JSON is plain text, and arguments that
are malformed, not finite (NaN, numbers beyond a double) or nested deeper than ``DEPTH`` stay the text that they are and
are reported; very long texts are kept whole; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramite.llm.common import ident, string

_CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"
_RESULT = "struct<tool_call_id:string,content:string>"

#: Schemas of the tools that the queries know, by name.
TOOLS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "fetch": {"type": "object", "properties": {"url": {"type": "string", "pattern": "^https?://"}}, "required": ["url"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}


#: Levels of arguments that are read as JSON.
DEPTH = 100
_SURROGATE = re.compile("[\ud800-\udfff]")


def plain(text: str) -> str:
    """The text with lone surrogates, which UTF-8 can't hold, as escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def canonical(value: object) -> str:
    return plain(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _finite(number: str) -> float:
    value = float(number)
    if not math.isfinite(value):
        raise ValueError(number)
    return value


def parsed(text: str) -> object:
    """The value of a JSON text; ValueError for what is malformed, not finite or too deep."""
    depth = deepest = 0
    for c in re.sub(r'"(?:[^"\\]|\\.)*"', "", text, flags=re.DOTALL):
        depth += (c in "[{") - (c in "]}")
        deepest = max(deepest, depth)
    if deepest > DEPTH:
        raise ValueError("nested too deeply")
    return json.loads(text, parse_constant=_finite, parse_float=_finite)


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """What breaks the schema (type, enum, bounds, pattern, items, properties, required, additionalProperties)."""
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []  # known only when the call runs
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds

    def fits(kind: str) -> bool:
        if kind in ("integer", "number"):
            return isinstance(value, int | float) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
        return isinstance(value, _KINDS[kind])

    if kinds and not any(map(fits, kinds)):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: below minimum")
        if value > schema.get("maximum", value):
            out.append(f"{at}: above maximum")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: pattern")
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{k}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    return out


def _references(value: object) -> set[str]:
    if isinstance(value, dict):
        found = {value["$ref"]} if set(value) == {"$ref"} and isinstance(value["$ref"], str) else set()
        return found.union(*map(_references, value.values()))
    return set().union(*map(_references, value)) if isinstance(value, list) else set()


def topological(n: int, before: dict[int, set[int]]) -> tuple[list[int], list[int]]:
    """The order of 0..n-1 with the smallest ready number first, and the numbers left in cycles."""
    waits = {k: len(before.get(k, ())) for k in range(n)}
    after: dict[int, list[int]] = {}
    for k, needs in before.items():
        for x in needs:
            after.setdefault(x, []).append(k)
    ready, order = [k for k in range(n) if not waits[k]], []
    heapq.heapify(ready)
    while ready:
        order.append(k := heapq.heappop(ready))
        for x in after.get(k, ()):
            waits[x] -= 1
            if not waits[x]:
                heapq.heappush(ready, x)
    return order, sorted(k for k in range(n) if waits[k])


def conversation(messages: list[dict], links: list[dict], tools: dict[str, dict]) -> tuple[str, int, list[str]]:
    """Canonical JSON, number of calls and problems of one conversation whose messages are in turn order."""
    problems: list[str] = []
    linked = {link["id"]: link for link in links}
    made: dict[str, int] = {}
    gave: dict[str, int] = {}
    shaped, before = [], {}
    for k, m in enumerate(messages):
        out: dict = {"role": m["role"], "content": m["text"]}
        if m["calls"] is not None:
            out["content"] = m["calls"]["content"]
            out["tool_calls"] = []
            for call in m["calls"]["tool_calls"]:
                name, made_id = call["name"], call["id"]
                try:
                    arguments = parsed(call["arguments"]) if call["arguments"] is not None else {}
                except ValueError:
                    arguments = call["arguments"]
                    problems.append(f"{made_id}: arguments aren't JSON")
                if name not in tools:
                    problems.append(f"{made_id}: no tool {name}")
                else:
                    problems += [f"{made_id}: {v}" for v in violations(arguments, tools[name])]
                if made_id in made:
                    problems.append(f"{made_id}: called twice")
                elif made_id is not None:
                    made[made_id] = k
                    before.setdefault(k, set()).update(("result", x) for x in _references(arguments) | set(call["after"] or ()))
                if not linked.get(made_id, {}).get("results"):
                    problems.append(f"{made_id}: no result")
                out["tool_calls"].append({"id": made_id, "name": name, "arguments": arguments})
        elif m["result"] is not None:
            out["content"] = m["result"]["content"]
            result_id = out["tool_call_id"] = m["result"]["tool_call_id"]
            gave.setdefault(result_id, k)
            if not linked.get(result_id, {}).get("calls"):
                problems.append(f"{result_id}: no call")
            before.setdefault(k, set()).add(("call", result_id))
        shaped.append(out)
    edges = {k: {at for kind, x in needs if (at := (gave if kind == "result" else made).get(x)) is not None and at != k} for k, needs in before.items()}
    order, cyclic = topological(len(shaped), edges)
    problems += [f"message {k}: in a cycle" for k in cyclic]
    return canonical({"messages": [shaped[k] for k in order + cyclic]}), sum(len(m.get("tool_calls", ())) for m in shaped), sorted(map(plain, problems))


def _format(batches: Iterator[pa.RecordBatch], tools: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [conversation(m, links or [], tools) for m, links in zip(batch.column("messages").to_pylist(), batch.column("links").to_pylist(), strict=True)]
        lengths = [len(m) for m in batch.column("messages").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(lengths, pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([" | ".join(r[2]) for r in rows], pa.string()), pa.array([r[0] for r in rows], pa.string())],
            names=["conv_id", "n_messages", "n_calls", "problems", "chat"],
        )


def formatted(conversations: DataFrame, tools: dict[str, dict] = TOOLS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_messages, n_calls, problems, chat): one row for each conversation."""
    rows = conversations.select(ident(conv_col).alias("conv_id"), ident(turn_col).alias("turn"), string(role_col).alias("role"), string(text_col).alias("text"))
    calls = F.when((F.col("role") == "assistant") & F.col("text").startswith("{") & F.col("text").contains('"tool_calls"'), F.from_json("text", _CALLS))
    result = F.when((F.col("role") == "tool") & F.col("text").startswith("{") & F.col("text").contains('"tool_call_id"'), F.from_json("text", _RESULT))
    rows = rows.withColumn("calls", calls).withColumn("result", result)
    rows = rows.withColumn("calls", F.when(F.col("calls.tool_calls").isNotNull() & ~F.exists("calls.tool_calls", lambda c: c.isNull()), F.col("calls")))
    rows = rows.withColumn("result", F.when(F.col("result.tool_call_id").isNotNull(), F.col("result")))
    called = rows.where("calls IS NOT NULL").select("conv_id", F.explode("calls.tool_calls.id").alias("id")).groupBy("conv_id", "id").agg(F.count("*").alias("calls"))
    answered = rows.where("result IS NOT NULL").select("conv_id", F.col("result.tool_call_id").alias("id")).groupBy("conv_id", "id").agg(F.count("*").alias("results"))
    a, b = called.alias("a"), answered.hint("shuffle_hash").alias("b")
    linked = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.id") == F.col("b.id")), "full_outer")
    links = linked.select(F.when(F.col("a.id").isNotNull() | F.col("a.calls").isNotNull(), F.col("a.conv_id")).otherwise(F.col("b.conv_id")).alias("link_conv"), F.struct(F.coalesce("a.id", "b.id").alias("id"), "calls", "results").alias("link")).where("link_conv IS NOT NULL").groupBy("link_conv").agg(F.collect_list("link").alias("links"))
    # nulls last in every part of the order
    order = F.struct(F.col("turn").isNull().alias("t0"), "turn", F.col("role").isNull().alias("r0"), "role", F.col("text").isNull().alias("x0"), "text", "calls", "result")
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    whole = rows.groupBy("conv_id", lone.alias("lone")).agg(F.sort_array(F.collect_list(order)).alias("messages"))
    joined = whole.join(links, F.col("conv_id") == F.col("link_conv"), "left").select("conv_id", "messages", "links")
    return joined.mapInArrow(lambda batches: _format(batches, tools), "conv_id long, n_messages int, n_calls int, problems string, chat string")


#: DuckDB's form for conversations without tool calls, as those of the table are.
ORACLE = """SELECT conv_id, CAST(count(*) AS INTEGER) AS n_messages, CAST(0 AS INTEGER) AS n_calls, '' AS problems,
'{"messages":[' || string_agg('{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}', ',' ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) || ']}' AS chat
FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM conversations) GROUP BY conv_id, lone"""

#: A message of the linked table: an assistant's text becomes the call of a tool, and its result comes a turn too early.
_CALLED = """SELECT conv_id, turn * 2 AS turn, role, text FROM conversations WHERE role IS DISTINCT FROM 'assistant'
 UNION ALL SELECT conv_id, turn * 2 + 1, 'assistant', to_json(named_struct('content', text, 'tool_calls', array(named_struct('id', concat('c', turn), 'name', 'search', 'arguments', to_json(named_struct('limit', turn % 4, 'query', coalesce(text, ''))))))) FROM conversations WHERE role = 'assistant'
 UNION ALL SELECT conv_id, turn * 2, 'tool', to_json(named_struct('content', text, 'tool_call_id', concat('c', turn))) FROM conversations WHERE role = 'assistant' AND turn % 8 < 7"""


def called(conversations: DataFrame) -> DataFrame:
    """The conversations with each assistant's message as a tool call and, but for some, a result that comes before it."""
    return conversations.sparkSession.sql(_CALLED.replace("FROM conversations", "FROM {table}"), table=conversations)


#: DuckDB's form of what ``formatted`` makes of ``called``: each result after its call, and the two kinds of problems.
CALLED_ORACLE = """WITH j AS (SELECT *, coalesce(CAST(to_json(text) AS VARCHAR), 'null') AS x, turn % 8 < 7 AS answered FROM conversations),
m AS (SELECT conv_id, turn * 2 AS o, role, '{"content":' || x || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS part, 1 AS n FROM j WHERE role IS DISTINCT FROM 'assistant'
 UNION ALL SELECT conv_id, turn * 2 + 1, role, '{"content":' || x || ',"role":"assistant","tool_calls":[{"arguments":{"limit":' || turn % 4 || ',"query":' || coalesce(nullif(x, 'null'), '""') || '},"id":"c' || turn || '","name":"search"}]}'
  || CASE WHEN answered THEN ',{"content":' || x || ',"role":"tool","tool_call_id":"c' || turn || '"}' ELSE '' END, CASE WHEN answered THEN 2 ELSE 1 END FROM j WHERE role = 'assistant'),
p AS (SELECT conv_id, 'c' || turn || ': no result' AS problem FROM j WHERE role = 'assistant' AND NOT answered UNION ALL SELECT conv_id, 'c' || turn || ': $.limit: below minimum' FROM j WHERE role = 'assistant' AND turn % 4 < 1),
q AS (SELECT conv_id, string_agg(problem, ' | ' ORDER BY problem) AS problems FROM p GROUP BY conv_id)
SELECT m.conv_id, CAST(sum(n) AS INTEGER) AS n_messages, CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS INTEGER) AS n_calls, coalesce(any_value(problems), '') AS problems,
'{"messages":[' || string_agg(part, ',' ORDER BY o) || ']}' AS chat FROM m LEFT JOIN q USING (conv_id) GROUP BY m.conv_id"""
