"""Quality rules as a short-circuit cascade ordered by rejection per cost.

A bounded sample tells what each rule costs on these texts and which of them it rejects: one job tells of each
sampled row which rules reject it and each rule's work on it, an expression over the text in units of about
one character looked at.  Rules are then ordered greedily by (rows still left that it rejects) / (its work), the same
order for the same sample whatever else the machine does.  The cascade is one CASE expression, so a rule runs only on
rows that all earlier rules passed.  The order changes which rule is named for a row that breaks several, never whether
a row is kept.

Cases: a null, empty or blank text is rejected (``blank``); other rules say nothing about a null
text or a zero denominator; a very long text is judged, and sampled, whole; repeated rows are judged alike; of rules of equal
gain the cheaper, then the earlier one comes first; columns with clashing names stay as they are; an empty table keeps the
rules in the order given.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramite.llm.common import packed, spread, string, unpacked

#: Rows of the sample, the first that the table's partitions give.
SAMPLE_ROWS = 512


@dataclass(frozen=True)
class Rule:
    """``spark`` and ``duckdb`` are the same predicate over a column ``t``: true rejects the text.  ``work`` is its cost."""

    name: str
    spark: str
    duckdb: str = ""
    work: str = "length(t)"


def _many(name: str, chars: str, share: str) -> Rule:
    """Rejects texts of which more than a share is characters of a class."""
    # counted by matches in Spark, where they are rare in good texts, and by what removal leaves in DuckDB
    java = chars.replace("\\", "\\\\")
    return Rule(name, f"regexp_count(t, '[{java}]') > {share}D * length(t)", f"length(t) - length(regexp_replace(t, '[{chars}]', '', 'g')) > CAST({share} AS DOUBLE) * length(t)", "6 * length(t)")


def _listed(name: str, at: str, spark: str, duckdb: str) -> Rule:
    """A predicate over the pieces ``w`` between separators, which are made once."""
    return Rule(name, f"transform(array(split(t, '{at}')), w -> {spark})[0]", f"list_transform([string_split(t, '{at}')], lambda w: {duckdb})[1]", "4 * length(t)")


RULES = [
    Rule("blank", r"t IS NULL OR NOT t RLIKE '[^ \\t\\r\\n]'", r"t IS NULL OR NOT regexp_matches(t, '[^ \t\r\n]')", "1 + length(t) - length(ltrim(t))"),
    _many("symbols", r"#*$%&|!~\^<>{}=+_", "0.05"),
    _many("shouting", r"\p{Lu}", "0.4"),
    _many("garbled", r"\x{0}-\x{8}\x{FFFD}", "0.01"),
    Rule("digits", "length(t) >= 200 AND regexp_count(t, '[0-9]') > 0.5D * length(t)", "length(t) >= 200 AND length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) > CAST(0.5 AS DOUBLE) * length(t)", "CASE WHEN length(t) >= 200 THEN 6 * length(t) ELSE 1 END"),
    Rule("word_length", "length(t) > 30 * (size(split(t, ' ')) + size(split(t, '\n')))", "length(t) > 30 * (len(string_split(t, ' ')) + len(string_split(t, '\n')))", "3 * length(t)"),
    _listed("duplicate_lines", "\n", "size(w) >= 4 AND size(array_distinct(w)) < 0.5D * size(w)", "len(w) >= 4 AND len(list_distinct(w)) < CAST(0.5 AS DOUBLE) * len(w)"),
    _listed("repeated_words", " ", "size(w) >= 8 AND size(filter(w, (x, i) -> i > 0 AND x <> '' AND x = w[i - 1])) > 0.3D * size(w)", "len(w) >= 8 AND len(list_filter(list_zip(w, w[2:]), lambda p: p[1] <> '' AND p[1] = p[2])) > CAST(0.3 AS DOUBLE) * len(w)"),
    # vocabularies grow like the square root of a text, so a share would reject every long text
    _listed("few_words", " ", "size(w) >= 40 AND size(array_distinct(w)) < 1.5D * sqrt(size(w))", "len(w) >= 40 AND len(list_distinct(w)) < CAST(1.5 AS DOUBLE) * sqrt(len(w))"),
]


def rejected(rule: Rule, text: Column) -> Column:
    """Whether the rule rejects; the text is bound to ``t`` by name."""
    return F.coalesce(F.expr(rule.spark), F.lit(False))


def ordered(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, as the sample tells."""
    text = docs.select(string(text_col).alias("t"))
    flags = F.array(*[rejected(r, F.col("t")) for r in rules]).alias("flags")
    work = F.array(*[F.expr(f"CAST(coalesce({r.work}, 1) AS DOUBLE)") for r in rules]).alias("work")
    # the limit comes last, so that only as many partitions are read as it takes; no text leaves the executors
    told = text.select(flags, work).limit(rows).collect()
    cost = [sum(r.work[k] for r in told) + 1.0 for k in range(len(rules))]
    left, todo, order = list(told), set(range(len(rules))), []
    while todo:
        gain = {k: sum(r.flags[k] for r in left) / cost[k] for k in todo}
        best = max(todo, key=lambda k: (gain[k], -cost[k], -k)) if told else min(todo)
        order.append(rules[best])
        left = [r for r in left if not r.flags[best]]
        todo.remove(best)
    return order


def decisions(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Packed rows with ``rejected_by``, the first rule of the cascade that rejects; null for kept rows."""
    cascade = ordered(docs, text_col) if rules is None else rules
    rows = spread(packed(docs, t=string(text_col)))
    case = "CASE " + " ".join(f"WHEN coalesce({r.spark}, false) THEN '{r.name}'" for r in cascade) + " END" if cascade else "CAST(NULL AS STRING)"
    return rows.withColumn("rejected_by", F.expr(case)).drop("t")


def kept(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows that every rule passes, with all their columns."""
    return unpacked(decisions(docs, text_col, rules).where("rejected_by IS NULL"))


def oracle(rules: list[Rule] = RULES) -> str:
    """DuckDB's form of the cascade's outcome."""
    return "SELECT doc_id, lang, source, n_chars FROM (SELECT *, text AS t FROM documents) WHERE " + " AND ".join(f"NOT coalesce({r.duckdb or r.spark}, false)" for r in rules)
