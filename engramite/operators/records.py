"""Records on their way in and out, many at once: normalised inserts, metadata, JSON lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramite.functions.normalize import enum, json_map, optional_string, probability, string_list, trimmed
from engramite.operators.goals import is_legal
from engramite.operators.relations import iso_time
from engramite.schema import EDGE_TYPES, GOAL_STATUSES, NODE_TYPES, OUTCOME_STATUSES, PRIORITIES, SOURCE_TYPES, TIMESCALES


def nodes(raw: DataFrame) -> DataFrame:
    return raw.select("id", enum(F.col("node_type"), NODE_TYPES, "semantic").alias("node_type"), probability(F.col("confidence")).alias("confidence"), optional_string(F.col("source")).alias("source"), F.coalesce(json_map(F.col("metadata")), F.lit("{}")).alias("metadata"))


def edges(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"edge_type": enum(F.col("edge_type"), EDGE_TYPES, "related"), "weight": probability(F.col("weight"))})


def outcomes(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"status": enum(F.col("status"), OUTCOME_STATUSES, "failure"), "confidence": probability(F.col("confidence")), "causal_node_ids": string_list(F.col("causal_node_ids"))})


def goals(raw: DataFrame, as_of_us: int) -> DataFrame:
    """Goals as they are stored; a completed one has progress 1 and the time of completion."""
    kinds = {"status": (GOAL_STATUSES, "proposed"), "timescale": (TIMESCALES, "short_term"), "source_type": (SOURCE_TYPES, "user"), "priority": (PRIORITIES, "normal")}
    out = raw.select("id", trimmed(F.col("title")).alias("title"), *[enum(F.col(c), *k).alias(c) for c, k in kinds.items()], probability(F.col("progress"), 0.0, trim=True).alias("progress"), optional_string(F.col("owner")).alias("owner"), string_list(F.col("tags")).alias("tags"))
    done = F.col("status") == "completed"
    return out.withColumn("progress", F.when(done, 1.0).otherwise(F.col("progress"))).withColumn("completed_us", F.when(done, F.lit(as_of_us)))


def _merged(metadata: Column, more: Column) -> Column:
    """JSON text of an object with the fields of a map from names to JSON texts put in."""
    held = F.from_json(F.coalesce(json_map(metadata), F.lit("{}")), "map<string,string>")
    kept = F.filter(F.json_object_keys(F.coalesce(json_map(metadata), F.lit("{}"))), lambda k: ~F.map_contains_key(more, k))
    parts = F.concat(F.transform(kept, lambda k: F.concat(F.lit('"'), k, F.lit('":'), _value(held[k]))), F.transform(F.map_keys(more), lambda k: F.concat(F.lit('"'), k, F.lit('":'), more[k])))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def _value(text: Column) -> Column:
    """A value of a parsed map as JSON again: objects, lists, numbers and constants as they are, all else as a string."""
    bare = text.rlike(r"^(\{.*\}|\[.*\]|-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false)$")
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'^\{"v":(.*)\}$', 1)
    return F.when(text.isNull(), "null").when(bare, text).otherwise(quoted)


def feedback_metadata(nodes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(node_id, metadata) of every node with outcomes: their number added to ``feedback_count``, and ``last_feedback``."""
    last = F.max_by(F.struct("action_id", "status", "confidence"), F.struct("seq", "action_id"))
    told = outcomes.groupBy(F.col("causal_node_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), last.alias("last"))
    out = told.join(nodes.select(F.col("id").alias("node_id"), "metadata"), "node_id")
    count = F.coalesce(F.get_json_object("metadata", "$.feedback_count").try_cast("long"), F.lit(0)) + F.col("n")
    return out.select("node_id", _merged(F.col("metadata"), F.create_map(F.lit("feedback_count"), count.cast("string"), F.lit("last_feedback"), F.to_json("last"))).alias("metadata"))


def transition_history(goals: DataFrame, target: Column, as_of_us: int) -> DataFrame:
    """Goals that may go to a status, with the change put before the earlier ones in their metadata's ``transitions``."""
    new = F.to_json(F.struct(F.col("status").alias("from"), target.alias("to"), iso_time(F.lit(as_of_us)).alias("at")))
    past = F.regexp_extract(F.coalesce(F.get_json_object("metadata", "$.transitions"), F.lit("[]")), r"^\[(.*)\]$", 1)
    whole = F.concat(F.lit("["), F.concat_ws(",", new, F.nullif(past, F.lit(""))), F.lit("]"))
    return goals.where(is_legal(F.col("status"), target)).withColumn("metadata", _merged(F.col("metadata"), F.create_map(F.lit("transitions"), whole)))


def json_lines(rows: DataFrame, key: str, times: Iterable[str] = ()) -> DataFrame:
    """(key, line): each row as one line of JSON with nulls, columns in their order, and epoch microseconds of ``times`` in ISO-8601."""
    shown = [(iso_time(F.col(c)) if c in set(times) else F.col(c)).alias(c) for c in rows.columns]
    return rows.select(F.col(key), F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("line"))
