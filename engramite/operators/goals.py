"""Life cycle of goals: transitions, progress, links, dependencies, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramite.functions.normalize import probability, string_list
from engramite.schema import TRANSITIONS


def is_legal(origin: Column, target: Column) -> Column:
    """Whether a goal may go from one status to another; staying is legal."""
    allowed = [F.concat(F.lit(a), F.lit(">"), F.lit(b)) for a, b in TRANSITIONS]
    return F.coalesce((origin == target) | F.concat(origin, F.lit(">"), target).isin(*allowed), F.lit(False))


def transition(goals: DataFrame, requests: DataFrame, as_of_us: int) -> DataFrame:
    """Requests (goal_id, to_status) against goals: the request's fate and the goal after it.

    ``result`` is applied, invalid_transition or not_found.  Completion sets progress 1 and the time.
    """
    held = goals.select(F.col("id").alias("goal_id"), F.col("status").alias("from_status"), "progress")
    out = requests.join(held, "goal_id", "left")
    legal = is_legal(F.col("from_status"), F.col("to_status"))
    result = F.when(F.col("from_status").isNull(), "not_found").when(legal, "applied").otherwise("invalid_transition")
    out = out.withColumn("result", result)
    done = (F.col("result") == "applied") & (F.col("to_status") == "completed")
    return out.select(
        "goal_id", "from_status", "to_status", "result", F.when(F.col("result") == "applied", F.col("to_status")).otherwise(F.col("from_status")).alias("status"),
        F.when(done, 1.0).otherwise(F.col("progress")).alias("progress"), F.when(done, F.lit(as_of_us)).alias("completed_us"),
    )


def set_progress(goals: DataFrame, progress: DataFrame, as_of_us: int) -> DataFrame:
    """New progress (goal_id, value); 1 or more completes a goal whatever its status."""
    held = goals.select(F.col("id").alias("goal_id"), F.col("status").alias("old_status"))
    p = probability(F.col("value"), default=0.0, trim=True)
    out = progress.join(held, "goal_id").withColumn("progress", p)
    full = F.col("progress") >= 1.0
    return out.select("goal_id", F.when(full, "completed").otherwise(F.col("old_status")).alias("status"), "progress", F.when(full, F.lit(as_of_us)).alias("completed_us"))


def linked(current: Column, added: Column) -> Column:
    """Ordered union of node ids, the first of equals kept."""
    return F.array_union(string_list(current), string_list(added))


def unlinked(current: Column, removed: Column) -> Column:
    return F.array_except(string_list(current), string_list(removed))


def add_dependencies(deps: DataFrame, wanted: DataFrame, goals: DataFrame) -> DataFrame:
    """Dependency pairs with those of ``wanted`` whose goals both exist; repeats collapse."""
    ids = goals.select("id").distinct()
    ok = wanted.join(ids, wanted["goal_id"] == ids["id"], "left_semi").join(ids, wanted["dependency_goal_id"] == ids["id"], "left_semi")
    return deps.select("goal_id", "dependency_goal_id").unionByName(ok.select("goal_id", "dependency_goal_id")).distinct()


def remove_dependencies(deps: DataFrame, unwanted: DataFrame) -> DataFrame:
    return deps.join(unwanted, ["goal_id", "dependency_goal_id"], "left_anti")


def dependency_closure(deps: DataFrame, hops: int = 2) -> DataFrame:
    """Extension: every (goal_id, dependency_goal_id) reachable through dependencies.

    Semi-naive: a round takes only the farthest pairs so far ``hops`` dependencies further, never pairs with pairs, and
    ends when none is as far.  What is new comes from one aggregation with the pairs so far.  Each round is a table in the shared folder, whose size tells Catalyst how to join.
    """
    from engramite.sources.tables import shared_dir

    spark = deps.sparkSession
    folder = shared_dir(spark)

    def kept(df: DataFrame, n: int) -> DataFrame:
        df.write.parquet(f"{folder}/round-{n}")
        return spark.read.schema(df.schema).parquet(f"{folder}/round-{n}")

    base = kept(deps.select("goal_id", "dependency_goal_id").distinct(), 0)
    step = base.select(F.col("goal_id").alias("dependency_goal_id"), F.col("dependency_goal_id").alias("next"))
    pairs, front, n = base, base, 0
    while True:
        reached, far, n = pairs.withColumn("hop", F.lit(0)), front, n + 1
        for hop in range(1, hops + 1):
            far = far.join(step, "dependency_goal_id").select("goal_id", F.col("next").alias("dependency_goal_id"))
            reached = reached.unionByName(far.withColumn("hop", F.lit(hop)))
        new = kept(reached.groupBy("goal_id", "dependency_goal_id").agg(F.min("hop").alias("hop")).where("hop > 0"), n)
        pairs = pairs.unionByName(new.drop("hop"))
        # a pair that takes fewer hops leads only to pairs that are there
        front = new.where(F.col("hop") == hops).drop("hop")
        if front.isEmpty():
            return pairs


def review_policy(goals: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Reviews (goal_id, decision, decision_confidence) put into effect: act, learn and escalate aim at active, proposed, blocked."""
    out = goals.select(F.col("id").alias("goal_id"), F.col("status").alias("from_status")).join(evaluated, "goal_id")
    out = out.withColumn("to_status", F.when(F.col("decision") == "act", "active").when(F.col("decision") == "learn", "proposed").otherwise("blocked"))
    same, legal = F.col("from_status") == F.col("to_status"), is_legal(F.col("from_status"), F.col("to_status"))
    return out.select("goal_id", "decision", "decision_confidence", "from_status", "to_status", (legal & ~same).alias("applied"), F.when(same, "already_in_target_status").when(~legal, "invalid_transition").alias("reason"))
