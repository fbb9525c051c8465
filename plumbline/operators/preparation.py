"""Preparation of many edges at once, as durable state: rounds, groups and outcomes are published rows.

The state of a path has the rows (edge_id, group_key, event, round, outcome): `planned` when a round finds a group that was not tried,
`done` with the outcome when it was. A run that ends anywhere goes on from what is stored: what is done is neither prepared
again nor forgotten by the budget, and a round that was planned is finished before the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import published
from .interaction import BLOCKING_STATES, preparation_key, preparation_status

STATE = "edge_id string, group_key string, event string, round int, outcome string"
PLANNED, DONE = "planned", "done"
#: fixed values: outcomes that end an edge
STOPS = ("awaiting_publication", "blocked", "no_progress")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return published.read(spark, path) if published.current(spark, path)[1] else spark.createDataFrame([], STATE)


def standing(state: DataFrame, budget: int | None = None) -> DataFrame:
    """Per edge: tried, waiting (planned, not done), last_round, stopped, exhausted and the outcomes that were seen."""
    done = F.col("event") == DONE
    saw = lambda *names: F.coalesce(F.bool_or(done & F.col("outcome").isin(*names)), F.lit(False))
    s = state.groupBy("edge_id").agg(
        F.count_if(done).alias("tried"), (F.count_if(~done) - F.count_if(done)).alias("waiting"), F.max("round").alias("last_round"), saw(*STOPS).alias("stopped"),
        saw("awaiting_publication").cast("int").alias("awaiting"), saw("no_progress").alias("no_progress"), saw("step_limit").alias("step_limit"),
    )
    spent = F.lit(False) if budget is None else F.col("tried") >= budget
    return s.withColumn("exhausted", spent & ~F.col("stopped") & (F.col("waiting") > 0))


def plan(requirements: DataFrame, state: DataFrame) -> DataFrame:
    """State rows of the next round: for edges that wait for nothing and did not stop, the groups that were not planned. An edge
    with a blocking requirement plans nothing. requirements: edge_id, state, preparation_group and more, of edges that are not ready."""
    r = requirements.withColumn("group_key", preparation_key(requirements)).withColumn("__blocks", F.col("state").isin(*BLOCKING_STATES))
    held = r.where("__blocks").select("edge_id").distinct()
    s = standing(state).select("edge_id", "waiting", "stopped", "last_round")
    groups = r.select("edge_id", "group_key").distinct().join(held, "edge_id", "left_anti").join(state.select("edge_id", "group_key").distinct(), ["edge_id", "group_key"], "left_anti")
    fresh = groups.join(s, "edge_id", "left").where(F.coalesce(F.col("waiting") == 0, F.lit(True)) & ~F.coalesce("stopped", F.lit(False)))
    return fresh.select("edge_id", "group_key", F.lit(PLANNED).alias("event"), (F.coalesce("last_round", F.lit(0)) + 1).alias("round"), F.lit("").alias("outcome"))


def next_groups(state: DataFrame, budget: int | None = None) -> DataFrame:
    """(edge_id, group_key, round): each edge's first group that waits, by key; none of edges that stopped or used their budget."""
    waiting = state.where(F.col("event") == PLANNED).join(state.where(F.col("event") == DONE).select("edge_id", "group_key"), ["edge_id", "group_key"], "left_anti")
    first = waiting.groupBy("edge_id").agg(F.min(F.struct("group_key", "round")).alias("x")).select("edge_id", "x.group_key", "x.round")
    return first.join(standing(state, budget).where("stopped or exhausted"), "edge_id", "left_anti")


def statuses(edges: DataFrame, state: DataFrame, budget: int | None = None) -> DataFrame:
    """(edge_id, status, rounds, tried) of edges (edge_id, ready)."""
    e = edges.join(standing(state, budget), "edge_id", "left")
    of = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    tried = of("tried", 0)
    e = e.select(
        "edge_id", tried.alias("tried"), of("last_round", 0).alias("rounds"), (F.col("ready") & (tried == 0)).alias("ready_before"), F.col("ready").alias("ready_after"), of("exhausted", False).alias("exhausted"),
        of("awaiting", 0).alias("awaiting"), of("no_progress", False).alias("no_progress"), of("step_limit", False).alias("step_limit"), ((tried > 0) & ~of("stopped", False)).alias("no_new"),
    )
    return e.select("edge_id", preparation_status().alias("status"), "rounds", "tried")


def run(spark: SparkSession, path: str, check: Callable[[DataFrame], tuple[DataFrame, DataFrame]], prepare: Callable[[DataFrame], DataFrame], budget: int | None = None) -> DataFrame:
    """Prepare every edge until it is ready, stops, has no new group or has used its budget of groups; returns `statuses`.

    check(state) gives edges (edge_id, ready) and the open requirements of those that are not ready; prepare(groups) gives
    (edge_id, group_key, outcome) for each group. A step prepares one group of every edge that is not finished, so steps are as many as the
    groups of the edge with most. Outcomes are checkpointed, then published: a group whose outcome was lost before that is prepared again."""
    key = ["edge_id", "group_key", "event"]
    while True:
        state = read_state(spark, path)
        edges, requirements = check(state)
        published.write_new_keys(plan(requirements.join(edges.where("ready"), "edge_id", "left_anti"), state), path, key)
        finished = True
        while True:
            groups = next_groups(read_state(spark, path), budget).checkpoint()
            if groups.isEmpty():
                break
            finished = False
            made = prepare(groups.select("edge_id", "group_key")).select("edge_id", "group_key", "outcome")
            done = groups.join(made, ["edge_id", "group_key"]).select("edge_id", "group_key", F.lit(DONE).alias("event"), "round", "outcome").checkpoint()
            if published.write_new_keys(done, path, key) == 0:
                raise ValueError("no group got an outcome")
        if finished:
            return statuses(edges, read_state(spark, path), budget)
