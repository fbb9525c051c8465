"""Durable preparation bound to the driver's whole tables, with DuckDB SQL of the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import preparation
from .queries import with_checkpoints
from .registry import query
from .tables import table


@query("""
with g as (select distinct o_custkey c, o_orderkey % 3 g from orders where o_custkey in (select c_custkey from customer)),
held as (select distinct o_custkey c from orders where o_orderkey % 29 = 0),
o as (select c, ['awaiting_publication', 'step_limit', 'no_progress', 'published', 'published', 'published', 'published'][cast((c + g) % 7 + 1 as int)] outcome, row_number() over (partition by c order by g) n, count(*) over (partition by c) total from g where c not in (select c from held)),
t as (select *, min(case when outcome in ('awaiting_publication', 'no_progress') then n else 99 end) over (partition by c) stop from o),
s as (select c, count(*) tried, max(total) total, bool_or(n = stop) stopped, bool_and(outcome = 'published') clean, bool_or(outcome = 'awaiting_publication') awaiting, bool_or(outcome = 'no_progress') np, bool_or(outcome = 'step_limit') sl from t where n <= stop and n <= 2 group by 1)
select 'c' || c_custkey edge_id, coalesce(tried, 0) tried, case when tried is null then 0 else 1 end rounds,
  case when c_custkey in (select c from held) then 'blocked' when tried is null then 'already_prepared' when clean and tried = total then 'prepared' when not stopped and total > tried then 'budget_exhausted'
       when awaiting then 'awaiting_publication' when np then 'no_progress' when sl then 'step_limit' else 'no_progress' end status
from customer left join s on c = c_custkey""")
def preparation_runs(spark: SparkSession, d: str) -> DataFrame:
    """Customers as edges, their orders as requirements of three groups, at most two of which are prepared."""
    with_checkpoints(spark)
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("edge_id"), F.col("c_custkey").alias("n"))
    k = F.col("o_orderkey")
    needs = table(spark, d, "orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("edge_id"), F.when(k % 29 == 0, "ambiguous").otherwise("needs_external_source").alias("state"), (k % 3).cast("string").alias("preparation_group"),
    ).distinct().join(c.select("edge_id"), "edge_id", "left_semi").checkpoint()

    def check(state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """A requirement is open until its group is published."""
        out = state.where("event = 'done' and outcome = 'published'").select("edge_id", F.replace("group_key", F.lit("external:"), F.lit("")).alias("preparation_group"))
        left = needs.join(out, ["edge_id", "preparation_group"], "left_anti")
        open_ = left.select("edge_id").distinct().withColumn("ready", F.lit(False))
        return c.select("edge_id").join(open_, "edge_id", "left").withColumn("ready", F.coalesce("ready", F.lit(True))), left

    def prepare(groups: DataFrame) -> DataFrame:
        place = (F.substring("edge_id", 2, 20).cast("long") + F.substring("group_key", 10, 20).cast("long")) % 7 + 1
        names = F.array(*map(F.lit, ("awaiting_publication", "step_limit", "no_progress", "published", "published", "published", "published")))
        return groups.withColumn("outcome", F.element_at(names, place.cast("int")))

    root = spark.sparkContext.getCheckpointDir()
    return preparation.run(spark, f"{root}/preparation-{uuid.uuid4().hex}", check, prepare, 2)
