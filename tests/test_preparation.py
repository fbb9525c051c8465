import pytest
from pyspark.sql import functions as F

from plumbline.operators import preparation, search
from plumbline.sources import published

#: edge -> outcomes of its groups a and b (published where none is named), and the status at the end
CASES = {
    "all": ({}, "prepared"), "none": ({"external:b": "no_progress"}, "no_progress"), "wait": ({"external:a": "awaiting_publication"}, "awaiting_publication"), "stop": ({"external:a": "blocked"}, "blocked"),
    "steps": ({"external:a": "step_limit", "external:b": "step_limit"}, "step_limit"), "idle": ({"external:a": "idle"}, "no_progress"),
}


class Work:
    """Edges with the groups a and b; prepare may fail at a step, as if the application had been lost."""

    def __init__(self, spark, fail_at=None):
        self.spark, self.fail_at, self.asked = spark, fail_at, []

    def check(self, state):
        needs = [(e, "needs_external_source", g) for e in CASES for g in "ab"] + [("held", "ambiguous", "a"), ("held", "needs_external_source", "b")]
        needs = self.spark.createDataFrame(needs, "edge_id string, state string, preparation_group string")
        done = state.where("event = 'done' and outcome = 'published'").select("edge_id", F.expr("substr(group_key, 10)").alias("preparation_group"))
        left = needs.join(done, ["edge_id", "preparation_group"], "left_anti")
        open_ = left.select("edge_id").distinct().withColumn("ready", F.lit(False))
        edges = self.spark.createDataFrame([(e,) for e in (*CASES, "held", "ready")], "edge_id string")
        return edges.join(open_, "edge_id", "left").withColumn("ready", F.coalesce("ready", F.lit(True))), left

    def prepare(self, groups):
        rows = [tuple(r) for r in groups.collect()]
        if self.fail_at == len({g for _, g in self.asked}):
            raise RuntimeError("lost")
        self.asked += rows
        return self.spark.createDataFrame([(e, g, CASES[e][0].get(g, "published")) for e, g in rows], "edge_id string, group_key string, outcome string")


EXPECTED = {e: s for e, (_, s) in CASES.items()} | {"held": "blocked", "ready": "already_prepared"}


def test_a_lost_run_goes_on_where_it_was(spark, tmp_path):
    path = str(tmp_path / "state")
    lost = Work(spark, fail_at=1)
    with pytest.raises(RuntimeError, match="lost"):
        preparation.run(spark, path, lost.check, lost.prepare)
    assert published.read(spark, path).where("event = 'done'").count() == len(CASES)
    again = Work(spark)
    got = {r["edge_id"]: r["status"] for r in preparation.run(spark, path, again.check, again.prepare).collect()}
    assert got == EXPECTED
    assert {g for _, g in lost.asked} == {"external:a"} and {g for _, g in again.asked} == {"external:b"}
    third = Work(spark)
    assert {r["edge_id"]: r["status"] for r in preparation.run(spark, path, third.check, third.prepare).collect()} == EXPECTED | {"ready": "already_prepared"}
    assert third.asked == []


def test_the_budget_counts_what_was_stored(spark, tmp_path):
    path = str(tmp_path / "state")
    for _ in range(2):
        w = Work(spark)
        got = {r["edge_id"]: (r["status"], r["tried"]) for r in preparation.run(spark, path, w.check, w.prepare, budget=1).collect()}
        assert got["all"] == ("budget_exhausted", 1) and got["wait"] == ("awaiting_publication", 1) and got["held"] == ("blocked", 0) and got["steps"] == ("budget_exhausted", 1)
    assert w.asked == []


def test_searches_are_bounded(spark):
    records = spark.createDataFrame([("k", "1", "name", "", "")], "record_kind string, record_id string, name string, parent string, file string")
    for query, limit in ((" ", 5), ("name", 0), ("name", 1001)):
        with pytest.raises(ValueError):
            search.search(records, query, limit)
    assert search.search(records, " name ", 1000, fuzzy=False).first()["match_kind"] == "exact"


def test_numbers_run_on_over_the_ranges(spark):
    from plumbline.operators import keys

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(1000).repartition(5).select((F.col("id") % 10).alias("a"), "id")
        got = keys.numbered(rows, [F.col("a").desc(), F.col("id")]).orderBy("n").collect()
        assert keys.numbered(rows.limit(0), ["id"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["n"] for r in got] == list(range(1, 1001)) and [(r["a"], r["id"]) for r in got] == sorted(((i % 10, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
