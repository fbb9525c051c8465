from pyspark.sql import functions as F

from plumbline.operators import orchestration as o

FLOW = "system_id string, revision_id string, flow_id string, flow_name string, active boolean, source_file string"
ENTITY = "system_id string, revision_id string, flow_id string, flow_name string, active boolean, relation string, profile string, entity_id string, published_stats_json string, source_file string, input_ordinal int"
TRIGGER = "system_id string, revision_id string, trigger_id string, flow_id string, flow_name string, active boolean, upstream_profile string, upstream_entity_id string, statistic_id string, source_file string"
DEPENDENCY = "system_id string, revision_id string, trigger_id string, producer_flow_id string, producer_flow_name string, consumer_flow_id string, consumer_flow_name string, resolution_status string, profile string, entity_id string, statistic_id string, producer_stat_supported boolean, producer_candidate_count int, provenance_json string"


def records(spark, entities, triggers, dependencies=(), flows=None):
    make = spark.createDataFrame
    flows = flows or [("A", "r", "p1", "P1", True, ""), ("A", "r", "p2", "P2", True, ""), ("B", "r", "c1", "C1", True, ""), ("A", "r", "off", "Off", False, "")]
    out = {k: make([], "system_id string, revision_id string") for k in o.RECORD_KINDS}
    return out | {
        "ctl_flow": make(flows, FLOW), "ctl_flow_entity": make(entities, ENTITY), "ctl_trigger": make(triggers, TRIGGER), "ctl_dependency": make(list(dependencies), DEPENDENCY),
    }


def revisions(spark):
    return spark.createDataFrame([("A", "r"), ("B", "r")], "system_id string, revision_id string")


def entity(flow, relation="published_entity", stats='["S"]', n=0, active=True, key="e"):
    return ("A", "r", flow, flow, active, relation, "prof", key, stats, "", n)


def trigger(stat="S", key="e", active=True, tid="t"):
    return ("B", "r", tid, "c1", "C1", active, "prof", key, stat, "")


def build(spark, *args, **kw):
    return o.build_topology(revisions(spark), records(spark, *args, **kw))


def status(t):
    return [r["status"] for r in t["edges"].collect()], [r["status"] for r in t["gaps"].collect()]


def test_one_producer(spark):
    assert status(build(spark, [entity("p1")], [trigger()])) == (["resolved_unique"], [])


def test_statistic_is_not_published(spark):
    assert status(build(spark, [entity("p1", stats='["X"]')], [trigger()])) == ([], ["statistic_not_confirmed"])


def test_unreadable_statistics_are_none(spark):
    assert status(build(spark, [entity("p1", stats="no json")], [trigger()])) == ([], ["statistic_not_confirmed"])


def test_two_producers_give_edges_and_a_gap(spark):
    t = build(spark, [entity("p1"), entity("p2", n=1)], [trigger()])
    assert status(t) == (["ambiguous_multiple"] * 2, ["ambiguous_multiple"])
    assert t["gaps"].first()["candidate_revisions"] == ["A@r"]


def test_direct_declarations_precede(spark):
    t = build(spark, [entity("p1"), entity("p2", relation="linked_entity", n=1)], [trigger()])
    assert [r["producer_flow_id"] for r in t["edges"].collect()] == ["p1"]


def test_nobody_else_produces(spark):
    assert status(build(spark, [], [trigger()])) == ([], ["external_half_wire"])


def test_inactive_flows_and_rows_do_not_count(spark):
    assert status(build(spark, [entity("off"), entity("p1", active=False)], [trigger()])) == ([], ["external_half_wire"])


def test_missing_identity_is_a_gap(spark):
    assert status(build(spark, [entity("p1")], [trigger(stat=None)])) == ([], ["unresolved_trigger_identity"])


def test_local_dependencies_pass_through_and_settle_their_trigger(spark):
    dep = ("B", "r", "t", "x", "X", "c1", "C1", "ambiguous", "prof", "e", "S", None, 2, None)
    t = build(spark, [entity("p1")], [trigger()], [dep])
    assert status(t) == (["ambiguous"], [])
    assert t["edges"].first()["kind"] == "repository_local"


def test_a_flow_counts_once_and_its_last_row_wins(spark):
    assert status(build(spark, [entity("p1"), entity("p1", stats='["X"]', n=1)], [trigger()])) == ([], ["statistic_not_confirmed"])


def test_a_system_is_pinned_once(spark):
    import pytest

    twice = spark.createDataFrame([("A", "r"), ("A", "s")], "system_id string, revision_id string")
    with pytest.raises(ValueError):
        o.check_revisions(twice, records(spark, [], []))
    with pytest.raises(ValueError):
        o.check_revisions(revisions(spark), {})


def test_table_lists_isolated_flows(spark):
    t = build(spark, [entity("p1")], [trigger()])
    got = o.dependency_table(t["edges"], t["gaps"], t["flows"])
    assert {r["producer_flow_id"] for r in got.where(F.col("row_kind") == "flow").collect()} == {"p2", "off"}
    assert {r["what"]: r["n"] for r in t["counts"].collect()} == {"revisions": 2, "flows": 4, "edges": 1, "gaps": 0}
