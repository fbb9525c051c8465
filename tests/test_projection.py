"""Semantic evidence: nesting of observed paths, external origins, continuation into callees, shortest ways, the whole build."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import graph, projection, source_target


@pytest.fixture(scope="module")
def nodes_of(spark):
    def make(*rows):
        return spark.createDataFrame([tuple(r.get(c) for c in projection.NODE_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in projection.NODE_COLUMNS))

    return make


def field(key, ref, kind=None, **more):
    """A field node and, with a type, the one typed object of its occurrence."""
    own = {"repo_id": "r", "value_node_id": key, "node_kind": "field", "display_ref": ref, "object_occurrence_id": f"{key}-o", **more}
    if kind is None:
        return [own]
    return [own, {"repo_id": "r", "value_node_id": f"{key}-n", "node_kind": "local_value", "display_ref": ref.split(".")[0], "occurrence_id": f"{key}-o", "declared_type": kind}]


# ---- target projection


def nesting(spark, nodes_of, fields, paths, status="resolved", extra=()):
    nodes = nodes_of(*[n for f in fields for n in f], *[n for f in extra for n in f])
    journeys = spark.createDataFrame([("j", "r", status, "payload.date")], "journey_id string, repo_id string, anchor_status string, anchor_ref string")
    on = spark.createDataFrame([("j", str(p), i, v) for p, path in enumerate(paths) for i, v in enumerate(path)], "journey_id string, path_id string, position int, value_node_id string")
    found = projection.target_projection(journeys, on, nodes).collect()
    return found[0]["chain"] if found else None


LADDER = [
    field("anchor", "payload.date"), field("alias", "identifications.date"), field("p", "person.birthday", "PersonInfo"), field("c", "customer.personInfo.birthday", "CustInfo"),
    field("a", "account.custInfo.personInfo.birthday", "CardAcctId"), field("b", "bank.cardAcctId.custInfo.personInfo.birthday", "BankAcct"),
]
CHAIN = ["PersonInfo.birthday", "CustInfo.personInfo.birthday", "CardAcctId.custInfo.personInfo.birthday", "BankAcct.cardAcctId.custInfo.personInfo.birthday"]
ALL = ["anchor", "alias", "p", "c", "a", "b"]


def test_nesting_climbs_from_the_first_typed_field(spark, nodes_of):
    assert nesting(spark, nodes_of, LADDER, [ALL]) == CHAIN
    assert nesting(spark, nodes_of, LADDER, [ALL], status="ambiguous") is None
    assert nesting(spark, nodes_of, LADDER, [["anchor", "alias", "p"]]) is None  # a lone alias is no nesting
    assert nesting(spark, nodes_of, LADDER, [["anchor", "p", "b"]]) == ["PersonInfo.birthday"] + CHAIN[3:]  # a step that nobody published is skipped


def test_paths_must_agree_on_the_entry(spark, nodes_of):
    assert nesting(spark, nodes_of, LADDER, [["anchor", "p", "c"], ["anchor", "alias", "p", "a"]]) == CHAIN[:3]
    assert nesting(spark, nodes_of, LADDER, [["anchor", "p", "c"], ["anchor", "c", "a"]]) is None


def test_ties_end_the_climb_and_types_break_them(spark, nodes_of):
    twins = [*LADDER[:3], field("x", "one.personInfo.birthday", "AbcInfo"), field("y", "two.personInfo.birthday", "XyzInfo")]
    assert nesting(spark, nodes_of, twins, [["anchor", "p", "x", "y"]]) is None
    typed = [*LADDER[:3], field("x", "one.personInfo.birthday", "AbcInfo"), field("y", "two.personInfo.birthday")]
    assert nesting(spark, nodes_of, typed, [["anchor", "p", "x", "y"]]) == ["PersonInfo.birthday", "AbcInfo.personInfo.birthday"]


def test_other_head_and_collection_follow(spark, nodes_of):
    more = [*LADDER, field("q", "proxy.cardAcctId.custInfo.personInfo.birthday", "ProxyAcctLonger"), field("l", "rows.cardAcctId.custInfo.personInfo.birthday", "java.util.List<Row>")]
    assert nesting(spark, nodes_of, more, [[*ALL, "q", "l"]]) == [*CHAIN, "ProxyAcctLonger.cardAcctId.custInfo.personInfo.birthday", "rows[].cardAcctId.custInfo.personInfo.birthday"]


def test_tied_collections_give_their_common_payload(spark, nodes_of):
    wrap = [field(k, f"{k}.outer.bankAcct.cardAcctId.custInfo.personInfo.birthday", "List<X>") for k in ("ones", "twos")]
    payload = field("z", "o.bankAcct.cardAcctId.custInfo.personInfo.birthday", "Outer")
    got = nesting(spark, nodes_of, [*LADDER, *wrap], [[*ALL, "ones", "twos"]], extra=[payload])
    assert got == [*CHAIN, "Outer.bankAcct.cardAcctId.custInfo.personInfo.birthday"]
    assert nesting(spark, nodes_of, [*LADDER, *wrap], [[*ALL, "ones", "twos"]]) == CHAIN
    two = [payload, field("z2", "o2.bankAcct.cardAcctId.custInfo.personInfo.birthday", "outer")]
    assert nesting(spark, nodes_of, [*LADDER, *wrap], [[*ALL, "ones", "twos"]], extra=two) == CHAIN


def test_references_that_are_no_plain_paths(spark, nodes_of):
    rows = [field("a", "get().x"), field("b", "new Card.id", object_declared_type="Card"), field("c", "id", object_declared_type="Card", property_name="num"), field("d", "a..b"), field("e", "plain.x"), field("f", "")]
    got = {r["value_node_id"]: (r["ref"], r["shape"]) for r in projection.semantic_refs(nodes_of(*[n for f in rows for n in f])).collect()}
    assert got == {"b": ("Card.id", "card.id"), "c": ("Card.num", "card.num"), "e": ("plain.x", "plain.x")}


# ---- external origins


def terminal(key, ref, kind="ExternalProfile", call="converter.convert()", status="external_or_unresolved"):
    return [
        {"repo_id": "service", "value_node_id": key, "node_kind": "field", "display_ref": ref, "occurrence_kind": "projected_object_field", "object_occurrence_id": f"{key}-call"},
        {"repo_id": "service", "value_node_id": f"{key}-c", "display_ref": call, "occurrence_id": f"{key}-call", "occurrence_kind": "method_invocation", "resolution_status": status, "declared_type": kind},
    ]


def gaps_of(spark, nodes_of, *terminals):
    ends = spark.createDataFrame([("j", "service", t[0]["value_node_id"]) for t in terminals], "journey_id string, repo_id string, value_node_id string")
    return projection.external_origin_gaps(ends, nodes_of(*[n for t in terminals for n in t]))


def test_only_typed_external_calls_are_material(spark, nodes_of):
    twice = terminal("e", "converter.convert().x")
    got = gaps_of(spark, nodes_of, terminal("a", "converter.convert().items.id"), terminal("b", "future.handle().status", kind=""), terminal("c", "x.y().z", status="resolved"), terminal("d", "other.ref"), [*twice, twice[1]])
    assert {(r["terminal_id"], tuple(r["relative"]), r["property"], r["parent_type"]) for r in got.collect()} == {("a", ("items", "id"), "id", "ExternalProfile"), ("d", ("ref",), "ref", "ExternalProfile")}


def external(key, prop, kind, symbol="dto", owners=1):
    op = {"repo_id": "maven", "operation": f"Op.{key}"}
    own = {**op, "symbol": symbol, "display_ref": symbol, "declared_type": kind, "occurrence_kind": "local_variable"}
    return [{**op, "value_node_id": key, "node_kind": "field", "display_ref": f"{symbol}.{prop}", "property_name": prop}, *[own] * owners]


@pytest.mark.parametrize("nested_origin, owners, hops, covered", [("o1", 1, 2, True), ("o9", 1, 2, False), ("o1", 2, 2, False), ("o1", 1, 0, False)])
def test_nested_evidence_shares_an_origin_with_its_ancestor(spark, nodes_of, nested_origin, owners, hops, covered):
    gaps = gaps_of(spark, nodes_of, terminal("t1", "converter.convert().items"), terminal("t2", "converter.convert().items.id"))
    nodes = nodes_of(*external("v1", "items", "ExternalProfile", owners=owners), *external("v2", "id", "Item", symbol="item"))
    paths = spark.createDataFrame([("v1", hops, "confirmed", "o1", "field"), ("v1", 1, "candidate", "o8", "field"), ("v1", 3, "high", "lit", "literal"), ("v2", 1, "probable", nested_origin, "field")], "value_node_id string, hop_count int, confidence string, end_id string, end_kind string")
    scopes = spark.createDataFrame([("j", "maven")], "journey_id string, repo_id string")
    got = projection.external_segments(gaps, scopes, nodes, paths)
    if covered:
        assert {(r["terminal_id"], r["value_node_id"], r["depth"], r["origin_id"]) for r in got.collect()} == {("t1", "v1", 0, "o1"), ("t2", "v2", 1, "o1")}
    else:
        assert got.count() == 0
    assert {(r["covered"], r["reason"]) for r in projection.with_coverage(gaps, got).collect()} == {(covered, "source_external_origin_link_unproven" if covered else "source_external_origin_unresolved")}


# ---- continuation into callees


def callee(depth, owner_count=1, parameter="details"):
    place = {"repo_id": "maven", "operation": "Mapper.map", "method_id": "m1"}
    out = [{**place, "symbol": parameter, "display_ref": parameter, "occurrence_kind": "method_parameter", "declared_type": "Raw"}]
    out += [{**place, "symbol": "dto", "display_ref": "dto", "occurrence_kind": "local_variable", "declared_type": "ExternalDetails"}] * owner_count
    out += [{**place, "value_node_id": "target", "node_kind": "field", "display_ref": "dto.id", "property_name": "id"}, {**place, "value_node_id": "from", "node_kind": "field", "display_ref": "details.id", "property_name": "id"}]
    return out, [(f"n{i}" if i else "from", f"n{i + 1}" if i + 1 < depth else "target") for i in range(depth)]


@pytest.mark.parametrize("depth, owners, parameter, status, origins, composed", [
    (1, 1, "details", "resolved", ["mapped.details"], "mapped.details.id"), (40, 1, "details", "resolved", ["mapped.details"], "mapped.details.id"), (1, 2, "details", "resolved", ["mapped.details"], None),
    (1, 1, "other", "resolved", ["mapped.details"], None), (1, 1, "details", "external_or_unresolved", ["mapped.details"], None), (1, 1, "details", "resolved", ["mapped.details", "second"], None),
])
def test_scalars_of_resolved_callees(spark, nodes_of, depth, owners, parameter, status, origins, composed):
    nodes, flows = callee(depth, owners, parameter)
    local = {"repo_id": "service", "operation": "Service.run"}
    mine = nodes_of({**local, "value_node_id": "l1", "node_kind": "field", "display_ref": "details.id"}, {**local, "display_ref": "details", "occurrence_kind": "method_parameter", "declared_type": "ExternalDetails"})
    ends = spark.createDataFrame([("j", "service", "l1")], "journey_id string, repo_id string, value_node_id string")
    needed = projection.local_requirements(ends, mine)
    assert [(r["local_id"], r["owner_type"], r["property"], r["local_path"]) for r in needed.collect()] == [("l1", "ExternalDetails", "id", ["id"])]
    segments = spark.createDataFrame([("j", "s1", str(i), o) for i, o in enumerate(origins)], "journey_id string, value_node_id string, origin_id string, origin_ref string")
    calls = spark.createDataFrame([("s1", "m1", "ExternalDetails", status)], "value_node_id string, callee_method_id string, result_type string, resolution_status string")
    scopes = spark.createDataFrame([("j", "maven")], "journey_id string, repo_id string")
    got = projection.scalar_continuations(segments, calls, needed, scopes, nodes_of(*nodes), spark.createDataFrame(flows, "src string, dst string"))
    assert [(r["local_id"], r["value_node_id"], r["origin_id"], r["composed_ref"]) for r in got.collect()] == ([("l1", "target", "from", composed)] if composed else [])


def test_unresolved_calls_show_the_one_method_of_their_name(spark, nodes_of):
    method = lambda k, m, **x: {"repo_id": "maven", "operation": f"{m}.mask", "method_id": m, "value_node_id": k, "display_ref": k, **x}
    one = [method("par", "A", occurrence_kind="method_parameter"), method("call", "A", occurrence_kind="method_invocation"), method("ret", "A", node_kind="return_value", occurrence_kind="method_return")]
    calls = spark.createDataFrame([("maven", "mask")], "repo_id string, method_name string")
    way = [("par", "call"), ("call", "ret")]
    run = lambda nodes, flows: projection.unresolved_callee_evidence(calls, nodes_of(*nodes), spark.createDataFrame(flows, "src string, dst string")).collect()
    assert [(r["method_id"], r["origin_id"], r["target_id"], r["invocations"]) for r in run(one, way)] == [("A", "par", "ret", ["call"])]
    assert run([*one, method("x", "B")], way) == [] and run(one, [("par", "ret")]) == [] and run(one, [*way, ("par", "other"), ("other", "ret")]) == []


# ---- shortest ways


def test_shortest_ways_are_counted(spark):
    e = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "a"), ("b", "e"), ("a", "b"), (None, "x")]
    diamonds = [x for i in range(60) for x in ((f"v{i}", f"l{i}"), (f"v{i}", f"r{i}"), (f"l{i}", f"v{i + 1}"), (f"r{i}", f"v{i + 1}"))]
    got = graph.shortest_paths(spark.createDataFrame(e + diamonds[:80], "src string, dst string"), spark.createDataFrame([("a",), ("v0",), (None,), ("alone",)], "node string"))
    rows = {(r["start"], r["end"]): (r["hops"], r["path_count"], r["path"]) for r in got.collect()}
    assert rows["a", "d"] == (2, 2, ["a", "b", "d"]) and rows["a", "e"] == (2, 1, ["a", "b", "e"]) and ("a", "a") not in rows
    assert rows["v0", "v20"][:2] == (40, 2**20) and not any(s == "alone" for s, _ in rows)


def test_source_projection_needs_one_local_node_and_one_way(spark, nodes_of):
    nodes = nodes_of(*[{"repo_id": "r", "value_node_id": v, "node_kind": k, "display_ref": f"ref {v}"} for v, k in (("anchor", "wire_field"), ("m", "derivation"), ("hid", "literal"), ("local", "field"))])
    journeys = spark.createDataFrame([("j", "anchor")], "journey_id string, anchor_id string")
    flows = lambda *e: spark.createDataFrame(e, "src string, dst string")
    seg = lambda *s: spark.createDataFrame([("j", d, x) for d, x in s], "journey_id string, depth int, local_id string")
    straight = flows(("local", "hid"), ("hid", "m"), ("m", "anchor"))
    run = lambda s, f: [r["chain"] for r in projection.source_projection(journeys, s, nodes, f).collect()]
    assert run(seg((0, "other"), (1, "local"), (1, "local")), straight) == [["ref local", "ref m", "ref anchor"]]
    assert run(seg((1, "local"), (1, "other")), straight) == [] and run(seg((1, "local")), flows(("local", "m"), ("local", "hid"), ("m", "anchor"), ("hid", "anchor"))) == []


# ---- the whole source-to-target build


def test_build(spark):
    cols = "workflow_target_logical_name string, target_column string, source_sql_column string, immediate_source_column string, source_relation_role string, driver_relation_status string, driver_relation_name string, branch_relation_name string, source_sql_relation_name string, immediate_source_relation_name string, mapping_id string, workflow_context_file string, source_sql_file string, linked array<struct<expression:string,expression_kind:string,output_name:string,resolution_status:string>>"
    e = [("upper(id)", "function", "", "resolved"), ("id", "direct_column", "", "resolved"), ("low(id)", "function", "", "partial")]
    m = lambda col, src, role, driver, i, linked=(), imm="": ("mart.t", col, src, imm, role, "resolved" if driver else "", driver, "", "", "", i, "f", "q", list(linked))
    mappings = spark.createDataFrame([m("id", "id", "driver_path", "src.base", "m1", e), m("id", "", "driver_path", "src.second", "m2", imm="raw"), m("name", "n", "lookup", "src.l", "m3"), m("blind", "", "driver_path", "src.base", "m4"), m("blind", "", "driver_path", "src.base", "m5", imm="a"), m("blind", "", "driver_path", "src.base", "m6", imm="b")], cols)
    env = spark.createDataFrame([], "semantic_key array<string>, status string, resolved_source_relation string, gap_ids array<string>")
    fields = spark.createDataFrame([("mart.t", "id", "p1", "evil", "evil", "T2", 1), ("mart.t", "id", "p2", "evil", "evil", "T2", 2), ("mart.t", "only", "p3", "", "", "", 3)], "target_relation string, target_column string, `T-trg-platform` string, `T-src` string, `T-src-platform` string, `T-trg` string, input_ordinal int")
    gaps = spark.createDataFrame([("g", "mart.t", "lost", "other", "", [], "", "", "", "", [])], "gap_id string, target_relation string, target_column string, gap_kind string, mapping_basis string, candidates array<string>, usage_id string, source_relation_name string, source_column string, evidence_text string, refs array<string>")
    none = spark.createDataFrame([], "usage_id string, survivors array<string>, excluded array<string>")
    out = source_target.build(mappings, env, fields, gaps, none)
    rows = {(r["T-trg"], r["T-trg-f"], r["T-trg-platform"], r["T-src-platform"], r["T-src-schema"], r["T-src"], r["T-src-f-name"], r["T-src-f"]) for r in out["rows"].collect()}
    assert rows == {
        ("T2", "id", "p2", "", "src", "base", "id", "upper(id)"), ("T2", "id", "p2", "", "src", "second", "raw", ""), ("t", "name", "", "", "", "", "", ""),
        ("t", "blind", "", "", "src", "base", "", ""), ("t", "only", "p3", "", "", "", "", ""), ("t", "lost", "", "", "", "", "", ""),
    }
    assert {(r["gap_type"], r["target_column"]) for r in out["gaps"].collect()} == {("CONSUMER_CONVENTION", "name"), ("INSUFFICIENT_EVIDENCE", "lost")}
    ids = {r["T-trg-f"]: (r["mapping_ids"], r["basis"], r["row_id"]) for r in out["rows"].collect()}
    assert ids["blind"][0] == ["m4", "m5", "m6"] and ids["name"][:2] == (["m3"], "target_observed_primary_source_not_resolved") and all(v[2].startswith("s2t-row-") for v in ids.values())


def test_driver_statuses_of_a_revision_reach_the_primary_source(spark):
    candidates = spark.createDataFrame([("r", "t", "final", "", ["c"], "mart.t", "confirmed_unique", 1)], "repo_id string, logical_target_name string, target_kind string, workflow_status string, workflow_contexts array<string>, recommended_target_relation string, target_relation_recommendation_status string, input_ordinal int")
    sources = [(f"v{i}", [], s, f"src.{i}") for i, s in enumerate(("Complete", "confirmed", "partial", "odd", ""))]
    values = spark.createDataFrame([("r", "t", "id", 5, sources, [], 1)], "repo_id string, logical_target_name string, target_column string, source_count int, sources array<struct<mapping_id:string,refs:array<int>,status:string,driver_relation_name:string>>, expressions array<struct<expression:string,expression_kind:string,output_name:string,resolution_status:string>>, input_ordinal int")
    gaps = spark.createDataFrame([], "repo_id string, logical_target_name string, gap_id string, owner_id string, gap_kind string, severity string, message string, details struct<target_column:string,workflow_context_file:string,impact:string,mapping_basis:string,evidence:string>")
    m = source_target.collect_revision_inputs(candidates, values, gaps)["mappings"]
    blank = m.withColumn("branch_relation_name", F.lit("legacy")).withColumn("source_sql_relation_name", F.lit("")).withColumn("immediate_source_relation_name", F.lit(""))
    assert {r["mapping_id"]: r["t"] for r in blank.select("mapping_id", source_target.primary_template()["template"].alias("t")).collect()} == {"v0": "src.0", "v1": "src.1", "v2": "src.2", "v3": "", "v4": ""}


# ---- what must not grow


def test_fields_without_an_object_and_journeys_do_not_meet_in_one_task(spark, nodes_of):
    """fields of no object take no part in the join to objects; references carry no lists of parts."""
    nodes = spark.range(4000).select(F.lit("r").alias("repo_id"), F.concat(F.lit("v"), F.col("id")).alias("value_node_id"), F.lit("field").alias("node_kind"), F.concat(F.lit("a.b"), F.col("id") % 5).alias("display_ref")).repartition(8)
    refs = projection.semantic_refs(nodes)
    assert "parts" not in refs.columns and refs.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2000
    journeys = spark.range(400).select(F.concat(F.lit("j"), F.col("id")).alias("journey_id"), F.lit("r").alias("repo_id"), F.lit("resolved").alias("anchor_status"), F.lit("").alias("anchor_ref"))
    path = spark.range(4000).select(F.concat(F.lit("j"), F.col("id") % 400).alias("journey_id"), F.lit("p").alias("path_id"), F.col("id").alias("position"), F.concat(F.lit("v"), F.col("id")).alias("value_node_id"))
    assert projection.observed_refs(journeys, path, refs.checkpoint()).count() == 400


def test_a_climb_is_no_rounds_of_joins(spark, monkeypatch):
    """eight rungs take no more checkpoints than one; ties end the climb, and a journey without references keeps its entry."""
    shapes = ["f"]
    for i in range(8):
        shapes.append(f"n{i}.{shapes[-1]}")
    rows = [("a", s, s, i + 1, 0, s) for i, s in enumerate(shapes)] + [("b", "x.f", "x.f", 2, 0, "x.f"), ("b", "y.f", "y.f", 2, 0, "y.f"), ("b", "z.x.f", "z.x.f", 3, 0, "z.x.f")]
    refs = spark.createDataFrame(rows, "journey_id string, ref string, shape string, n int, preference int, ident string")
    front = spark.createDataFrame([(j, "f", "f", 1) for j in "abc"], "journey_id string, ref string, shape string, n int")
    made, real = [], type(refs).checkpoint
    monkeypatch.setattr(type(refs), "checkpoint", lambda self, *a: made.append(1) or real(self, *a))
    got = sorted((r["journey_id"], r["rung"], r["ref"]) for r in projection.climb(front, refs).collect())
    assert got == [("a", i, s) for i, s in enumerate(shapes)] + [("b", 0, "f"), ("c", 0, "f")] and len(made) == 1
