"""What must not grow with the product of two tables, nor wait for one key."""

import collections
import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import graph, interaction, keys, orchestration, projection, replica, source_target
from plumbline.plans import details, evidence, queries

SF = "/root/testdata/sf0.001"


def catalogue_nodes(spark, copies):
    transport = F.struct(*[F.lit(v).alias(k) for k, v in {"protocol": "http", "endpoint": "/x", "payload_role": "request", "interface_direction": "outbound", "http_method": "GET"}.items()])
    base = spark.range(copies).select(F.lit("r").alias("repo_id"), F.col("id").alias("value_node_id"), F.lit("op").alias("operation"), F.lit("v.a").alias("display_ref"), F.lit("o").alias("owner_ref"), F.lit("a").alias("wire_path"), transport.alias("transport"))
    return base.withColumn("node_kind", F.lit("field"))


def boundary(spark, n):
    """n fields that ask the same, and one without a payload."""
    f = spark.range(n).select(F.col("id").cast("string").alias("edge_id"), F.when(F.col("id") > 0, "P").alias("source_payload"))
    same = {"role": "request", "field_path": "a", "source_repository": "r", "target_repository": "r", "protocol": "http", "method": "get", "matched_identity": "/x"}
    return f.select("*", F.col("source_payload").alias("target_payload"), *[F.lit(v).alias(k) for k, v in same.items()])


def test_payload_nodes_meet_a_field_once(spark, monkeypatch):
    """of the nodes of one reference a field meets the least one, before any ranking."""
    nodes, ops = catalogue_nodes(spark, 500), spark.createDataFrame([("r", "P", "op", "v")] * 3, "repo_id string, payload string, operation string, symbol string")
    met = []
    real = interaction.min_per_signature
    monkeypatch.setattr(interaction, "min_per_signature", lambda rows, *a: met.append(rows.count()) or real(rows, *a))
    found = interaction.payload_scoped_nodes(boundary(spark, 20), nodes, ops, "source")
    assert [r["value_node_id"] for r in found.collect()] == [0] * 19 and met == [19]


def test_sides_are_decided_once_per_probe(spark, monkeypatch):
    """twenty fields that ask the same are one probe; a null payload is its own."""
    nodes, ops = catalogue_nodes(spark, 5), spark.createDataFrame([("r", "P", "op", "v")], "repo_id string, payload string, operation string, symbol string")
    complete, seen, real = spark.createDataFrame([("r", True)], "repo_id string, complete boolean"), [], interaction.source_fallback
    monkeypatch.setattr(interaction, "source_fallback", lambda f, *a: seen.append(f.count()) or real(f, *a))
    leaves = nodes.select(F.col("repo_id").alias("source_repository"), F.col("wire_path").alias("field_path"), "value_node_id")
    out = interaction.source_fallbacks(boundary(spark, 20), nodes, ops, leaves, nodes.select(F.col("value_node_id").alias("anchor_id"), F.array("wire_path").alias("visited")), complete)
    got = {(r["source_payload"], r["fallback"], r["anchor_id"]) for r in out.collect()}
    assert got == {("P", "payload_instance", 0), (None, "none", None)} and out.count() == 20 and seen == [2]


def test_targets_are_decided_once_per_probe(spark, monkeypatch):
    """the target side too."""
    nodes, ops = catalogue_nodes(spark, 5), spark.createDataFrame([("r", "P", "op", "v")], "repo_id string, payload string, operation string, symbol string")
    complete, seen, real = spark.createDataFrame([("r", True)], "repo_id string, complete boolean"), [], interaction.fallback_status
    monkeypatch.setattr(interaction, "fallback_status", lambda f, *a: seen.append(f.count()) or real(f, *a))
    out = interaction.target_fallbacks(boundary(spark, 20), nodes, ops, complete)
    assert {(r["target_payload"], r["anchor_id"], r["anchor_status"]) for r in out.collect()} == {("P", 0, "resolved"), (None, None, "terminal")} and out.count() == 20 and seen == [2]


def test_survivors_are_found_once_per_scope_and_column(spark):
    """a scope's relations are rows, not a list in every usage; the answers are those of the usages one by one."""
    scopes = spark.createDataFrame(
        [(1, "r1", "complete", ["x"]), (1, "r2", " complete ", ["id"]), (1, "r3", "partial", ["x"]), (1, "r4", None, None), (1, "r5", "complete", None), (1, "r2", "complete", ["x"]), (2, "r6", "complete", ["x"])],
        "scope_id int, sql_relation_id string, output_contract_status string, output_columns array<string>")
    asked = spark.createDataFrame([(1, "ID"), (1, "x"), (2, "id"), (3, "id")], "scope_id int, column_name string")
    got = {(r["scope_id"], r["column_name"]): (r["survivors"], r["excluded"]) for r in source_target.column_survivors(asked, scopes).collect()}
    lists = scopes.groupBy("scope_id").agg(F.collect_list(F.struct("sql_relation_id", "output_contract_status", "output_columns")).alias("scope_relations"))
    one = source_target.usage_survivors(asked.join(lists, "scope_id").select(F.struct("scope_id", "column_name").alias("usage_id"), "column_name", F.lit("ambiguous_unqualified").alias("resolution_basis"), "scope_relations"))
    want = {tuple(r["usage_id"]): (r["survivors"], r["excluded"]) for r in one.collect()}
    assert got == want | {(3, "id"): ([], [])} and got[1, "ID"] == (["r2", "r3", "r4"], ["r1", "r2", "r5"])


def test_children_of_one_reference_are_made_by_several_tasks(spark):
    """the pairs of one popular reference are not one task's."""
    nodes = spark.range(6000).select(F.lit("field").alias("node_kind"), F.lit("op").alias("operation"), F.concat(F.lit("a.b"), F.col("id")).alias("display_ref"), F.col("id").alias("value_node_id"))
    anchors = spark.createDataFrame([(1, "op", "a"), (2, "op", "a"), (3, "op", "none"), (4, None, "a")], "anchor_id int, operation string, display_ref string")
    out = interaction.child_expansion(anchors, nodes)
    got = [tuple(r) for r in out.select("anchor_id", "value_node_id", "field").collect()]
    assert sorted(got) == sorted((a, i, f"b{i}") for a in (1, 2) for i in range(6000))
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_anchors_are_sent_to_children_in_lists(spark, monkeypatch):
    """F1 of round 4: what is dealt to a reference's blocks are lists of anchors, not a row for each; equal, null and lone ones all stay."""
    sent, real = [], interaction.dealt
    monkeypatch.setattr(interaction, "dealt", lambda df, *k: sent.append(df.count()) or real(df, *k))
    refs = [("a.x", 1), ("a.y", 2), ("a\nb.x", 3), ("a.y\n", 4), ("a.", 5), ("a", 6), (".x", 7), ("a.b.x", 8), (None, 9)]
    nodes = spark.createDataFrame([("field", "op", *r) for r in refs] + [("wire", "op", "a.z", 10), ("field", None, "a.z", 11)], "node_kind string, operation string, display_ref string, value_node_id int")
    many = spark.range(3000).select(F.when(F.col("id") > 0, F.lit(1)).alias("anchor_id"), F.lit("op").alias("operation"), F.lit("a").alias("display_ref"))
    few = spark.createDataFrame([(2, "op", ""), (3, "op", "a.b"), (4, "op", "a\nb"), (5, None, "a"), (6, "op", None), (7, "op", "none")], "anchor_id int, operation string, display_ref string")
    out = interaction.child_expansion(many.union(few), nodes)
    assert out.columns == ["operation", "display_ref", "anchor_id", "field", "value_node_id"] and max(sent) < 100
    got = collections.Counter(tuple(r)[2:] for r in out.collect())
    assert got == {(a, f, i): n for f, i in (("x", 1), ("y", 2), ("y\n", 4)) for a, n in ((1, 2999), (None, 1))} | {(2, "x", 7): 1, (3, "x", 8): 1}
    assert interaction.child_expansion(few.drop("anchor_id"), nodes).count() == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_what_a_task_holds_of_the_lines_is_bounded(spark, monkeypatch):
    """Producers are aggregated in parts of a bounded number of lines, however many the table has."""
    monkeypatch.setattr(keys, "DEALT_ROWS", 100)
    p = queries.producers(spark, SF)
    assert p.rdd.getNumPartitions() >= 60
    lines = queries.table(spark, SF, "lineitem").withColumn("p", F.spark_partition_id())
    assert keys.dealt(lines, "l_partkey", rows=lines.count()).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 400


def test_anchors_are_resolved_once_per_probe(spark, monkeypatch):
    """attempts that ask the same are resolved once, and each gets the answer."""
    f = boundary(spark, 20).select("*", F.lit("v.a").alias("ref"), F.lit(1).alias("attempt"), F.lit("wire").alias("strategy"), F.array(F.lit("o")).alias("source_interfaces"))
    nodes, seen, real = catalogue_nodes(spark, 1), [], interaction.resolve_anchors
    want = sorted((r["edge_id"], r["candidate_count"], r["basis"], r["anchor_id"], r["anchor_status"]) for r in real(f, nodes, "source").collect())
    monkeypatch.setattr(interaction, "resolve_anchors", lambda a, *rest: seen.append(a.count()) or real(a, *rest))
    got = interaction.resolve_anchor_probes(f, nodes, "source").select("edge_id", "candidate_count", "basis", "anchor_id", "anchor_status")
    assert sorted(tuple(r) for r in got.collect()) == want and seen == [2]


def test_reached_types_pass_no_rounds_through_the_driver(spark, monkeypatch):
    """no round broadcasts what it found or knows."""
    types = spark.range(40).select(F.concat(F.lit("t"), F.col("id")).alias("type_id"), F.concat(F.lit("t"), F.col("id")).alias("fqcn"), F.lit("").alias("simple_name"))
    relations = spark.range(1, 40).select(F.concat(F.lit("t"), F.floor(F.col("id") / 2)).alias("source_type_id"), F.concat(F.lit("t"), F.col("id")).alias("target_type_id"), F.when(F.col("id") % 8 == 7, "ambiguous").otherwise("resolved").alias("resolution_status"))
    plans, real = [], type(types).checkpoint

    def seen(self, *a):
        out = real(self, *a)
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(type(types), "checkpoint", seen)
    got = {r["type_id"] for r in replica.selected_types(types, relations, spark.createDataFrame([("t1",)], "root string")).collect()}
    want, front = {1}, {1}
    while front:
        front = {i for i in range(1, 40) if i // 2 in front and i % 8 != 7} - want
        want |= front
    assert got == {f"t{i}" for i in want}
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans[2:])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_what_a_task_holds_of_flow_entities_is_bounded(spark, monkeypatch):
    """producers are ranked in parts of a bounded number of published rows."""
    monkeypatch.setattr(keys, "DEALT_ROWS", 100)
    parts, real = [], orchestration.select_producers
    monkeypatch.setattr(orchestration, "select_producers", lambda p: parts.append(p.rdd.getNumPartitions()) or real(p))
    assert details.topology_counts(spark, SF).count() == 4 and parts[0] >= 50


@pytest.mark.parametrize("few", [500_000, 0])
def test_shortest_ways_run_no_round_without_edges(spark, monkeypatch, few):
    """starts are not sought again in a first round, nor all that was found in a last one that no edge serves; all ways are found,
    in circles too, whether targets are few or many."""
    monkeypatch.setattr(graph, "FEW_TARGETS", few)
    fronts, real = [], type(spark.range(1)).checkpoint

    def seen(self, *a):
        out = real(self, *a)
        fronts.extend([out.count()] if "path_count" in out.columns else [])
        return out

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", seen)
    run = lambda edges, starts: {(r["start"], r["end"]): (r["hops"], r["path_count"], r["path"]) for r in graph.shortest_paths(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(s,) for s in starts], "node string")).collect()}
    star = [(f"o{i}", f"s{j}") for i in range(10) for j in range(3)] + [(f"s{j}", f"n{j % 2}") for j in range(3)]
    assert len(run(star, [f"o{i}" for i in range(10)])) == 50 and fronts == [20] + [0] * (few == 0)

    pick = random.Random(4)
    edges = sorted({(f"n{pick.randrange(12)}", f"n{pick.randrange(12)}") for _ in range(26)})
    want = {}
    for s in ("n0", "n5"):
        level, hop, near = {s: [[s]]}, 0, {s}
        while level:
            hop, grown = hop + 1, {}
            for node, ways in level.items():
                for a, b in edges:
                    if a == node and b not in near:
                        grown.setdefault(b, []).extend([*w, b] for w in ways)
            want |= {(s, b): (hop, len(ways), min(ways, key=lambda w: "".join(f"{x}>" for x in w[:-1]))) for b, ways in grown.items()}
            level, near = grown, near | set(grown)
    assert run(edges, ["n0", "n5"]) == want


def test_source_chains_walk_only_from_what_journeys_ask(spark, monkeypatch):
    """F16: what flows into an anchor from nodes that no journey asks for is not walked; depths tie by their local nodes."""
    found, real = [], projection.shortest_paths
    monkeypatch.setattr(projection, "shortest_paths", lambda *a: found.append(real(*a)) or found[-1])
    flows = spark.createDataFrame([(f"l{i}", f"m{i}") for i in range(50)] + [(f"m{i}", a) for i in range(50) for a in ("a", "b")], "src string, dst string")
    nodes = spark.createDataFrame([("l3", "field", "L3"), ("m3", "derivation", "L3"), ("a", "wire_field", "A"), ("a", "wire_field", "A")], "value_node_id string, node_kind string, display_ref string")
    journeys = spark.createDataFrame([("j", "a"), ("k", "a"), ("n", "b")], "journey_id string, anchor_id string")
    segments = spark.createDataFrame([("j", 2, "l3"), ("j", 1, "l4"), ("j", 2, "l3"), ("j", None, "l9"), ("k", 2, "l3"), ("k", 2, "l4"), ("n", None, "l7"), ("n", None, "")], "journey_id string, depth int, local_id string")
    got = [tuple(r) for r in projection.source_projection(journeys, segments, nodes, flows).collect()]
    assert got == [("j", "l3", ["L3", "A"])] and found[0].count() == 6


def test_journeys_walk_in_their_rows_as_in_rounds(spark):
    """F2 of round 4: a journey's own small graph gives in its row what rounds of joins give."""
    pick, graphs = random.Random(5), []
    for j in range(400):
        ids = [f"{j}-{i}" for i in range(7)]
        flows = [(pick.choice(ids), pick.choice(ids)) for _ in range(pick.randrange(12))] + [(None, ids[0]), (ids[1], None)]
        nodes = [(f" {v} ", pick.choice(["field", "wire_field", "literal"]), pick.choice(["a", " b ", "", None])) for v in ids for _ in range(pick.randrange(1, 3))]
        graphs.append((j, ids[0], ids[pick.randrange(3)], flows + flows[:2], nodes))
    of = "journey_id int, anchor_id string, local_id string, flows array<struct<src: string, dst: string>>, nodes array<struct<value_node_id: string, node_kind: string, display_ref: string>>"
    g = spark.createDataFrame([*graphs, (400, None, "x", [("x", "y")], []), (401, "y", None, [("x", "y")], []), (402, "y", "x", [], [])], of)
    got = sorted(tuple(r) for r in projection.source_projection_in_rows(g).collect())
    rounds = projection.source_projection(g.select("journey_id", "anchor_id"), g.select("journey_id", F.lit(1).alias("depth"), "local_id"), g.select(F.inline("nodes")), g.select(F.inline("flows")))
    assert got == sorted(tuple(r) for r in rounds.collect()) and len(got) > 3


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_orders_with_few_lines_take_no_rounds(spark, monkeypatch):
    """F2 of round 4: lines are sent once and nothing is staged for a round; orders with many lines still take rounds, with the same rows."""
    rounds, real = [], projection.shortest_paths
    monkeypatch.setattr(projection, "shortest_paths", lambda *a: rounds.append(1) or real(*a))
    want = sorted(tuple(r) for r in evidence.source_chains(spark, SF).collect())
    assert want and not rounds
    monkeypatch.setattr(evidence, "ROW_LINES", 4)
    assert sorted(tuple(r) for r in evidence.source_chains(spark, SF).collect()) == want and rounds


def test_origins_are_sought_for_journeys_that_can_be_covered(spark, monkeypatch):
    """a journey with a terminal that nothing can cover meets no fields, and no row is repeated for a field's origins before the end."""
    gaps = spark.createDataFrame([("j", "t1", "T", "a", ["a"]), ("j", "t2", "T", "a", ["zz", "a"]), ("k", "t3", "T", "a", ["a"]), ("k", "t4", "T", "a", ["a", "a"]), ("k", "", "U", "a", ["a"])], "journey_id string, terminal_id string, parent_type string, property string, relative array<string>")
    scopes = spark.createDataFrame([("j", "r"), ("k", "r"), ("k", "none")], "journey_id string, repo_id string")
    op = F.concat(F.lit("op"), F.col("id"))
    base = spark.range(5).select(F.lit("r").alias("repo_id"), op.alias("operation"), "id")
    fields = base.select("repo_id", "operation", F.concat(F.lit("v"), "id").alias("value_node_id"), F.lit("field").alias("node_kind"), F.lit("o.a").alias("display_ref"), F.lit("a").alias("property_name"))
    owners = base.select("repo_id", "operation", F.lit("local_value").alias("node_kind"), F.lit("o").alias("display_ref"), F.lit("o").alias("symbol"), F.lit("local_variable").alias("occurrence_kind"), F.lit("T").alias("declared_type"))
    paths = spark.range(5).select(F.concat(F.lit("v"), "id").alias("value_node_id"), F.lit(1).alias("hop_count"), F.lit("confirmed").alias("confidence"), F.explode(F.array(*map(F.lit, "xyz"))).alias("end_id"), F.lit("field").alias("end_kind"))
    met, real = [], type(gaps).checkpoint

    def seen(self, *a):
        out = real(self, *a)
        met.extend([out.count()] if {"journey_id", "value_node_id"} <= set(out.columns) else [])
        return out

    monkeypatch.setattr(type(gaps), "checkpoint", seen)
    found = projection.external_segments(gaps, scopes, fields.unionByName(owners, allowMissingColumns=True), paths)
    got = [(r["journey_id"], r["terminal_id"], r["value_node_id"], r["origin_id"]) for r in found.collect()]
    assert sorted(got) == sorted(("k", t, f"v{i}", x) for t in ("t3", "t4") for i in range(5) for x in "xyz")
    assert max(met) == 10


def test_rows_read_mappings_no_more_once_they_are_staged(spark):
    """decisions and what rows need of a mapping are made once; every part of the build reads those."""
    texts = {"workflow_target_logical_name": "mart.t", "source_sql_column": "s", "immediate_source_column": "", "source_relation_role": "driver_path", "driver_relation_status": "resolved", "driver_relation_name": "db.r", "branch_relation_name": "", "source_sql_relation_name": "", "immediate_source_relation_name": "", "workflow_context_file": "", "source_sql_file": ""}
    e = lambda text, kind, status: F.struct(F.lit(text).alias("expression"), F.lit(kind).alias("expression_kind"), F.lit("").alias("output_name"), F.lit(status).alias("resolution_status"))
    linked = F.array(e("f(s)", "function", ""), e("g(s)", "function", "partial"), e("s", "direct_column", "resolved"), e("h(s)", " ", "resolved"))
    mappings = spark.range(6).select(F.concat(F.lit("m"), "id").alias("mapping_id"), F.concat(F.lit("c"), F.col("id") % 2).alias("target_column"), F.when(F.col("id") < 2, linked).alias("linked"), *[F.lit(v).alias(c) for c, v in texts.items()])
    env = spark.createDataFrame([], "semantic_key array<string>, status string, resolved_source_relation string, gap_ids array<string>")
    fields = spark.createDataFrame([("mart.t", "only", 1)], "target_relation string, target_column string, input_ordinal int")
    gaps = spark.createDataFrame([], "gap_id string, target_relation string, target_column string, gap_kind string, mapping_basis string, candidates array<string>, usage_id string, source_relation_name string, source_column string, evidence_text string, refs array<string>")
    rows = source_target.build(mappings, env, fields, gaps, spark.createDataFrame([], "usage_id string, survivors array<string>, excluded array<string>"))["rows"]
    assert sorted((r["T-trg-f"], r["T-src-f-name"], r["T-src-f"], len(r["mapping_ids"])) for r in rows.collect()) == [("c0", "s", "f(s)", 3), ("c1", "s", "f(s)", 3), ("only", "", "", 0)]
    assert "Range (" not in rows._jdf.queryExecution().executedPlan().toString()
