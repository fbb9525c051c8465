import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as t
from plumbline.operators import bridge, compare, fuzzy, graph, interaction, keys, model_lineage, ranking, reconstruct, replica, search, source_target, sqlfacts


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, t.clean(F.lit("\t a \n"))) == "a"
    assert one(spark, t.relation_leaf(F.lit('db."Big`Name`"'))) == "bigname"
    assert tuple(one(spark, t.relation_parts(F.lit("a.b.c")))) == ("a.b", "c")
    assert tuple(one(spark, t.relation_parts(F.lit("c")))) == ("", "c")
    assert one(spark, t.file_stem(F.lit("x/y/q.load.sql"))) == "q.load"
    assert one(spark, t.is_template(F.lit("%(a)"))) is False and one(spark, t.is_placeholder(F.lit("%(a)"))) is True


def test_closure_with_cycle(spark, rows):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    s = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.closure(e, s), "node", "hops") == [("a", 0), ("b", 1), ("c", 2)]


def test_closure_goes_on_as_far_as_there_is(spark, rows):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(40)], "src string, dst string")
    s = spark.createDataFrame([("n0",)], "node string")
    assert rows(graph.closure(e, s), "node", "hops") == sorted([(f"n{i}", i) for i in range(41)], key=str)
    assert graph.closure(e, s, 30).count() == 31


def test_paths_by_direction_and_confidence(spark):
    e = spark.createDataFrame([("a", "b", "confirmed"), ("b", "c", "candidate"), ("x", "b", None), ("y", "b", "probable")], "src string, dst string, confidence string")
    s = spark.createDataFrame([("b",)], "node string")
    go = lambda *a: {tuple(r["path"]) for r in graph.attribute_paths(e, s, *a).collect()}
    assert go("reverse") == {("b", "a"), ("b", "x"), ("b", "y")} and go("reverse", "confirmed") == {("b", "a"), ("b", "x")}
    assert go("forward") == set() and go("forward", "candidate") == {("b", "c")}
    with pytest.raises(ValueError):
        go("sideways")


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [0] * len(b) if not b else [0, *_step(row, x, b)]
    return row[-1]


def _step(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(out[-1], row[j + 1]))
    return out[1:]


def test_weighted_ratio():
    """Published figures of the metric, and the common subsequence against the table of it."""
    assert fuzzy.ratio("this is a test", "this is a test!") == pytest.approx(96.551724, abs=1e-5)
    assert fuzzy.partial_ratio("this is a test", "this is a test!") == 100
    assert fuzzy.token_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == fuzzy.token_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert fuzzy.weighted("this is a test", "this is a new test!!!") == pytest.approx(85.5)
    assert fuzzy.weighted("this is a word", "THIS IS A WORD") == pytest.approx(21.428571, abs=1e-5)
    assert fuzzy.weighted("", "a") == 0
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc d") for _ in range(rng.randrange(9))) for _ in range(2))
        assert fuzzy.common(a, b) == slow_common(a, b) == fuzzy.common(b, a)
        x, y = sorted((a, b), key=len)
        if x:
            every = [y[i:j] for i in range(len(y)) for j in range(i + 1, min(len(y), i + len(x)) + 1) if j - i == len(x) or i == 0 or j == len(y)]
            assert fuzzy.partial_ratio(a, b) >= max(fuzzy.ratio(x, s) for s in every) - 1e-9


def test_paths_are_simple_and_bounded(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "d"), ("b", "d")], "src string, dst string")
    s = spark.createDataFrame([("a",)], "node string")
    got = {tuple(r["path"]) for r in graph.paths(e, s).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "c", "d"), ("a", "b", "d")}
    assert all(r["truncated"] for r in graph.paths(e, s, max_branching=1).collect())


def test_page_tells_of_more(spark):
    df = spark.range(5)
    p = keys.page(df, ["id"], 2, 2).collect()
    assert [(r["id"], r["has_more"], r["next_offset"]) for r in p] == [(2, True, 4), (3, True, 4)]
    assert [(r["id"], r["has_more"]) for r in keys.page(df, ["id"], 4, 2).collect()] == [(4, False)]
    assert keys.page(df, ["id"], 9, 2).count() == 0


def test_conflicts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", None)], "k string, v int")
    assert [r["k"] for r in keys.conflicts(df, ["k"]).collect()] == ["b"]
    with pytest.raises(keys.ConflictError):
        keys.require_none(keys.conflicts(df, ["k"]), "no")


# ---- source to target

MAPPING = "workflow_target_logical_name string, target_column string, source_sql_column string, source_relation_role string, driver_relation_status string, driver_relation_name string, branch_relation_name string, source_sql_relation_name string, immediate_source_relation_name string, mapping_id string, workflow_context_file string, source_sql_file string"
DECISION = "semantic_key array<string>, status string, resolved_source_relation string, gap_ids array<string>"


def mapping(status="", driver="", branch="", role="driver_path", mid="m1", column="c", terminal="t.x"):
    return ("T", column, "s", role, status, driver, branch, terminal, "", mid, "ctx", "f.sql")


def collapse(spark, rows, decisions=()):
    return source_target.collapse_primary_sources(spark.createDataFrame(rows, MAPPING), spark.createDataFrame(list(decisions), DECISION)).collect()


@pytest.mark.parametrize(
    "row, status, relation, basis",
    [
        (mapping("resolved", "db.a", "stg.b"), "resolved", "db.a", "mechanically_observed_driver_primary_source"),
        (mapping("ambiguous", "db.a", "stg.b"), "unresolved", None, "unresolved_primary_source_template"),
        (mapping("", "", "stg.b"), "resolved", "stg.b", "mechanically_observed_branch_primary_source"),
        (mapping("", "", ""), "resolved", "t.x", "resolved_primary_source_identity"),
        (mapping("partial", "db.${env}", ""), "template", "db.${env}", "mechanically_observed_driver_primary_source_template"),
        (mapping("", "", "db.${env}"), "unresolved", None, "unresolved_primary_source_template"),
    ],
)
def test_primary_source(spark, row, status, relation, basis):
    (d,) = collapse(spark, [row])
    assert (d["status"], d["source_relation"], d["basis"]) == (status, relation, basis)


def test_environment_resolves_or_blocks(spark):
    key = ["T", "c", "db.${env}", "s"]
    row = mapping("", "", "db.${env}")
    assert collapse(spark, [row], [(key, "resolved", "db.prod", [])])[0]["source_relation"] == "db.prod"
    assert collapse(spark, [row], [(key, "resolved", "db.prod", []), (key, "resolved", "db.test", [])])[0]["status"] == "ambiguous"


def test_contexts_collapse_and_roles_filter(spark):
    got = collapse(spark, [mapping("resolved", "db.a", mid="m2"), mapping("resolved", "db.a", mid="m1"), mapping("resolved", "db.z", role="lookup")])
    assert len(got) == 1 and got[0]["mapping_ids"] == ["m1", "m2"]


def test_expression_fan_out(spark):
    d = source_target.collapse_primary_sources(spark.createDataFrame([mapping("resolved", "db.a")], MAPPING), spark.createDataFrame([], DECISION))
    e = spark.createDataFrame([("m1", "a+1", "arithmetic", "resolved"), ("m1", "b", "direct_column", "resolved"), ("m1", "c+1", "arithmetic", "open")], "mapping_id string, expression string, expression_kind string, resolution_status string")
    assert [r["expression"] for r in source_target.fan_out(d, e).collect()] == ["a+1"]
    assert [r["expression"] for r in source_target.fan_out(d, e.limit(0)).collect()] == [""]


def test_survivors_of_output_contracts(spark):
    rel = "array<struct<sql_relation_id:string,output_contract_status:string,output_columns:array<string>>>"
    c = spark.createDataFrame([("u", "ID", "ambiguous_unqualified", [("r1", "complete", ["x"]), ("r2", "complete", ["id"]), ("r3", "partial", ["x"]), ("r4", "", None)])], f"usage_id string, column_name string, resolution_basis string, scope_relations {rel}")
    r = source_target.usage_survivors(c).first()
    assert (r["survivors"], r["excluded"]) == (["r2", "r3", "r4"], ["r1"])


def test_targets(spark):
    s = "repo_id string, logical_target_name string, target_kind string, workflow_status string, workflow_contexts array<string>, input_ordinal int"
    rows = [("r", "T", "final", "", ["a"], 0), ("r", "t", "final", "", ["a"], 1), ("r", "I", "intermediate", "", ["a"], 2), ("r", "D", "final", "disabled", ["a"], 3), ("r", "O", "final", "", ["x/__off__/y"], 4), ("r", "P", "final", "", ["x/__off__/y", "z"], 5)]
    assert [r["logical_target_name"] for r in source_target.eligible_targets(spark.createDataFrame(rows, s)).orderBy("input_ordinal").collect()] == ["T", "P"]


def test_metadata_never_names_a_source(spark):
    rows = spark.range(1).select(*source_target.target_source_columns(F.lit("s.t"), F.lit("c"), F.lit("db.src"), F.lit("x"), F.lit("x+1")))
    meta = spark.createDataFrame([("t", "plat", "EVIL", 0), ("t", "later", "EVIL", 1)], "`T-trg` string, `T-trg-platform` string, `T-src` string, input_ordinal int")
    r = source_target.with_metadata(rows, meta, ["T-trg"]).first()
    assert (r["T-trg-platform"], r["T-src"], r["T-src-schema"], len(r)) == ("later", "src", "db", 26)


# ---- lineage, replica, bridge


def test_unique_object_and_paths(spark):
    o = spark.createDataFrame([("1", "m.Card", "Card"), ("2", "n.Card", "Card"), ("3", "m.Solo", "Solo")], "object_id string, fqcn string, name string")
    r = spark.createDataFrame([("card",), ("M.card",), ("solo",), ("none",)], "requested string")
    got = {x["requested"]: (x["candidate_count"], x["object_id"]) for x in model_lineage.resolve_objects(r, o).collect()}
    assert got == {"card": (2, None), "M.card": (1, "1"), "solo": (1, "3"), "none": (0, None)}
    b = spark.createDataFrame([("1", "Owner", "card"), ("1", "Owner", "card")], "object_id string, owner string, owner_field string")
    q = spark.createDataFrame([("1", "Card", "id"), ("3", "Solo", "id")], "object_id string, name string, field string")
    assert {x["source_attribute_path"] for x in model_lineage.attribute_paths(q, b).collect()} == {"Owner.card → Card.id", "Solo.id"}


def test_relation_path(spark):
    step = "array<struct<kind:string,materialization_id:string>>"
    k = "observed_relation_materialization"
    r = spark.createDataFrame([("l", "src.a", "id", "dm.final", "id", [(k, "m2"), ("other", "z"), (k, "m1"), (k, "gone")])], f"lineage_id string, terminal_relation string, terminal_column string, target_relation string, target_column string, branch_path {step}")
    m = spark.createDataFrame([("m1", "sql/stage.sql", "tmp.one"), ("m2", "sql/two.sql", "tmp.two")], "materialization_id string, query_file string, output_table_name string")
    x = model_lineage.relation_paths(r, m).first()
    assert x["missing"] == ["gone"]
    assert x["relation_path"].startswith("src.a.id → stage → tmp.one → two → tmp.two") and x["relation_path"].endswith("dm.final.id")


def test_annotation_arguments(spark):
    args = F.from_json(F.lit('[{"name":"id","raw":"\\"x\\"","literal_value":null},{"name":null,"raw":"Y","literal_value":"v"}]'), "array<struct<name:string,raw:string,literal_value:string>>")
    assert one(spark, replica.literal_argument(args, "id")) == "x"
    assert one(spark, replica.literal_argument(args, "value")) == "v"
    assert one(spark, replica.literal_argument(args, "code")) is None


def test_replica_model(spark, rows):
    types = spark.createDataFrame([("t1", "m.A", "A"), ("t2", "m.B", "B"), ("t3", "m.C", "C")], "type_id string, fqcn string, simple_name string")
    fields = spark.createDataFrame([("f1", "t1", "id", "Id", "long"), ("f2", "t1", "b", "", "B")], "field_id string, type_id string, name string, description string, declared_type string")
    effective = spark.createDataFrame([("t1", "id", "f1"), ("t1", "b", "f2")], "type_id string, field_name string, field_id string")
    rel = spark.createDataFrame([("t1", "t2", "f2", "association", "resolved"), ("t2", "t3", "f2", "association", "unresolved")], "source_type_id string, target_type_id string, field_id string, relationship_kind string, resolution_status string")
    ann = spark.createDataFrame([("t1", "MetaEntity", [("id", '"id"', "id")])], "type_id string, annotation_name string, arguments array<struct<name:string,raw:string,literal_value:string>>")
    ents = spark.createDataFrame([("e1", "m.A", "rep.a", "observed_exact"), ("e2", "m.B", "rep.b", "observed_exact"), ("e3", "m.C", "rep.c", "observed_exact")], "mapping_id string, logical_type_name string, physical_table_name string, mapping_status string")
    maps = spark.createDataFrame([("x1", "m.A", "e1", "id", "ID_", "observed_exact"), ("x2", "m.A", "e1", "b", "ID_", "observed_exact"), ("x3", "m.A", "e1", "ghost", "G", "observed_exact")], "mapping_id string, logical_type_name string, entity_mapping_id string, logical_field_name string, physical_column_name string, mapping_status string")
    roots = spark.createDataFrame([("a",)], "root string")
    m = replica.build_replica_model(types, fields, effective, rel, ann, ents, maps, roots)
    assert rows(m["tables"], "fqcn", "key_status", "key_gap") == [("m.A", "confirmed_declared_identity_mapped", ""), ("m.B", "gap", "ucp_identity_annotation_not_observed")]
    assert rows(m["fields"], "field", "mapping_status", "description_status", "gap") == [
        ("b", "ambiguous_multiple_ucp_fields", "ucp_description_not_published", "tsa_column_mapping_ambiguous"), ("ghost", "observed_exact", "ucp_field_not_found", "ucp_field_not_found"),
        ("id", "ambiguous_multiple_ucp_fields", "confirmed", "tsa_column_mapping_ambiguous")]
    assert rows(m["relationships"], "source_relation", "target_relation", "physical_join_status") == [("rep.a", "rep.b", "not_observed")]
    with pytest.raises(keys.ConflictError):
        replica.resolve_roots(spark.createDataFrame([("nope",)], "root string"), types)


def test_compose_never_promotes(spark):
    ev = spark.createDataFrame([("e1", "T", "f", "p.f", "root.a", ""), ("e2", "T", "f", "q.f", "root.b", ""), ("e3", "T", "f", "p.f", "", "kpk_consumer_attribute_not_observed"), ("e4", "T", "z", "p.z", "root.c", "")], "endpoint string, source_type string, source_field string, source_path string, egress_attribute string, egress_gap string")
    lin = spark.createDataFrame([("T", "f", "p.f", "confirmed", "", "dm.t", 0), ("T", "z", "p.z", "gap", "why", "", 1)], "source_type string, source_field string, source_path string, status string, gap string, target_relation string, input_ordinal int")
    got = {r["endpoint"]: (r["join_status"], r["gap"]) for r in bridge.compose(ev, lin).collect()}
    assert got == {
        "e1": ("confirmed_exact_ucp_semantic_path_and_kpk_egress", ""), "e2": ("context_ambiguous", 'right_context_not_exact:["p.f"]'),
        "e3": ("unresolved_kpk_egress", "kpk_consumer_attribute_not_observed"), "e4": ("unresolved_profile_lineage", "why")}


# ---- ranking, search, comparison


def test_package_and_response(spark):
    c = "array<struct<candidate_id:string,repository_id:string,supporting_interface_ids:array<string>>>"
    r = "array<struct<candidate_id:string,rank:int,supporting_interface_ids:array<string>>>"
    good = [("a", "r1", ["i1"]), ("b", "r2", ["i2"])]
    df = spark.createDataFrame([("h", "h", good, [("a", 1, ["i1"])]), ("h", "x", good[:1], [("a", 2, ["i2"])]), ("h", "h", good, [("z", 1, []), ("z", 1, [])])], f"content_hash string, package_hash string, candidates {c}, ranked {r}")
    got = [tuple(map(tuple, x)) for x in df.select(ranking.package_faults(), ranking.response_faults()).collect()]
    assert got == [((), ()), (("candidate_count", "hash"), ("foreign_evidence", "ranks")), ((), ("candidate_repeated", "ranks", "unknown_candidate"))]


def test_rerank_isolates_failures(spark):
    c = "array<struct<candidate_id:string,repository_id:string,supporting_interface_ids:array<string>>>"
    good = [("a", "r1", ["i1"]), ("b", "r2", ["i2"])]
    df = spark.createDataFrame([(k, k, good) for k in ("ok", "boom", "bad")], f"content_hash string, package_hash string, candidates {c}")

    def provider(body):
        k = json.loads(body)["package_hash"]
        if k == "boom":
            raise RuntimeError("down")
        return json.dumps({"ranked": [{"candidate_id": "a" if k == "ok" else "q", "rank": 1, "supporting_interface_ids": ["i1"]}]})

    out = ranking.rerank(df, provider, "ranked array<struct<candidate_id:string,rank:int,supporting_interface_ids:array<string>>>")
    assert {r["package_hash"]: r["status"] for r in out.collect()} == {"ok": "VALIDATED", "boom": "PROVIDER_ERROR", "bad": "INVALID_RESPONSE"}


def test_search_ranks_exact_first(spark):
    r = spark.createDataFrame([("t", "1", "Orders", "", "a.sql"), ("t", "2", "orders_hist", "", ""), ("t", "3", "x", "", "orders.sql"), ("t", "4", "ordres", "", "")], "record_kind string, record_id string, name string, parent string, file string")
    got = search.search(r, "orders", 3).collect()
    assert [(x["record_id"], x["match_kind"], x["truncated"]) for x in got] == [("1", "exact", True), ("2", "fts5", True), ("3", "fts5", True)]
    # too short for substrings; as a stretch of two names it scores 90
    assert [(x["record_id"], x["match_kind"], x["score"]) for x in search.search(r, "or", 9).collect()] == [("2", "fuzzy_candidate", 90.0), ("4", "fuzzy_candidate", 90.0)]
    assert search.search(r, "or", 9, fuzzy=False).count() == 0
    ref = one(spark, search.selection_ref(("b", F.lit("x")), ("a", F.lit(1))))
    import hashlib

    assert ref == hashlib.sha256(b'{"a": 1, "b": "x"}').hexdigest()


@pytest.mark.parametrize(
    "a, b, free, reasons",
    [
        ("1", "1.0", (), ["type"]), ("1", "true", (), ["type"]), ('{"a":null}', "{}", (), ["missing_field"]), ("{}", '{"a":1}', (), ["unexpected_field"]), ("[1,2]", "[1]", (), ["array_length"]),
        ("[1,2]", "[2,1]", (), ["value", "value"]), ('{"x":[1,2,2]}', '{"x":[2,1,2]}', ("/x",), []), ('{"x":[1,2,2]}', '{"x":[2,1,1]}', ("/x",), ["multiset"]), ('"a"', '"a"', (), []),
    ],
)
def test_differences(spark, a, b, free, reasons):
    pairs = spark.createDataFrame([("p", a, b)], "pair_id string, expected string, actual string")
    assert sorted(r["reason"] for r in compare.compare_documents(pairs, free).collect()) == reasons


def test_differences_are_told_once_and_in_place(spark):
    pairs = [
        ("nested", '{"a":{"b":[1,{"c":2}]}}', '{"a":{"b":[1,{"c":3,"d":4}]}}'), ("kinds", '{"a":{"0":1}}', '{"a":[1]}'), ("gone", '{"a":{"b":{"c":1}}}', "{}"), ("short", '[[1,2,3],{"x":1}]', '[[1]]'),
        ("escaped", '{"a/b":1,"c~d":2}', '{"a/b":2,"c~d":2}'), ("bad", '{"a":1,"a":1}', "{}"), ("null", "null", "{}"),
    ]
    got = {}
    for r in compare.compare_documents(spark.createDataFrame(pairs, "pair_id string, expected string, actual string")).collect():
        got.setdefault(r["pair_id"], set()).add((r["path"], r["reason"].split(":")[0]))
    assert got == {
        "nested": {("/a/b/1/c", "value"), ("/a/b/1/d", "unexpected_field")}, "kinds": {("/a", "type")}, "gone": {("/a", "missing_field")}, "short": {("", "array_length"), ("/0", "array_length")},
        "escaped": {("/a~1b", "value")}, "bad": {("", "invalid_json")}, "null": {("", "type")},
    }


def test_unordered_pointers_must_name_arrays(spark):
    pairs = spark.createDataFrame([("p", '{"x":[1]}', '{"x":1}'), ("q", '{"x":[1,2]}', '{"x":[2,1]}'), ("r", "{}", '{"x":[]}')], "pair_id string, expected string, actual string")
    assert {(r["pair_id"], r["reason"].split(":")[0]) for r in compare.compare_documents(pairs, ["/x"]).collect()} == {("p", "invalid_policy"), ("r", "invalid_policy")}
    with pytest.raises(ValueError):
        compare.compare_documents(pairs, ["/x", "/x/0"])


def test_pairs_that_repeat_an_id_or_lack_a_document(spark):
    pairs = spark.createDataFrame([("p", "[1]", "[2]"), ("p", "[1]", "[1]"), ("p", "{}", "[]"), (None, "1", "1.0"), ("n", None, "1"), ("m", "1", None)], "pair_id string, expected string, actual string")
    got = sorted((str(r["pair_id"]), r["path"], r["reason"].split(":")[0]) for r in compare.compare_documents(pairs).collect())
    assert got == [("None", "", "type"), ("m", "", "invalid_json"), ("n", "", "invalid_json"), ("p", "", "type"), ("p", "/0", "value")]
    assert compare.compare_documents(pairs.limit(0)).collect() == []


@pytest.mark.parametrize("bad", ['{"a":1,"a":2}', "NaN", "[Infinity]"])
def test_strict_json(bad):
    with pytest.raises(ValueError):
        compare.strict_json(bad)


# ---- collection of a revision's inputs


def revision(spark, refs, values=True, column="id"):
    expressions = [("id", "direct_column", "ID", "resolved"), ("upper(code)", "function", "", "resolved")]
    candidates = spark.createDataFrame([("r", "Target", "final", "", ["c"], "mart.target", "confirmed_unique", 1)], "repo_id string, logical_target_name string, target_kind string, workflow_status string, workflow_contexts array<string>, recommended_target_relation string, target_relation_recommendation_status string, input_ordinal int")
    rows = [("r", "target", column, 2, [("v1", refs), ("v2", [1])], expressions, 1)] if values else []
    sources = spark.createDataFrame(rows, "repo_id string, logical_target_name string, target_column string, source_count int, sources array<struct<mapping_id:string,refs:array<int>>>, expressions array<struct<expression:string,expression_kind:string,output_name:string,resolution_status:string>>, input_ordinal int")
    gaps = spark.createDataFrame([], "repo_id string, logical_target_name string, gap_id string, owner_id string, gap_kind string, severity string, message string, details struct<target_column:string,workflow_context_file:string,impact:string,mapping_basis:string,evidence:string>")
    return source_target.collect_revision_inputs(candidates, sources, gaps)


def test_revision_inputs_keep_all_sources_and_expressions(spark, rows):
    got = revision(spark, [0, 1, 0])
    assert {r["mapping_id"]: [e["expression"] for e in r["linked"]] for r in got["mappings"].collect()} == {"v1": ["id", "upper(code)"], "v2": ["upper(code)"]}
    assert rows(got["fields"]) == [("mart.target", "id")] and {r["what"]: r["n"] for r in got["counts"].collect()}["mapping_rows"] == 2


@pytest.mark.parametrize("refs, column", [([7], "id"), ([-1], "id"), ([0], "other"), ([None], "id")])
def test_wrong_expression_references_fail(spark, refs, column):
    with pytest.raises(keys.ConflictError):
        revision(spark, refs, column=column)


def test_targets_without_any_knowledge_fail(spark):
    with pytest.raises(keys.ConflictError, match="no target-column knowledge"):
        revision(spark, [], values=False)


def test_usage_refs_name_the_usage(spark):
    g = spark.createDataFrame([("g", "t", "c", "other", "", ["x"], "u1", "", "", "", ["r"])], "gap_id string, target_relation string, target_column string, gap_kind string, mapping_basis string, candidates array<string>, usage_id string, source_relation_name string, source_column string, evidence_text string, refs array<string>")
    env = spark.createDataFrame([], "target_relation string, target_column string, template string, source_column string")
    seen = spark.createDataFrame([("u1", ["a", "b"], ["z"])], "usage_id string, survivors array<string>, excluded array<string>")
    r = source_target.classify_gaps(g, env, seen).first()
    assert r["evidence_refs"] == ["candidate_relation_id:a", "candidate_relation_id:b", "excluded_relation_id:z", "r", "sql_column_usage_id:u1"] and r["candidate_ids"] == ["a", "b"]


# ---- SQL


def test_lineage_is_bound_by_position_and_branch(spark, rows):
    f = sqlfacts.extract(spark, [
        ("a.sql", "INSERT INTO t (x, y) SELECT a.id, b.id FROM p a JOIN q b ON a.k = b.k"), ("b.sql", "INSERT INTO t (x) SELECT a.id FROM p a UNION ALL SELECT b.id FROM q b"),
        ("c.sql", "INSERT INTO t (x) SELECT CONCAT(a.u, b.v) FROM p a JOIN q b ON a.k = b.k"), ("d.sql", "INSERT INTO t (x) SELECT a.id FROM p a EXCEPT SELECT b.id FROM q b"),
    ])
    got = rows(sqlfacts.direct_lineage(f), "query_id", "target_column", "source_relation", "source_column")
    assert got == [
        ("repo:q1", "x", "p", "id"), ("repo:q1", "y", "q", "id"), ("repo:q2", "x", "p", "id"), ("repo:q2", "x", "q", "id"), ("repo:q3", "x", "p", "u"), ("repo:q3", "x", "q", "v"), ("repo:q4", "x", "p", "id"),
    ]
    assert f["sql_projection"].where("query_id = 'repo:q3'").first()["expression"] == "CONCAT(a.u, b.v)"


def test_join_facts_follow_the_contract(spark):
    f = sqlfacts.extract(spark, [("a.sql", "SELECT a.x FROM a JOIN b ON b.id = a.id AND a.k < b.k AND a.z = 1"), ("b.sql", "SELECT a.x FROM a JOIN b USING (id) JOIN c USING (id)")])
    e = {(r["query_id"], r["join_ordinal"]): r for r in f["sql_join_edge"].collect()}
    first = e["repo:q1", 1]
    assert [(p["left_column"], p["right_column"], p["operator"], p["predicate_role"]) for p in first["column_pairs"]] == [("id", "id", "=", "equality_key"), ("k", "k", "<", "range_or_temporal")]
    assert first["additional_predicates"] == ["(a.z = 1)"] and first["status"] == "confirmed" and first["physical_join_confirmed"]
    third = e["repo:q2", 2]
    assert third["left_relation_id"] is None and third["reasons"] == ["using_left_relation_ambiguous"] and third["status"] == "partial"
    assert sqlfacts.join_edge_id("r", "q", "s", 1, None, "a = b", ["x", "y"]).startswith("sql_join_edge_r_")


def test_recursive_lineage(spark, rows):
    f = sqlfacts.extract(spark, [("a.sql", "INSERT INTO b (y) SELECT a.x FROM a"), ("b.sql", "INSERT INTO c (z) SELECT b.y FROM b")])
    assert rows(sqlfacts.recursive_lineage(sqlfacts.direct_lineage(f))) == [("b.y", "a.x", 1), ("c.z", "a.x", 2), ("c.z", "b.y", 1)]


def test_rebuilds_nested_queries(spark):
    make = spark.createDataFrame
    scopes = make([("q", "s1", 1, None, None), ("q", "s2", 1, "x > 1", None), ("q", "s3", 1, None, None), ("bad", "b1", 1, None, None)], "query_id string, node_id string, projection_count int, where_predicate string, distinct_clause string")
    proj = make([("q", "s1", 1, "d.x"), ("q", "s2", 1, "x"), ("q", "s3", 1, "y"), ("bad", "b1", 1, "x")], "query_id string, node_id string, projection_ordinal int, expression string")
    rel = make([("q", "s1", "r1", "derived", "", "d", "from", ["u"], "", ""), ("q", "s2", "r2", "physical", "t", "t", "from", [], "", ""), ("q", "s3", "r3", "physical", "w", "", "from", [], "", ""), ("bad", "b1", "r4", "physical", "t", "", "from", [], "", "")],
               "query_id string, node_id string, sql_relation_id string, relation_kind string, relation_name string, alias string, usage_role string, source_scope_ids array<string>, generator_expression string, generator_wrapper_alias string")
    joins = make([("bad", "b1", 1, "LEFT", "gone", "a = b", [])], "query_id string, node_id string, join_ordinal int, join_type string, right_relation_id string, predicate string, using_columns array<string>")
    ops = make([("q", "u", "union", False, "s2", "s3")], "query_id string, node_id string, operator string, distinct boolean, left_id string, right_id string")
    ctes = make([], "query_id string, cte_ordinal int, cte_name string, node_id string, column_aliases array<string>, recursive boolean")
    got = {r["query_id"]: r for r in reconstruct.render_queries(make([("q", "s1"), ("bad", "b1")], "query_id string, root_id string"), scopes, proj, rel, joins, ops, ctes).collect()}
    assert got["q"]["status"] == "restored" and "UNION ALL" in got["q"]["sql"] and "WHERE x > 1" in got["q"]["sql"]
    assert reconstruct.check_parse(spark, got["q"]["sql"]) is None
    assert got["bad"]["status"] == "unresolved" and got["bad"]["error"] == "join without its relation"


# ---- interaction


def test_boundary_and_route(spark):
    e = spark.createDataFrame([("e", "http", "get", "/api", "caller", "prov", [("http_method_path", "GET /api")]), ("self", "http", "GET", "/x", "a", "a", [])], "edge_id string, protocol string, method string, matched_identity string, source_repository_id string, target_repository_id string, basis array<struct<kind:string,value:string>>")
    h = spark.createDataFrame([("e", "caller", 0, "i1", "P", ["a.b"], ["zz"]), ("e", "prov", 1, "i2", "P", [], ["c"])], "edge_id string, repository_id string, position int, interface_id string, response_payload string, response_field_paths array<string>, response_field_names array<string>")
    f = interaction.boundary_fields(e, h, "response")
    got = f.orderBy("field_path").select("field_path", "source_repository", "source_payload", interaction.route_ref().alias("r")).collect()
    assert [tuple(x) for x in got] == [("a.b", "prov", "P", "boundary:rest:/api:response.a.b"), ("c", "prov", "P", "boundary:rest:/api:response.c")]


def test_ladder_stops_at_ties(spark):
    c = spark.createDataFrame([("j", "id", r) for r in ("card.id", "client.card.id", "x.client.card.id", "y.client.card.id")] + [("k", "id", "a[].id")], "journey_id string, leaf string, ref string")
    got = {r["journey_id"]: r["ladder"] for r in interaction.nesting_ladder(c).collect()}
    assert got == {"j": ["card.id", "client.card.id"], "k": ["a[].id"]}


def test_shape_fields_need_an_expandable_parent(spark, rows):
    shape = spark.createDataFrame([("items", True), ("items.id", False), ("other.id", False)], "raw_path string, is_collection boolean")
    parents = spark.createDataFrame([("items", True), ("other", False)], "field_path string, expandable boolean")
    assert rows(interaction.shape_fields(shape, parents), "path") == [("items[].id",)]


def test_readiness_and_labels(spark):
    cols = "repository_id string, bound boolean, server_ok boolean, revision_compatible boolean, revision_available boolean, tools_ok boolean, ambiguous boolean, external_boundary boolean, material_gap boolean"
    r = spark.createDataFrame([("a", True, True, True, True, True, False, False, False), ("b", True, True, True, True, False, False, False, False)], cols)
    got = interaction.readiness(r)
    assert {x["repository_id"]: x["readiness"] for x in got.collect()} == {"a": "ready", "b": "missing_required_tool"}
    assert interaction.readiness_status(got, True).first()["status"] == "not_ready"
    g = spark.createDataFrame([("e", "request", "f", "r", "source", "no such reason")], "edge_id string, role string, field_path string, repository_id string, side string, reason string")
    j = spark.createDataFrame([], "edge_id string, role string, field_path string")
    with pytest.raises(keys.ConflictError):
        interaction.human_rows(j, g)


def need(spark, *states):
    return spark.createDataFrame([(s, g) for s, g in states], "state string, preparation_group string")


@pytest.mark.parametrize("outcomes, budget, status", [
    ({}, None, "prepared"), ({"external:b": "no_progress"}, None, "no_progress"), ({"external:a": "awaiting_publication"}, None, "awaiting_publication"), ({}, 1, "budget_exhausted"), ({"external:a": "blocked"}, None, "blocked"),
    ({"external:a": "step_limit", "external:b": "step_limit"}, None, "step_limit"), ({"external:a": "idle"}, None, "no_progress"),
])
def test_preparation_goes_on_until_it_ends(spark, outcomes, budget, status):
    done = []

    def check():
        left = [g for g in ("a", "b") if f"external:{g}" not in done]
        return not left, need(spark, *[("needs_external_source", g) for g in left])

    def prepare(key):
        if key not in outcomes:
            done.append(key)
        return outcomes.get(key, "published")

    got = interaction.preparation_loop(check, prepare, budget)
    assert got["status"] == status and len(got["outcomes"]) <= (budget or 2)


def test_preparation_ends_before_it_begins(spark):
    fail = lambda key: pytest.fail("nothing is to be prepared")
    assert interaction.preparation_loop(lambda: (True, need(spark)), fail)["status"] == "already_prepared"
    for state in ("ambiguous", "external_source_owner_unresolved"):
        assert interaction.preparation_loop(lambda: (False, need(spark, (state, "a"), ("needs_external_source", "b"))), fail)["status"] == "blocked"
    assert interaction.preparation_loop(lambda: (False, need(spark)), fail)["status"] == "blocked"


def test_reversed_comparisons_keep_their_predicate(spark):
    """Columns are put left to right; operator and predicate stay as written, and the predicate is what counts."""
    f = sqlfacts.extract(spark, [("a.sql", "SELECT a.x FROM a JOIN b ON b.hi > a.lo")])
    pair = f["sql_join_edge"].first()["column_pairs"][0]
    assert (pair["left_column"], pair["right_column"], pair["operator"], pair["predicate"]) == ("lo", "hi", ">", "(b.hi > a.lo)")
    edges = f["sql_join_edge"]
    assert "expression_links" in sqlfacts.bulk_joins(edges).columns and "expression_links" not in sqlfacts.context_joins(edges).columns


def test_clean_takes_all_blanks_from_both_ends_only(spark):
    """trimmed without matching."""
    from pyspark.sql import functions as F

    from plumbline.functions import text

    blanks = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
    df = spark.createDataFrame([(f"{blanks}a{blanks}b{blanks}",), (blanks,), ("",), (None,), ("\u2003a\u2003",)], "t string")
    assert [r[0] for r in df.select(text.clean("t")).collect()] == [f"a{blanks}b", "", "", "", "\u2003a\u2003"]
    assert "regexp_replace" not in df.select(F.col("t"), text.clean("t"))._jdf.queryExecution().analyzed().toString()
