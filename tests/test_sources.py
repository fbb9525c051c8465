import pytest
from pyspark.sql import functions as F

from plumbline.sources import published, records, sinks
from plumbline.streaming import incremental


def test_pages_are_complete_or_fail(spark):
    items = [(i,) for i in range(7)]
    spark.dataSource.register(records.paged_source("pages_ok", lambda o, n: {"total": 7, "items": [(i,) for i in range(7)][o : o + n]}, "id int", 3))
    assert sorted(r["id"] for r in spark.read.format("pages_ok").load().collect()) == [i for (i,) in items]
    spark.dataSource.register(records.paged_source("pages_short", lambda o, n: {"total": 7, "items": [(1,)]}, "id int", 3))
    with pytest.raises(Exception, match="items, not"):
        spark.read.format("pages_short").load().collect()


def test_revisions_are_pinned():
    for bad in ("latest", "active", " "):
        with pytest.raises(ValueError):
            records.check_pin("s", bad)


def test_revision_scan_prunes_and_counts(spark, tmp_path):
    df = spark.createDataFrame([("s", "r1", 1), ("s", "r2", 2)], "system_id string, revision_id string, x int")
    df.write.parquet(str(tmp_path / "k.parquet"))
    t = records.load_revision(spark, str(tmp_path), "s", "r1", {"k": "system_id string, revision_id string, x int"})
    assert [r["x"] for r in t["k"].collect()] == [1]
    records.check_counts(t, {"k": 1})
    with pytest.raises(ValueError):
        records.check_counts(t, {"k": 2})


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿left_status,endpoint_key\nexact_field,A.b\nother,A.c\nconfirmed,\n', encoding="utf-8")
    assert [r["endpoint_key"] for r in records.crossing_evidence(spark, str(tmp_path / "a.csv")).collect()] == ["A.b"]
    (tmp_path / "b.csv").write_text("﻿interaction;role\nx,y;response\n", encoding="utf-8")
    assert tuple(records.interaction_rows(spark, str(tmp_path / "b.csv")).first()) == ("x,y", "response")


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([("b", ["x", "y"], 'say "hi", you'), ("a", [], None)], "k string, xs array<string>, t string")
    sinks.write_csv(df, str(tmp_path / "o"), ["k", "xs", "t", "gone"], [F.col("k")], bom=True, second_row=["1", "2", "3", "4"])
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "o").glob("part-*"))
    assert text == '﻿k,xs,t,gone\n1,2,3,4\na,,,\nb,x;y,"say ""hi"", you",\n'


def test_new_keys_only(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert published.write_new_keys(df, path, ["k"]) == 2
    assert published.write_new_keys(df.union(spark.createDataFrame([("c", 3)], "k string, v int")), path, ["k"]) == 1
    with pytest.raises(ValueError):
        published.write_new_keys(spark.createDataFrame([("a", 9)], "k string, v int"), path, ["k"])


def test_graphs(spark):
    e = spark.createDataFrame([("A", "r", "p", "B", "r", "c", True), ("A", "r", "p", "B", "r", "c", True), ("A", "r", "q", "B", "r", "c", False)], "producer_system string, producer_revision string, producer_flow_id string, consumer_system string, consumer_revision string, consumer_flow_id string, stat_supported boolean")
    text = sinks.graph_text(sinks.dependency_graph(e))
    assert text.count("-->") == 1 and text.count("-.->") == 1 and text.startswith("flowchart LR\n")


def test_remote_batches(spark):
    c = "a" * 40
    s = "status string, repository_id string, repository_url string, resolved_commit string"
    ok = spark.createDataFrame([("completed", "r", "https://g/x", c), ("reused", "r", "https://g/x", c), ("failed", "q", "", "")], s)
    assert records.remote_batches(ok).count() == 1
    for bad in ([("completed", "r", "https://u@g/x", c)], [("completed", "r", "https://g/x", "abc")], [("completed", "r", "https://g/x", c), ("reused", "r", "https://g/y", c)]):
        with pytest.raises(ValueError):
            records.remote_batches(spark.createDataFrame(bad, s))


def test_stream_keeps_one_result_per_key(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int").write.parquet(src)
    for _ in range(2):
        incremental.apply_per_batch(incremental.read_facts(spark, src, "k string, v int"), lambda df: df.select("k", (F.col("v") * 2).alias("w")), out, ["k"], str(tmp_path / "ck")).awaitTermination(120)
    assert {(r["k"], r["w"]) for r in published.read(spark, out).collect()} == {("a", 2), ("b", 4)}


def test_reads_are_kept_under_their_identity_and_never_failures(spark):
    cache, calls = records.ReadCache(), []

    def get(n):
        calls.append(n)
        if n < 0:
            raise ValueError("unavailable")
        return spark.range(n)

    for _ in range(2):
        assert cache.read("nodes", ("s", "r1"), lambda: get(3)).count() == 3
        with pytest.raises(ValueError):
            cache.read("nodes", ("s", "r2"), lambda: get(-1))
    assert cache.read("paths", ("s", "r1"), lambda: get(4)).count() == 4
    assert calls == [3, -1, -1, 4] and cache.hits == 1
    cache.close()
    assert not cache.kept


def test_page_size_of_candidates_is_a_parameter(spark):
    sizes = []

    def fetch(offset, limit):
        sizes.append(limit)
        return {"total": 5, "items": [(i,) for i in range(5)][offset : offset + limit]}

    reader = records.PagedReader(fetch, 2)
    assert [p.offset for p in reader.partitions()] == [0, 2, 4]
    assert [x for p in reader.partitions() for x in reader.read(p)] == [(i,) for i in range(5)]


def test_json_documents(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"k": "a", "v": 1}')
    (tmp_path / "list.json").write_text('[{"k": "a", "v": 1}, {"k": "b", "v": 2}]')
    (tmp_path / "envelope.json").write_text('{"items": [{"k": "c", "v": 3}]}')
    read = lambda name, *a: sorted(map(tuple, records.read_documents(spark, str(tmp_path / name), *a).collect()))
    assert read("one.json", "k string, v int") == [("a", 1)] and read("list.json", "k string, v int") == [("a", 1), ("b", 2)]
    assert read("envelope.json", "k string, v int", "items") == [("c", 3)] or read("envelope.json", "k:string,v:int", "items") == [("c", 3)]


def test_rows_are_ordered_by_six_columns_first(spark, tmp_path):
    from plumbline.operators.source_target import ROW_COLUMNS

    row = lambda **v: tuple(v.get(c.replace("-", "_"), "") for c in ROW_COLUMNS)
    rows = [row(T_trg_schema="b", T_trg="a", T_trg_platform="1"), row(T_trg_schema="a", T_trg="z", T_trg_platform="2")]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in ROW_COLUMNS))
    sinks.write_rows(df, str(tmp_path / "o"), ["d"] * len(ROW_COLUMNS))
    lines = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "o").glob("part-*")).splitlines()
    assert lines[0] == ",".join(ROW_COLUMNS) and lines[1] == ",".join(["d"] * len(ROW_COLUMNS)) and [x[0] for x in lines[2:]] == ["2", "1"]
    with pytest.raises(ValueError):
        sinks.write_rows(df, str(tmp_path / "p"), ["d"])


def test_replica_reports(spark, tmp_path):
    t = spark.createDataFrame([("rep.a", "A", "MetaEntity", "entity_id", "id", "id_col", "confirmed_declared_identity_mapped", ""), ("rep.b", "B", "", "", "", "", "gap", "none")], "replica_relation string, fqcn string, key_annotation string, key_kind string, key_logical_field string, key_replica_column string, key_status string, key_gap string")
    f = spark.createDataFrame([], "replica_relation string, replica_column string, fqcn string, field string, field_type string, field_description string, description_status string, mapping_status string, gap string")
    r = spark.createDataFrame([("rep.a", "parent", "reference", "rep.b", "", "confirmed_ucp_relationship_projected_to_replicas", "not_observed", "x")], "source_relation string, relationship_field string, relationship_kind string, target_relation string, target_key string, status string, physical_join_status string, gap string")
    sinks.write_replica_model({"tables": t, "fields": f, "relationships": r}, str(tmp_path))
    read = lambda n: "".join(p.read_text() for p in (tmp_path / n).glob("part-*")).splitlines()
    assert read("keys") == ["table,logical_pk,key_kind,logical_pk_status,physical_pk_status,gap", "rep.a,id_col,entity_id,confirmed,not_observed,", "rep.b,,,gap,not_observed,none"]
    assert read("links")[1] == "rep.a,parent,rep.b,,confirmed,not_observed" and len(read("fields")) == 1


def test_audit_and_progress(spark):
    import json

    gaps = spark.createDataFrame([("A",), ("A",), ("B",)], "gap_type string")
    assert json.loads(sinks.audit(gaps, spark.range(4), {"pages": 2})) == {"row_count": 4, "gap_count": 3, "gaps_by_type": {"A": 2, "B": 1}, "retrieval": {"pages": 2}}
    assert json.loads(sinks.progress_line("done", n=1)) == {"event": "done", "n": 1}


def test_replica_graph_and_sql_files(spark, tmp_path):
    r = spark.createDataFrame([("a", "b", "f"), ("a", "b", "f")], "source_relation string, target_relation string, relationship_field string")
    assert sinks.graph_text(sinks.replica_graph(r)).count("-->|f|") == 1
    q = spark.createDataFrame([("q1", "SELECT 1", "restored"), ("q2", None, "unresolved")], "query_id string, sql string, status string")
    sinks.write_sql_files(q, str(tmp_path / "s"))
    found = {p.parent.name: p.read_text() for p in (tmp_path / "s").glob("*/part-*")}
    assert found == {"query_id=q1": "SELECT 1\n"}


def test_two_writers_store_no_key_twice(spark, tmp_path, monkeypatch):
    """The second writer publishes between the first one's reading and its publishing."""
    path = str(tmp_path / "r")
    make = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    create, raced = published.Files.create, []

    def late(self, version, body):
        if not raced:
            raced.append(1)
            published.write_new_keys(make(("a", 1), ("b", 2)), path, ["k"])
        return create(self, version, body)

    monkeypatch.setattr(published.Files, "create", late)
    assert published.write_new_keys(make(("b", 2), ("c", 3), ("c", 3)), path, ["k"]) == 1
    assert sorted(map(tuple, published.read(spark, path).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    assert len(list((tmp_path / "r" / "data").iterdir())) == 2
    raced.clear()
    with pytest.raises(ValueError, match="differs"):
        published.write_new_keys(make(("b", 9)), path, ["k"])
    with pytest.raises(ValueError, match="under one key"):
        published.write_new_keys(make(("z", 1), ("z", 2)), path, ["k"])
    assert published.read(spark, path).count() == 3


def test_a_killed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    bad = spark.range(100).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(1).cast("int").alias("v"))
    with pytest.raises(Exception, match="lost"):
        published.write_new_keys(bad, path, ["k"])
    with pytest.raises(ValueError, match="nothing is published"):
        published.read(spark, path)
    assert published.write_new_keys(bad.where("k <> '77'"), path, ["k"]) == 99


def test_stored_results_are_resumed_or_refused(spark, tmp_path):
    path = str(tmp_path / "r")
    packages = spark.createDataFrame([("h1", "c1"), ("h2", "c2")], "package_hash string, case_id string")
    ask = lambda p=packages: [r["package_hash"] for r in published.pending(p, path, "package_hash", ["case_id"], ["ranked", "abstained"]).collect()]
    assert ask() == ["h1", "h2"]
    results = "package_hash string, case_id string, status string"
    published.write_new_keys(spark.createDataFrame([("h1", "c1", "ranked")], results), path, ["package_hash"])
    assert ask() == ["h2"]
    manifest = published.batch_manifest(spark.createDataFrame([("h1", "c1", "ranked"), ("h2", "c2", "abstained")], results), 1).first()
    assert tuple(manifest) == (2, 1, 1, {"abstained": 1, "ranked": 1})
    with pytest.raises(ValueError, match="match case_id"):
        ask(spark.createDataFrame([("h1", "other")], packages.schema))
    published.write_new_keys(spark.createDataFrame([("h2", "c2", "started")], results), path, ["package_hash"])
    with pytest.raises(ValueError, match="not terminal"):
        ask()


def test_a_query_that_fails_now_loses_its_statement(spark, tmp_path):
    path, s = str(tmp_path / "q"), "query_id string, sql string, status string"
    first = published.publish_sql(spark.createDataFrame([("q1", "SELECT 'é'", "restored"), ("q2", "SELECT 2", "restored"), ("q3", None, "unresolved")], s), path)
    assert {r["query_id"]: r["bytes"] for r in first.collect()} == {"q1": 11, "q2": 8, "q3": None}
    published.publish_sql(spark.createDataFrame([("q2", None, "unresolved"), ("q3", "SELECT 3", "restored")], s), path)
    assert {r["query_id"]: r["sql"] for r in published.read(spark, path).collect()} == {"q1": "SELECT 'é'", "q3": "SELECT 3"}
    published.verify_sql(spark, path)
    published.publish_sql(spark.createDataFrame([("q1", None, "unresolved"), ("q3", None, "unresolved")], s), path)
    assert published.read(spark, path).count() == 0


def test_token_chains(spark):
    """Whole, without items, with a token that comes again, with an empty one."""
    nodes = "value_node_id string, operation string"

    def fetch(key, token):
        at = int(token or 0)
        page = [(f"{key[0]}-{at}", "op"), "no item"]
        if key[0] == "whole":
            return {"items": page, "truncated": at < 3, "next_token": str(at + 1)}
        if key[0] == "none":
            return {"items": None}
        return {"items": page, "truncated": True, "next_token": "" if key[0] == "empty" else str(at % 2 + 1)}

    chains = [("whole", "field"), ("none", "field"), ("again", "field"), ("empty", "field")]
    spark.dataSource.register(records.token_source("chains", fetch, "repo_id string, node_kind string", nodes, chains))
    items, manifest = records.catalogue(spark.read.format("chains").load(), ["repo_id", "node_kind"])
    assert {r["repo_id"]: r["complete"] for r in manifest.collect()} == {"whole": True, "none": False, "again": False, "empty": False}
    got = sorted((r["value_node_id"], r["complete"]) for r in records.value_nodes(items, manifest, "field", "op").collect())
    assert got == [("again-0", False), ("again-1", False), ("again-2", False), ("empty-0", False), *[(f"whole-{i}", True) for i in range(4)]]
