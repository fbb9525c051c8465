"""More operators bound to the driver's whole tables: sources, collection, topology records, references, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bridge, interaction, keys, model_lineage, orchestration, ranking, replica, search, source_target
from ..sources import records, sinks
from .queries import with_checkpoints
from .registry import query
from .tables import table

TEXTS = "array<string>"


def text(c: str) -> Column:
    return F.col(c).cast("string")


def name(prefix: str, c: Column | str) -> Column:
    return F.concat(F.lit(prefix), (F.col(c) if isinstance(c, str) else c).cast("string"))


# ---- collection of a revision's inputs

INPUTS_SQL = """
t as (select p_partkey k, 't' || p_partkey nm, case when p_size % 3 = 0 then 'dm.' || p_partkey else 't' || p_partkey end rel from part where p_size % 4 <> 0),
m as (
  select rel, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_returnflag || l_linestatus id, case when l_returnflag = 'A' then 'F' else 'f' end || l_linenumber col, case when l_linestatus = 'F' then 1 else 2 end linked,
         l_orderkey * 100 + l_linenumber * 10 + case when l_returnflag = 'A' then 0 else 1 end o from lineitem join t on k = l_partkey),
first as (select rel, lower(col) c, min_by(col, o) spelling from m group by all)
"""


def revision_inputs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Parts as targets, lines as the value sources of their columns, orders as gaps."""
    k = F.col("p_partkey")
    candidates = table(spark, d, "part").select(
        F.lit("r").alias("repo_id"), name("t", k).alias("logical_target_name"), F.when(F.col("p_size") % 4 == 0, "intermediate").otherwise("final").alias("target_kind"), F.lit("").alias("workflow_status"),
        F.array(F.lit("c")).alias("workflow_contexts"), name("dm.", k).alias("recommended_target_relation"), F.when(F.col("p_size") % 3 == 0, "confirmed_unique").otherwise("probable_ranked").alias("target_relation_recommendation_status"),
        k.alias("input_ordinal"),
    )
    column = name("f", "l_linenumber")
    refs = F.when(F.col("l_linestatus") == "F", F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(1), F.lit(0)))
    expression = lambda e, kind, out: F.struct(e.alias("expression"), F.lit(kind).alias("expression_kind"), out.alias("output_name"), F.lit("resolved").alias("resolution_status"))
    source = F.struct(F.concat(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"), F.col("l_linestatus")).alias("mapping_id"), refs.alias("refs"))
    values = table(spark, d, "lineitem").select(
        F.lit("r").alias("repo_id"), name("T", "l_partkey").alias("logical_target_name"), F.when(F.col("l_returnflag") == "A", F.upper(column)).otherwise(column).alias("target_column"), F.lit(1).alias("source_count"),
        F.array(source).alias("sources"), F.array(expression(column, "direct_column", column), expression(F.concat(F.lit("upper("), column, F.lit(")")), "function", F.lit(""))).alias("expressions"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.when(F.col("l_returnflag") == "A", 0).otherwise(1)).alias("input_ordinal"),
    )
    o = F.col("o_orderkey")
    details = F.struct(
        F.concat(F.lit("F"), (o % 7 + 1).cast("string")).alias("target_column"), F.lit("wf").alias("workflow_context_file"), F.when(o % 2 == 0, "loud").otherwise("").alias("impact"), F.lit("").alias("mapping_basis"), F.lit("{}").alias("evidence"),
    )
    gaps = table(spark, d, "orders").select(
        F.lit("r").alias("repo_id"), name("t", "o_custkey").alias("logical_target_name"), F.when(o % 3 == 0, "").otherwise(name("g", o)).alias("gap_id"), name("owner", o).alias("owner_id"), F.when(o % 5 == 0, "").otherwise(F.col("o_orderstatus")).alias("gap_kind"),
        F.lit("quiet").alias("severity"), F.lit(" seen ").alias("message"), details.alias("details"),
    )
    return source_target.collect_revision_inputs(candidates, values, gaps)


@query(f"with {INPUTS_SQL} select distinct rel workflow_target_logical_name, id mapping_id, min_by(col, o) target_column, cast(min_by(linked, o) as int) linked from m group by 1, 2")
def revision_mappings(spark: SparkSession, d: str) -> DataFrame:
    """SRC8, T1-T3, T5, T7: a mapping per id of the eligible targets, with the expressions it refers to."""
    m = revision_inputs(spark, d)["mappings"]
    return m.select("workflow_target_logical_name", "mapping_id", "target_column", F.size("linked").alias("linked"))


@query(f"""with {INPUTS_SQL}
select rel workflow_target_logical_name, case when o_orderkey % 3 = 0 then 'owner' else 'g' end || o_orderkey gap_id, coalesce(spelling, 'F' || (o_orderkey % 7 + 1)) target_column, case when o_orderkey % 5 = 0 then 'unresolved' else o_orderstatus end gap_kind,
       case when o_orderkey % 2 = 0 then 'loud' else 'quiet' end impact, 'seen' mapping_basis
from orders join t on k = o_custkey left join first using (rel) where c is null or c = 'f' || (o_orderkey % 7 + 1)
union all select t.rel, case when o_orderkey % 3 = 0 then 'owner' else 'g' end || o_orderkey, 'F' || (o_orderkey % 7 + 1), case when o_orderkey % 5 = 0 then 'unresolved' else o_orderstatus end, case when o_orderkey % 2 = 0 then 'loud' else 'quiet' end, 'seen'
from orders join t on k = o_custkey where exists (select 1 from first where first.rel = t.rel) and not exists (select 1 from first where first.rel = t.rel and c = 'f' || (o_orderkey % 7 + 1))""")
def revision_gaps(spark: SparkSession, d: str) -> DataFrame:
    """SRC8, T6, T8: published gaps in one shape, their columns in the mappings' spelling."""
    return revision_inputs(spark, d)["gaps"].select("workflow_target_logical_name", "gap_id", "target_column", "gap_kind", "impact", "mapping_basis")


@query(f"""with {INPUTS_SQL}, f as (select distinct rel, spelling from first),
g as (select count(*) n from orders join t on k = o_custkey)
select 'target_candidates_seen' what, count(*) n from part union all select 'eligible_targets', count(*) from t union all select 'mapping_rows', count(distinct id) from m union all select 'mapping_gaps', n from g union all select 'target_fields', count(*) from f""")
def revision_input_counts(spark: SparkSession, d: str) -> DataFrame:
    """SRC8, T9: what was collected."""
    return revision_inputs(spark, d)["counts"]


# ---- topology from published record kinds

TOPOLOGY_SQL = """
flows as (select 's' || s_suppkey flow, s_nationkey sys, s_acctbal >= 0 active from supplier union all select 'c' || c_custkey, c_nationkey, c_acctbal >= 0 from customer),
fe as (select l_linestatus profile, l_partkey || '-' || l_linenumber entity, s_nationkey sys, 's' || l_suppkey flow, case when l_quantity > 40 then 1 when l_quantity > 10 then 2 else 3 end kind, l_returnflag flag, (l_orderkey * 1000 + l_linenumber * 100 + cast(l_quantity as int)) * 4 + position(l_returnflag in 'ANR') o
  from lineitem join supplier on l_suppkey = s_suppkey where l_discount < 0.09),
act as (select fe.* from fe join flows using (flow, sys) where active and kind < 3),
sel as (select * from act qualify kind = 1 or not bool_or(kind = 1) over (partition by profile, entity, sys)),
prod as (select * from sel qualify row_number() over (partition by profile, entity, sys, flow order by o desc) = 1),
trig as (
  select 'g' || o_orderkey id, 'c' || o_custkey flow, c_nationkey sys, o_orderstatus profile, (o_orderkey % (select count(*) from part)) || '-' || (1 + o_orderkey % 7) entity, substr('ANRX', cast(o_orderkey % 4 + 1 as int), 1) stat
  from orders join customer on o_custkey = c_custkey where c_acctbal >= 0 and o_totalprice > 1000 and o_orderpriority <> '1-URGENT'),
hit as (select t.id, p.flow pflow, p.sys psys, p.flag = t.stat ok from trig t left join prod p on p.profile = t.profile and p.entity = t.entity and p.sys <> t.sys),
st as (select id, count(*) filter (where ok) n from hit group by 1),
loc as (select count(*) n from orders where o_orderpriority = '1-URGENT'),
edges as (select (select n from loc) + (select count(*) from hit where ok) n)
"""


def topology_records(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A revision per nation: suppliers and customers as flows, lines as their entities, orders as triggers; urgent orders are
    resolved locally."""
    with_checkpoints(spark)
    r1, parts = F.lit("r1").alias("revision_id"), F.broadcast(table(spark, d, "part").agg(F.count("*").alias("n")))  # one row
    flow = lambda t, p, k, n, a: table(spark, d, t).select(text(n).alias("system_id"), r1, name(p, k).alias("flow_id"), (F.col(a) >= 0).alias("active"))
    flows = flow("supplier", "s", "s_suppkey", "s_nationkey", "s_acctbal").union(flow("customer", "c", "c_custkey", "c_nationkey", "c_acctbal"))
    line = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    entities = line.select(
        text("s_nationkey").alias("system_id"), r1, name("s", "l_suppkey").alias("flow_id"), F.col("l_linestatus").alias("profile"), F.concat_ws("-", "l_partkey", "l_linenumber").alias("entity_id"), (F.col("l_discount") < 0.09).alias("active"),
        F.when(F.col("l_quantity") > 40, orchestration.DIRECT).when(F.col("l_quantity") > 10, orchestration.LINKED).otherwise("observed").alias("relation"),
        F.concat(F.lit('["'), F.col("l_returnflag"), F.lit('"]')).alias("published_stats_json"),
        ((F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")) * 4 + F.instr(F.lit("ANR"), F.col("l_returnflag"))).alias("input_ordinal"),
    )
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).crossJoin(parts)
    entity = F.concat_ws("-", k % F.col("n"), 1 + k % 7)
    statistic = F.element_at(F.array(*map(F.lit, "ANRX")), (k % 4 + 1).cast("int"))
    triggers = o.select(
        text("c_nationkey").alias("system_id"), r1, name("g", k).alias("trigger_id"), name("c", "o_custkey").alias("flow_id"), F.col("o_orderstatus").alias("upstream_profile"), entity.alias("upstream_entity_id"), statistic.alias("statistic_id"),
        (F.col("o_totalprice") > 1000).alias("active"),
    )
    local = o.where("o_orderpriority = '1-URGENT'").select(
        text("c_nationkey").alias("system_id"), r1, name("g", k).alias("trigger_id"), F.lit("resolved").alias("resolution_status"), F.lit("p").alias("producer_flow_id"), name("c", "o_custkey").alias("consumer_flow_id"),
        F.col("o_orderstatus").alias("profile"), entity.alias("entity_id"), statistic.alias("statistic_id"), F.lit(True).alias("producer_stat_supported"), F.lit(1).alias("producer_candidate_count"),
    )
    kinds = {"ctl_flow": flows, "ctl_flow_entity": entities, "ctl_trigger": triggers, "ctl_dependency": local}
    rest = {kind: flows.limit(0) for kind in orchestration.RECORD_KINDS if kind not in kinds}
    return table(spark, d, "nation").select(text("n_nationkey").alias("system_id"), r1), kinds | rest


@query(f"""with {TOPOLOGY_SQL} select 'revisions' what, count(*) n from nation union all select 'flows', count(*) from flows union all select 'edges', n from edges union all select 'gaps', count(*) from st where n <> 1""")
def topology_counts(spark: SparkSession, d: str) -> DataFrame:
    """The topology of the published record kinds, in numbers."""
    return orchestration.build_topology(*topology_records(spark, d))["counts"]


@query(f"""with {TOPOLOGY_SQL} select 'cross_revision' kind, h.id trigger_id, cast(psys as varchar) producer_system, pflow producer_flow_id, case when n = 1 then 'resolved_unique' else 'ambiguous_multiple' end status from hit h join st using (id) where ok
union all select 'repository_local', 'g' || o_orderkey, cast(c_nationkey as varchar), 'p', 'resolved' from orders join customer on o_custkey = c_custkey where o_orderpriority = '1-URGENT'""")
def topology_edges(spark: SparkSession, d: str) -> DataFrame:
    """Local and cross-revision dependencies."""
    e = orchestration.build_topology(*topology_records(spark, d))["edges"]
    return e.select("kind", "trigger_id", "producer_system", "producer_flow_id", "status")


@query(f"""with {TOPOLOGY_SQL}, e as (select distinct psys, pflow, t.sys csys, t.flow cflow from hit join trig t using (id) where ok)
select '  n' || substr(sha256(psys || chr(0) || 'r1' || chr(0) || pflow), 1, 16) || ' --> n' || substr(sha256(csys || chr(0) || 'r1' || chr(0) || cflow), 1, 16) line from e
union select '  n' || substr(sha256(psys || chr(0) || 'r1' || chr(0) || pflow), 1, 16) || '["' || pflow || '"]' from e union select '  n' || substr(sha256(csys || chr(0) || 'r1' || chr(0) || cflow), 1, 16) || '["' || cflow || '"]' from e""")
def dependency_graph_lines(spark: SparkSession, d: str) -> DataFrame:
    """SNK4: the lines of the cross-revision graph."""
    e = orchestration.build_topology(*topology_records(spark, d))["edges"]
    return sinks.dependency_graph(e.where("kind = 'cross_revision'"))


# ---- sources

@query("""
with e as (select p_brand id, count(*) n, min(p_type) t from part group by 1)
select cast(c_custkey as varchar) mapping_id, case when n = 1 then t end physical_table_name from customer left join e on id = 'Brand#' || (c_custkey % 40) where c_mktsegment = 'BUILDING' and 'f' || c_nationkey = 'f7'""")
def observed_field_mappings(spark: SparkSession, d: str) -> DataFrame:
    """SRC4: customers as field mappings, by type and field, with the table of their entity mapping where it is the one."""
    c = table(spark, d, "customer").select(text("c_custkey").alias("mapping_id"), F.col("c_mktsegment").alias("logical_type_name"), name("f", "c_nationkey").alias("logical_field_name"), name("Brand#", F.col("c_custkey") % 40).alias("entity_mapping_id"))
    e = table(spark, d, "part").select(F.col("p_brand").alias("mapping_id"), F.col("p_type").alias("physical_table_name"))
    return records.observed_mappings(c, e, "BUILDING", "f7").select("mapping_id", "physical_table_name")


@query("select p_partkey, p_brand from part")
def resolved_record_shape(spark: SparkSession, d: str) -> DataFrame:
    """SRC5: of all tables the one that has the columns of a part."""
    names = ("region", "nation", "customer", "supplier", "part", "orders")
    return records.resolve_shape({n: table(spark, d, n) for n in names}, "declared_part", {"p_partkey", "p_brand"}).select("p_partkey", "p_brand")


@query("select p_partkey value_node_id, 'r' || (p_size % 30) repo_id, p_size % 30 < 25 and p_size % 30 % 2 = 0 complete from part where p_type = (select min(p_type) from part)")
def complete_value_nodes(spark: SparkSession, d: str) -> DataFrame:
    """SRC6: nodes of a kind with the complete flag of their repository; nations are the manifest."""
    kind = table(spark, d, "part").agg(F.min("p_type")).first()[0]
    n = table(spark, d, "part").select(F.col("p_partkey").alias("value_node_id"), F.col("p_type").alias("node_kind"), name("r", F.col("p_size") % 30).alias("repo_id"))
    m = table(spark, d, "nation").select(name("r", "n_nationkey").alias("repo_id"), (F.col("n_nationkey") % 2 == 0).alias("complete"))
    return records.value_nodes(n, m, kind).select("value_node_id", "repo_id", "complete")


@query("select distinct cast(c_custkey as varchar) repository_id, 'https://g/' || c_custkey repository_url, sha1(cast(c_custkey as varchar)) resolved_commit from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def completed_batches(spark: SparkSession, d: str) -> DataFrame:
    """SRC12: customers as entries of a batch manifest, of which some segments are done."""
    seg = F.col("c_mktsegment")
    m = table(spark, d, "customer").select(F.when(seg == "BUILDING", "completed").when(seg == "MACHINERY", "reused").otherwise("failed").alias("status"), text("c_custkey").alias("repository_id"), name("https://g/", "c_custkey").alias("repository_url"), F.sha1(text("c_custkey")).alias("resolved_commit"))
    return records.remote_batches(m)


@query("select c_name item_id, repeat(c_mktsegment, 3) body from customer where c_name = 'Customer#000000007'")
def knowledge_item(spark: SparkSession, d: str) -> DataFrame:
    """SRC13: one item, whose body is within the bound."""
    return records.knowledge_item(table(spark, d, "customer").select(F.col("c_name").alias("item_id"), F.repeat("c_mktsegment", F.lit(3)).alias("body")), "Customer#000000007", 100)


# ---- model requests

@query("""
with o as (select 'p' || p_partkey id, 'm.' || p_brand || '.' || p_type fqcn, p_type nm from part), q as (select c_custkey, case c_custkey % 3 when 0 then upper(t) when 1 then 'm.' || b || '.' || t else 'none' end want from customer, (select min(p_type) t, min(p_brand) b from part)),
n as (select id, lower(fqcn) k from o union select id, lower(nm) from o), c as (select k, count(*) n, min(id) id from n group by 1)
select c_custkey, coalesce(n, 0) candidate_count, case when n = 1 then id end object_id from q left join c on k = lower(want)""")
def resolve_model_objects(spark: SparkSession, d: str) -> DataFrame:
    """L1: requests by full or simple name."""
    p, k = table(spark, d, "part"), F.col("c_custkey")
    o = p.select(name("p", "p_partkey").alias("object_id"), F.concat_ws(".", F.lit("m"), "p_brand", "p_type").alias("fqcn"), F.col("p_type").alias("name"))
    least = F.broadcast(p.agg(F.min("p_type").alias("t"), F.min("p_brand").alias("b")))  # one row
    r = table(spark, d, "customer").crossJoin(least).select("c_custkey", F.when(k % 3 == 0, F.upper("t")).when(k % 3 == 1, F.concat_ws(".", F.lit("m"), "b", "t")).otherwise("none").alias("requested"))
    return model_lineage.resolve_objects(r, o).select("c_custkey", "candidate_count", "object_id")


@query("""
with f as (select 'o' || (p_partkey % 200) o, lower(p_type) k, count(*) n, min(p_partkey) id from part group by 1, 2)
select c_custkey, coalesce(n, 0) field_count, case when n = 1 then id end field_id from customer, (select min(p_type) t from part) left join f on o = 'o' || (c_custkey % 200) and k = lower(t)""")
def resolve_model_fields(spark: SparkSession, d: str) -> DataFrame:
    """L2: fields of an object by name, in any case."""
    p = table(spark, d, "part")
    f = p.select(name("o", F.col("p_partkey") % 200).alias("object_id"), F.upper("p_type").alias("name"), F.col("p_partkey").alias("field_id"))
    r = table(spark, d, "customer").crossJoin(F.broadcast(p.agg(F.min("p_type").alias("field")))).select("c_custkey", name("o", F.col("c_custkey") % 200).alias("object_id"), "field")  # one row
    return model_lineage.resolve_fields(r, f).select("c_custkey", F.col("field_count").cast("long").alias("field_count"), "field_id")


@query("""
with b as (select s_nationkey o, count(distinct (s_suppkey % 3, s_suppkey % 2)) n, min('O' || (s_suppkey % 3)) w, min('f' || (s_suppkey % 2)) f from supplier group by 1)
select c_custkey, case when n = 1 then w || '.' || f || ' → ' else '' end || 'T.' || c_mktsegment source_attribute_path from customer left join b on o = c_nationkey""")
def model_attribute_paths(spark: SparkSession, d: str) -> DataFrame:
    """L3: attribute paths, led by the incoming binding where it is the only one."""
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("object_id"), name("O", F.col("s_suppkey") % 3).alias("owner"), name("f", F.col("s_suppkey") % 2).alias("owner_field"))
    r = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("object_id"), F.lit("T").alias("name"), F.col("c_mktsegment").alias("field"))
    return model_lineage.attribute_paths(r, b).select("c_custkey", "source_attribute_path")


@query("""
with m as (select 'm' || p_partkey id, p_brand stage, 'T' || (p_partkey % 5) tbl from part),
s as (select l_orderkey k, l_linenumber n, 'm' || l_partkey id, l_suppkey, l_quantity from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity) = 1)
select cast(k as varchar) lineage_id, cast(count(*) filter (where m.id is null) as int) missing, cast(count(*) as int) steps from s left join m using (id) group by 1""")
def relation_path_steps(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as materialization steps; those of no known part are missing."""
    keyed = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("x"))
    steps = F.array_sort(F.collect_list(F.struct("l_linenumber", name("m", "x.l_partkey").alias("id"))))
    path = F.transform(steps, lambda s: F.struct(F.lit("observed_relation_materialization").alias("kind"), s["id"].alias("materialization_id")))
    rows = keyed.groupBy(text("l_orderkey").alias("lineage_id")).agg(path.alias("branch_path")).select("lineage_id", F.lit("src").alias("terminal_relation"), F.lit("c").alias("terminal_column"), F.lit("dst").alias("target_relation"), F.lit("c").alias("target_column"), "branch_path")
    m = table(spark, d, "part").select(name("m", "p_partkey").alias("materialization_id"), F.col("p_brand").alias("query_file"), name("T", F.col("p_partkey") % 5).alias("output_table_name"))
    p = model_lineage.relation_paths(rows, m).join(rows.select("lineage_id", F.size("branch_path").alias("steps")), "lineage_id")
    return p.select("lineage_id", F.size("missing").alias("missing"), "steps")


@query("select p_brand object_id, p_type field, min(p_partkey) \"position\" from part group by 1, 2")
def model_source_fields(spark: SparkSession, d: str) -> DataFrame:
    """All fields of each object, by first position."""
    return model_lineage.source_fields(table(spark, d, "part").select(F.col("p_brand").alias("object_id"), F.col("p_type").alias("name"), F.col("p_partkey").alias("input_ordinal")))


@query("""
with v as (select p_partkey, 'mart.' || p_brand r, 'c' || p_size c, ['base', 'hist', 'delta'][cast(p_partkey % 3 + 1 as int)] v, p_type t from part)
select p_partkey, v variant, row_number() over (order by lower(r), lower(c), case v when 'base' then 1 when 'hist' then 2 else 3 end, lower(t), p_partkey) n from v""")
def lineage_output_order(spark: SparkSession, d: str) -> DataFrame:
    """Rows by target, column, representation and terminal."""
    with_checkpoints(spark)
    k = F.col("p_partkey")
    v = F.element_at(F.array(*map(F.lit, ("base", "hist", "delta"))), (k % 3 + 1).cast("int"))
    rows = table(spark, d, "part").select(k, v.alias("variant"), F.concat(F.lit("mart."), F.col("p_brand")).alias("target_relation"), name("c", "p_size").alias("target_column"), F.col("p_type").alias("terminal_relation"))
    return keys.numbered(rows, [*model_lineage.output_order(), "p_partkey"]).select("p_partkey", "variant", "n")


# ---- replica reports

REPLICA_SQL = """
t as (select p_partkey, 'rep.' || p_partkey rel, case when p_size % 4 = 0 then 0 else 1 end ann, case when p_size % 3 = 0 then '' else 'id_' || p_size end col from part)
"""


def replica_tables(spark: SparkSession, d: str) -> DataFrame:
    """Parts as mapped tables; a quarter without a key annotation, a third without a mapped key column."""
    p, z = table(spark, d, "part"), F.col("p_size")
    t = p.select(F.col("p_partkey").alias("type_id"), text("p_partkey").alias("fqcn"), text("p_partkey").alias("entity_mapping_id"), name("rep.", "p_partkey").alias("replica_relation"))
    a = p.select(F.col("p_partkey").alias("type_id"), F.when(z % 4 == 0, "MetaNote").otherwise("MetaEntity").alias("annotation_name"), F.array(F.struct(F.lit("id").alias("name"), F.lit("").alias("raw"), F.lit("key").alias("literal_value"))).alias("arguments"))
    m = p.select(text("p_partkey").alias("logical_type_name"), text("p_partkey").alias("entity_mapping_id"), F.lit("key").alias("logical_field_name"), F.when(z % 3 == 0, "").otherwise(name("id_", z)).alias("physical_column_name"), F.lit("observed_exact").alias("mapping_status"))
    return replica.map_keys(t, a, spark.createDataFrame([], "type_id long, field_name string"), m)


@query(f"""with {REPLICA_SQL} select rel || ',' || case when ann = 1 then col else '' end || ',' || case when ann = 1 then 'entity_id' else '' end || ',' || case when ann = 1 and col <> '' then 'confirmed' else 'gap' end || ',not_observed,' ||
  case when ann = 0 then 'ucp_identity_annotation_not_observed' when col = '' then 'tsa_identity_mapping_missing_physical_column' else '' end line from t""")
def replica_key_report(spark: SparkSession, d: str) -> DataFrame:
    """E4, E5, SNK1, SNK5: the key report's lines."""
    return sinks.csv_lines(sinks.key_rows(replica_tables(spark, d)), ["table", "logical_pk", "key_kind", "logical_pk_status", "physical_pk_status", "gap"])


@query(f"""with {REPLICA_SQL}, l as (select distinct l_partkey s, l_suppkey g from lineitem)
select a.rel source_table, 'f' || g relationship, b.rel target_table, case when b.ann = 1 then b.col else '' end target_logical_pk, 'confirmed' logical_link_status, 'not_observed' physical_fk_status from l join t a on a.p_partkey = s join t b on b.p_partkey = g""")
def replica_link_report(spark: SparkSession, d: str) -> DataFrame:
    """E10, E11, SNK5: links between mapped tables, projected from resolved relationships; no physical join is claimed."""
    r = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source_type_id"), F.col("l_suppkey").alias("target_type_id"), F.lit("reference").alias("relationship_kind"), F.lit("resolved").alias("resolution_status"), name("x", "l_suppkey").alias("field_id")).distinct()
    f = table(spark, d, "supplier").select(name("x", "s_suppkey").alias("field_id"), name("f", "s_suppkey").alias("name"))
    links = sinks.link_rows(replica.project_relationships(replica_tables(spark, d), r, f))
    return links.withColumn("target_logical_pk", F.array_join("target_logical_pk", ";"))


@query("""
with recursive g as (select c_custkey // 2 a, c_custkey b from customer where c_custkey > 1 and c_mktsegment <> 'MACHINERY'),
reach(n) as (select 1::bigint union all select b from reach join g on a = n)
select 't' || n type_id from reach""")
def reached_types(spark: SparkSession, d: str) -> DataFrame:
    """Types that resolved relationships reach from a root, however many steps away; those of one segment are open."""
    with_checkpoints(spark)
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    types = c.select(name("t", k).alias("type_id"), name("t", k).alias("fqcn"), F.lit("").alias("simple_name"))
    status = F.when(F.col("c_mktsegment") == "MACHINERY", "ambiguous").otherwise("resolved")
    r = c.select(F.when(k > 1, name("t", F.floor(k / 2))).alias("source_type_id"), name("t", k).alias("target_type_id"), status.alias("resolution_status"))
    return replica.selected_types(types, r, spark.createDataFrame([("T1",)], "root string"))


# ---- bridge

@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey) = 1")
def deduped_compositions(spark: SparkSession, d: str) -> DataFrame:
    """K3: the first composed row of each key."""
    return bridge.dedupe_composed(table(spark, d, "orders").withColumn("input_ordinal", F.col("o_orderkey")), ["o_custkey", "o_orderstatus"]).select("o_custkey", "o_orderkey")


@query("select p_partkey, p_size % 3 <> 0 and p_size % 5 <> 0 and p_size % 7 <> 0 proven from part")
def proven_branches(spark: SparkSession, d: str) -> DataFrame:
    """K5: parts as datamart branches: four names, and no blocking note."""
    z = F.col("p_size")
    gap = F.when(z % 5 == 0, "x;right_context_not_exact:[]").when(z % 7 == 0, "profile_confirmed_lineage_not_found").otherwise("a note")
    p = table(spark, d, "part").select("p_partkey", F.lit("r").alias("replica_relation"), F.lit("c").alias("replica_column"), F.when(z % 3 == 0, " ").otherwise("t").alias("target_relation"), F.lit("f").alias("target_column"), gap.alias("gap"))
    return p.select("p_partkey", bridge.branch_proven().alias("proven"))


@query("select l_orderkey, case when count(distinct l_suppkey) = 1 then 's' || min(l_suppkey) else '' end producer from lineitem group by 1")
def single_producers(spark: SparkSession, d: str) -> DataFrame:
    """K6: the producer of a provenance document, where there is one."""
    doc = F.to_json(F.collect_list(F.struct(name("s", "l_suppkey").alias("producer_repository"))))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(doc.alias("p")).select("l_orderkey", bridge.one_producer(F.col("p")).alias("producer"))


# ---- search

@query("""
with r as (select 'relation' record_kind, cast(p_partkey as varchar) record_id, p_name name, '' parent from part union all select 'field', p_partkey || ':' || p_type, p_type, p_name from part
  union all select 'declared_type', 't' || c_custkey, c_name, '' from customer union all select 'declared_field', 'f' || o_orderkey, o_orderpriority, c_name from orders join customer on o_custkey = c_custkey
  union all select 'mapping_replica', s_suppkey || ':replica', s_name, '' from supplier union all select 'mapping_logical', s_suppkey || ':logical', 'l' || s_suppkey, '' from supplier where s_suppkey % 2 = 0)
select * from r""")
def index_records(spark: SparkSession, d: str) -> DataFrame:
    """Q1: index rows of relations, fields, types and mappings."""
    rel = table(spark, d, "part").select(text("p_partkey").alias("sql_relation_id"), F.col("p_name").alias("relation_name"), F.lit("f").alias("file"), F.array(F.struct(F.col("p_type").alias("column_name"), F.lit("f").alias("file"))).alias("fields"))
    types = table(spark, d, "customer").select(name("t", "c_custkey").alias("type_id"), F.col("c_name").alias("fqcn"), F.lit("").alias("simple_name"), F.lit("").alias("file"))
    fields = table(spark, d, "orders").select(name("f", "o_orderkey").alias("field_id"), name("t", "o_custkey").alias("type_id"), F.col("o_orderpriority").alias("name"), F.lit("").alias("file"))
    maps = table(spark, d, "supplier").select(text("s_suppkey").alias("mapping_id"), F.lit("").alias("parent"), F.lit("").alias("file"), F.col("s_name").alias("physical_name"), F.when(F.col("s_suppkey") % 2 == 0, name("l", "s_suppkey")).otherwise("").alias("logical_name"))
    return search.relation_records(rel).unionByName(search.model_records(types, fields)).unionByName(search.mapping_records(maps)).drop("file")


@query("select n_nationkey, 'sha256:' || sha256('{\"kind\": \"nation\", \"name\": \"' || n_name || '\"}') ref from nation")
def selection_refs(spark: SparkSession, d: str) -> DataFrame:
    """Q3: references to objects by their content."""
    ref = search.selection_ref(("name", F.col("n_name")), ("kind", F.lit("nation")))
    return table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("sha256:"), ref).alias("ref"))


@query("""
with x as (select p_brand rel, p_type col, p_partkey id, p_name t from part), k as (select min(rel) rel from x), c as (select min(col) col from x)
select id, id - id + case when n > 20 then 1 else 0 end has_more from (select x.id, t, count(*) over () n, row_number() over (order by t, '', x.id) r from x, k, c where x.rel = k.rel and x.col = c.col) where r <= 20""")
def attribute_lineage_page(spark: SparkSession, d: str) -> DataFrame:
    """Q6: the first page of a column's lineage."""
    least = table(spark, d, "part").agg(F.min("p_brand"), F.min("p_type")).first()
    rows = table(spark, d, "part").select(F.lower("p_brand").alias("target_relation"), F.upper("p_type").alias("target_column"), F.col("p_name").alias("terminal_relation"), F.lit("").alias("terminal_column"), F.col("p_partkey").alias("lineage_id"), F.col("p_partkey").alias("input_ordinal"))
    return search.attribute_lineage(rows, least[0], least[1], 0, 20).select(F.col("lineage_id").alias("id"), F.col("has_more").cast("long").alias("has_more"))


@query("with l as (select min((p_brand, p_name)) x from part) select p_partkey, p_type expression from part, l where p_brand = x[1] and p_name = x[2]")
def calculation_logic(spark: SparkSession, d: str) -> DataFrame:
    """Q8: the expressions of a query's output column."""
    least = table(spark, d, "part").agg(F.min(F.struct("p_brand", "p_name")).alias("x")).select("x.*").first()
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("query_id"), F.upper("p_name").alias("output_name"), F.col("p_type").alias("expression"))
    return search.calculation_logic(p, least[0], f" {least[1]} ").select("p_partkey", "expression")


@query("select c_custkey, row_number() over (order by c_name, c_custkey) + 99 record_index from (select * from customer order by c_name, c_custkey limit 25 offset 100)")
def evidence_records(spark: SparkSession, d: str) -> DataFrame:
    """Q9: a page of evidence by number."""
    return search.evidence_page(table(spark, d, "customer").select("c_name", "c_custkey"), ["c_name", "c_custkey"], 100, 25).select("c_custkey", F.col("record_index").cast("long").alias("record_index"))


@query("""
with e as (select p_type id, count(*) n from (select p_type || '-' || p_size p_type from part) group by 1), f as (select p_type || '-' || p_size id, list_sort(list(distinct p_brand)) fl from part group by 1)
select r.id entity_id, case when n = 1 then 'available' when n > 1 then 'ambiguous' else 'not_found' end status, coalesce(array_to_string(fl, ','), '') flows
from (select distinct t || '-' || z id from (select distinct p_type t from part), (select unnest(range(1, 60)) z)) r left join e on e.id = r.id left join f on f.id = r.id""")
def entity_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Q11: entities by exact id, with their flows."""
    p = table(spark, d, "part").withColumn("entity_id", F.concat_ws("-", "p_type", text("p_size")))
    r = p.select("p_type").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(59)), lambda z: F.concat_ws("-", F.col("p_type"), z.cast("string")))).alias("entity_id"))
    out = search.entity_context(r, p, p.select("entity_id", F.col("p_brand").alias("flow_id")))
    return out.select("entity_id", "status", F.coalesce(F.array_join("flows", ","), F.lit("")).alias("flows"))


@query("select array_to_string(list_sort(list(distinct o_orderpriority)), ',') sources, array_to_string(list_sort(list(distinct o_orderstatus)), ',') systems from orders")
def search_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Q13: what a search covered."""
    c = search.coverage(table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("system_id")))
    return c.select(F.array_join("sources", ",").alias("sources"), F.array_join("systems", ",").alias("systems"))


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'A' and l_linestatus = 'F')")
def downstream_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Q5: targets with a source match of this relation and column."""
    matches = F.collect_set(F.struct(F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("column")))
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(matches.alias("matches"))
    return search.downstream(table(spark, d, "orders").join(line, "o_orderkey"), " a", "F ").select("o_orderkey")


# ---- ranking

@query("""
with r as (select s_nationkey n, s_suppkey k, row_number() over (partition by s_nationkey order by s_suppkey) i from supplier), p as (select n, count(*) c from r group by 1)
select n s_nationkey, case when n % 5 = 0 then 'PROVIDER_ERROR' when n % 3 = 0 or n % 4 = 0 then 'INVALID_RESPONSE' else 'VALIDATED' end status,
  case when n % 3 = 0 and n % 4 = 0 then 'ranks,unknown_candidate' when n % 3 = 0 then 'unknown_candidate' when n % 4 = 0 then 'ranks' else '' end faults from p""")
def response_validation(spark: SparkSession, d: str) -> DataFrame:
    """A response per nation's package; some name unknown candidates, or number them wrongly, or failed."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    c = F.array_sort(F.collect_list(F.struct(text("s_suppkey").alias("candidate_id"), F.array(F.lit("i")).alias("supporting_interface_ids"))))
    p = table(spark, d, "supplier").groupBy("s_nationkey").agg(c.alias("candidates"))
    first = F.element_at("candidates", 1)
    ranked = F.array(F.struct(F.when(n % 3 == 0, "none").otherwise(first["candidate_id"]).alias("candidate_id"), F.when(n % 4 == 0, 2).otherwise(1).alias("rank"), F.when(n % 3 == 0, F.array().cast(TEXTS)).otherwise(first["supporting_interface_ids"]).alias("supporting_interface_ids")))
    out = p.withColumn("ranked", ranked).withColumn("faults", ranking.response_faults())
    status = ranking.terminal_status(F.when(n % 5 == 0, F.lit("timeout")), F.col("faults"))
    return out.select("s_nationkey", status.alias("status"), F.array_join("faults", ",").alias("faults"))


@query("select o_orderstatus status, count(*) row_count from orders group by 1")
def rerank_status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Results by status."""
    return ranking.status_counts(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")))


# ---- interactions

def order_fields(spark: SparkSession, d: str) -> DataFrame:
    """Orders as boundary fields of HTTP calls from their customer's repository to their clerk's."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        text("o_orderkey").alias("edge_id"), F.lit("request").alias("role"), F.concat(name("a", k % 7), name(".b", k % 5), name(".c", k % 3)).alias("field_path"), name("r", c % 11).alias("source_repository"), name("r", c % 13).alias("target_repository"),
        name("P", k % 4).alias("source_payload"), name("P", k % 6).alias("target_payload"), F.lit("http").alias("protocol"), F.lit("get").alias("method"), name("/x", k % 9).alias("matched_identity"),
        F.when(k % 2 == 0, F.array(F.struct(F.lit("http_method_path").alias("kind"), F.concat(F.lit("GET /x"), (k % 9).cast("string")).alias("value")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>")).alias("basis"),
    )


FIELDS_SQL = """
f as (select cast(o_orderkey as varchar) edge_id, o_orderkey k, o_custkey c, 'a' || (o_orderkey % 7) || '.b' || (o_orderkey % 5) || '.c' || (o_orderkey % 3) path from orders)
"""


@query("select cast(n_nationkey as varchar) edge_id from nation where n_nationkey in (3, 7)")
def checked_topology(spark: SparkSession, d: str) -> DataFrame:
    """The named edges of a topology of the known format."""
    t = table(spark, d, "region").select(F.lit(interaction.TOPOLOGY_FORMAT).alias("format"), text("r_regionkey").alias("topology_id"))
    return interaction.check_topology(t, table(spark, d, "nation").select(text("n_nationkey").alias("edge_id")), ["3", "7"])


@query(f"""with {FIELDS_SQL}, s as (select k, 's' || (k % 4) sym from f where k % 4 <> 0)
select edge_id, 'wire' strategy, 'HTTP request ' || path ref from f union all select edge_id, 'route', 'boundary:rest:/x' || (k % 9) || ':request.' || path from f where k % 2 = 0
union all select edge_id, 'local_payload', sym || '.' || path from f join s using (k) union all select edge_id, 'field_path', path from f
union all select edge_id, 'structural_suffix', regexp_replace(path, '^[^.]*\\.', '') from f union all select edge_id, 'this', 'this.' || path from f""")
def anchor_references(spark: SparkSession, d: str) -> DataFrame:
    """The references under which a boundary field may be known."""
    f = order_fields(spark, d)
    b = F.array(F.struct(F.when(F.col("k") % 4 != 0, name("s", F.col("k") % 4)).otherwise("s0").alias("symbol"), name("P", F.col("k") % 4).alias("declared_type"), F.when(F.col("k") % 4 != 0, "exact_single_assignment").otherwise("several").alias("binding_status")))
    h = table(spark, d, "orders").select(text("o_orderkey").alias("edge_id"), name("r", F.col("o_custkey") % 11).alias("repository_id"), F.lit(1).alias("position"), F.col("o_orderkey").alias("k")).withColumn("bindings", b)
    return interaction.anchor_refs(f, interaction.payload_symbols(h), "source").select("edge_id", "strategy", "ref")


FALLBACK_SQL = f"""{FIELDS_SQL},
ops as (select 'r' || (p_partkey % 11) repo, 'P' || (p_partkey % 4) payload, 'op' || (p_partkey % 50) op, 'v' || (p_partkey % 2) sym from part group by all),
nodes as (select p_partkey id, 'r' || (p_partkey % 11) repo, 'op' || (p_partkey % 50) op, 'v' || (p_partkey % 2) || '.a' || (p_partkey % 7) || '.b' || (p_partkey % 5) || '.c' || (p_partkey % 3) ref, 'a' || (p_partkey % 7) || '.b' || (p_partkey % 5) || '.c' || (p_partkey % 3) wire, '/x' || (p_size % 9) ep, p_brand own from part),
pay as (select edge_id, op, ref, min(id) id from f join ops on ops.repo = 'r' || (c % 11) and payload = 'P' || (k % 4) join nodes n using (op) where n.repo = ops.repo and n.ref = sym || '.' || path group by all),
rte as (select edge_id, op, own, min(id) id from f join nodes n on n.repo = 'r' || (c % 11) and wire = path and ep = '/x' || (k % 9) group by all),
shp as (select edge_id, min(id) id from f join nodes n on n.repo = 'r' || (c % 11) and wire = path group by 1 having count(distinct id) = 1),
cnt as (select f.edge_id, c, (select count(*) from pay where pay.edge_id = f.edge_id) np, (select min(id) from pay where pay.edge_id = f.edge_id) ip, (select count(*) from rte where rte.edge_id = f.edge_id) nr, (select min(id) from rte where rte.edge_id = f.edge_id) ir, shp.id ishape from f left join shp on shp.edge_id = f.edge_id),
fb as (select *, case when c % 11 = 3 then 'incomplete_catalogue' when np = 1 then 'payload_instance' when np > 1 then 'ambiguous_payload_instance' when nr = 1 then 'route_wire' when nr > 1 then 'ambiguous_route_wire' when ishape is not null then 'counterpart_shape' else 'none' end how from cnt)
"""


def value_catalogue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as field and wire nodes, the operations that hold payloads, and which repositories are complete."""
    p, z = F.col("p_partkey"), F.col("p_size")
    path = F.concat(name("a", p % 7), name(".b", p % 5), name(".c", p % 3))
    transport = F.struct(F.lit("HTTP").alias("protocol"), name("/x", z % 9).alias("endpoint"), F.lit("request").alias("payload_role"), F.lit("outbound").alias("interface_direction"), F.lit("GET").alias("http_method"))
    part = table(spark, d, "part")
    base = part.select(name("r", p % 11).alias("repo_id"), p.alias("value_node_id"), F.concat(name("v", p % 2), F.lit("."), path).alias("display_ref"), name("op", p % 50).alias("operation"), F.col("p_brand").alias("owner_ref"), path.alias("wire_path"), transport.alias("transport"))
    nodes = base.withColumn("node_kind", F.explode(F.array(F.lit("field"), F.lit("wire_field"))))
    ops = part.select(name("r", p % 11).alias("repo_id"), name("P", p % 4).alias("payload"), name("op", p % 50).alias("operation"), name("v", p % 2).alias("symbol")).distinct()
    complete = part.select(name("r", p % 11).alias("repo_id"), (p % 11 != 3).alias("complete")).distinct()
    return nodes, ops, complete


def source_side(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    with_checkpoints(spark)
    f = order_fields(spark, d)
    nodes, ops, complete = value_catalogue(spark, d)
    wires = nodes.where("node_kind = 'wire_field'")
    leaves = wires.select(F.col("repo_id").alias("source_repository"), F.col("wire_path").alias("field_path"), "value_node_id")
    flows = wires.select(F.col("value_node_id").alias("anchor_id"), F.array("wire_path").alias("visited"))
    return f, interaction.source_fallbacks(f, nodes, ops, leaves, flows, complete)


@query(f"""with {FALLBACK_SQL} select edge_id, how fallback, case how when 'payload_instance' then ip when 'route_wire' then ir when 'counterpart_shape' then ishape end anchor_id,
  case when how = 'route_wire' then 'terminal' when how in ('payload_instance', 'counterpart_shape') then 'resolved' else 'unresolved' end anchor_status from fb""")
def source_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """Where a field comes from when no reference anchors it."""
    return source_side(spark, d)[1].select("edge_id", "fallback", "anchor_id", "anchor_status")


@query(f"""with {FALLBACK_SQL}, anch as (select edge_id, k id from f where k % 4 = 1)
select edge_id, coalesce(anch.id, case how when 'payload_instance' then ip when 'route_wire' then ir when 'counterpart_shape' then ishape end) anchor_id, case when anch.id is not null then 'exact_reference' else how end basis,
  case when anch.id is not null then 'resolved' when how = 'route_wire' then 'terminal' when how in ('payload_instance', 'counterpart_shape') then 'resolved' else 'unresolved' end status from fb left join anch using (edge_id)""")
def resolved_sides(spark: SparkSession, d: str) -> DataFrame:
    """A side's anchor: the best direct one, else what the fallback found."""
    f, rest = source_side(spark, d)
    direct = f.where(F.col("edge_id").cast("long") % 4 == 1).select("edge_id", "role", "field_path", F.col("edge_id").cast("long").alias("anchor_id"), F.lit("exact_reference").alias("basis"))
    return interaction.resolve_side(f, direct, rest).select("edge_id", "anchor_id", F.col("anchor_basis").alias("basis"), "status")


@query("""
with f as (select cast(o_orderkey as varchar) edge_id, o_custkey % 13 r, 'P' || (o_orderkey % 6) payload, 'a' || (o_orderkey % 7) || '.b' || (o_orderkey % 5) || '.c' || (o_orderkey % 3) path from orders),
ops as (select distinct p_partkey % 11 r, 'P' || (p_partkey % 4) payload, 'op' || (p_partkey % 50) op, 'v' || (p_partkey % 2) sym from part),
nodes as (select p_partkey id, p_partkey % 11 r, 'op' || (p_partkey % 50) op, 'v' || (p_partkey % 2) || '.a' || (p_partkey % 7) || '.b' || (p_partkey % 5) || '.c' || (p_partkey % 3) ref from part),
sig as (select edge_id, op, ref, min(id) id from f join ops using (r, payload) join nodes using (r, op) where ref = sym || '.' || path group by all), n as (select edge_id, count(*) n, min(id) id from sig group by 1)
select edge_id, case when n = 1 then id end anchor_id, case when n = 1 then 'resolved' when n is null and r < 11 and r <> 3 then 'terminal' else 'unresolved' end anchor_status from f left join n using (edge_id)""")
def target_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """Where a field goes on; nowhere after a complete scan is an end, not a gap."""
    with_checkpoints(spark)
    f = order_fields(spark, d)
    nodes, ops, complete = value_catalogue(spark, d)
    return interaction.target_fallbacks(f, nodes, ops, complete).select("edge_id", "anchor_id", "anchor_status")


@query("""select cast(o_orderkey as varchar) edge_id, 'journey-' || substr(sha256('{"edge_id":"' || o_orderkey || '","role":"request"}'), 1, 24) journey_id from orders""")
def journey_ids(spark: SparkSession, d: str) -> DataFrame:
    """Stable ids of journeys."""
    return table(spark, d, "orders").select(text("o_orderkey").alias("edge_id"), interaction.journey_id(text("o_orderkey").alias("edge_id"), F.lit("request").alias("role")).alias("journey_id"))


@query("""
with j as (select o_orderkey k, cast(o_orderkey as varchar) e from orders)
select e edge, 'http GET /x' interaction, 'field' || k crossing_attribute, case when k % 4 = 0 then 'не удалось определить источник атрибута внутри producer; ' else '' end || 'потенциальная межрепозиторная связь ещё не подтверждена' gap,
  'a: ' || case when k % 2 = 0 then 's.x → s.y' else '[unresolved source]' end || ' == http GET /x / request ==> b: t.z [GAP: ' || case when k % 4 = 0 then 'source_local_anchor_unresolved | ' else '' end || 'candidate_transport_crossing_unverified]' full_attribute_path from j""")
def readable_journeys(spark: SparkSession, d: str) -> DataFrame:
    """Journeys as a person reads them."""
    k = F.col("o_orderkey")
    j = table(spark, d, "orders").select(
        text("o_orderkey").alias("edge_id"), F.lit("request").alias("role"), name("field", k).alias("field_path"), F.lit("HTTP").alias("protocol"), F.lit("get").alias("method"), F.lit("/x").alias("matched_identity"), F.lit("a").alias("source_repository"), F.lit("b").alias("target_repository"),
        F.lit("").alias("producer_attribute"), F.lit("").alias("consumer_attribute"), F.when(k % 2 == 0, F.array(F.lit("s.x"), F.lit("s.y"), F.lit("s.x"))).otherwise(F.array().cast(TEXTS)).alias("source_path"), F.array(F.lit("t.z")).alias("target_path"),
        F.when(k % 4 == 0, "unresolved").otherwise("resolved").alias("source_status"), F.lit("resolved").alias("target_status"), F.lit(True).alias("payload_compatible"),
    )
    r = interaction.human_rows(j, interaction.journey_gaps(j))
    return r.select(F.regexp_replace("crossing_attribute", "field", "").alias("edge"), "interaction", "crossing_attribute", "gap", "full_attribute_path")


@query("""select count(*) journey_count, count(*) filter (where o_orderkey % 4 <> 0) source_resolved, count(*) filter (where o_orderkey % 5 <> 0) target_resolved, count(*) filter (where o_orderkey % 5 = 0) target_terminal, count(*) filter (where o_orderkey % 3 = 0) payload_compatible from orders""")
def journey_totals(spark: SparkSession, d: str) -> DataFrame:
    """Journeys in numbers."""
    k = F.col("o_orderkey")
    return interaction.journey_summary(table(spark, d, "orders").select(F.when(k % 4 == 0, "unresolved").otherwise("resolved").alias("source_status"), F.when(k % 5 == 0, "terminal").otherwise("resolved").alias("target_status"), (k % 3 == 0).alias("payload_compatible")))


@query("""
with x as (select l_orderkey k, count(*) n from lineitem group by 1)
select cast(o_orderkey as varchar) edge_id, case when o_orderkey % 9 = 0 then 'failed' when n is null then 'missing' else 'complete' end status from orders left join x on k = o_orderkey""")
def edge_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A record per edge; one failure leaves the others alone."""
    e = table(spark, d, "orders").select(text("o_orderkey").alias("edge_id"))
    n = table(spark, d, "lineitem").groupBy(text("l_orderkey").alias("edge_id")).agg(F.count("*").alias("journey_count"))
    out = e.join(n, "edge_id", "left").withColumn("error", F.when(F.col("edge_id").cast("long") % 9 == 0, "timeout"))
    return interaction.edge_ledger(e, out).select("edge_id", "status")


@query("""
with c as (select p_brand raw, true coll from part group by 1), s as (select distinct 'b.' || p_brand || '.' || p_type raw from part)
select 'b.' || p_brand || '[].' || p_type path, 'b.' || p_brand || '[]' parent from (select distinct p_brand, p_type from part) where p_brand <= 'Brand#3'
union all select 'b.' || p_brand || '.' || p_type, 'b.' || p_brand from (select distinct p_brand, p_type from part) where p_brand > 'Brand#3' and p_brand <= 'Brand#4'""")
def expandable_shape(spark: SparkSession, d: str) -> DataFrame:
    """Published fields under branches of the topology that may be expanded; early brands are collections."""
    p = table(spark, d, "part").select("p_brand", "p_type").distinct()
    branch = F.concat_ws(".", F.lit("b"), "p_brand")
    shape = p.select(F.concat_ws(".", F.lit("b"), "p_brand", "p_type").alias("raw_path"), F.lit(False).alias("is_collection")).union(p.select(branch, F.col("p_brand") <= "Brand#3").distinct())
    parents = p.select(branch.alias("field_path"), (F.col("p_brand") <= "Brand#4").alias("expandable")).distinct()
    return interaction.shape_fields(shape, parents)


@query("""
with b as (select o_custkey k, count(distinct o_orderstatus) n, min(o_orderstatus) st from orders group by 1),
v as (select l_suppkey k, count(*) n, count(*) filter (where l_returnflag = 'R') miss, bool_or(l_returnflag = 'R' and l_quantity > 49) amb, bool_or(l_returnflag = 'R' and l_quantity between 48 and 49) ext, bool_or(l_returnflag = 'R' and l_quantity < 3) mat from lineitem group by 1)
select c_custkey, case when b.n is null or b.n <> 1 then 'missing_binding' when c_custkey % 3 = 0 and st = 'F' then 'server_unavailable' when c_custkey % 3 = 1 and st = 'F' then 'missing_compatible_revision' when st = 'O' then 'revision_unavailable'
    when st = 'P' and c_custkey % 2 = 0 then 'missing_required_tool' when amb then 'preparation_ambiguous' when ext then 'preparable_external_boundary' when mat then 'material_semantic_gap' else 'ready' end readiness,
  coalesce(v.n, 0) boundary_anchor_count, coalesce(miss, 0) boundary_anchor_missing_count
from customer left join b on b.k = c_custkey left join v on v.k = c_custkey""")
def derived_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Customers as repositories, bound by their orders' one status; lines as probed boundaries."""
    k, q = F.col("c_custkey"), F.col("l_quantity")
    repositories = table(spark, d, "customer").select(text("c_custkey").alias("repository_id"))
    bindings = table(spark, d, "orders").select(text("o_custkey").alias("repository_id"), F.col("o_orderstatus").alias("system_id"), text("o_custkey").alias("revision_id")).distinct()
    status = F.when((F.col("st") == "F") & (k % 3 == 0), "server_unavailable").when((F.col("st") == "F") & (k % 3 == 1), "missing_revision").when(F.col("st") == "O", "archived").otherwise("ready")
    tools = F.when((F.col("st") == "P") & (k % 2 == 0), F.array(F.lit("other"))).otherwise(F.array(F.lit("other"), F.lit(interaction.REQUIRED_TOOL)))
    revisions = table(spark, d, "customer").withColumn("st", F.explode(F.array(*map(F.lit, "FOP")))).select(F.col("st").alias("system_id"), text("c_custkey").alias("revision_id"), status.alias("status"), tools.alias("available_tools"))
    state = F.when(q > 49, "ambiguous").when(q >= 48, "external_boundary").when(q < 3, "material_gap")
    sides = table(spark, d, "lineitem").select(text("l_suppkey").alias("repository_id"), F.when(F.col("l_returnflag") == "R", "unresolved").otherwise("resolved").alias("anchor_status"), state.alias("requirement_state"))
    r = interaction.readiness(interaction.readiness_inputs(repositories, bindings, revisions, sides))
    return r.select(F.col("repository_id").cast("long").alias("c_custkey"), "readiness", "boundary_anchor_count", "boundary_anchor_missing_count")
