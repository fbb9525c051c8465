"""Declared models bound to the driver's whole tables, each with DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import declared
from .evidence import name
from .queries import with_checkpoints
from .registry import query
from .tables import table

MODEL_SQL = """recursive e as (
  select c_custkey s, c_custkey // 2 t from customer where c_custkey > 1 and c_custkey % 10 <> 0 union all select c_custkey, c_custkey // 3 from customer where c_custkey > 0 and c_custkey % 6 = 0),
a(s, t, h) as (select c_custkey, c_custkey, cast(0 as bigint) from customer union select a.s, e.t, h + 1 from a join e on e.s = a.t),
m as (select s, t, min(h) h from a group by 1, 2),
f as (select o_custkey t, 'f' || (o_orderkey % 5) n, 'o' || o_orderkey id from orders),
x as (select s, n, h, count(distinct id) k, min(id) id, min(t) t from m join f using (t) group by 1, 2, 3 qualify row_number() over (partition by s, n order by h) = 1)"""


def declared_model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as types below half their number, and below a third of it too: long chains and diamonds; each tenth extends
    something unresolved. Orders are their fields, under five names."""
    with_checkpoints(spark)
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    up = lambda n: name("t", F.floor(k / n).cast("string"))
    first = c.where(k > 1).select(name("t", "c_custkey").alias("subtype_id"), F.when(k % 10 != 0, up(2)).alias("supertype_id"))
    second = c.where((k > 0) & (k % 6 == 0)).select(name("t", "c_custkey").alias("subtype_id"), up(3).alias("supertype_id"))
    fields = table(spark, d, "orders").select(name("o", "o_orderkey").alias("field_id"), name("t", "o_custkey").alias("type_id"), name("f", (F.col("o_orderkey") % 5).cast("string")).alias("field_name"))
    return c.select(name("t", "c_custkey").alias("type_id")), first.union(second), fields


@query(f"""with {MODEL_SQL}
select 't' || s type_id, n field_name, case when k = 1 then id end field_id, case when k = 1 then 't' || t end declaring_type_id, h distance, k declaration_count,
  case when k = 1 then 'confirmed' else 'ambiguous' end status, h > 0 inherited, s not in (select s from m where t > 1 and t % 10 = 0) complete from x""")
def effective_fields(spark: SparkSession, d: str) -> DataFrame:
    """D (declared model): every type's fields through inheritance, nearest declaration first."""
    return declared.effective_fields(*declared_model(spark, d))


@query(f"""with {MODEL_SQL}
select (select count(*) from customer) type_count, (select count(*) from f) field_count, (select count(*) from x) effective_field_count, (select count(*) from e) relationship_count,
  (select count(*) from customer where c_custkey > 1 and c_custkey % 10 = 0) gap_count""")
def declared_model_counts(spark: SparkSession, d: str) -> DataFrame:
    """D (declared model): the materialised counts; unresolved supertypes are the gaps."""
    types, inheritance, fields = declared_model(spark, d)
    known = F.col("supertype_id").isNotNull()
    return declared.model_counts(types, fields, declared.effective_fields(types, inheritance, fields), inheritance.where(known), inheritance.where(~known))


REFERENCE_SQL = """r as (select l_orderkey o, l_linenumber i, l_partkey p, case when l_returnflag = 'R' then 'https://x/S' || l_linenumber else '#/components/schemas/S~1' || (l_linenumber + 1) end ref from lineitem),
s as (select l_orderkey o, '#/components/schemas/S~1' || l_linenumber ref, count(distinct l_partkey) n, min(l_partkey) p from lineitem group by 1, 2),
x as (select r.o, i, r.p, r.ref, case when n = 1 then 's' || o || '-' || s.p end target_schema_id, case when r.ref like 'https%' then 'external_schema_reference_not_resolved' when n > 1 then 'ambiguous' when n is null then 'local_schema_reference_not_resolved' end gap
  from r left join s using (o, ref))"""


def references(spark: SparkSession, d: str) -> DataFrame:
    """Lines as schemas of their order's document that refer to the next line, or out of the document."""
    rows = table(spark, d, "lineitem")
    doc = name("d", "l_orderkey").alias("path")
    out = F.concat(F.lit("https://x/S"), F.col("l_linenumber").cast("string"))
    literal = F.when(F.col("l_returnflag") == "R", out).otherwise(F.concat(F.lit("#/components/schemas/S~1"), (F.col("l_linenumber") + 1).cast("string")))
    schemas = rows.select(doc, F.concat(F.lit("/components/schemas/S~1"), F.col("l_linenumber").cast("string")).alias("locator"), name("s", "l_orderkey", "l_partkey").alias("schema_id"))
    return declared.schema_references(rows.select(doc, "l_linenumber", "l_partkey", literal.alias("literal_ref")), schemas)


@query(f"""with {REFERENCE_SQL}
select 'd' || o "path", i l_linenumber, p l_partkey, ref literal_ref, target_schema_id, case when gap is null then 'resolved' else 'unresolved' end status, gap from x""")
def schema_references(spark: SparkSession, d: str) -> DataFrame:
    """D (declared model): references by pointer within a document, others as gaps."""
    return references(spark, d)


@query(f"""with {REFERENCE_SQL}, n as (select o, count(*) r, count(gap) u from x group by 1)
select 'd' || o_orderkey "path", coalesce(r, 0) reference_count, coalesce(u, 0) unresolved_count,
  case when o_orderstatus = 'P' then 'not_applicable' when o_orderpriority = '1-URGENT' or coalesce(u, 0) > 0 then 'partial' else 'complete' end coverage from orders left join n on o = o_orderkey""")
def schema_coverage(spark: SparkSession, d: str) -> DataFrame:
    """D (declared model): coverage per document."""
    docs = table(spark, d, "orders").select(name("d", "o_orderkey").alias("path"), (F.col("o_orderstatus") != "P").alias("structured"), (F.col("o_orderpriority") != "1-URGENT").alias("parsed"))
    return declared.schema_coverage(docs, references(spark, d))
