"""Lineage from a declared model through replica mappings to datamart columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean, file_stem, first_filled, fold_case, relation_leaf
from .keys import first_wins

#: fixed values: representations of a replica table, in output order, with the suffix of each
VARIANTS = {"base": "", "hist": "_hist", "delta": "_delta"}
#: fixed values: physical target statuses that need no note
SETTLED = ("confirmed_unique", "resolved", "confirmed")
#: fixed values: statuses and gap codes
MAPPING_AMBIGUOUS = "tsa_field_mapping_ambiguous"
MAPPING_NOT_FOUND = "tsa_field_mapping_not_found"
MAPPING_INEXACT = "tsa_mapping_not_observed_exact"
TARGET_AMBIGUOUS = "physical_target_relation_ambiguous"
NO_LINEAGE = "profile_confirmed_lineage_not_found"
NO_CANDIDATE = "profile_target_candidate_not_found"
RELATION_OPEN = "confirmed_lineage_target_relation_ambiguous"
ARROW = " → "


def resolve_objects(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """requests (requested) with the one object whose full or simple name it is. An object counts once, even if
    both names match. Adds candidate_count, status, object_id, fqcn."""
    names = objects.select("object_id", "fqcn", "name", F.explode(F.array_distinct(F.array(fold_case("fqcn"), fold_case("name")))).alias("key"))
    found = names.where("key != ''").groupBy("key").agg(F.count("*").alias("n"), F.first(F.struct("object_id", "fqcn", "name")).alias("o"))
    out = requests.join(found, fold_case("requested") == F.col("key"), "left")
    one = F.col("n") == 1
    return out.select(*requests.columns, F.coalesce("n", F.lit(0)).alias("candidate_count"), *[F.when(one, F.col(f"o.{c}")).alias(c) for c in ("object_id", "fqcn", "name")])


def resolve_fields(requests: DataFrame, fields: DataFrame) -> DataFrame:
    """requests (object_id, field) with the count of that object's fields of the name, in any case."""
    known = fields.groupBy("object_id", fold_case("name").alias("key")).agg(F.count("*").alias("field_count"), F.first("field_id").alias("field_id"))
    r = requests.withColumn("key", fold_case("field")).join(known, ["object_id", "key"], "left").drop("key")
    return r.withColumn("field_count", F.coalesce("field_count", F.lit(0))).withColumn("field_id", F.when(F.col("field_count") == 1, F.col("field_id")))


def attribute_paths(requests: DataFrame, bindings: DataFrame) -> DataFrame:
    """requests (object_id, name, field) with source_attribute_path: led by the incoming binding if there is just
    one distinct (owner, owner_field)."""
    b = bindings.select("object_id", clean("owner").alias("owner"), clean("owner_field").alias("owner_field")).where("owner != '' and owner_field != ''").distinct()
    one = b.groupBy("object_id").agg(F.count("*").alias("n"), F.first("owner").alias("owner"), F.first("owner_field").alias("owner_field"))
    own = F.concat_ws(".", "name", "field")
    path = F.when(F.col("n") == 1, F.concat(F.concat_ws(".", "owner", "owner_field"), F.lit(ARROW), own)).otherwise(own)
    return requests.join(one, "object_id", "left").withColumn("source_attribute_path", path).drop("n", "owner", "owner_field")


def gate_mappings(requests: DataFrame, mappings: DataFrame) -> DataFrame:
    """requests (fqcn, field) with the replica relation and column where exactly one complete mapping was observed,
    else gap and status. mappings: fqcn, field, relation, column, mapping_status."""
    m = mappings.groupBy("fqcn", "field").agg(F.count("*").alias("n"), F.first(F.struct(clean("relation").alias("relation"), clean("column").alias("column"), clean("mapping_status").alias("mapping_status"))).alias("m"))
    out = requests.join(m, ["fqcn", "field"], "left")
    n = F.coalesce("n", F.lit(0))
    whole = (F.col("m.relation") != "") & (F.col("m.column") != "") & (F.col("m.mapping_status") == "observed_exact")
    gap = F.when(n > 1, MAPPING_AMBIGUOUS).when(n == 0, MAPPING_NOT_FOUND).when(~whole, MAPPING_INEXACT)
    ok = (n == 1) & whole
    return out.select(
        *requests.columns, F.when(ok, F.col("m.relation")).alias("replica_relation"), F.when(ok, F.col("m.column")).alias("replica_column"),
        gap.alias("gap"), F.when(n > 1, "ambiguity").when(~ok, "gap").alias("status"),
    )


def variant_leaves(relation: Column) -> Column:
    """array<struct<leaf, variant>> of the names a replica relation may have."""
    return F.array(*[F.struct(relation_leaf(F.concat(relation, F.lit(s))).alias("leaf"), F.lit(v).alias("variant")) for v, s in VARIANTS.items()])


def variant_of(relation: Column, other: Column) -> Column:
    """base, hist, delta or null: which representation of relation the other name is."""
    leaf = relation_leaf(other)
    return F.coalesce(*[F.when(relation_leaf(F.concat(relation, F.lit(s))) == leaf, v) for v, s in VARIANTS.items()])


def admit_candidates(mapped: DataFrame, candidates: DataFrame) -> DataFrame:
    """mapped (replica_relation) x targets with a source match on any variant; columns decide later. candidates:
    logical_target_name, source_relation_matches array<struct<logical_name, relation_name>>."""
    leaves = candidates.where(clean("logical_target_name") != "").select(
        "logical_target_name", F.explode("source_relation_matches").alias("s")
    ).select("logical_target_name", relation_leaf(first_filled("s.logical_name", "s.relation_name")).alias("leaf")).distinct()
    wanted = mapped.withColumn("w", F.explode(variant_leaves(F.col("replica_relation")))).withColumn("leaf", F.col("w.leaf")).drop("w")
    return wanted.join(leaves, "leaf").drop("leaf").distinct()


def match_lineage(admitted: DataFrame, lineage: DataFrame) -> DataFrame:
    """Confirmed lineage that ends in the replica column on a known variant. History and delta rows count only
    where the same target has a base row. lineage: logical_target_name, lineage_id, target_column,
    terminal_relation, terminal_column, lineage_status."""
    good = lineage.where(fold_case("lineage_status") == "confirmed").withColumn("__column", fold_case("terminal_column"))
    rows = admitted.withColumn("__column", fold_case("replica_column")).join(good, ["logical_target_name", "__column"]).drop("__column")
    rows = rows.withColumn("variant", variant_of(F.col("replica_relation"), F.col("terminal_relation"))).where("variant is not null")
    anchor = F.max(F.col("variant") == "base").over(W.partitionBy("fqcn", "field", "logical_target_name"))
    return rows.withColumn("__base", anchor).where((F.col("variant") == "base") | F.col("__base")).drop("__base")


def physical_target(rows: DataFrame, resolutions: DataFrame) -> DataFrame:
    """target_relation, gap and status: the recommendation is shown, but several candidates or an unsettled
    status are noted, never promoted."""
    r = resolutions.select(
        "logical_target_name", clean("recommended_target_relation").alias("__rec"), F.array_distinct(F.filter("physical_relation_candidates", lambda x: clean(x) != "")).alias("__cand"),
        first_filled("physical_relation_recommendation_status", "physical_relation_status").alias("__status"),
    )
    out = rows.join(r, "logical_target_name", "left")
    gap = (
        F.when(F.coalesce(F.size("__cand"), F.lit(0)) > 1, TARGET_AMBIGUOUS)
        .when((F.coalesce("__status", F.lit("")) != "") & ~F.col("__status").isin(*SETTLED), F.concat(F.lit("physical_target_relation_"), F.col("__status"))).otherwise("")
    )
    out = out.withColumn("target_relation", first_filled("__rec", "target_relation_name", "logical_target_name")).withColumn("gap", gap)
    status = F.when(F.col("gap") == "", "confirmed").otherwise(RELATION_OPEN)
    return out.withColumn("status", status).drop("__rec", "__cand", "__status")


def dedupe_branches(rows: DataFrame) -> DataFrame:
    """Distinct branches stay: the key holds the lineage id, or the branch itself where there is none."""
    keyed = rows.withColumn("__k", F.xxhash64(fold_case("target_relation"), fold_case("target_column"), fold_case("terminal_relation"), "variant", first_filled("lineage_id", F.to_json("branch_path")))).withColumn(
        "__t", F.struct(fold_case("target_relation"), fold_case("target_column"), fold_case("terminal_relation"), F.col("variant"), first_filled("lineage_id", F.to_json("branch_path")))
    )
    return first_wins(keyed, ["fqcn", "field", "__k", "__t"], ["input_ordinal"]).drop("__k", "__t")


def transformation_path(steps: Column) -> Column:
    """Distinct expressions, source first. steps: array<struct<expression>>, target first."""
    return F.array_distinct(F.filter(F.transform(F.reverse(F.coalesce(steps, F.array().cast("array<struct<expression:string>>"))), lambda s: clean(s["expression"])), lambda x: x != ""))


def relation_paths(rows: DataFrame, materializations: DataFrame, key: str = "lineage_id") -> DataFrame:
    """key, relation_path and missing (ids not found). rows: key, terminal_relation, terminal_column, target_relation,
    target_column, branch_path array<struct<kind, materialization_id>> (target first). materializations:
    materialization_id, query_file, output_table_name; of repeated ids the last stands."""
    m = materializations.select(F.col("materialization_id").alias("mid"), file_stem("query_file").alias("stage"), clean("output_table_name").alias("table"), F.lit(True).alias("known"))
    steps = rows.select(key, F.posexplode("branch_path").alias("pos", "step")).where(clean("step.kind") == "observed_relation_materialization").select(key, "pos", clean("step.materialization_id").alias("mid"))
    found = steps.join(m, "mid", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("pos")).alias("o"), "mid", "stage", "table", "known"))).alias("steps"))
    out = rows.join(found, key, "left")
    begin = F.when(clean("terminal_relation") != "", F.array(F.concat_ws(".", clean("terminal_relation"), F.nullif(clean("terminal_column"), F.lit(""))))).otherwise(F.array().cast("array<string>"))
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))

    def add(acc: Column, s: Column) -> Column:
        stage, table = F.coalesce(s["stage"], F.lit("")), F.coalesce(s["table"], F.lit(""))
        grow = lambda xs, x, ok: F.when(ok & (x != "") & (relation_leaf(last(xs)) != F.lower(x)), F.concat(xs, F.array(x))).otherwise(xs)
        with_stage = grow(acc, stage, F.lower(stage) != F.lower(table))
        return grow(with_stage, table, F.lit(True))

    known = F.filter(F.coalesce("steps", F.array().cast("array<struct<o:int,mid:string,stage:string,table:string,known:boolean>>")), lambda s: F.coalesce(s["known"], F.lit(False)))
    walked = F.aggregate(known, begin, add)
    end = F.concat_ws(".", clean("target_relation"), F.nullif(clean("target_column"), F.lit("")))
    whole = F.when((clean("target_relation") != "") & (fold_case(last(walked)) != fold_case(end)), F.concat(walked, F.array(end))).otherwise(walked)
    missing = F.transform(F.filter(F.coalesce("steps", F.array().cast("array<struct<o:int,mid:string,stage:string,table:string,known:boolean>>")), lambda s: s["known"].isNull()), lambda s: s["mid"])
    return out.select(key, F.array_join(whole, ARROW).alias("relation_path"), missing.alias("missing"))


def source_fields(fields: DataFrame) -> DataFrame:
    """Distinct field names of each object in order of first position."""
    return fields.where(clean("name") != "").groupBy("object_id", clean("name").alias("field")).agg(F.min("input_ordinal").alias("position"))


def build_lineage(requests: DataFrame, mappings: DataFrame, candidates: DataFrame, lineage: DataFrame, resolutions: DataFrame) -> DataFrame:
    """A row per confirmed lineage of each request (fqcn, field), or its gap row."""
    gated = gate_mappings(requests, mappings)
    mapped = gated.where("gap is null").drop("gap", "status")
    admitted = admit_candidates(mapped, candidates)
    rows = dedupe_branches(physical_target(match_lineage(admitted, lineage), resolutions))
    shape = ["fqcn", "field", "replica_relation", "replica_column", "variant", "target_relation", "target_column", "terminal_relation", "lineage_id", "status", "gap"]
    seen = candidates.select(F.explode("source_relation_matches").alias("s")).select(relation_leaf(first_filled("s.logical_name", "s.relation_name")).alias("leaf")).distinct()
    reached = mapped.withColumn("w", F.explode(variant_leaves(F.col("replica_relation")))).join(seen, F.col("w.leaf") == seen["leaf"], "left_semi").select("fqcn", "field").distinct().withColumn("__seen", F.lit(True))
    lost = mapped.join(rows.select("fqcn", "field").distinct(), ["fqcn", "field"], "left_anti").join(reached, ["fqcn", "field"], "left")
    lost = lost.withColumn("gap", F.when(F.col("__seen"), NO_LINEAGE).otherwise(NO_CANDIDATE)).withColumn("status", F.lit("gap"))
    gaps = gated.where("gap is not null").unionByName(lost.drop("__seen"))
    return rows.select(*shape).unionByName(gaps.select("fqcn", "field", "replica_relation", "replica_column", "status", "gap"), allowMissingColumns=True)


def output_order() -> list[Column]:
    rank = F.array_position(F.array(*[F.lit(v) for v in VARIANTS]), F.col("variant"))
    return [fold_case("target_relation"), fold_case("target_column"), rank, fold_case("terminal_relation")]


