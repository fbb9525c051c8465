"""Logical model projected to its replica: tables, keys, fields, relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean, fold_case
from .graph import reached
from .keys import first_wins, require_none, sorted_set

#: fixed values: identity annotation -> (argument, key kind)
KEY_ANNOTATIONS = {
    "MetaEntity": ("id", "entity_id"),
    "MetaRootEntity": ("id", "root_entity_id"),
    "MetaVersionedEntity": ("id", "versioned_entity_id"),
    "MetaDictionary": ("code", "dictionary_code"),
    "MetaVersionedDictionary": ("code", "versioned_dictionary_code"),
}
#: fixed values: relationship statuses that do not count as resolved
UNRESOLVED = ("", "unresolved", "ambiguous", "not_found", "not_resolved")
EXACT = "observed_exact"
#: fixed values: statuses and gap codes
ENTITY_AMBIGUOUS = "tsa_entity_mapping_ambiguous"
ENTITY_WITHOUT_TABLE = "tsa_entity_mapping_missing_table"
SEVERAL_KEYS = "multiple_ucp_identity_annotations"
NO_KEY = "ucp_identity_annotation_not_observed"
KEY_NOT_LITERAL = "ucp_identity_annotation_has_no_literal_key_field"
KEY_FOREIGN = "ucp_identity_field_not_in_effective_fields"
KEY_AMBIGUOUS = "tsa_identity_field_mapping_ambiguous"
KEY_UNMAPPED = "tsa_identity_field_mapping_not_found"
KEY_WITHOUT_COLUMN = "tsa_identity_mapping_missing_physical_column"
KEY_CONFIRMED = "confirmed_declared_identity_mapped"
FIELD_AMBIGUOUS = "ucp_field_ambiguous"
FIELD_NOT_FOUND = "ucp_field_not_found"
NO_DESCRIPTION = "ucp_description_not_published"
SEVERAL_FIELDS = "ambiguous_multiple_ucp_fields"
COLUMN_AMBIGUOUS = "tsa_column_mapping_ambiguous"
PROJECTED = "confirmed_ucp_relationship_projected_to_replicas"
NO_PHYSICAL_JOIN = "physical_fk_join_not_observed"


def resolve_roots(roots: DataFrame, types: DataFrame) -> DataFrame:
    """root -> type_id: by full name, else by simple name; must match once."""
    by = lambda c: types.groupBy(fold_case(c).alias("key")).agg(F.count("*").alias("n"), F.first("type_id").alias("type_id")).where("key != ''")
    full, simple = by("fqcn"), by("simple_name")
    r = roots.withColumn("key", fold_case("root")).join(full, "key", "left")
    r = r.join(simple.select("key", F.col("n").alias("n2"), F.col("type_id").alias("type2")), "key", "left")
    out = r.select("root", F.coalesce("n", "n2", F.lit(0)).alias("matches"), F.coalesce("type_id", "type2").alias("type_id"))
    require_none(out.where("matches != 1"), "a root must name exactly one type")
    return out.select("root", "type_id")


def selected_types(types: DataFrame, relationships: DataFrame, roots: DataFrame | None) -> DataFrame:
    """type_id of all types, or of those that resolved relationships reach from the roots."""
    if roots is None:
        return types.select("type_id").distinct()
    good = relationships.where(~fold_case("resolution_status").isin(*UNRESOLVED))
    edges = good.select(clean("source_type_id").alias("src"), clean("target_type_id").alias("dst")).where("src != '' and dst != ''")
    return reached(edges, resolve_roots(roots, types).select(F.col("type_id").alias("node"))).select(F.col("node").alias("type_id"))


def exact_only(mappings: DataFrame) -> DataFrame:
    return mappings.where(clean("mapping_status") == EXACT)


def map_entities(types: DataFrame, entity_mappings: DataFrame) -> DataFrame:
    """types with entity_mapping_id, replica_relation and gap: no mapping is no row, several or no table is a gap."""
    m = exact_only(entity_mappings).groupBy(F.col("logical_type_name").alias("fqcn")).agg(F.count("*").alias("candidate_count"), F.first("mapping_id").alias("entity_mapping_id"), F.first(clean("physical_table_name")).alias("replica_relation"))
    gap = F.when(F.col("candidate_count") > 1, ENTITY_AMBIGUOUS).when(F.col("replica_relation") == "", ENTITY_WITHOUT_TABLE)
    return types.join(m, "fqcn").withColumn("gap", gap)


def literal_argument(arguments: Column, name: Column | str) -> Column:
    """Literal value of a named annotation argument, or null. arguments: array<struct<name, raw, literal_value>>."""
    raw = lambda a: clean(a["raw"])
    value = lambda a: F.coalesce(F.nullif(clean(a["literal_value"]), F.lit("")), F.when(raw(a).rlike(r'^".*"$') & (F.char_length(raw(a)) >= 2), F.substring(raw(a), F.lit(2), F.char_length(raw(a)) - 2)))
    named = lambda a: F.coalesce(F.nullif(clean(a["name"]), F.lit("")), F.lit("value"))
    want = F.lit(name) if isinstance(name, str) else name
    return F.nullif(F.try_element_at(F.transform(F.filter(arguments, lambda a: (named(a) == want) & value(a).isNotNull()), value), F.lit(-1)), F.lit(""))


def key_table(spark) -> DataFrame:
    return spark.createDataFrame([(a, k, v) for a, (k, v) in KEY_ANNOTATIONS.items()], "annotation_name string, argument string, key_kind string")


def map_keys(tables: DataFrame, annotations: DataFrame, effective_fields: DataFrame, field_mappings: DataFrame) -> DataFrame:
    """tables (type_id, fqcn, entity_mapping_id) with key annotation, kind, logical field, replica column, status and
    gap, and version and collocation columns. Only columns of the same entity mapping count."""
    kinds = F.broadcast(key_table(tables.sparkSession))  # five rows
    a = annotations.join(kinds, "annotation_name")
    args = F.col("arguments")
    a = a.groupBy("type_id").agg(
        F.count("*").alias("n"), F.first("annotation_name").alias("key_annotation"), F.first("key_kind").alias("key_kind"),
        F.first(literal_argument(args, F.col("argument"))).alias("key_field"), F.first(literal_argument(args, "version")).alias("version_field"),
        F.first(literal_argument(args, "collocationId")).alias("collocation_field"),
    )
    t = tables.join(a, "type_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    names = effective_fields.groupBy("type_id").agg(F.collect_set(clean("field_name")).alias("names"))
    columns = exact_only(field_mappings).groupBy(F.col("logical_type_name").alias("fqcn"), "entity_mapping_id", clean("logical_field_name").alias("f")).agg(F.count("*").alias("m"), F.first(clean("physical_column_name")).alias("c"))
    t = t.join(names, "type_id", "left")
    for name in ("key", "version", "collocation"):
        found = columns.select("fqcn", "entity_mapping_id", F.col("f").alias(f"{name}_field"), F.col("m").alias(f"{name}_m"), F.col("c").alias(f"{name}_c"))
        t = t.join(found, ["fqcn", "entity_mapping_id", f"{name}_field"], "left")
    one, field = F.col("n") == 1, F.col("key_field")
    foreign = (F.coalesce(F.size("names"), F.lit(0)) > 0) & ~F.array_contains("names", field)
    gap = (
        F.when(F.col("n") > 1, SEVERAL_KEYS).when(F.col("n") == 0, NO_KEY)
        .when(field.isNull(), KEY_NOT_LITERAL).when(F.coalesce(foreign, F.lit(False)), KEY_FOREIGN)
        .when(F.coalesce("key_m", F.lit(0)) > 1, KEY_AMBIGUOUS).when(F.coalesce("key_m", F.lit(0)) == 0, KEY_UNMAPPED)
        .when(F.col("key_c") == "", KEY_WITHOUT_COLUMN).otherwise("")
    )
    single = lambda name: F.when(one & (F.col(f"{name}_m") == 1), F.col(f"{name}_c")).otherwise("")
    return t.select(
        *tables.columns, F.when(one, F.col("key_annotation")).otherwise("").alias("key_annotation"), F.when(one, F.col("key_kind")).otherwise("").alias("key_kind"),
        F.when(one, F.coalesce("key_field", F.lit(""))).otherwise("").alias("key_logical_field"), F.when(gap == "", F.col("key_c")).otherwise("").alias("key_replica_column"),
        F.when(gap == "", KEY_CONFIRMED).otherwise("gap").alias("key_status"), gap.alias("key_gap"),
        single("version").alias("version_replica_column"), single("collocation").alias("collocation_replica_column"),
    )


def replica_fields(tables: DataFrame, field_mappings: DataFrame, fields: DataFrame, effective_fields: DataFrame) -> DataFrame:
    """Mapped (column, field) of each table with the declared field behind it: effective fields first, else the
    type's own; descriptions only from one field. Several fields on a column are ambiguous."""
    m = exact_only(field_mappings).select(F.col("logical_type_name").alias("fqcn"), "entity_mapping_id", clean("physical_column_name").alias("replica_column"), clean("logical_field_name").alias("field"), "mapping_id")
    m = m.where("replica_column != '' and field != ''")
    rows = first_wins(tables.select("type_id", "fqcn", "entity_mapping_id", "replica_relation").join(m, ["fqcn", "entity_mapping_id"]), ["type_id", "replica_column", "field"], ["mapping_id"])
    rows = rows.withColumn("fields_on_column", F.size(F.collect_set("field").over(W.partitionBy("type_id", "replica_column"))))
    inherited = effective_fields.where(clean("field_id") != "").groupBy("type_id", clean("field_name").alias("field")).agg(sorted_set(F.col("field_id")).alias("effective_ids"))
    own = fields.groupBy("type_id", clean("name").alias("field")).agg(sorted_set(F.col("field_id")).alias("own_ids"))
    rows = rows.join(inherited, ["type_id", "field"], "left").join(own, ["type_id", "field"], "left")
    rows = rows.withColumn("ids", F.coalesce(F.when(F.size("effective_ids") > 0, F.col("effective_ids")), "own_ids", F.array().cast("array<string>")))
    doc = fields.select(F.col("field_id").alias("one_id"), clean("description").alias("description"), clean("declared_type").alias("declared_type"))
    rows = rows.withColumn("one_id", F.when(F.size("ids") == 1, F.element_at("ids", 1))).join(doc, "one_id", "left")
    status = F.when(F.size("ids") > 1, FIELD_AMBIGUOUS).when(F.col("one_id").isNull() | F.col("description").isNull(), FIELD_NOT_FOUND).when(F.col("description") == "", NO_DESCRIPTION).otherwise("confirmed")
    ambiguous = F.col("fields_on_column") > 1
    return rows.withColumn("description_status", status).select(
        "replica_relation", "replica_column", "fqcn", "field", F.coalesce("declared_type", F.lit("")).alias("field_type"), F.coalesce("description", F.lit("")).alias("field_description"),
        "description_status", F.when(ambiguous, SEVERAL_FIELDS).otherwise(EXACT).alias("mapping_status"),
        F.when(ambiguous, COLUMN_AMBIGUOUS).when(F.col("description_status") == "confirmed", "").otherwise(F.col("description_status")).alias("gap"),
    )


def project_relationships(tables: DataFrame, relationships: DataFrame, fields: DataFrame) -> DataFrame:
    """Resolved relationships between mapped tables; a physical join is never claimed."""
    good = relationships.where(~fold_case("resolution_status").isin(*UNRESOLVED))
    side = lambda p: tables.select(F.col("type_id").alias(f"{p}_type_id"), F.col("fqcn").alias(f"{p}_fqcn"), F.col("replica_relation").alias(f"{p}_relation"), F.col("key_replica_column").alias(f"{p}_key"), F.col("key_status").alias(f"{p}_key_status"))
    out = good.join(side("source"), "source_type_id").join(side("target"), "target_type_id").join(fields.select("field_id", F.col("name").alias("relationship_field")), "field_id", "left")
    return out.select(
        "source_fqcn", "source_relation", "source_key", "source_key_status", F.coalesce("relationship_field", F.lit("")).alias("relationship_field"), "relationship_kind", "resolution_status",
        "target_fqcn", "target_relation", "target_key", "target_key_status", F.lit("not_observed").alias("physical_join_status"),
        F.lit(PROJECTED).alias("status"), F.lit(NO_PHYSICAL_JOIN).alias("gap"),
    )


def direction_index(relationships: DataFrame) -> DataFrame:
    """relation, direction, other: each relationship seen from both ends; a self-loop once, as outgoing."""
    s, t = F.col("source_relation"), F.col("target_relation")
    out = relationships.select(s.alias("relation"), F.lit("outgoing").alias("direction"), t.alias("other"))
    return out.unionByName(relationships.where(s != t).select(t.alias("relation"), F.lit("incoming").alias("direction"), s.alias("other")))


def build_replica_model(types: DataFrame, fields: DataFrame, effective_fields: DataFrame, relationships: DataFrame, annotations: DataFrame, entity_mappings: DataFrame, field_mappings: DataFrame, roots: DataFrame | None = None) -> dict[str, DataFrame]:
    chosen = types.join(selected_types(types, relationships, roots), "type_id", "left_semi")
    mapped = map_entities(chosen, entity_mappings)
    tables = map_keys(mapped.where("gap is null").drop("gap", "candidate_count"), annotations, effective_fields, field_mappings)
    cols = replica_fields(tables, field_mappings, fields, effective_fields)
    links = project_relationships(tables, relationships, fields)
    counts = tables.agg(F.count("*").alias("tables"), F.count_if(F.col("key_status") != "gap").alias("confirmed_keys"))
    return {"tables": tables, "fields": cols, "relationships": links, "gaps": mapped.where("gap is not null").select("fqcn", "gap", "candidate_count"), "counts": counts}
