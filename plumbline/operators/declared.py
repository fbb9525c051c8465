"""Declared data models: effective fields through inheritance, schema references, coverage and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean
from .graph import reached
from .keys import AMBIGUOUS, CONFIRMED, resolve_unique

#: fixed values: reference states, the gap of a reference out of its document, coverage states
RESOLVED, UNRESOLVED = "resolved", "unresolved"
EXTERNAL_GAP, LOCAL_GAP = "external_schema_reference_not_resolved", "local_schema_reference_not_resolved"
NOT_APPLICABLE, PARTIAL, COMPLETE = "not_applicable", "partial", "complete"


def effective_fields(types: DataFrame, inheritance: DataFrame, fields: DataFrame) -> DataFrame:
    """(type_id, field_name, field_id, declaring_type_id, distance, declaration_count, status, inherited, complete): for each
    type the nearest declaration of every field name that it or a supertype declares.

    types: type_id; inheritance: subtype_id, supertype_id (null or empty where the expression was not resolved); fields:
    field_id, type_id, field_name. Several declarations at the least distance are ambiguous and none is picked; one that
    several ways reach counts once. Cycles end. complete is false where the type or a supertype extends something unresolved, so
    that fields may be missing or nearer. Rows without a type, a name or an id take no part; repeated rows count once.

    A name goes down from its declaration as a row and stops where a nearer one stands (`nearest_declarations`), so rows are types
    times names, not types times supertypes times declarations; nor are a type's supertypes listed for complete (`graph.reached`)."""
    known = types.select("type_id").where(clean("type_id") != "").distinct()
    edge = inheritance.where(clean("subtype_id") != "")
    up = edge.where(clean("supertype_id") != "").select(F.col("supertype_id").alias("src"), F.col("subtype_id").alias("dst")).distinct().checkpoint()
    open_ended = edge.where(clean("supertype_id") == "").select(F.col("subtype_id").alias("node"))
    partial = reached(up, open_ended).select(F.col("node").alias("type_id"), F.lit(False).alias("complete"))

    own = fields.where((clean("type_id") != "") & (clean("field_name") != "") & (clean("field_id") != "")).select(F.col("type_id").alias("owner"), "field_name", "field_id")
    at = nearest_declarations(up, own).withColumnRenamed("node", "type_id").join(known, "type_id", "left_semi")
    near = at.groupBy("type_id", "field_name").agg(F.max("distance").alias("distance"), F.count("*").alias("owners"), F.max("n").alias("n"), F.min(F.struct("field_id", "owner")).alias("first")).checkpoint()
    # only declarations of several types at one distance are met again: an id may stand in more than one of them
    several = at.join(near.where("owners > 1").select("type_id", "field_name"), ["type_id", "field_name"], "left_semi").select("type_id", "field_name", "owner")
    several = several.join(own, ["owner", "field_name"]).groupBy("type_id", "field_name").agg(F.count_distinct("field_id").alias("n"))
    columns = ["type_id", "field_name", "distance", "n", "first"]
    near = near.where("owners = 1").select(columns).union(near.where("owners > 1").drop("n").join(several, ["type_id", "field_name"]).select(columns))
    one = F.col("n") == 1
    return near.join(partial, "type_id", "left").select(
        "type_id", "field_name", F.when(one, F.col("first.field_id")).alias("field_id"), F.when(one, F.col("first.owner")).alias("declaring_type_id"), "distance",
        F.col("n").alias("declaration_count"), F.when(one, CONFIRMED).otherwise(AMBIGUOUS).alias("status"), (F.col("distance") > 0).alias("inherited"), F.coalesce("complete", F.lit(True)).alias("complete"),
    )


def nearest_declarations(edges: DataFrame, own: DataFrame) -> DataFrame:
    """node, field_name, owner, n, field_id, distance: for each name and node the owners at the least distance against which edges (src
    the supertype, dst the subtype) lead there, with the number of ids that declare it in the owner and the least of them.

    own: owner, field_name, field_id. Semi-naive: what is nearest to a node is nearest to some supertype one step closer, so a round
    extends only the last one's rows and drops names that a node has; fronts are checkpointed."""
    e = edges.select(F.col("src").alias("node"), "dst")
    front = own.groupBy("owner", "field_name").agg(F.count_distinct("field_id").alias("n"), F.min("field_id").alias("field_id"))
    front = front.select(F.col("owner").alias("node"), "field_name", "owner", "n", "field_id", F.lit(0).alias("distance")).checkpoint()
    known, hop = front, 0
    while not front.isEmpty():
        hop += 1
        below = front.join(e, "node").select(F.col("dst").alias("node"), "field_name", "owner", "n", "field_id")
        below = below.join(known.select("node", "field_name"), ["node", "field_name"], "left_anti").distinct()
        front = below.withColumn("distance", F.lit(hop)).checkpoint()
        known = known.union(front)
    return known


def pointer(ref: Column) -> Column:
    """The JSON pointer of a local reference, its escapes undone; null for any other."""
    return F.when(ref.startswith("#"), F.replace(F.replace(F.substring(ref, 2, 1_000_000), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))


def schema_references(references: DataFrame, schemas: DataFrame) -> DataFrame:
    """references with target_schema_id, status and gap.

    references: path (their document), literal_ref; schemas: path, locator (a pointer without #), schema_id. A local reference is
    resolved in its own document only, by exact pointer, if just one schema stands there; equal names elsewhere do not count. Any
    other reference keeps its literal and is a gap; nothing is read or guessed."""
    at = references.withColumn("__at", pointer(clean("literal_ref")))
    found = resolve_unique(at, schemas.select("path", pointer(F.concat(F.lit("#"), "locator")).alias("__at"), F.col("schema_id").alias("__id")), ["path", "__at"], "__id")
    gap = F.when(F.col("__at").isNull(), EXTERNAL_GAP).when(F.col("candidate_count") > 1, AMBIGUOUS).when(F.col("candidate_count") == 0, LOCAL_GAP)
    return found.select(*references.columns, F.col("candidate").alias("target_schema_id"), F.when(gap.isNull(), RESOLVED).otherwise(UNRESOLVED).alias("status"), gap.alias("gap"))


def schema_coverage(documents: DataFrame, references: DataFrame) -> DataFrame:
    """(path, reference_count, unresolved_count, coverage) per document: not applicable without a structured source, partial
    where it could not be parsed or a reference is open, else complete. documents: path, structured, parsed."""
    n = references.groupBy("path").agg(F.count("*").alias("r"), F.count_if(F.col("status") == UNRESOLVED).alias("u"))
    of = lambda c: F.coalesce(c, F.lit(0))
    state = F.when(~F.col("structured"), NOT_APPLICABLE).when(~F.col("parsed") | (of("u") > 0), PARTIAL).otherwise(COMPLETE)
    return documents.join(n, "path", "left").select("path", of("r").alias("reference_count"), of("u").alias("unresolved_count"), state.alias("coverage"))


def property_flags(fields: DataFrame) -> DataFrame:
    """fields with required (the owner's list names them) and nullable (said so, or null among the types): neither follows
    from the other. fields: field_name, owner_required and type_variants (arrays), nullable_flag."""
    has = lambda xs, x: F.coalesce(F.array_contains(xs, x), F.lit(False))
    return fields.withColumn("required", has("owner_required", F.col("field_name"))).withColumn("nullable", F.coalesce("nullable_flag", F.lit(False)) | has("type_variants", F.lit("null")))


def model_counts(types: DataFrame, fields: DataFrame, effective: DataFrame, relationships: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row of the materialised counts."""
    tables = {"type_count": types, "field_count": fields, "effective_field_count": effective, "relationship_count": relationships, "gap_count": gaps}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, df in tables.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in tables])
