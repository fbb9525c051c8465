"""Object search and the lookup tools over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean, digest, first_filled, fold_case
from .fuzzy import weighted_ratio
from .keys import page, sorted_set

#: fixed values: match kinds in rank order, the least fuzzy score and the least length of a substring query
KINDS, LEAST_FUZZY, LEAST_LENGTH = ("exact", "fts5", "fuzzy_candidate"), 65.0, 3
MOST_HITS = 1000
RECORD = ["record_kind", "record_id", "name", "parent", "file"]


def relation_records(relations: DataFrame) -> DataFrame:
    """Index rows of relations and of their fields. fields: array<struct<column_name, file>>."""
    rel = relations.select(F.lit("relation").alias("record_kind"), F.col("sql_relation_id").alias("record_id"), clean("relation_name").alias("name"), F.lit("").alias("parent"), clean("file").alias("file"))
    f = relations.select("sql_relation_id", "relation_name", F.explode("fields").alias("f"))
    return rel.unionByName(f.select(F.lit("field").alias("record_kind"), F.concat_ws(":", "sql_relation_id", "f.column_name").alias("record_id"), clean("f.column_name").alias("name"), clean("relation_name").alias("parent"), clean("f.file").alias("file")))


def model_records(types: DataFrame, fields: DataFrame) -> DataFrame:
    """Index rows of declared types and fields."""
    t = types.select(F.lit("declared_type").alias("record_kind"), F.col("type_id").alias("record_id"), first_filled("fqcn", "simple_name").alias("name"), F.lit("").alias("parent"), clean("file").alias("file"))
    f = fields.join(types.select("type_id", clean("fqcn").alias("parent")), "type_id")
    return t.unionByName(f.select(F.lit("declared_field").alias("record_kind"), F.col("field_id").alias("record_id"), clean("name").alias("name"), "parent", clean("file").alias("file")))


def mapping_records(mappings: DataFrame) -> DataFrame:
    """Index rows of replica mappings: the physical and the logical name each, if not empty."""
    names = F.array(F.struct(F.lit("replica").alias("k"), clean("physical_name").alias("n")), F.struct(F.lit("logical").alias("k"), clean("logical_name").alias("n")))
    m = mappings.select("mapping_id", "parent", "file", F.explode(names).alias("x")).where("x.n != ''")
    return m.select(F.concat(F.lit("mapping_"), F.col("x.k")).alias("record_kind"), F.concat_ws(":", "mapping_id", "x.k").alias("record_id"), F.col("x.n").alias("name"), clean("parent").alias("parent"), clean("file").alias("file")).distinct()


def search(records: DataFrame, query: str, limit: int, fuzzy: bool = True) -> DataFrame:
    """Best match of each record: exact name (any case), substring of name or file for queries of three characters
    or more, else a weighted ratio of 65 or more. Ranked by kind, score, name, record; truncated tells of more. A blank
    query and a limit that is not from 1 to MOST_HITS are refused."""
    query = query.strip()
    if query == "":
        raise ValueError("a search query cannot be blank")
    if not 1 <= limit <= MOST_HITS:
        raise ValueError(f"a limit is from 1 to {MOST_HITS}")
    q = F.lit(query)
    want = fold_case(q)
    exact = fold_case("name") == want
    part = F.lit(len(query) >= LEAST_LENGTH) & (fold_case("name").contains(want) | fold_case("file").contains(want))
    score = weighted_ratio(F.coalesce(F.col("name"), F.lit("")), q) if fuzzy else F.lit(0.0)
    kind = F.when(exact, 0).when(part, 1)
    if fuzzy:
        kind = kind.when(score >= LEAST_FUZZY, 2)
    hits = records.withColumn("__k", kind).where("__k is not null").withColumn("score", F.when(F.col("__k") < 2, F.lit(100.0)).otherwise(score))
    names = F.array(*[F.lit(k) for k in KINDS])
    hits = hits.withColumn("match_kind", F.element_at(names, F.col("__k") + 1))
    order = [F.col("__k"), F.col("score").desc(), F.col("name"), F.col("record_kind"), F.col("record_id")]
    top = hits.orderBy(*order).limit(limit + 1)
    top = top.withColumn("rank", F.row_number().over(W.orderBy(*order))).withColumn("truncated", F.count("*").over(W.partitionBy(F.lit(1))) > limit)
    return top.where(F.col("rank") <= limit).drop("__k")


def selection_ref(*fields: tuple[str, Column]) -> Column:
    """sha256 of an object's JSON with sorted keys and a blank after each separator."""
    text = [F.concat(F.lit(f'"{k}": '), F.coalesce(F.to_json(F.array(c)).substr(F.lit(2), F.char_length(F.to_json(F.array(c))) - 2), F.lit("null"))) for k, c in sorted(fields, key=lambda x: x[0])]
    return digest(F.concat(F.lit("{"), F.concat_ws(", ", *text), F.lit("}")))


def object_details(records: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (ref, record_id, name) with resolution and the found record: by ref, else by id, else by name."""
    r = requests.withColumn("__how", F.when(clean("ref") != "", "ref").when(clean("record_id") != "", "id").otherwise("name")).withColumn("__want", F.coalesce(F.nullif(clean("ref"), F.lit("")), F.nullif(clean("record_id"), F.lit("")), fold_case("name")))
    keys = records.select(F.explode(F.array(
        F.struct(F.lit("ref").alias("h"), F.col("selection_ref").alias("v")), F.struct(F.lit("id").alias("h"), F.col("record_id").alias("v")), F.struct(F.lit("name").alias("h"), fold_case("name").alias("v")),
    )).alias("k"), F.struct("record_kind", "record_id", "name", "parent").alias("found"))
    by = keys.groupBy(F.col("k.h").alias("__how"), F.col("k.v").alias("__want")).agg(F.count("*").alias("n"), F.min("found").alias("found"))
    out = r.join(by, ["__how", "__want"], "left")
    n = F.coalesce("n", F.lit(0))
    resolution = F.when(n == 0, "not_found").when(n > 1, "ambiguous").when(F.col("__how") == "name", "name_candidate").otherwise("exact_published_record")
    return out.select(*requests.columns, resolution.alias("resolution"), F.when(n == 1, F.col("found")).alias("found"))


def upstream(lineage: DataFrame) -> DataFrame:
    """Lineage rows, one per id; rows without an id all stay."""
    order = W.partitionBy("lineage_id").orderBy("input_ordinal")
    blank = clean("lineage_id") == ""
    return lineage.withColumn("__n", F.row_number().over(order)).where(blank | (F.col("__n") == 1)).drop("__n")


def downstream(candidates: DataFrame, relation: str, column: str) -> DataFrame:
    """Targets with a source match of exactly this relation and column. matches: array<struct<relation, column>>."""
    return candidates.where(F.exists("matches", lambda m: (fold_case(m["relation"]) == relation.strip().lower()) & (fold_case(m["column"]) == column.strip().lower())))


def attribute_lineage(lineage: DataFrame, relation: str, column: str, offset: int, limit: int) -> DataFrame:
    """A lossless page of a column's lineage."""
    rows = lineage.where((fold_case("target_relation") == relation.strip().lower()) & (fold_case("target_column") == column.strip().lower()))
    return page(rows, ["terminal_relation", "terminal_column", "lineage_id", "input_ordinal"], offset, limit)


def change_locations(rows: DataFrame) -> DataFrame:
    """file -> roles, lineage_ids, query_ids (sorted sets)."""
    return rows.where(clean("file") != "").groupBy("file").agg(sorted_set(F.col("role")).alias("roles"), sorted_set(F.col("lineage_id")).alias("lineage_ids"), sorted_set(F.col("query_id")).alias("query_ids"))


def calculation_logic(projections: DataFrame, query_id: str, output_name: str) -> DataFrame:
    return projections.where((F.col("query_id") == query_id) & (fold_case("output_name") == output_name.strip().lower()))


def evidence_page(records: DataFrame, order: list[str], index: int, size: int) -> DataFrame:
    """Records index+1 to index+size, by number."""
    rows = records.orderBy(*order).offset(index).limit(size)
    return rows.withColumn("record_index", F.row_number().over(W.orderBy(*order)) - 1 + index)


def unique_identity(mappings: DataFrame) -> DataFrame:
    """(relation, column) -> fqcn, field where exactly one logical identity stands behind it, with status."""
    who = F.struct("fqcn", "field")
    by = mappings.groupBy("relation", "column").agg(F.min(who).alias("least"), F.max(who).alias("most"))
    one = F.col("least") == F.col("most")
    return by.select("relation", "column", F.when(one, "available").otherwise("ambiguous_mapping").alias("status"), F.when(one, F.col("least.fqcn")).alias("fqcn"), F.when(one, F.col("least.field")).alias("field"))


def entity_context(requests: DataFrame, entities: DataFrame, flows: DataFrame) -> DataFrame:
    """requests (entity_id) with the entity's count and sorted flows; only an exact, unique id is available."""
    e = entities.groupBy("entity_id").agg(F.count("*").alias("n"))
    f = flows.groupBy("entity_id").agg(sorted_set(F.col("flow_id")).alias("flows"))
    out = requests.join(e, "entity_id", "left").join(f, "entity_id", "left")
    return out.select(*requests.columns, F.when(F.col("n") == 1, "available").when(F.col("n") > 1, "ambiguous").otherwise("not_found").alias("status"), "flows")


def execution_context(records: DataFrame, keys: DataFrame) -> DataFrame:
    """record_kind -> count and the first three ids of records whose key was observed. Counts are an aggregate with
    map-side combine; the rank limit is applied before the shuffle, so a kind of many records is no hot key."""
    seen = records.join(keys, "key", "left_semi")
    counts = seen.groupBy("record_kind").agg(F.count("*").alias("record_count"))
    n = F.row_number().over(W.partitionBy("record_kind").orderBy("record_id"))
    first = seen.select("record_kind", "record_id").withColumn("n", n).where("n <= 3").groupBy("record_kind").agg(F.array_sort(F.collect_list("record_id")).alias("sample"))
    return counts.join(first, "record_kind", "left")


def coverage(hits: DataFrame) -> DataFrame:
    return hits.agg(sorted_set(F.col("source")).alias("sources"), sorted_set(F.col("system_id")).alias("systems"))


#: fixed values: the public tools and their parameters
TOOLS = {
    "search_objects": ("query", "limit"), "get_object_details": ("ref", "record_id", "name"), "get_attribute_lineage": ("relation", "column", "offset", "limit"),
    "get_dependencies": ("relation", "column", "offset", "limit"), "find_change_locations": ("relation", "column"), "get_calculation_logic": ("query_id", "output_name"),
    "get_evidence": ("record_index", "page_size"),
}


def tool_catalogue() -> list[dict]:
    return [{"type": "function", "function": {"name": n, "parameters": {"type": "object", "properties": {p: {"type": "integer" if p in ("limit", "offset", "record_index", "page_size") else "string"} for p in ps}}}} for n, ps in TOOLS.items()]


