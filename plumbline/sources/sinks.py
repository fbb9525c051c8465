"""Result sinks: CSV with fixed columns, graphs as text, audits. Results per key are in `published`."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, digest, tri_state, verbatim
from ..operators.keys import count_by
from ..operators.replica import KEY_CONFIRMED, PROJECTED
from ..operators.source_target import ROW_COLUMNS

BOM = "﻿"
#: fixed values: the columns that order rows first
ROW_KEY = ("T-trg-schema", "T-trg", "T-trg-f", "T-src-schema", "T-src", "T-src-f-name")


def quoted(c: Column, separator: str) -> Column:
    text = verbatim(c)
    return F.when(text.rlike(f'["\n\r{separator}]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, columns: list[str], separator: str = ",") -> DataFrame:
    """(line): the columns in order, missing ones empty, arrays joined by ;."""
    kinds = dict(df.dtypes)
    value = lambda c: F.lit("") if c not in kinds else F.array_join(F.col(f"`{c}`"), ";") if kinds[c].startswith("array") else F.col(f"`{c}`")
    return df.select(F.concat_ws(separator, *[quoted(value(c), separator) for c in columns]).alias("line"))


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[Column | str], separator: str = ",", bom: bool = False, second_row: list[str] | None = None) -> None:
    """One sorted file: header, perhaps a description row, rows. The parts are sorted by the cluster; one task writes."""
    spark = df.sparkSession
    head = (BOM if bom else "") + separator.join(columns)
    top = [(0, head)] + ([(1, separator.join(second_row))] if second_row else [])
    kept = df.withColumn("__order", F.struct(*[F.expr(o) if isinstance(o, str) else o for o in order]))
    body = kept.select(F.col("__order"), *[F.col(f"`{c}`") for c in df.columns]).orderBy("__order")
    lines = csv_lines(body, columns, separator)
    first = spark.createDataFrame(top, "n int, line string").orderBy("n").select("line").coalesce(1)
    first.union(lines).coalesce(1).write.mode("overwrite").text(path)


def write_rows(df: DataFrame, path: str, descriptions: list[str]) -> None:
    """The 26-column table with its description row; a wrong width fails."""
    if len(descriptions) != len(ROW_COLUMNS) or list(df.columns) != list(ROW_COLUMNS):
        raise ValueError("a row has 26 columns in a fixed order")
    write_csv(df, path, list(ROW_COLUMNS), row_order(), second_row=descriptions)


def row_order() -> list[Column]:
    """Target schema, table and field, source schema, table and field, then the whole row."""
    return [F.col(f"`{c}`") for c in (*ROW_KEY, *ROW_COLUMNS)]


def compact_status(c: str, confirmed: str) -> Column:
    return F.when(clean(c) == confirmed, "confirmed").otherwise(clean(c))


def key_rows(tables: DataFrame) -> DataFrame:
    """The key report of a replica model's tables."""
    columns = F.when(clean("key_replica_column") == "", F.array().cast("array<string>")).otherwise(F.array(clean("key_replica_column")))
    return tables.select(
        F.col("replica_relation").alias("table"), columns.alias("logical_pk"), "key_kind", compact_status("key_status", KEY_CONFIRMED).alias("logical_pk_status"),
        F.lit("not_observed").alias("physical_pk_status"), F.col("key_gap").alias("gap"),
    )


def link_rows(relationships: DataFrame) -> DataFrame:
    """The link report of a replica model's relationships."""
    key = F.when(clean("target_key") == "", F.array().cast("array<string>")).otherwise(F.array(clean("target_key")))
    return relationships.select(
        F.col("source_relation").alias("source_table"), F.col("relationship_field").alias("relationship"), F.col("target_relation").alias("target_table"), key.alias("target_logical_pk"),
        compact_status("status", PROJECTED).alias("logical_link_status"), F.col("physical_join_status").alias("physical_fk_status"),
    )


def write_replica_model(model: dict[str, DataFrame], path: str) -> None:
    """The five reports of a replica model as CSV files under path; lists are joined by semicolons."""
    reports = {
        "tables": (model["tables"], ["replica_relation", "fqcn", "key_annotation", "key_kind", "key_logical_field", "key_replica_column", "key_status", "key_gap"]),
        "fields": (model["fields"], ["replica_relation", "replica_column", "fqcn", "field", "field_type", "field_description", "description_status", "mapping_status", "gap"]),
        "relationships": (model["relationships"], ["source_relation", "relationship_field", "relationship_kind", "target_relation", "target_key", "status", "physical_join_status", "gap"]),
        "keys": (key_rows(model["tables"]), ["table", "logical_pk", "key_kind", "logical_pk_status", "physical_pk_status", "gap"]),
        "links": (link_rows(model["relationships"]), ["source_table", "relationship", "target_table", "target_logical_pk", "logical_link_status", "physical_fk_status"]),
    }
    for name, (df, columns) in reports.items():
        write_csv(df, f"{path.rstrip('/')}/{name}", columns, [F.col(c) for c in columns])


def audit(gaps: DataFrame, rows: DataFrame, retrieval: dict | None = None) -> str:
    """JSON of row and gap counts by type."""
    by = {r["gap_type"]: r["row_count"] for r in count_by(gaps, "gap_type").collect()}
    body = {"row_count": rows.count(), "gap_count": sum(by.values()), "gaps_by_type": dict(sorted(by.items()))}
    return json.dumps(body | ({"retrieval": retrieval} if retrieval else {}), ensure_ascii=False, sort_keys=True)


def node_id(*parts: Column, algorithm: str = "sha256", length: int = 16) -> Column:
    joined = F.concat_ws("\0", *[verbatim(p) for p in parts])
    return F.concat(F.lit("n"), F.substring(F.sha1(joined) if algorithm == "sha1" else digest(joined), 1, length))


def label(c: Column) -> Column:
    return F.concat(F.lit('["'), F.replace(verbatim(c), F.lit('"'), F.lit("'")), F.lit('"]'))


def dependency_graph(edges: DataFrame) -> DataFrame:
    """(line) of a flow graph, each once: solid arrows where the statistic is not known to be unsupported, else dotted."""
    a = node_id(F.col("producer_system"), F.col("producer_revision"), F.col("producer_flow_id"))
    b = node_id(F.col("consumer_system"), F.col("consumer_revision"), F.col("consumer_flow_id"))
    e = edges.select(
        F.concat(F.lit("  "), a, label(F.col("producer_flow_id"))).alias("l1"), F.concat(F.lit("  "), b, label(F.col("consumer_flow_id"))).alias("l2"),
        F.concat(F.lit("  "), a, F.when(tri_state("stat_supported"), " --> ").otherwise(" -.-> "), b).alias("l3"),
    )
    lines = F.array(*[F.struct(F.lit(n).alias("n"), F.col(c).alias("line")) for n, c in ((0, "l1"), (0, "l2"), (1, "l3"))])
    return e.select(F.explode(lines).alias("x")).select("x.*").distinct().orderBy("n", "line").select("line")


def replica_graph(relationships: DataFrame) -> DataFrame:
    a, b = (node_id(F.col(c), algorithm="sha1", length=10) for c in ("source_relation", "target_relation"))
    e = relationships.select(F.concat(F.lit("  "), a, label(F.col("source_relation")), F.lit(" -->|"), clean("relationship_field"), F.lit("| "), b, label(F.col("target_relation"))).alias("line"))
    return e.distinct().orderBy("line")


def graph_text(lines: DataFrame, direction: str = "LR") -> str:
    """The whole graph as text: for graphs that a person reads."""
    return "\n".join([f"flowchart {direction}", *[r["line"] for r in lines.toLocalIterator()]]) + "\n"


def write_sql_files(rendered: DataFrame, path: str) -> None:
    """One text row per restored query under query_id=<id>; unresolved ones have no file."""
    rendered.where("status = 'restored'").select("query_id", "sql").write.mode("overwrite").partitionBy("query_id").text(path)


def progress_line(event: str, **fields) -> str:
    return json.dumps({"event": event, **fields}, ensure_ascii=False, sort_keys=True)
