"""Building blocks: counted resolution, precedence, first and last wins, sets, conflicts, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONFIRMED, AMBIGUOUS, GAP = "confirmed", "ambiguous", "gap"


def status_of(count: Column) -> Column:
    return F.when(count == 1, CONFIRMED).when(count > 1, AMBIGUOUS).otherwise(GAP)


def candidate_counts(right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys -> candidate_count (distinct values that are neither null nor empty) and candidate, where it is the only one."""
    v = filled(F.col(value))
    n = right.groupBy(*keys).agg(F.count_distinct(v).cast("int").alias("candidate_count"), F.min(v).alias("candidate"))
    return n.withColumn("candidate", F.when(F.col("candidate_count") == 1, F.col("candidate")))


def resolve_unique(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """left with candidate_count, status and candidate (the value, if it is the only one of its key in right). No row is
    dropped or multiplied. The right side is counted before the join, so a hot key costs one row, and no left row
    carries a list; `candidate_lists` names the candidates, once per key."""
    out = left.join(candidate_counts(right, keys, value), list(keys), "left")
    out = out.withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))
    return out.withColumn("status", status_of(F.col("candidate_count")))


def candidate_lists(right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys -> candidates: their sorted distinct values, one row per key."""
    return right.groupBy(*keys).agg(sorted_set(F.col(value)).alias("candidates"))


def precedence(df: DataFrame, group: Sequence[str], flag: Column) -> DataFrame:
    """The flagged rows of each group that has any; all rows of the others."""
    direct = F.coalesce(flag, F.lit(False))
    return df.withColumn("__any", F.max(direct).over(W.partitionBy(*group))).where(direct | ~F.col("__any")).drop("__any")


def _pick(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in a stated total order."""
    return _pick(df, key, [F.col(c).asc() for c in order])


def last_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in a stated total order."""
    return _pick(df, key, [F.col(c).desc() for c in order])


def filled(c: Column) -> Column:
    return F.when(c.isNotNull() & (c.cast("string") != ""), c)


def sorted_set(c: Column) -> Column:
    """Aggregate: sorted distinct values that are neither null nor empty."""
    return F.array_sort(F.collect_set(filled(c)))


def ordered_distinct(position: Column, value: Column) -> Column:
    """Aggregate: distinct non-empty values in order of first position."""
    rows = F.array_sort(F.collect_list(F.when(filled(value).isNotNull(), F.struct(position.alias("p"), value.alias("v")))))
    return F.array_distinct(F.transform(rows, lambda r: r["v"]))


def conflicts(df: DataFrame, key: Sequence[str], same: Sequence[Column] | None = None) -> DataFrame:
    """Keys whose rows differ in the compared columns. Identical repeats are no conflict."""
    compared = list(same) if same is not None else [F.col(c) for c in df.columns if c not in key]
    shape = F.xxhash64(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(compared)]), {"ignoreNullFields": "false"}))
    return df.groupBy(*key).agg(F.min(shape).alias("a"), F.max(shape).alias("b"), F.count("*").alias("row_count")).where("a != b").drop("a", "b")


class ConflictError(ValueError):
    """Rows that must agree, or must be there, do not."""


def require_none(violations: DataFrame, message: str) -> None:
    """The one action of the guards: fails if there is any violation."""
    found = violations.limit(3).collect()
    if found:
        raise ConflictError(f"{message}: {[r.asDict() for r in found]}")


def page(df: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    """Rows offset+1 to offset+limit in a total order, with has_more and next_offset."""
    if offset < 0 or limit < 1:
        raise ValueError("offset must be 0 or more and limit 1 or more")
    rows = df.orderBy(*order).offset(offset).limit(limit + 1)
    n = F.row_number().over(W.orderBy(*order))
    more = F.count("*").over(W.partitionBy(F.lit(1))) > limit
    out = rows.withColumn("__n", n).withColumn("has_more", more).where(F.col("__n") <= limit).drop("__n")
    return out.withColumn("next_offset", F.when(F.col("has_more"), F.lit(offset + limit)))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "n") -> DataFrame:
    """df with a row's number, from 1, in a total order. Rows are sorted into ranges over the cluster and numbered in each; only
    the ranges' sizes, one row per partition, meet in one task. The sorted rows are checkpointed, so that ranges stay as they are."""
    ranged = df.orderBy(*order).withColumn("__range", F.spark_partition_id()).checkpoint()
    before = F.coalesce(F.sum("__size").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__size")).withColumn("__before", before).drop("__size")
    within = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return ranged.join(F.broadcast(sizes), "__range").withColumn(name, (within + F.col("__before")).cast("long")).drop("__range", "__before")


#: rows that a task is dealt at most, about
DEALT_ROWS = 500_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt by keys over the session's shuffle partitions, or if the number of rows is known over one for each DEALT_ROWS, and
    left so: rows that are few but meet many others, or grow to long lists, would be merged into a task or two by their bytes, or
    stay in the one task that read their file; and what a task holds must not grow with the table."""
    session = df.sparkSession
    n = int(session.conf.get("spark.sql.shuffle.partitions")) if rows is None else max(session.sparkContext.defaultParallelism, -(-rows // DEALT_ROWS))
    return df.repartition(n, *keys)


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("row_count"))
