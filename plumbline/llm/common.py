"""Shared helpers: reading tables, intermediate tables in the cluster's shared folder, folds."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z and nothing else
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the cluster names none, only a local master (tests) gets a
    temporary one: elsewhere executors would write to their own disks, and the driver would read empty tables."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/plumbline-{spark.sparkContext.applicationId}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of df has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return a worker's free memory to the system at the end of a task: workers are kept for the next stage."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def row_count(staged: DataFrame) -> int:
    """Rows of a staged table, from its file footers."""
    return staged.count()


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint only where a count proves the bound; otherwise the plan stays a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once, however often body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id falls into fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % F.lit(modulus), F.lit(0)).cast("int")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)
