"""Results published as a whole: Parquet folders that Spark's own committer writes, made visible by one atomic step.

A path holds data/<unique>/ folders and versions/<n>, each naming the folders of one state. A writer reads the last version, writes
its rows beside it, and creates the next version's file, which must not exist: of two writers one wins, and the other
reads again what is stored before it tries once more. Readers see whole versions only; what a lost executor, a killed job or a
losing writer leaves behind is in no version, and a losing writer removes its own folder."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, digest
from ..operators.keys import conflicts, require_none

DATA, VERSIONS, HASH = "data", "versions", "content_hash"


class Files:
    """The few file operations of a published path, by the session's own file system."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm.org.apache.hadoop.fs
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.at = lambda *parts: jvm.Path("/".join([path.rstrip("/"), *parts]))
        self.fs = self.at().getFileSystem(self.conf)
        self.local = self.fs.getScheme() == "file"

    def versions(self) -> list[int]:
        root = self.at(VERSIONS)
        names = [s.getPath().getName() for s in self.fs.listStatus(root)] if self.fs.exists(root) else []
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, version: int) -> dict:
        stream = self.fs.open(self.at(VERSIONS, str(version)))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, version: int, body: dict) -> bool:
        """Create a version if it is not there yet: a link on a shared folder, else the file system's rename, which must refuse an
        existing file (HDFS does; an object store that overwrites needs a single writer)."""
        waiting, target = self.at(VERSIONS, f".{uuid.uuid4().hex}"), self.at(VERSIONS, str(version))
        self.fs.mkdirs(self.at(VERSIONS))
        out = self.fs.create(waiting)
        out.write(bytearray(json.dumps(body, sort_keys=True).encode()))
        out.close()
        try:
            if not self.local:
                return bool(self.fs.rename(waiting, target))
            os.link(waiting.toUri().getPath(), target.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            self.fs.delete(waiting, False)

    def remove(self, folder: str) -> None:
        self.fs.delete(self.at(DATA, folder), True)


def current(spark: SparkSession, path: str) -> tuple[Files, int, list[str]]:
    files = Files(spark, path)
    known = files.versions()
    return files, (known[-1] if known else 0), (files.read(known[-1])["folders"] if known else [])


def load(spark: SparkSession, path: str, folders: Sequence[str]) -> DataFrame:
    return spark.read.parquet(*[f"{path.rstrip('/')}/{DATA}/{f}" for f in folders])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last version; a path without one fails."""
    _, version, folders = current(spark, path)
    if version == 0:
        raise ValueError(f"nothing is published at {path}")
    return load(spark, path, folders).drop(HASH)


def publish(spark: SparkSession, path: str, build: Callable[[DataFrame | None], DataFrame], replace: bool = False) -> int:
    """Write build(rows of the last version, None before the first) and publish it beside those rows, or instead of them.
    Returns the number of rows written; none make no version unless they replace. A lost race starts again from what the winner stored."""
    while True:
        files, version, folders = current(spark, path)
        folder = uuid.uuid4().hex
        try:
            build(load(spark, path, folders) if folders else None).write.parquet(f"{path.rstrip('/')}/{DATA}/{folder}")
            n = load(spark, path, [folder]).count()
        except BaseException:
            files.remove(folder)
            raise
        # What fails from here on keeps the folder: its version may be there already.
        done = (n == 0 and not replace) or files.create(version + 1, {"folders": [folder] if replace else [*folders, folder]})
        if (n == 0 and not replace) or not done:
            files.remove(folder)
        if done:
            return n


def write_new_keys(results: DataFrame, path: str, key: Sequence[str]) -> int:
    """Publish the results whose key is not stored yet, once each; a key that is stored, or given twice, with another content
    fails and stores nothing. Returns the number of new rows. A repeated run changes nothing, and writers at once store no key twice."""
    keys = list(key)
    hashed = results.withColumn(HASH, digest(F.to_json(F.struct(*sorted(results.columns)), {"ignoreNullFields": "false"})))

    def new(old: DataFrame | None) -> DataFrame:
        require_none(conflicts(hashed, keys, [F.col(HASH)]), "results differ under one key")
        if old is None:
            return hashed.dropDuplicates(keys)
        both = hashed.join(old.select(*keys, F.col(HASH).alias("__old")), keys, "left")
        require_none(both.where(F.col("__old") != F.col(HASH)).select(*keys), "a stored result differs from the new one under its key")
        return both.where("__old is null").drop("__old").dropDuplicates(keys)

    return publish(results.sparkSession, path, new)


def pending(packages: DataFrame, path: str, key: str, same: Sequence[str], terminal: Sequence[str]) -> DataFrame:
    """The packages without a stored result, to be run now. A stored result that differs in a column of `same`, or whose status
    is not terminal, fails: it is neither reused nor replaced."""
    spark = packages.sparkSession
    if current(spark, path)[1] == 0:
        return packages
    stored = read(spark, path).select(key, "status", *[F.col(c).alias(f"__{c}") for c in same])
    both = packages.select(key, *same).join(stored, key)
    for c in same:
        require_none(both.where(~F.col(c).eqNullSafe(F.col(f"__{c}"))).select(key), f"a stored result does not match {c}")
    require_none(both.where(~F.coalesce(F.col("status").isin(*terminal), F.lit(False))).select(key), "a stored result is not terminal")
    return packages.join(stored.select(key), key, "left_anti")


def batch_manifest(results: DataFrame, invoked: int) -> DataFrame:
    """One row of a run: packages, those run now, those resumed, and the counts by status."""
    by = results.groupBy("status").agg(F.count("*").alias("n"))
    all_of = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("package_count"), F.array_sort(F.collect_list(F.struct("status", "n"))).alias("xs"))
    return all_of.select("package_count", F.lit(invoked).alias("invocation_count"), (F.col("package_count") - invoked).alias("resumed_count"), F.map_from_entries("xs").alias("status_counts"))


def publish_sql(rendered: DataFrame, path: str) -> DataFrame:
    """Publish restored queries (query_id, sql, sha256, bytes) and return the report. Queries of this run replace what was stored
    of them, so one that fails now has no statement any more; queries of other runs stay. rendered: query_id, sql, status."""
    restored = F.col("status") == "restored"
    text = F.when(restored, F.col("sql"))
    report = rendered.select("query_id", "status", clean("reason").alias("reason") if "reason" in rendered.columns else F.lit("").alias("reason"), F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"))
    require_none(conflicts(rendered.select("query_id", "status", "sql"), ["query_id"]), "a query was rendered in two ways")

    def state(old: DataFrame | None) -> DataFrame:
        now = rendered.where(restored).select("query_id", "sql", F.sha2("sql", 256).alias("sha256"), F.octet_length("sql").cast("long").alias("bytes")).dropDuplicates(["query_id"])
        return now if old is None else old.join(rendered.select("query_id"), "query_id", "left_anti").unionByName(now)

    publish(rendered.sparkSession, path, state, replace=True)
    return report.distinct()


def verify_sql(spark: SparkSession, path: str) -> None:
    """Every stored statement has the bytes and the hash that were published with it."""
    rows = read(spark, path)
    require_none(rows.where((F.sha2("sql", 256) != F.col("sha256")) | (F.octet_length("sql") != F.col("bytes"))).select("query_id"), "a stored statement was changed")
