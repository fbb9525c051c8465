"""Record sources: pinned revisions from files, paged sources, CSV and JSON documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import clean
from ..operators.keys import conflicts, require_none

#: words that are no pinned revision
MOVING = ("", "active", "latest")
PAGE, MAX_PAGES = 500, 100_000
#: fixed values: left statuses that count as evidence
EVIDENCE_STATUSES = ("exact_field", "confirmed")
COMPLETED = ("completed", "reused")


def check_pin(system_id: str, revision_id: str) -> None:
    if system_id.strip() == "" or revision_id.strip().lower() in MOVING:
        raise ValueError("a revision must be pinned by system and exact revision id")


def load_revision(spark: SparkSession, root: str, system_id: str, revision_id: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """One DataFrame per record kind, read from <root>/<kind>.parquet and pruned to the pinned revision."""
    check_pin(system_id, revision_id)
    pin = (F.col("system_id") == system_id) & (F.col("revision_id") == revision_id)
    return {k: spark.read.schema(s).parquet(f"{root.rstrip('/')}/{k}.parquet").where(pin) for k, s in schemas.items()}


def check_counts(tables: Mapping[str, DataFrame], manifest: Mapping[str, int]) -> None:
    """Rows read equal the manifest's record counts: a short or long read fails."""
    wrong = {k: (n, manifest.get(k)) for k, df in tables.items() if (n := df.count()) != manifest.get(k)}
    if wrong:
        raise ValueError(f"records read differ from the manifest: {wrong}")


class ReadCache:
    """Reads of pinned revisions, each made once per batch: kept under their whole identity, and never if they failed. The
    tables are persisted on the executors (lost parts are read again) until close."""

    def __init__(self) -> None:
        self.kept: dict[tuple, DataFrame] = {}
        self.hits = 0

    def read(self, kind: str, identity: tuple, get: Callable[[], DataFrame]) -> DataFrame:
        key = (kind, *identity)
        if key in self.kept:
            self.hits += 1
        else:
            self.kept[key] = get().persist()
        return self.kept[key]

    def close(self) -> None:
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()


class PageRange(InputPartition):
    def __init__(self, offset: int):
        self.offset = offset


class PagedReader(DataSourceReader):
    """One partition per page. fetch(offset, limit) -> {"total": n, "items": [tuples]}."""

    def __init__(self, fetch: Callable[[int, int], dict], limit: int):
        self.fetch, self.limit = fetch, limit
        self.total = fetch(0, 1)["total"]
        if not isinstance(self.total, int) or self.total < 0 or self.total > limit * MAX_PAGES:
            raise ValueError("the source tells no usable total")

    def partitions(self) -> list[InputPartition]:
        return [PageRange(o) for o in range(0, self.total, self.limit)] or [PageRange(0)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        page = self.fetch(partition.offset, self.limit)
        items = page.get("items")
        want = min(self.limit, max(0, self.total - partition.offset))
        if page.get("total") != self.total:
            raise ValueError("the total changed while reading")
        if not isinstance(items, list) or len(items) != want:
            raise ValueError(f"page at {partition.offset} has {len(items) if isinstance(items, list) else 'no'} items, not {want}")
        return iter(items)


def paged_source(name: str, fetch: Callable[[int, int], dict], schema: str, limit: int = PAGE) -> type[DataSource]:
    """A data source class to register; its pages are read by the workers, and every page is checked."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return PagedReader(fetch, limit)

    return Paged


class Chain(InputPartition):
    def __init__(self, key: tuple[str, ...]):
        self.key = key


class TokenReader(DataSourceReader):
    """One partition per chain of pages; a worker follows its tokens and passes items on page by page."""

    def __init__(self, fetch: Callable[[tuple[str, ...], str], dict], chains: list[tuple[str, ...]], width: int):
        self.fetch, self.chains, self.width = fetch, chains, width

    def partitions(self) -> list[InputPartition]:
        return [Chain(k) for k in self.chains]

    def read(self, partition: Chain) -> Iterator[tuple]:
        token, seen, complete = "", set(), True
        while True:
            listing = self.fetch(partition.key, token)
            items = listing.get("items")
            if not isinstance(items, list):
                complete = False
                break
            for item in items:
                if isinstance(item, tuple):
                    yield (*partition.key, *item, None)
            if not listing.get("truncated"):
                break
            token = str(listing.get("next_token") or "")
            if token == "" or token in seen:
                complete = False
                break
            seen.add(token)
        yield (*partition.key, *[None] * self.width, complete)


def token_source(name: str, fetch: Callable[[tuple[str, ...], str], dict], key: str, items: str, chains: list[tuple[str, ...]]) -> type[DataSource]:
    """A data source class over token-paged listings: rows of key and item columns, and one closing row per chain, with complete
    instead of an item. fetch(key, token) -> {"items": [tuples], "truncated": bool, "next_token": text}. A listing without items,
    and a token that is missing or comes again, end their chain as incomplete: that is a result, not an error."""
    width = len(T.StructType.fromDDL(items).fields)

    class Tokens(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"{key}, {items}, complete boolean"

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return TokenReader(fetch, chains, width)

    return Tokens


def catalogue(listed: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(items, manifest) of a token source: the items, and complete per chain. A chain that ended twice is complete only if
    it was both times. `value_nodes` joins them."""
    manifest = listed.where("complete is not null").groupBy(*key).agg(F.min("complete").alias("complete"))
    return listed.where("complete is null").drop("complete"), manifest


def observed_mappings(records: DataFrame, entities: DataFrame, logical_type: str | None = None, logical_field: str | None = None) -> DataFrame:
    """Field mappings by equality filters, with the physical table of their entity mapping if it is just one."""
    r = records
    if logical_type is not None:
        r = r.where(F.col("logical_type_name") == logical_type)
    if logical_field is not None:
        r = r.where(F.col("logical_field_name") == logical_field)
    one = entities.groupBy(F.col("mapping_id").alias("entity_mapping_id")).agg(F.count("*").alias("__n"), F.first("physical_table_name").alias("__t"))
    return r.join(one, "entity_mapping_id", "left").withColumn("physical_table_name", F.when(F.col("__n") == 1, F.col("__t"))).drop("__n", "__t")


def resolve_shape(tables: Mapping[str, DataFrame], kind: str, required: set[str]) -> DataFrame:
    """The table of the canonical name, else the only one that has all required columns."""
    if kind in tables:
        if missing := required - set(tables[kind].columns):
            raise ValueError(f"{kind} lacks {sorted(missing)}")
        return tables[kind]
    fits = [k for k, df in tables.items() if required <= set(df.columns)]
    if len(fits) != 1:
        raise ValueError(f"{kind}: {len(fits)} tables have its columns")
    return tables[fits[0]]


def value_nodes(nodes: DataFrame, manifest: DataFrame, node_kind: str, operation: str | None = None) -> DataFrame:
    """Nodes of a kind with the repository's complete flag; a repository without a manifest row is incomplete."""
    n = nodes.where(F.col("node_kind") == node_kind)
    if operation is not None:
        n = n.where(F.col("operation") == operation)
    return n.join(manifest.select("repo_id", "complete"), "repo_id", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))


def read_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """All columns as text; a byte order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("sep", separator).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def crossing_evidence(spark: SparkSession, path: str) -> DataFrame:
    e = read_csv(spark, path)
    return e.where(clean("left_status").isin(*EVIDENCE_STATUSES) & (clean("endpoint_key") != ""))


def interaction_rows(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ";")


def read_documents(spark: SparkSession, path: str, schema: str, envelope: str | None = None) -> DataFrame:
    """JSON documents: one, an array, or an array in an envelope field. A malformed document is an error."""
    if envelope is None:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    inner = spark.read.schema(f"{envelope} array<struct<{schema}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return inner.select(F.explode(envelope).alias("d")).select("d.*")


def remote_batches(manifest: DataFrame) -> DataFrame:
    """Completed entries of a batch manifest, (repository_id, repository_url, resolved_commit) checked; entries that
    differ under one id fail."""
    done = manifest.where(clean("status").isin(*COMPLETED)).select(clean("repository_id").alias("repository_id"), clean("repository_url").alias("repository_url"), clean("resolved_commit").alias("resolved_commit"))
    bad = done.where((F.col("repository_id") == "") | ~F.col("repository_url").rlike(r"^(https|ssh)://[^\s?#@]+$") | ~F.col("resolved_commit").rlike(r"^[0-9a-f]{40}([0-9a-f]{24})?$"))
    require_none(bad, "a batch entry has no safe url or exact commit")
    require_none(conflicts(done, ["repository_id"]), "batch entries differ under one id")
    return done.distinct()


def knowledge_item(items: DataFrame, item_id: str, max_bytes: int = 4_000_000) -> DataFrame:
    """One item by id; a body over the bound is refused."""
    found = items.where(F.col("item_id") == item_id)
    require_none(found.where(F.octet_length("body") > max_bytes).select("item_id"), "an item is larger than the bound")
    return found
