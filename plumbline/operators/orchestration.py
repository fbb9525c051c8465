"""Cross-revision topology of orchestration flows.

A record set per kind, each row with system_id and revision_id. Links across revisions need an exact
(profile, entity) key and a published statistic; missing and ambiguous producers are reported, never promoted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import verbatim
from .keys import dealt, last_wins, precedence, require_none

#: fixed values: the record kinds a revision must publish
RECORD_KINDS = ("ctl_flow", "ctl_flow_entity", "ctl_trigger", "ctl_dependency", "ctl_dependency_gap", "ctl_entity", "ctl_schedule", "ctl_lock")
#: fixed values: relations by which a flow produces an entity; the first is the direct one
DIRECT, LINKED = "published_entity", "linked_entity"
#: fixed values: statuses
UNIQUE, AMBIGUOUS, NO_STATISTIC, HALF_WIRE, NO_IDENTITY = (
    "resolved_unique", "ambiguous_multiple", "statistic_not_confirmed", "external_half_wire", "unresolved_trigger_identity",
)
REVISION = ["system_id", "revision_id"]


def check_revisions(revisions: DataFrame, records: Mapping[str, DataFrame]) -> None:
    """A system is pinned once, and every record kind is there."""
    missing = [k for k in RECORD_KINDS if k not in records]
    if missing:
        raise ValueError(f"record kinds are missing: {missing}")
    require_none(revisions.groupBy("system_id").count().where("count > 1"), "a system is pinned more than once")


def statistics(c: Column) -> Column:
    """Set of statistics in a JSON array text; anything else is empty."""
    return F.array_distinct(F.coalesce(F.from_json(c, "array<string>"), F.expr("cast(array() as array<string>)")))


def active_producers(flows: DataFrame, flow_entities: DataFrame) -> DataFrame:
    """Rows by which an active flow produces a fully keyed entity."""
    active = flows.where("active").select(*REVISION, verbatim("flow_id").alias("flow_id")).distinct()
    fe = flow_entities.where(F.col("active") & F.col("relation").isin(DIRECT, LINKED))
    fe = fe.withColumn("flow_id", verbatim("flow_id")).withColumn("profile", verbatim("profile")).withColumn("entity_id", verbatim("entity_id"))
    return fe.where("profile != '' and entity_id != ''").join(active, [*REVISION, "flow_id"], "left_semi")


def select_producers(producers: DataFrame) -> DataFrame:
    """Direct declarations take precedence inside a revision; a flow counts once, its last row wins."""
    key = ["profile", "entity_id", *REVISION]
    return last_wins(precedence(producers, key, F.col("relation") == DIRECT), [*key, "flow_id"], ["input_ordinal"])


def eligible_triggers(triggers: DataFrame, flows: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Active triggers of active flows that no local dependency resolves."""
    active = flows.where("active").select(*REVISION, verbatim("flow_id").alias("flow_id")).distinct()
    local = dependencies.select(*REVISION, verbatim("trigger_id").alias("trigger_id")).distinct()
    t = triggers.where("active")
    for c in ("flow_id", "trigger_id"):
        t = t.withColumn(c, verbatim(c))
    t = t.select("*", verbatim("upstream_profile").alias("profile"), verbatim("upstream_entity_id").alias("entity_id"), verbatim("statistic_id").alias("statistic"))
    return t.join(active, [*REVISION, "flow_id"], "left_semi").join(local, [*REVISION, "trigger_id"], "left_anti")


def resolve_triggers(triggers: DataFrame, producers: DataFrame) -> DataFrame:
    """triggers (profile, entity_id, statistic) with confirmed_count, external_count, status and candidate_revisions.
    producers: profile, entity_id, system_id, revision_id, flow_id, published (array).

    Producers are counted per key, revision and statistic (with map-side combine; a row without statistic counts them
    all), and the counts gathered per key. A trigger meets one row, whose size is that of the pinned revisions and
    their statistics, never of the producers; the producers are read once."""
    key = ["profile", "entity_id"]
    marked = F.array_append(F.array_distinct(F.array_compact("published")), F.lit(None).cast("string"))
    counted = producers.select(*key, *REVISION, F.explode(marked).alias("stat")).groupBy(*key, *REVISION, "stat").agg(F.count("*").alias("n"))
    by_key = counted.groupBy(*key).agg(F.collect_list(F.struct(*REVISION, "stat", "n")).alias("__all"))
    none = F.array().cast("array<struct<system_id:string,revision_id:string,stat:string,n:bigint>>")
    t = triggers.join(by_key, key, "left")
    other = F.filter(F.coalesce("__all", none), lambda p: (p["system_id"] != F.col("system_id")) | (p["revision_id"] != F.col("revision_id")))
    t = t.withColumn("__other", other)
    total = lambda keep: F.aggregate(F.filter("__other", keep), F.lit(0).cast("bigint"), lambda a, p: a + p["n"])
    blank = (F.col("profile") == "") | (F.col("entity_id") == "") | (F.col("statistic") == "")
    t = t.withColumn("confirmed_count", F.when(blank, 0).otherwise(total(lambda p: p["stat"] == F.col("statistic"))).cast("int"))
    t = t.withColumn("external_count", total(lambda p: p["stat"].isNull()).cast("int"))
    n = F.col("confirmed_count")
    status = F.when(blank, NO_IDENTITY).when(n == 1, UNIQUE).when(n > 1, AMBIGUOUS).when(F.col("external_count") > 0, NO_STATISTIC).otherwise(HALF_WIRE)
    seen = F.array_sort(F.array_distinct(F.transform(F.filter("__other", lambda p: p["stat"].isNull()), lambda p: F.concat_ws("@", p["system_id"], p["revision_id"]))))
    return t.withColumn("status", status).withColumn("candidate_revisions", F.when(blank, F.slice(seen, 1, 0)).otherwise(seen)).drop("__all", "__other")


def local_edges(dependencies: DataFrame) -> DataFrame:
    """Published local dependencies, with the status they have."""
    t = verbatim
    return dependencies.select(
        F.lit("repository_local").alias("kind"), t("resolution_status").alias("status"),
        F.col("system_id").alias("producer_system"), F.col("revision_id").alias("producer_revision"),
        t("producer_flow_id").alias("producer_flow_id"), F.col("system_id").alias("consumer_system"), F.col("revision_id").alias("consumer_revision"),
        t("consumer_flow_id").alias("consumer_flow_id"), t("profile").alias("profile"), t("entity_id").alias("entity_id"), t("statistic_id").alias("statistic_id"),
        F.col("producer_stat_supported").alias("stat_supported"), F.coalesce(F.col("producer_candidate_count"), F.lit(0)).cast("int").alias("producer_candidates"),
        t("trigger_id").alias("trigger_id"),
    )


def cross_edges(resolved: DataFrame, producers: DataFrame) -> DataFrame:
    """An edge for each confirmed producer, also of ambiguous triggers."""
    p = producers.select("profile", "entity_id", F.explode(F.array_distinct("published")).alias("statistic"), F.col("system_id").alias("producer_system"), F.col("revision_id").alias("producer_revision"), F.col("flow_id").alias("producer_flow_id"))
    e = resolved.where("confirmed_count > 0").join(p, ["profile", "entity_id", "statistic"]).where("producer_system != system_id or producer_revision != revision_id")
    return e.select(
        F.lit("cross_revision").alias("kind"), "status", "producer_system", "producer_revision", "producer_flow_id", F.col("system_id").alias("consumer_system"), F.col("revision_id").alias("consumer_revision"),
        F.col("flow_id").alias("consumer_flow_id"), "profile", "entity_id", F.col("statistic").alias("statistic_id"), F.lit(True).alias("stat_supported"),
        F.col("confirmed_count").alias("producer_candidates"), "trigger_id",
    )


def trigger_gaps(resolved: DataFrame) -> DataFrame:
    """A gap for every trigger that is not resolved to one producer."""
    return resolved.where(F.col("status") != UNIQUE).select(
        F.col("system_id").alias("consumer_system"), F.col("revision_id").alias("consumer_revision"), F.col("flow_id").alias("consumer_flow_id"), "trigger_id",
        "status", "profile", "entity_id", F.col("statistic").alias("statistic_id"), F.col("confirmed_count").alias("producer_candidates"), "candidate_revisions",
    )


def build_topology(revisions: DataFrame, records: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """edges, gaps, flows and counts of pinned revisions. Producers and resolved triggers are checkpointed (the session needs
    a checkpoint folder): edges, gaps and counts all read them. What produces an entity is dealt by it, a bounded number a task, and
    neither ranking moves it again."""
    check_revisions(revisions, records)
    flows = records["ctl_flow"]
    entities = records["ctl_flow_entity"]
    active = dealt(active_producers(flows, entities), "profile", "entity_id", rows=entities.count())
    producers = select_producers(active).withColumn("published", statistics(F.col("published_stats_json"))).checkpoint()
    resolved = resolve_triggers(eligible_triggers(records["ctl_trigger"], flows, records["ctl_dependency"]), producers).checkpoint()
    edges = local_edges(records["ctl_dependency"]).unionByName(cross_edges(resolved, producers))
    gaps = trigger_gaps(resolved)
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    counts = n(revisions, "revisions").union(n(flows, "flows")).union(n(edges, "edges")).union(n(gaps, "gaps"))
    return {"edges": edges, "gaps": gaps, "flows": flows, "counts": counts}


def dependency_table(edges: DataFrame, gaps: DataFrame, flows: DataFrame) -> DataFrame:
    """One table of dependencies, gaps and the flows that take no part in either."""
    # both ends of an edge from one reading of the edges
    end = lambda side: F.struct(F.col(f"{side}_system").alias("system_id"), F.col(f"{side}_revision").alias("revision_id"), F.col(f"{side}_flow_id").alias("flow_id"))
    ends = edges.select(F.explode(F.array(end("producer"), end("consumer"))).alias("end")).select("end.*")
    ends = ends.union(gaps.select("consumer_system", "consumer_revision", "consumer_flow_id")).distinct()
    alone = flows.withColumn("flow_id", verbatim("flow_id")).join(ends, [*REVISION, "flow_id"], "left_anti")
    rows = edges.withColumn("row_kind", F.lit("dependency")).unionByName(gaps.drop("candidate_revisions").withColumn("row_kind", F.lit("gap")), allowMissingColumns=True)
    isolated = alone.select(F.lit("flow").alias("row_kind"), F.col("system_id").alias("producer_system"), F.col("revision_id").alias("producer_revision"), F.col("flow_id").alias("producer_flow_id"))
    return rows.unionByName(isolated, allowMissingColumns=True)
