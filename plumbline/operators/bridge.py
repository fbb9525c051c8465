"""Service attributes joined to model attributes and datamart columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean
from .keys import first_wins, sorted_set

#: fixed values: join statuses and gaps
CONFIRMED, NO_EGRESS, CONTEXT, NO_LINEAGE = "confirmed_exact_ucp_semantic_path_and_kpk_egress", "unresolved_kpk_egress", "context_ambiguous", "unresolved_profile_lineage"
NOT_FOUND, SEVERAL, OUTSIDE, UNSEEN, AMBIGUOUS = (
    "kpk_interaction_crossing_not_found", "kpk_interaction_ambiguous:", "kpk_consumer_attribute_outside_selected_output_root",
    "kpk_consumer_attribute_not_observed", "kpk_consumer_attribute_ambiguous:",
)
#: fixed values: notes that keep a datamart branch from being proven
BLOCKING = ("right_context_not_exact", "task46_target_specific_ucp_context_not_bound", "profile_confirmed_lineage_not_found")


def under_root(attribute: Column, root: str) -> Column:
    plain = lambda c: F.replace(clean(c), F.lit("[]"), F.lit(""))
    a, r = plain(attribute), plain(F.lit(root))
    return (a != "") & (r != "") & ((a == r) | F.startswith(a, F.concat(r, F.lit("."))))


def bind_consumers(evidence: DataFrame, interactions: DataFrame, repository: str, output_root: str, interaction: str = "") -> DataFrame:
    """evidence with interaction, egress attribute and egress_gap: exact on crossing_attribute, one interaction and
    one consumer attribute under the output root."""
    if not repository or not output_root:
        raise ValueError("repository and output_root must not be empty")
    i = interactions.where((clean("role") == "response") & (clean("consumer_repository") == repository) & (clean("crossing_attribute") != ""))
    if interaction:
        i = i.where(clean("interaction") == interaction)
    by = i.groupBy(clean("crossing_attribute").alias("crossing_attribute")).agg(
        sorted_set(clean("interaction")).alias("names"), F.array_sort(F.collect_set(clean("consumer_attribute"))).alias("attributes"),
        sorted_set(clean("gap")).alias("gaps"), sorted_set(clean("full_attribute_path")).alias("paths"),
    )
    out = evidence.join(by, "crossing_attribute", "left")
    n, one = F.size("attributes"), F.element_at("attributes", 1)
    several = F.lit(not interaction) & (F.size("names") > 1)
    gap = (
        F.when(F.col("attributes").isNull(), NOT_FOUND).when(several, F.concat(F.lit(SEVERAL), F.to_json("names")))
        .when((n == 1) & (one == ""), UNSEEN).when((n == 1) & under_root(one, output_root), "").when(n == 1, OUTSIDE).otherwise(F.concat(F.lit(AMBIGUOUS), F.to_json("attributes")))
    )
    name = F.lit(interaction) if interaction else F.when(F.size("names") == 1, F.element_at("names", 1)).otherwise("")
    return out.withColumn("egress_gap", gap).select(
        *evidence.columns, F.lit(repository).alias("service"), name.alias("interaction"), F.when(gap == "", one).otherwise("").alias("egress_attribute"), "egress_gap",
        F.coalesce(F.array_join("gaps", "; "), F.lit("")).alias("interaction_gap"), F.coalesce(F.array_join("paths", " | OR | "), F.lit("")).alias("interaction_path"),
    )


def best_tier(left: DataFrame, right: DataFrame, tiers: list[list[str]], key: list[str]) -> DataFrame:
    """left joined to right on the strictest list of columns that has any match; tier counts from 1, 0 without.
    left's rows are known by key. One shuffled join a tier; what a tier matched leaves."""
    rest, parts = left, []
    names = [c for c in right.columns if c not in left.columns]
    for i, cols in enumerate(tiers, 1):
        r = right.select(*[F.col(c).alias(f"__{c}") for c in cols], *names)
        cond = [F.col(c) == F.col(f"__{c}") for c in cols]
        hit = rest.join(r, cond).drop(*[f"__{c}" for c in cols]).withColumn("tier", F.lit(i))
        parts.append(hit)
        rest = rest.join(right.select(*cols).distinct(), cols, "left_anti")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.unionByName(rest.withColumn("tier", F.lit(0)), allowMissingColumns=True)


def compose(evidence: DataFrame, lineage: DataFrame) -> DataFrame:
    """Evidence (source_type, source_field, source_path, egress_attribute, egress_gap, endpoint) with confirmed
    lineage of the same full path; else of the same field, marked as ambiguous; else the first gap row."""
    good = lineage.where(clean("status") == "confirmed")
    rows = best_tier(evidence, good.withColumn("right_path", F.col("source_path")).withColumn("right_gap", clean("gap")).drop("gap", "status"), [["source_type", "source_field", "source_path"], ["source_type", "source_field"]], ["endpoint"])
    seen = good.groupBy("source_type", "source_field").agg(sorted_set(clean("source_path")).alias("seen_paths"))
    lost = first_wins(lineage.where(clean("status") != "confirmed"), ["source_type", "source_field"], ["input_ordinal"]).select("source_type", "source_field", clean("gap").alias("first_gap"))
    rows = rows.join(seen, ["source_type", "source_field"], "left").join(lost, ["source_type", "source_field"], "left")
    bound, tier = F.col("egress_attribute") != "", F.col("tier")
    inexact = F.concat(F.lit("right_context_not_exact:"), F.to_json("seen_paths"))
    both = lambda *cs: F.array_join(F.filter(F.array(*cs), lambda x: x != ""), ";")
    status = F.when(~bound, NO_EGRESS).when(tier == 1, CONFIRMED).when(tier == 2, CONTEXT).otherwise(NO_LINEAGE)
    gap = (
        F.when((tier == 1) & bound, F.col("right_gap")).when(tier == 1, F.coalesce(F.nullif("egress_gap", F.lit("")), F.lit(UNSEEN)))
        .when((tier == 2) & bound, inexact).when(tier == 2, both(F.col("egress_gap"), inexact))
        .otherwise(both(F.col("egress_gap"), F.coalesce(F.nullif("first_gap", F.lit("")), F.lit("profile_lineage_not_confirmed"))))
    )
    return rows.withColumn("join_status", status).withColumn("gap", gap).drop("right_path", "right_gap", "seen_paths", "first_gap", "tier")


def dedupe_composed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return first_wins(rows, keys, ["input_ordinal"])


def branch_proven() -> Column:
    """All four names are there and no note blocks."""
    named = F.lit(True)
    for c in ("replica_relation", "replica_column", "target_relation", "target_column"):
        named = named & (clean(c) != "")
    blocked = F.lit(False)
    for b in BLOCKING:
        blocked = blocked | clean("gap").contains(b)
    return named & ~blocked


def one_producer(provenance: Column) -> Column:
    """The producer repository in a provenance JSON array, if it is the only one."""
    names = F.array_distinct(F.filter(F.transform(F.coalesce(F.from_json(provenance, "array<struct<producer_repository:string>>"), F.array().cast("array<struct<producer_repository:string>>")), lambda p: clean(p["producer_repository"])), lambda x: x != ""))
    return F.when(F.size(names) == 1, F.element_at(names, 1)).otherwise("")


def two_branches(left: DataFrame, right: DataFrame, key: str, proven: str) -> DataFrame:
    """All pairs of a key's left (service) and right (datamart) rows where it has both; right rows alone; left rows
    alone only if proven. A key's proven left rows displace its merely observed ones. Adds left_status, right_status."""
    best = left.groupBy(key).agg(F.max(proven).alias("__any"))
    kept = left.join(best, key).where(F.col(proven) | ~F.col("__any")).drop("__any").withColumn("__l", F.lit(True))
    joined = kept.join(right.withColumn("__r", F.lit(True)), key, "full_outer")
    out = joined.where(F.col("__r").isNotNull() | F.col(proven))
    l_status = F.when(F.col("__l").isNull(), "not_proven").when(F.col(proven), "proven").otherwise("crossing_observed_egress_not_proven")
    return out.withColumn("left_status", l_status).withColumn("right_status", F.when(F.col("__r").isNull(), "not_proven").otherwise("proven")).drop("__l", "__r")
