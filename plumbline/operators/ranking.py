"""Ranking of candidates, and validation of packages and responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .keys import count_by

#: fixed values
LEADER, TIED = "single_evidence_leader_not_runtime_proof", "ambiguous_top_evidence"
VALIDATED, PROVIDER_ERROR, INVALID = "VALIDATED", "PROVIDER_ERROR", "INVALID_RESPONSE"
LEAST_CANDIDATES, MOST_CANDIDATES, MOST_RANKED = 2, 15, 3


def shortlist(candidates: DataFrame, case: list[str], score: str = "retrieval_score", evidence: str = "evidence_count", names: tuple[str, ...] = ("repository_id", "interface_id")) -> DataFrame:
    """candidates with rank, leader_count (ties at the top in score and evidence) and selection_status of the case."""
    order = W.partitionBy(*case).orderBy(F.desc(score), F.desc(evidence), *names)
    top = W.partitionBy(*case)
    out = candidates.withColumn("rank", F.row_number().over(order))
    best = F.max(F.struct(score, evidence)).over(top)
    out = out.withColumn("__best", best)
    out = out.withColumn("leader_count", F.count_if((F.col(score) == F.col("__best")[score]) & (F.col(evidence) == F.col("__best")[evidence])).over(top)).drop("__best")
    return out.withColumn("selection_status", F.when(F.col("leader_count") == 1, LEADER).otherwise(TIED))


def package_faults() -> Column:
    """Sorted faults of a package: content_hash, package_hash, candidates array<struct<candidate_id, repository_id,
    supporting_interface_ids>>."""
    c = F.col("candidates")
    ids, repos = F.transform(c, lambda x: x["candidate_id"]), F.transform(c, lambda x: x["repository_id"])
    evidence = lambda x: x["supporting_interface_ids"]
    faults = F.array(
        F.when(F.col("content_hash") != F.col("package_hash"), "hash"), F.when(~F.size(c).between(LEAST_CANDIDATES, MOST_CANDIDATES), "candidate_count"),
        F.when(F.size(F.array_distinct(ids)) != F.size(ids), "candidate_ids"), F.when(F.size(F.array_distinct(repos)) != F.size(repos), "repositories"),
        F.when(F.exists(c, lambda x: F.coalesce(F.size(evidence(x)), F.lit(0)) == 0), "no_evidence"), F.when(F.exists(c, lambda x: F.size(F.array_distinct(evidence(x))) != F.size(evidence(x))), "evidence_repeated"),
    )
    return F.array_sort(F.array_compact(faults))


def contiguous(ranks: Column) -> Column:
    """Ranks are 1 to n, in any order."""
    return F.coalesce((F.size(ranks) > 0) & (F.array_sort(ranks) == F.sequence(F.lit(1), F.greatest(F.size(ranks), F.lit(1)))), F.lit(False))


def is_subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def response_faults() -> Column:
    """Sorted faults of a response joined to its package: ranked array<struct<candidate_id, rank,
    supporting_interface_ids>> against candidates."""
    r, c = F.col("ranked"), F.col("candidates")
    ids = F.transform(r, lambda x: x["candidate_id"])
    known = F.transform(c, lambda x: x["candidate_id"])
    own = lambda x: F.flatten(F.transform(F.filter(c, lambda y: y["candidate_id"] == x["candidate_id"]), lambda y: y["supporting_interface_ids"]))
    faults = F.array(
        F.when(~F.size(r).between(1, MOST_RANKED), "ranked_count"), F.when(~is_subset(ids, known), "unknown_candidate"), F.when(F.size(F.array_distinct(ids)) != F.size(ids), "candidate_repeated"),
        F.when(F.exists(r, lambda x: ~is_subset(x["supporting_interface_ids"], own(x))), "foreign_evidence"), F.when(~contiguous(F.transform(r, lambda x: x["rank"].cast("int"))), "ranks"),
    )
    return F.array_sort(F.array_compact(faults))


def terminal_status(error: Column, faults: Column) -> Column:
    return F.when(error.isNotNull(), PROVIDER_ERROR).when(F.size(faults) > 0, INVALID).otherwise(VALIDATED)


def rerank(packages: DataFrame, provider: Callable[[str], str], response_schema: str) -> DataFrame:
    """packages with ranked, error, faults and status. provider maps a package's JSON to a response's JSON; its
    failure marks one package and leaves the others alone."""
    columns = packages.columns

    def call(batches):
        for pdf in batches:
            out, errors = [], []
            for body in pdf["__body"]:
                try:
                    out.append(provider(body))
                    errors.append(None)
                except Exception as e:
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(__response=out, error=errors)[["package_hash", "__response", "error"]]

    body = packages.select("package_hash", F.to_json(F.struct(*columns)).alias("__body"))
    got = body.mapInPandas(call, "package_hash string, __response string, error string")
    got = got.withColumn("ranked", F.from_json("__response", response_schema)["ranked"]).drop("__response")
    out = packages.join(got, "package_hash").withColumn("faults", response_faults())
    return out.withColumn("faults", F.when(F.col("ranked").isNull(), F.array(F.lit("unreadable"))).otherwise(F.col("faults"))).withColumn("status", terminal_status(F.col("error"), F.col("faults")))


def status_counts(results: DataFrame) -> DataFrame:
    return count_by(results, "status")


def command_provider(command: list[str], timeout: float) -> Callable[[str], str]:
    """A provider that hands one JSON document to a program, without a shell, and reads one back."""

    def call(body: str) -> str:
        import subprocess

        return subprocess.run(command, input=body, capture_output=True, text=True, timeout=timeout, check=True).stdout

    return call
