"""Operators over streams of facts: the same DataFrame code, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.published import write_new_keys


def read_facts(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def apply_per_batch(facts: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Run a batch operator on each micro-batch and keep one result per key: a batch that is run again after a
    failure finds its keys stored."""
    return (
        facts.writeStream.foreachBatch(lambda batch, _: write_new_keys(operator(batch), path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def gap_counts(gaps: DataFrame, time: str = "observed_at", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Gaps by window and status; rows later than the watermark are left out."""
    return gaps.withWatermark(time, late).groupBy(F.window(time, window), "status").agg(F.count("*").alias("gap_count"))
