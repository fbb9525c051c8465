"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, source mixture.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written to the cluster's shared
folder and read again as the next one's docs. All but the last return the columns of documents.

Every stage takes nulls in any column, empty and very long texts (read whole), repeated rows, empty tables and extra
columns of any name, which it hands on as they are; what it makes of them stands with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontam, langid, mixing, ngramjoin, secretscan
from plumbline.llm.common import stage_table, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models know; what they reject goes, and so do texts that are null or have no letter.
    Repeated rows are judged alike; ties of languages go to the first name; without a labelled text all go."""
    return langid.keep_identified(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at a Jaccard similarity of 0.8 or more: the one of smallest doc_id,
    then of smallest text hash; of rows that repeat both, the least. Rows without an id or without words all stay."""
    return ngramjoin.keep_one(docs, width=5, percent=80)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that occur in test items' windows; a text of nothing else goes. Null and empty texts stay;
    repeated rows are cut alike; items without an id count, items without words do not."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mask; overlapping spans become one. Null texts stay null; no row goes."""
    return secretscan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, rate, copies, taken; a row each. Null
    text has size 0, a null source is one of its own, rows that repeat id and text are taken alike."""
    return mixing.pareto_mix(docs)


STAGES = [
    ("language identification", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", cut_benchmark_passages),
    ("secret scan", mask_secrets),
    ("source mixture", mix_sources),
]
#: Language models, removal spans and the randomness battery are beyond SQL: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage_table(docs, f"stage{i}")
    return docs
