"""Approximate nearest neighbours by a permutation index.

Inner-product search is first turned to search by angle: vectors are divided by the largest norm and get one more
component that fills them up to length 1; queries get 0 there. A vector is represented by its `POSTED` nearest
pivots in order. Each block of vectors has an inverted file per pivot: the credit (`POSTED` less the place) of each
vector that holds it. As half of the vectors hold a pivot, a file is one byte per vector, 0 where it is not held.
A query reads the files of its `ASKED` nearest pivots. Over two orders of one length the footrule distance
(differences of places; a missing pivot counts as place `POSTED`) is a constant less twice the sum of the smaller
credits, so that sum ranks a block. The best RERANK * sqrt(block rows) of a block, and 10 k at least, are
reranked by the exact inner product of the original vectors in double precision.

The pivots are fitted on a bounded sample (the first distinct vectors in an order by hash of vec_id). All
vectors are indexed. Blocks of vectors meet blocks of queries, so a task's memory is bounded, and there is no
pair of rows but inside such a task.

Vectors that are null, zero, of another length than most, or hold a null or non-finite component take no part.
A query's own row is known by vec_id; of repeated vec_ids all others count. Ties in score, and in footrule
distance, go to the smaller vec_id. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, stage_table

PIVOTS, POSTED, ASKED = 256, 128, 64
RERANK = 10
CHUNK = 8192
MIN_BLOCK, MAX_BLOCK, QUERY_BLOCK = 8192, 65_536, 16_384
SCHEMA = "query_id long, vec_id long, score double"


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def orders(vectors: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The `depth` nearest pivots of each row, nearest first."""
    s = vectors @ pivots.T
    near = np.argpartition(-s, depth - 1, axis=1)[:, :depth] if depth < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, axis=1), axis=1, kind="stable"), axis=1)


def inverted_files(vectors: np.ndarray, pivots: np.ndarray, posted: int) -> np.ndarray:
    """Pivots x vectors: a vector's credit in each pivot's file, posted for its nearest pivot down to 1; 0 if it has not."""
    out = np.zeros((len(pivots), len(vectors)), np.uint8)
    for at in range(0, len(vectors), CHUNK):
        o = orders(vectors[at : at + CHUNK], pivots, posted)
        out[o.ravel(), at + np.repeat(np.arange(len(o)), posted)] = np.tile(np.arange(posted, 0, -1), len(o))
    return out


def smallest(values: np.ndarray, k: int) -> np.ndarray:
    """k indices of least value; among equals the first."""
    if k >= len(values):
        return np.arange(len(values))
    edge = np.partition(values, k - 1)[k - 1]
    below = np.flatnonzero(values < edge)
    return np.concatenate((below, np.flatnonzero(values == edge)[: k - len(below)]))


def rerank_count(n: int, k: int) -> int:
    """How many of a block's n vectors are reranked for each query."""
    return max(10 * k, int(np.ceil(RERANK * np.sqrt(n))))


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, norm: float, k: int, count: int | None = None) -> pd.DataFrame:
    """Up to k nearest of one block for each query. ids ascend."""
    posted, asked = min(POSTED, len(pivots)), min(ASKED, len(pivots))
    asks = orders(np.pad(queries, ((0, 0), (0, 1))), pivots, asked)
    filled = np.sqrt(np.maximum(0.0, 1 - (vectors**2).sum(axis=1) / norm**2))
    files = inverted_files(np.column_stack((vectors / norm, filled)), pivots, posted)
    count = rerank_count(len(ids), k) if count is None else count
    saved, part = np.empty(len(ids), np.int16), np.empty(len(ids), np.uint8)
    out = []
    for q, query, ask in zip(query_ids, queries, asks):
        saved[:] = 0
        for place, p in enumerate(ask):
            np.minimum(files[p], np.uint8(posted - place), out=part)
            saved -= part
        own = slice(*np.searchsorted(ids, (q, q + 1)))
        saved[own] = 1
        near = smallest(saved, count + own.stop - own.start)
        near = near[ids[near] != q][:count]
        # not a matrix product: equal vectors get scores equal to the bit
        score = np.einsum("ij,j->i", vectors[near], query)
        best = np.lexsort((ids[near], -score))[:k]
        out.append((np.full(len(best), q), ids[near[best]], score[best]))
    return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("query_id", "vec_id", "score"), zip(*out))})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score. vectors and queries: (vec_id, embedding)."""
    spark = vectors.sparkSession
    keep = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows, asks = keep(vectors), keep(queries)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.max(square).alias("m")).orderBy(F.desc("n"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    d, n, norm = sizes[0]["d"], sizes[0]["n"], float(np.sqrt(sizes[0]["m"]))
    rows, asks = rows.where(F.size("embedding") == d), asks.where(F.size("embedding") == d)
    n_asks = asks.count()
    if not n_asks:
        return empty
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(8 * PIVOTS).collect()
    raw = pd.DataFrame([list(map(float, r["embedding"])) for r in sample]).drop_duplicates().to_numpy()[:PIVOTS]
    pivots = np.column_stack((raw / norm, np.sqrt(np.maximum(0.0, 1 - (raw**2).sum(axis=1) / norm**2))))
    shared = spark.sparkContext.broadcast(pivots)

    block = int(np.clip(n / 64, MIN_BLOCK, MAX_BLOCK))
    n_blocks, n_parts = -(-n // block), -(-n_asks // QUERY_BLOCK)
    spread = lambda m: F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(m)).cast("int")
    left = rows.select("vec_id", "embedding", spread(n_blocks).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("p"))
    right = asks.select("vec_id", "embedding", spread(n_parts).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"))

    def run(data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": int, "vec_id": int})
        data = data.sort_values("vec_id", kind="stable")
        full = lambda df: np.stack(df["embedding"].to_numpy()).astype(np.float64)
        out = search_block(data["vec_id"].to_numpy(), full(data), ask["vec_id"].to_numpy(), full(ask), shared.value, norm, k)
        give_back()
        return out

    found = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInPandas(run, SCHEMA)
    found = stage_table(found, "near")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
