"""Toxicity by a factorization machine over hashed terms.

A text's features are its distinct lower-case terms (runs of word characters), hashed to 2**18 slots. The score
is the logistic of b + sum w_i + sum over pairs <v_i, v_j>: the pairwise part, computed in linear time through
sums of factor vectors, sees combinations (an insult with a group mention) that additive weights miss.

The classifier is fitted on the driver on a bounded sample: about `max_rows` labelled documents, chosen by a hash
of doc_id, so alike at every size. Slots that fewer than `min_docs` sampled texts hold are left out. Of the rest at most
`slots` are kept: those in pairs whose label rate differs from the rates of both their members (chi-squared `MIN_PAIR` or
more, among the `PAIR_SLOTS` most common slots), which matter though neither may by itself, then those whose own
chi-squared against the label is `MIN_CHI` or more. Training (AdaGrad, fixed seed and order) is deterministic. Every text
is scored whole.

Labels are used from rows whose crc32(doc_id) mod 5 is not 0; a null label is no label, repeated labels of one
document count once (toxic if any is). Null or empty texts get the score of a text without terms. With no
labels at all every score is 0. Repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

HASH_BITS = 18
MAX_ROWS = 12_000
SLOTS = 8192
FACTORS = 6
#: a term's chi-squared against the label at p = 0.001
MIN_CHI = 10.8
#: a pair's chi-squared against each member's rate: p = 4e-8, for the half million pairs of so many slots
PAIR_SLOTS, MIN_PAIR, CHUNK = 1024, 30.0, 1000
#: toxic texts are the rarer and the costlier ones to miss
TOXIC_WEIGHT = 3.0
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_terms = re.compile(r"\w+").findall


def features(text: str | None) -> np.ndarray:
    """Distinct slots of a text's terms."""
    if not text:
        return np.zeros(0, np.int64)
    terms = set(_terms(text.lower()))
    return np.unique(np.fromiter((crc32(t.encode("utf-8", "surrogatepass")) >> (32 - HASH_BITS) for t in terms), np.int64, len(terms)))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(toxic, text) of about max_rows labelled documents of the training folds."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id", 5) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    # About max_rows rows of two numbers: a bounded broadcast.
    chosen = F.broadcast(known.where(u < F.lit(min(1.0, max_rows / max(1, n)))))
    return docs.select("doc_id", "text").join(chosen, "doc_id").select("toxic", "text")


def logits(model: dict, rows: list[np.ndarray]) -> np.ndarray:
    """rows: hashed slots of each text."""
    kept = [s[s >= 0] for s in (model["slot_of"][r] for r in rows)]
    return model["b"] + forward(kept, model["w"], model["v"])[0]


def forward(rows: list[np.ndarray], w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Value without the bias, factor sums, flat indices and row of each."""
    idx = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n = len(rows)
    value = np.bincount(row, w[idx], n)
    sums = np.stack([np.bincount(row, v[idx, f], n) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(row, (v[idx] ** 2).sum(axis=1), n)
    return value + 0.5 * ((sums**2).sum(axis=1) - squares), sums, idx, row


def pair_slots(rows: list[np.ndarray], y: np.ndarray, df: np.ndarray, min_docs: int) -> np.ndarray:
    """Slots of pairs that tell more of the label than either member does. A few rows are laid out at a time."""
    common = np.argsort(-df, kind="stable")[:PAIR_SLOTS]
    common = common[df[common] >= min_docs]
    place = np.full(len(df), -1, np.int64)
    place[common] = np.arange(len(common))
    both, toxic = (np.zeros((len(common),) * 2) for _ in range(2))
    for at in range(0, len(rows), CHUNK):
        part = [place[r] for r in rows[at : at + CHUNK]]
        x = np.zeros((len(part), len(common)), np.float32)
        for line, cols in zip(x, part):
            line[cols[cols >= 0]] = 1
        both += x.T @ x
        toxic += (x * y[at : at + CHUNK, None].astype(np.float32)).T @ x
    rate = (np.diag(toxic) + 0.5) / (np.diag(both) + 1)
    chi = lambda r: (toxic - both * r) ** 2 / np.maximum(both * r * (1 - r), 1e-9)
    found = (np.minimum(chi(rate[:, None]), chi(rate[None])) >= MIN_PAIR) & (both >= min_docs) & ~np.eye(len(common), dtype=bool)
    return common[found.any(axis=1)]


def fit(rows: list[np.ndarray], y: np.ndarray, min_docs: int = 3, slots: int = SLOTS, factors: int = FACTORS, epochs: int = 12) -> dict:
    n, width = len(rows), 1 << HASH_BITS
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    df = np.bincount(flat, minlength=width).astype(float)
    pos = np.bincount(flat, y[owner], width)
    rate = y.mean() if n else 0.0
    expected = df * rate
    chi = np.where(df >= min_docs, (pos - expected) ** 2 / np.maximum(expected * (1 - rate), 1e-9), -1)
    chi[pair_slots(rows, y, df, min_docs)] = np.inf
    top = np.argsort(-chi, kind="stable")[:slots]
    top = top[chi[top] >= MIN_CHI]
    slot_of = np.full(width, -1, np.int64)
    slot_of[top] = np.arange(len(top))
    data = [s[s >= 0] for s in (slot_of[r] for r in rows)]

    rng = np.random.default_rng(7)
    w, v = np.zeros(len(top)), rng.normal(0, 0.02, (len(top), factors))
    b = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))) if n else -np.inf
    gw, gv, gb = np.full(len(top), 1.0), np.full_like(v, 1.0), 1.0
    lr, l2w, l2v = 0.5, 0.1, 1.0
    for _ in range(epochs if len(top) else 0):
        order = rng.permutation(n)
        for a in range(0, n, 256):
            part = order[a : a + 256]
            value, sums, idx, row = forward([data[i] for i in part], w, v)
            g = (1 / (1 + np.exp(-np.clip(value + b, -30, 30))) - y[part]) * np.where(y[part] > 0, TOXIC_WEIGHT, 1)
            seen = np.bincount(idx, minlength=len(top)) > 0
            dw = np.bincount(idx, g[row], len(top)) + l2w * w * seen
            gate = np.bincount(idx, g[row], len(top))[:, None]
            dv = np.stack([np.bincount(idx, g[row] * sums[row, f], len(top)) for f in range(factors)], axis=1) - gate * v + l2v * v * seen[:, None]
            gw += dw**2
            gv += dv**2
            gb += g.sum() ** 2
            w -= lr * dw / np.sqrt(gw)
            v -= 0.5 * lr * dv / np.sqrt(gv)
            b -= 0.5 * lr * g.sum() / np.sqrt(gb)
    return {"slot_of": slot_of.astype(np.int32), "w": w, "v": v, "b": b}


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict:
    """Fit on the bounded sample; only its hashed slots reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = [features(t).astype(np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(slots, pa.list_(pa.int32()))], names=["toxic", "slots"])

    sample = labelled_sample(docs, labels, max_rows).select(F.col("toxic").cast("int").alias("toxic"), "text")
    got = sample.mapInArrow(run, "toxic int, slots array<int>").toPandas()
    rows = [np.asarray(s, np.int64) for s in got["slots"]]
    # A fixed order, whatever the partitioning.
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), rows[i].tobytes()))
    return fit([rows[i] for i in order], got["toxic"].to_numpy()[order].astype(float) if len(rows) else np.zeros(0))


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 5) == 0).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = logits(shared.value, [features(t) for t in b.column(2).to_pylist()])
            with np.errstate(over="ignore"):
                score = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(run, SCHEMA)
