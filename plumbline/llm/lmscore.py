"""Language-model scores from a log-frequency Bloom filter.

Tokens are words (A-Z lower-cased, split at ASCII white space) and one end per text. Counts are taken over all
training documents, of every token and of every pair of neighbouring tokens (a text begins after an end). The
filter holds the count of each of them on a log scale (base square root of 2): level q means that (gram, 1) to
(gram, q) were put in. Levels are read back by probing 1, 2, ... until one is missing.

    p(v)   = (c(v) + 1) / (sum c + V + 1)
    p(v|u) = (1 - l) p(v) + l * c(u, v) / c(u)

with c as read from the filter; where u itself was not seen, p(v|u) is p(v). l is the Good-Turing share of pairs seen
before: 1 less the occurrences of pairs that occur once, over all occurrences (0.9 at most).

The filter grows with the corpus: it is cut by ranges of gram hashes into parts, each sized from its own number of
levels (`LOAD` bits set for each bit it has), so every gram is held at every size. No part leaves its task: whole
documents are gathered to blocks; a block keeps its distinct tokens as sorted 64-bit hashes and its texts as positions in
them. Each block sends a part one row of its distinct grams there with their training counts; the part sums them, fills
its piece of the filter, reads the grams back and returns one row of levels (and exact token counts, for the base
score) to the block.

A filter of all the corpus's grams grows with it, so it is not broadcast: blocks send their grams to the parts that hold them,
and only what has a proven bound (five sums) reaches the driver.

Null text counts as empty: one token, the end. A null doc_id is in fold 0. Repeated rows are scored (and learned
from) each; equal texts score alike. Without training documents all counts are 0. Very long texts are read whole, as a
block of their own at most. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, fold, give_back, stage_table

BLOCK_WORDS = 1_000_000
SLICE_TOKENS = 1 << 18
FILTER_BITS = 1 << 25
MOST_TASKS = 100_000
SLICES = 64
PROBES = 3
LOAD = 0.15
MAX_LEVEL = 80
END = b"\n"  # no word holds white space
END_HASH = np.uint64(xxhash.xxh3_64_intdigest(END))
GOLD = np.uint64(0x9E3779B97F4A7C15)
BLOCK_SCHEMA = "block long, doc_id array<long>, held array<boolean>, n array<int>, ids binary, hashes binary, train binary"
GRAM_SCHEMA = "part int, block long, words binary, word_n binary, pairs binary, pair_n binary"
LEVEL_SCHEMA = "block long, part int, word_q binary, word_n binary, pair_q binary, n_tokens long, n_kinds long, mass double, n_pairs long, once long"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * GOLD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 for 1, and two levels an octave; 0 for 0."""
    return np.where(counts > 0, 1 + np.floor(2 * np.log2(np.maximum(counts, 1)) + 1e-9), 0).astype(np.int64)


def level_values() -> np.ndarray:
    """The count that each level stands for: the mean of the whole numbers in it."""
    out = [0.0]
    for q in range(1, MAX_LEVEL + 1):
        lo, hi = int(np.ceil(2 ** ((q - 1) / 2) - 1e-9)), int(np.ceil(2 ** (q / 2) - 1e-9)) - 1
        out.append((lo + hi) / 2 if hi >= lo else 2 ** ((q - 0.5) / 2))
    return np.array(out)


def pair_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Hash of a pair of token hashes."""
    return mix(mix(u + GOLD) + v)


def places(keys: np.ndarray, level: int | np.ndarray, width: int) -> list[np.ndarray]:
    """The bit positions of (key, level) inside a slice of width bits."""
    a = mix(keys + np.asarray(level, np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    b = mix(a ^ GOLD) | np.uint64(1)
    return [((a + np.uint64(i) * b) >> np.uint64(7)) % np.uint64(width) for i in range(PROBES)]


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return (mix(keys) % np.uint64(slices)).astype(np.int64)


def fill_slice(keys: np.ndarray, levels: np.ndarray, width: int) -> np.ndarray:
    """Bytes of a slice of width bits that holds levels 1 to the given one of each key."""
    out = np.zeros(width, bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        for s in places(keys[levels >= q], q, width):
            out[s] = True
    return np.packbits(out, bitorder="little")


def read_levels(filt: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Levels of keys by repeated probes. filt: slices x bytes."""
    width = filt.shape[1] * 8
    out, alive = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for q in range(1, MAX_LEVEL + 1):
        if not len(alive):
            break
        part = slice_of(keys[alive], len(filt))
        ok = np.ones(len(alive), bool)
        for s in places(keys[alive], q, width):
            ok &= (filt[part, (s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1
        alive = alive[ok]
        out[alive] = q
    return out


def gather_blocks(docs: DataFrame, block_words: int) -> DataFrame:
    """Staged blocks of whole documents (BLOCK_SCHEMA)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 7) == 2).alias("held"), F.col("text").cast("binary").alias("text"))

    def pack(doc_ids: list, held: list, texts: list[np.ndarray], seen: dict[bytes, int]) -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
        kinds, place = np.unique(hashes, return_inverse=True)
        ids = place[np.concatenate(texts)].astype(np.int32)
        n = np.array([len(t) for t in texts], np.int32)
        learned = ids[np.repeat(~np.array(held, bool), n)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([uuid.uuid4().int >> 65], pa.int64()),
                pa.array([doc_ids], pa.list_(pa.int64())),
                pa.array([held], pa.list_(pa.bool_())),
                pa.array([n], pa.list_(pa.int32())),
                pa.array([zstandard.ZstdCompressor(level=1).compress(ids.tobytes())], pa.binary()),
                pa.array([kinds.tobytes()], pa.binary()),
                pa.array([np.bincount(learned, minlength=len(kinds)).astype(np.int32).tobytes()], pa.binary()),
            ],
            names=["block", "doc_id", "held", "n", "ids", "hashes", "train"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, held, texts, seen, n = [], [], [], {}, 0
        for b in batches:
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (x.as_py() for x in b.column(2))):
                ws = t.translate(LOWER_BYTES).split() if t else []
                ws.append(END)
                doc_ids.append(i)
                held.append(h)
                texts.append(np.array([seen.setdefault(w, len(seen)) for w in ws], np.int32))
                n += len(ws)
                if n >= block_words:
                    yield pack(doc_ids, held, texts, seen)
                    doc_ids, held, texts, seen, n = [], [], [], {}, 0
        if doc_ids:
            yield pack(doc_ids, held, texts, seen)

    return stage_table(rows.mapInArrow(run, BLOCK_SCHEMA), "blocks")


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def open_up(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, all first bytes before all second bytes and so on."""
    return squeeze(np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T))


def open_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(open_up(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def pair_places(ids: np.ndarray, n: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token before each token (a text begins after an end), the sorted keys of distinct pairs, and each token's pair in them."""
    before = np.concatenate(([0], ids[:-1])).astype(np.int64)
    before[np.concatenate(([0], np.cumsum(n)[:-1]))] = np.searchsorted(hashes, END_HASH)
    codes, place = np.unique(before * len(hashes) + ids, return_inverse=True)
    keys = pair_key(hashes[codes // len(hashes)], hashes[codes % len(hashes)])
    order = np.argsort(keys)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    return before, keys[order], rank[place]


def part_bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins in sorted keys: parts are equal ranges of their upper 32 bits."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1).astype(np.uint64))


def gram_rows(blocks: DataFrame, parts: int) -> DataFrame:
    """Each block's distinct tokens and pairs with their training counts, one row per part (GRAM_SCHEMA)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block, held, n, ids, hashes, train = (b.column(k)[i].as_py() for k in range(6))
                n, ids, hashes = np.array(n), open_up(ids, np.int32), np.frombuffer(hashes, np.uint64)
                _, pairs, place = pair_places(ids, n, hashes)
                learned = np.repeat(~np.array(held, bool), n)
                sent = (hashes, np.frombuffer(train, np.int32)), (pairs, np.bincount(place[learned], minlength=len(pairs)).astype(np.int32))
                at = [part_bounds(keys, parts) for keys, _ in sent]
                used = [p for p in range(parts) if any(x[p] < x[p + 1] for x in at)]
                cut = [[f(x[w[p] : w[p + 1]]) for p in used] for (keys, counts), w in zip(sent, at) for f, x in ((squeeze_keys, keys), (squeeze, counts))]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int64()), *(pa.array(x, pa.binary()) for x in cut)], names=["part", "block", "words", "word_n", "pairs", "pair_n"])
        give_back()

    return blocks.select("block", "held", "n", "ids", "hashes", "train").mapInArrow(run, GRAM_SCHEMA)


def fill_and_read(rows: pd.DataFrame) -> pd.DataFrame:
    """One part of the filter: sums its grams' counts, fills it, and reads them back for each block (LEVEL_SCHEMA).
    A last row without a block has the sums that normalise."""
    sizes, grams = {}, {}
    for kind, counts in (("words", "word_n"), ("pairs", "pair_n")):
        keys = [open_keys(x) for x in rows[kind]]
        sizes[kind] = np.cumsum([len(x) for x in keys])[:-1]
        kinds, place = np.unique(np.concatenate(keys), return_inverse=True)
        # sums of whole numbers below 2^53
        grams[kind] = kinds, place, np.bincount(place, np.concatenate([open_up(x, np.int32) for x in rows[counts]]), len(kinds)).astype(np.int64)
    levels = {k: level_of(total) for k, (_, _, total) in grams.items()}
    need = sum(int(q.sum()) for q in levels.values())
    width = 64 * (1 + int(need * PROBES / LOAD / 64))
    filt = fill_slice(np.concatenate([g[0] for g in grams.values()]), np.concatenate(list(levels.values())), width)[None]
    read = {k: read_levels(filt, g[0]).astype(np.uint8) for k, g in grams.items()}
    split = lambda x, kind: [squeeze(y) for y in np.split(x[grams[kind][1]], sizes[kind])]
    total, twos = grams["words"][2], grams["pairs"][2]
    out = pd.DataFrame({"block": rows["block"].astype("Int64"), "part": rows["part"], "word_q": split(read["words"], "words"), "word_n": split(total, "words"), "pair_q": split(read["pairs"], "pairs")})
    sums = {"n_tokens": total.sum(), "n_kinds": (total > 0).sum(), "mass": level_values()[read["words"][total > 0]].sum(), "n_pairs": twos.sum(), "once": (twos == 1).sum()}
    for name, value in sums.items():
        out[name] = type(value)(0)
    return pd.concat([out, pd.DataFrame({"block": pd.array([None], "Int64"), "part": rows["part"].iloc[:1].to_numpy(), "word_q": [b""], "word_n": [b""], "pair_q": [b""]} | {k: [v] for k, v in sums.items()})])


def build_filter(entries: DataFrame, bits: int) -> np.ndarray:
    """A small table's filter as slices x bytes. entries: key long, level int."""

    def slice_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = slice_of(b.column(0).to_numpy().view(np.uint64), SLICES).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), b.column(0), b.column(1)], names=["part", "key", "level"])

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "data": [fill_slice(pdf["key"].to_numpy().view(np.uint64), pdf["level"].to_numpy(), bits // SLICES).tobytes()]})

    rows = entries.mapInArrow(slice_rows, "part int, key long, level int").groupBy("part").applyInPandas(fill, "part int, data binary").collect()
    out = np.zeros((SLICES, bits // SLICES // 8), np.uint8)
    for r in rows:
        out[r["part"]] = np.frombuffer(bytes(r["data"]), np.uint8)
    return out


def score_block(doc_ids: list, held: list, n: np.ndarray, ids: np.ndarray, hashes: np.ndarray, counts: np.ndarray, word_q: np.ndarray, pair_q: np.ndarray, m: dict) -> pd.DataFrame:
    """Scores of a block's texts. Per-token arrays of floats are made for a slice of whole texts at a time."""
    values = level_values()
    base = np.log10((counts + 1) / (m["n"] + m["v"] + 1))
    seen = values[word_q]
    single = (seen + 1) / m["mass"]
    before, _, place = pair_places(ids, n, hashes)
    stop = np.cumsum(n)
    out = []
    first = 0
    while first < len(n):
        begin = int(stop[first] - n[first])
        last = max(first + 1, int(np.searchsorted(stop, begin + SLICE_TOKENS, side="right")))
        end = int(stop[last - 1])
        sizes, own = n[first:last], ids[begin:end]
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        p, context = single[own], seen[before[begin:end]]
        ratio = np.minimum(values[pair_q[place[begin:end]]] / np.maximum(context, 1), 1.0)
        p = np.where(context > 0, (1 - m["lam"]) * p + m["lam"] * ratio, p)
        sums = [np.add.reduceat(x, starts) for x in ((counts > 0)[own].astype(np.int64), base[own], np.log10(np.minimum(p, 1.0)))]
        out.append((sizes.astype(np.int64), *sums))
        first = last
    n_tokens, known, base_score, score = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame(
        {"doc_id": pd.array(doc_ids, "Int64"), "held_out": held, "n_tokens": n_tokens, "n_known": known, "base_score": base_score, "score": score}
    )


def score_texts(docs: DataFrame, block_words: int = BLOCK_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs. filter_bits: about the
    size of a part of the filter; there are as many parts as the corpus needs."""
    blocks = gather_blocks(docs, block_words)
    words = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    n_words, n_blocks = blocks.agg(F.coalesce(F.sum(words), F.lit(0)), F.count("*")).first()
    # a word adds one token and one pair at most
    parts = max(1, -int(-2 * n_words * PROBES / LOAD // filter_bits))
    # a task for each part and block, so that what a task reads does not grow with the corpus
    grams = gram_rows(blocks, parts).repartition(min(parts, MOST_TASKS), "part")
    levels = stage_table(grams.groupBy("part").applyInPandas(fill_and_read, LEVEL_SCHEMA), "levels")
    r = levels.where("block is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_kinds", "mass", "n_pairs", "once")]).first()
    model = {"n": r["n_tokens"], "v": r["n_kinds"], "mass": r["mass"] + r["n_kinds"] + 1, "lam": min(0.9, 1 - r["once"] / r["n_pairs"]) if r["n_pairs"] else 0.0}

    def run(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        r, found = texts.iloc[0], found.sort_values("part")
        read = [np.concatenate([open_up(x, kind) for x in found[c]]) for c, kind in (("word_n", np.int64), ("word_q", np.uint8), ("pair_q", np.uint8))]
        ids = [None if pd.isna(x) else int(x) for x in r["doc_id"]]
        return score_block(ids, list(r["held"]), np.asarray(r["n"], np.int64), open_up(r["ids"], np.int32), np.frombuffer(r["hashes"], np.uint64), *read, model)

    tasks = min(max(n_blocks, 1), MOST_TASKS)
    left = blocks.select("block", "doc_id", "held", "n", "ids", "hashes").repartition(tasks, "block")
    right = levels.where("block is not null").select("block", "part", "word_n", "word_q", "pair_q").repartition(tasks, "block")
    scored = left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(run, SCHEMA)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model["n"])).cast("long").alias("train_tokens"), "base_score", "score")
