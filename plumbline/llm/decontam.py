"""Benchmark decontamination with an FM-index per training shard.

Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters. A test item's windows are
its runs of `window` consecutive words; an item of fewer words, but not none, is one window. Each worker gathers
whole documents to shards of a bounded number of words and indexes each shard: suffix array over word
symbols, Burrows-Wheeler transform in a wavelet matrix, suffix positions sampled every 16 words. All windows are
searched backwards at once; occurrences are located by walking to a sampled position; a document's overlapping
or touching occurrences merge into removal spans.

A shard's alphabet is the test set's vocabulary. Words outside it cannot be part of a window, so they, and
stretches of known words shorter than the shortest window, become one separator; nothing that can match is left
out. The test set travels in blocks of at most about `BLOCK_WORDS` words. A pass over the documents broadcasts at most
`PASS_BLOCKS` of them and searches shards block by block; a larger test set takes further passes, each staged with the spans
and items found so far, so a broadcast is bounded whatever the size of the test set.

Null text or text without words has no hits. Null item texts or ones without words have no windows. The windows of an item
with a null id hit words like any other's, but it is not among the items. Repeated documents or items each count; an
empty benchmark gives no hits. Very long texts are searched whole. Other columns are ignored, also those of the test set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import batched, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, fresh, give_back, stage_table

WINDOW = 10
SHARD_WORDS = 600_000
SLICE_ROWS = 200
BLOCK_WORDS, PASS_BLOCKS = 200_000, 8
SAMPLE = 16
_WORD_BYTES = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
#: lower-cases A-Z, and turns every byte that is no part of a word into a space
WORD_TABLE = bytes(c if (c := LOWER_BYTES[b]) in _WORD_BYTES else 32 for b in range(256))
SPANS = "array<struct<start:bigint,end:bigint>>"
SCHEMA = f"doc_id long, n_words long, n_hit long, items array<string>, spans {SPANS}"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_TABLE).split() if text else []


class Bits:
    """A bit vector with ranks, packed to 64-bit words."""

    def __init__(self, bit: np.ndarray):
        packed = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
        body = np.packbits(bit.astype(bool), bitorder="little")
        packed[: len(body)] = body
        self.words = packed.view(np.uint64)
        self.sums = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.sums[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """rank and access over a sequence of small integers, vectorised over queries."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        cur, n = seq, len(seq)
        for level in reversed(range(self.levels)):
            bit = (cur >> level) & 1
            self.bits.append(Bits(bit))
            self.zeros.append(n - int(bit.sum()))
            cur = np.concatenate((cur[bit == 0], cur[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c[j] before position i[j]."""
        start = np.zeros_like(i)
        for k, level in enumerate(reversed(range(self.levels))):
            one = ((c >> level) & 1).astype(bool)
            a, b = self.bits[k].rank(i), self.bits[k].rank(start)
            i = np.where(one, self.zeros[k] + a, i - a)
            start = np.where(one, self.zeros[k] + b, start - b)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for k in range(self.levels):
            a, one = self.bits[k].rank(i), self.bits[k].get(i)
            out = (out << 1) | one
            i = np.where(one, self.zeros[k] + a, i - a)
        return out


class FMIndex:
    """Index of a symbol sequence in which 0 separates stretches that no pattern crosses."""

    def __init__(self, seq: np.ndarray, sigma: int):
        n = len(seq)
        # Separators count as different from each other here, so sorting ends at the longest stretch.
        rank = np.where(seq == 0, np.cumsum(seq == 0), seq + np.int64(n + 1))
        _, rank = np.unique(rank, return_inverse=True)
        k = 1
        while True:
            tail = np.zeros(n, np.int64)
            tail[: n - k] = rank[k:] + 1
            key = rank.astype(np.int64) * (n + 2) + tail
            self.sa = np.argsort(key, kind="stable")
            ordered = key[self.sa]
            new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            rank = np.empty(n, np.int64)
            rank[self.sa] = new
            if n == 0 or new[-1] == n - 1 or k >= n:
                break
            k *= 2
        self.n = n
        bwt = seq[self.sa - 1].astype(np.int64)
        self.wavelet = WaveletMatrix(bwt, sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma))))
        # Sampled: every SAMPLE-th position and each position after a separator, so a walk never meets one.
        keep = np.arange(n) % SAMPLE == 0
        keep[1:] |= seq[:-1] == 0
        keep[seq == 0] = True
        keep = keep[self.sa]
        self.marked, self.samples = Bits(keep), self.sa[keep].astype(np.int32)
        del self.sa

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) for patterns, right-aligned in a matrix."""
        m, wide = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for back in range(1, wide + 1):
            at = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(at):
                break
            c = patterns[at, wide - back]
            base = self.first[c]
            lo[at], hi[at] = base + self.wavelet.rank(c, lo[at]), base + self.wavelet.rank(c, hi[at])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.marked.get(at))
        while len(todo):
            c = self.wavelet.access(at[todo])
            at[todo] = self.first[c] + self.wavelet.rank(c, at[todo])
            steps[todo] += 1
            todo = todo[~self.marked.get(at[todo])]
        return self.samples[self.marked.rank(at)] + steps


def pattern_block(items: list[tuple[str | None, list[bytes]]], window: int) -> dict:
    """Vocabulary, distinct windows (right-aligned symbols) and the items of each window."""
    vocab: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item, ws in items:
        ids = [vocab.setdefault(w, len(vocab) + 1) for w in ws]
        for i in range(max(1, len(ids) - window + 1)):
            found.setdefault(tuple(ids[i : i + window]), set()).update(() if item is None else (item,))
    pats = list(found)
    lengths = np.array([len(p) for p in pats], np.int64)
    matrix = np.zeros((len(pats), int(lengths.max(initial=1))), np.int64)
    for i, p in enumerate(pats):
        matrix[i, matrix.shape[1] - len(p) :] = p
    return {"vocab": vocab, "matrix": matrix, "lengths": lengths, "items": [sorted(found[p]) for p in pats]}


def benchmark_blocks(bench: DataFrame, window: int, block_words: int) -> Iterator[dict]:
    """The test set's windows, in blocks of at most about block_words words each; read a partition at a time."""
    items, n = [], 0
    for row in bench.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).toLocalIterator():
        ws = words(row["text"])
        if not ws:
            continue
        items.append((row["item_id"], ws))
        n += len(ws)
        if n >= block_words:
            yield pattern_block(items, window)
            items, n = [], 0
    if items:
        yield pattern_block(items, window)


def search_shard(docs: list[list[bytes]], block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences as arrays: document, first word, window number."""
    get, none = block["vocab"].get, (np.zeros(0, np.int64),) * 3
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    ids = np.zeros(int(starts[-1]) + len(docs), np.int64)  # a separator closes each document
    at = starts[:-1] + np.arange(len(docs))
    for a, d in zip(at, docs):
        ids[a : a + len(d)] = np.fromiter(map(get, d, repeat(0)), np.int64, len(d))
    # Stretches of known words that are too short for any window become separators too.
    known = np.concatenate(([False], ids != 0, [False]))
    edge = np.flatnonzero(known[1:] != known[:-1])
    lo, hi = edge[::2], edge[1::2]
    ok = hi - lo >= block["lengths"].min()
    lo, hi = lo[ok], hi[ok]
    if not len(lo):
        return none
    long = hi - lo + 1
    offset = np.repeat(lo - np.concatenate(([0], np.cumsum(long)[:-1])), long)
    where = np.arange(int(long.sum())) + offset  # position in ids of each symbol of the sequence
    seq = ids[where]
    index = FMIndex(seq, len(block["vocab"]) + 1)
    a, b = index.search(block["matrix"], block["lengths"])
    hits = b - a
    rows = np.repeat(a - np.concatenate(([0], np.cumsum(hits)[:-1])), hits) + np.arange(int(hits.sum()))
    pos = where[index.locate(rows)]
    doc = np.searchsorted(at, pos, side="right") - 1
    return doc, pos - at[doc], np.repeat(np.arange(len(hits)), hits)


Found = tuple[list[list[tuple[int, int]]], list[set[str]]]


def judge_shard(docs: list[list[bytes]], blocks: list[dict], before: Found) -> Found:
    """Each document's removal spans (merged word offsets) and items, with those that earlier passes found."""
    n = len(docs)
    spans, items = [list(x) for x in before[0]], [set(x) for x in before[1]]
    found = [(np.repeat(np.arange(n), [len(x) for x in spans]), *(np.array([y[k] for x in spans for y in x], np.int64) for k in (0, 1)))]
    for block in blocks:
        doc, first, pattern = search_shard(docs, block)
        found.append((doc, first, first + block["lengths"][pattern]))
        pairs = np.unique(doc * len(block["items"]) + pattern)
        for d, p in zip((pairs // len(block["items"])).tolist(), (pairs % len(block["items"])).tolist()):
            items[d].update(block["items"][p])
    doc, lo, hi = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((lo, doc))
    spans = [[] for _ in range(n)]
    for d, x, y in zip(doc[order].tolist(), lo[order].tolist(), hi[order].tolist()):
        if spans[d] and x <= spans[d][-1][1]:
            spans[d][-1] = (spans[d][-1][0], max(y, spans[d][-1][1]))
        else:
            spans[d].append((x, y))
    return spans, items


def span_array(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


Finish = Callable[[pa.Table, list[list[bytes]], Found], pa.Table]


def run_passes(docs: DataFrame, bench: DataFrame, finish: Finish, schema: str, window: int, shard_words: int, block_words: int, pass_blocks: int) -> DataFrame:
    """docs (with a column text) through all blocks of the test set; finish makes the last pass's rows of a shard."""
    sc = docs.sparkSession.sparkContext
    width, at_text = len(docs.columns), docs.columns.index("text")
    carried = fresh(docs, "spans", "items")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", {carried[0]} {SPANS}, {carried[1]} array<string>"

    def one_pass(blocks: list, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def flush(held: list[pa.RecordBatch], texts: list[list[bytes]]) -> list[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            before = ([[]] * len(texts), [()] * len(texts))
            if t.num_columns > width:
                before = [[(s["start"], s["end"]) for s in x] for x in t.column(width).to_pylist()], t.column(width + 1).to_pylist()
                t = t.select(range(width))
            found = judge_shard(texts, [b.value for b in blocks], before)
            if not last:
                t = t.append_column(carried[0], span_array(found[0])).append_column(carried[1], pa.array([sorted(x) for x in found[1]], pa.list_(pa.string())))
            return (finish(t, texts, found) if last else t).combine_chunks().to_batches()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, texts, n = [], [], 0
            for batch in (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
                held.append(batch)
                more = [words(x.encode() if isinstance(x, str) else x) for x in batch.column(at_text).to_pylist()]
                texts += more
                n += sum(map(len, more))
                if n >= shard_words:
                    yield from flush(held, texts)
                    held, texts, n = [], [], 0
            if held:
                yield from flush(held, texts)
            del held, texts
            give_back()

        return run

    passes = batched(benchmark_blocks(bench, window, block_words), pass_blocks)
    own, state = next(passes, ()), docs
    while True:
        following, blocks = next(passes, None), [sc.broadcast(b) for b in own]
        if following is None:
            return state.mapInArrow(one_pass(blocks, True), schema)
        state = stage_table(state.mapInArrow(one_pass(blocks, False), types), "pass")
        for b in blocks:
            b.destroy()
        own = following


def find_contamination(
    docs: DataFrame, bench: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, pass_blocks: int = PASS_BLOCKS
) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids as strings), spans (word offsets, merged), a row per document."""

    def finish(t: pa.Table, texts: list[list[bytes]], found: Found) -> pa.Table:
        spans, items = found
        columns = [t.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([sum(b - a for a, b in x) for x in spans], pa.int64())]
        return pa.table([*columns, pa.array([sorted(x) for x in items], pa.list_(pa.string())), span_array(spans)], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return run_passes(rows, bench, finish, SCHEMA, window, shard_words, block_words, pass_blocks)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words in spans (word offsets) and the characters between them."""
    raw = text.encode()
    mapped = np.frombuffer(raw.translate(WORD_TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mapped.astype(np.int8), [0]))))
    lo, hi = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : lo[a]])
        at = hi[b - 1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(
    docs: DataFrame, bench: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, pass_blocks: int = PASS_BLOCKS
) -> DataFrame:
    """docs with the removal spans cut out of text; documents left without a word, that had hits, are dropped. n_chars follows the text."""
    names = docs.columns
    at_text, at_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def finish(t: pa.Table, texts: list[list[bytes]], found: Found) -> pa.Table:
        hit = [i for i, s in enumerate(found[0]) if s]
        if not hit:
            return t
        field, new = t.schema.field(at_text), t.column(at_text).to_pylist()
        keep = np.ones(len(new), bool)
        for i in hit:
            new[i] = cut_words(new[i], found[0][i])
            keep[i] = bool(words(new[i].encode()))
        t = t.set_column(at_text, field, pa.array(new, field.type))
        if at_chars is not None:
            field, chars = t.schema.field(at_chars), t.column(at_chars).to_pylist()
            for i in hit:
                chars[i] = len(new[i])
            t = t.set_column(at_chars, field, pa.array(chars, field.type))
        return t.filter(pa.array(keep))

    return run_passes(docs, bench, finish, docs.schema, window, shard_words, block_words, pass_blocks)
