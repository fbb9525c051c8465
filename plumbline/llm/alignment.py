"""Cross-tokenizer alignment of a byte-level BPE (A, on space+text) and a SentencePiece model (B, on text).

Both token rows of a text cover the bytes of space+text. Ends are cumulated sums of token lengths; offsets where both end
(`intersect1d`) cut the rows into groups, which `searchsorted` labels; tokens that end together are linked, each A with each B,
by repeats. Where both models allow a cut before a space (`bytebpe`, `tokencount`), a word's end is a common cut wherever the
word stands, so each distinct word is aligned once, all new words of a slice of texts at once (ends run on from one to the
next), and a text is the row of its words; with other models whole texts are aligned so.

The pass is written to the shared folder with each text's distinct linked pairs and how often it links them. Pairs are summed
in the tasks first, then by pair and a salt, then by pair, so a pair of every text is gathered in no task. The sums are as many
as the pairs of entries that meet; they are handed back to the texts in slices of `SLICE` pairs, each broadcast and read with
one binary search a pair; every slice takes a pass over the pairs of texts, and texts are summed up at the end.

Texts that are null, empty, or whose tokens' bytes are not those of space+text (such as texts with U+2581) have no tokens and
zeros. Special tokens' strings are plain text. Very long texts are read whole. Repeated rows are rows of their own, and count
as often; a null doc_id stays null; ties for the best pair all count. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import MEMO_LENGTH, Encoder, file_facts, packed, token_bytes, words_of
from .common import give_back, stage_table
from .tokencount import MARK, model_facts

MEMO = 200_000
Unit = tuple[int, bytes, bytes]
#: characters aligned at once; pairs summed in a task before they are handed on; pairs of a broadcast
TEXT_SLICE, TASK_PAIRS, SLICE, SALTS = 1_000_000, 1_000_000, 4_000_000, 16
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<int>"


def align(a_length: np.ndarray, b_length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts (offsets where both end), the group of each A and each B token, and the links as positions in A and in B."""
    a_end, b_end = np.cumsum(a_length, dtype=np.int64), np.cumsum(b_length, dtype=np.int64)
    cuts = np.intersect1d(a_end, b_end, assume_unique=bool(a_length.all() and b_length.all()))  # no empty token: no end twice
    a_first, b_first = np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)
    a_times, b_times = np.searchsorted(a_end, cuts, "right") - a_first, np.searchsorted(b_end, cuts, "right") - b_first
    each = a_times * b_times
    within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    per = np.repeat(b_times, each)
    return cuts, np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end), np.repeat(a_first, each) + within // per, np.repeat(b_first, each) + within % per


def piece_bytes(piece: str) -> bytes:
    return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-Fa-f]{2}>", piece) else piece.replace(MARK, " ").encode()


class Sides:
    """Both models, and what a unit (a word after its space, or a whole text after one) comes to."""

    def __init__(self, a_model: str, a_facts: dict, b_model: bytes, by_word: bool):
        import sentencepiece

        self.a = Encoder(a_model, a_facts, added_as_text=True)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        vocab = {i: s for s, i in token_bytes(self.a.library).items()} | {i: t.content.encode() for i, t in self.a.library.get_added_tokens_decoder().items()}
        self.a_bytes = [vocab.get(i, b"") for i in range(max(vocab) + 1)]
        self.b_bytes = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_length, self.b_length = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_bits = len(self.a_bytes).bit_length()
        self.pair_bits = self.a_bits + len(self.b_bytes).bit_length()
        self.by_word = by_word and not self.a.whole
        # a token with the mark that follows it: "," inside a side of a group, "|" after its A side, ";" after the group
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        self.written = [f"{i}{m}".encode() for m, n in ((",", n_a), ("|", n_a), (",", n_b), (";", n_b)) for i in range(n)]
        self.known: dict[str, Unit | None] = {}
        self.old: dict[str, Unit | None] = {}

    def units_of(self, text: str | None) -> list[str]:
        if not text or MARK in text:
            return []
        return words_of(text) if self.by_word else [text]

    def look_up(self, units: set[str]) -> dict[str, Unit | None]:
        """What each unit comes to: aligned when first met, then remembered in a table of bounded size; a full one becomes the
        old one, from which what is met again is taken."""
        if len(self.known) > MEMO:
            self.old, self.known = self.known, {}
        new = [u for u in units if u not in self.known and u not in self.old]
        found = dict(zip(new, self.align_units(new)))
        out = {u: self.known[u] if u in self.known else self.old[u] for u in units if u not in found} | found
        self.known.update((u, x) for u, x in out.items() if len(u) <= MEMO_LENGTH)
        return out

    @staticmethod
    def told(ids: list[bytes], table: list[bytes], units: list[str]) -> bool:
        """Whether each unit's tokens make its bytes after a space."""
        given = [f" {u}".encode() for u in units]
        made = [table[x] for x in memoryview(b"".join(ids)).cast("I")]
        ends = np.cumsum([0, *map(len, made)])[np.cumsum([len(x) // 4 for x in ids])]
        return b"".join(made) == b"".join(given) and bool((ends == np.cumsum(list(map(len, given)))).all())

    def align_units(self, units: list[str]) -> list[Unit | None]:
        """(number of A tokens plus that of B tokens << 32, the groups as text, the linked pairs packed) of each unit; None where
        the tokens' bytes are not the unit's."""
        if not units:
            return []
        a_ids = [self.a.some(f" {u}") if self.by_word else self.a.after_space(u) for u in units]
        # The encoder puts the space itself, but gives nothing for it alone.
        b_ids = [packed(ids) if u else packed([self.b.piece_to_id(MARK)]) for u, ids in zip(units, self.b.encode(units))]
        bad = [] if self.told(a_ids, self.a_bytes, units) and self.told(b_ids, self.b_bytes, units) else [i for i, u in enumerate(units) if not self.told([a_ids[i]], self.a_bytes, [u]) or not self.told([b_ids[i]], self.b_bytes, [u])]
        for i in bad:
            a_ids[i] = b_ids[i] = b""
        n_a, n_b = (np.array([len(x) // 4 for x in side], np.int64) for side in (a_ids, b_ids))
        a, b = (np.frombuffer(b"".join(side), np.uint32).astype(np.int64) for side in (a_ids, b_ids))
        cuts, a_group, b_group, link_a, link_b = align(self.a_length[a], self.b_length[b])
        # in order of groups, A before B; a token's place follows from the tokens of the groups before
        in_a, in_b = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
        marks = np.empty(len(a) + len(b), np.int64)
        marks[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[a_group]] = a + len(self.a_bytes) * np.diff(a_group, append=len(cuts)).astype(bool)
        marks[np.arange(len(b)) + np.cumsum(in_a)[b_group]] = b + 2 * len(self.a_bytes) + len(self.b_bytes) * np.diff(b_group, append=len(cuts)).astype(bool)
        text = list(map(self.written.__getitem__, marks.tolist()))
        # a unit's end is a cut, so its links are those of its A tokens
        link_end = np.searchsorted(link_a, np.cumsum(n_a)).tolist()
        pairs = ((b[link_b] << self.a_bits) | a[link_a]).tobytes()
        out, at, link = [], 0, 0
        for i, (x, y, end) in enumerate(zip(n_a.tolist(), n_b.tolist(), link_end)):
            out.append((x + (y << 32), b"".join(text[at : at + x + y])[:-1], pairs[8 * link : 8 * end]))
            at, link = at + x + y, end
        for i in bad:
            out[i] = None
        return out


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per row of docs: its counts, the hash of its groups, and its distinct linked pairs (a, b) with their numbers n."""
    with open(a_path, encoding="utf-8") as f:
        a_model = f.read()
    with open(b_path, "rb") as f:
        b_model = f.read()
    # Both files and what is proven of them are as large as the vocabularies: a bounded broadcast.
    shared = docs.sparkSession.sparkContext.broadcast((a_model, file_facts(a_model), b_model, bool(model_facts(b_model))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Sides(*shared.value)
        first, second, third = (itemgetter(i) for i in range(3))

        def aligned(ids: list[int | None], texts: list[list[str]]) -> pa.RecordBatch:
            found = sides.look_up(set(chain.from_iterable(texts)))
            bad = {u for u, x in found.items() if x is None}
            n_a, n_b, n_groups, hashes, links = [], [], [], [], []
            for units in texts:
                if bad and not bad.isdisjoint(units):
                    units = []
                met = list(map(found.__getitem__, units))
                tokens, groups = sum(map(first, met)), b";".join(map(second, met))
                links.append(b"".join(map(third, met)))
                n_a.append(tokens & 0xFFFFFFFF)
                n_b.append(tokens >> 32)
                n_groups.append(groups.count(b";") + 1 if met else 0)
                hashes.append(hashlib.sha256(groups).hexdigest() if met else "")
            n_links = np.array([len(x) // 8 for x in links], np.int64)
            owner = np.repeat(np.arange(len(ids), dtype=np.int64), n_links)
            keys, times = np.unique((owner << sides.pair_bits) | np.frombuffer(b"".join(links), np.int64), return_counts=True)
            offsets = pa.array(np.searchsorted(keys, np.arange(len(ids) + 1, dtype=np.int64) << sides.pair_bits), pa.int32())
            pair = keys & ((1 << sides.pair_bits) - 1)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (pair & ((1 << sides.a_bits) - 1), pair >> sides.a_bits, times)]
            counts = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *counts, pa.array(hashes, pa.string()), *lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "n"])

        for batch in batches:
            ids, texts, characters = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids.append(doc_id)
                texts.append(sides.units_of(text))
                characters += len(text or "")
                if characters >= TEXT_SLICE:
                    yield aligned(ids, texts)
                    ids, texts, characters = [], [], 0
            if ids:
                yield aligned(ids, texts)
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count, best: how many links hold the pair, and whether no pair of that b has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        pairs, sums, waiting = np.empty(0, np.int64), np.empty(0, np.int64), []

        def met() -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate([own, *new]) for own, new in zip((pairs, sums), zip(*waiting)))
            keys, inverse = np.unique(keys, return_inverse=True)
            return keys, np.bincount(inverse, n, len(keys)).astype(np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs & 0xFFFFFFFF, pa.int32()), pa.array(pairs >> 32, pa.int32()), pa.array(sums), pa.array(np.full(len(pairs), salt), pa.int32())], names=["a", "b", "n", "salt"])

        held = 0
        for batch in batches:
            a, b, n = (np.asarray(batch.column(i).flatten()).astype(np.int64) for i in range(3))
            waiting.append(((b << 32) | a, n))
            held += len(a)
            if held >= TASK_PAIRS:
                (pairs, sums), waiting, held = met(), [], 0
                if len(pairs) >= TASK_PAIRS:
                    yield rows()
                    pairs, sums = pairs[:0], sums[:0]
        if waiting:
            pairs, sums = met()
        yield rows()

    part = aligned.select("a", "b", "n").mapInArrow(run, "a int, b int, n long, salt int")
    counted = part.groupBy("a", "b", "salt").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(F.sum("n").alias("count"))
    counted = stage_table(counted, "pairs")
    most = counted.groupBy("b").agg(F.max("count").alias("most"))
    return counted.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def link_texts(aligned: DataFrame, pairs: DataFrame, slice_pairs: int = SLICE) -> DataFrame:
    """aligned without its pairs, with n_best and count_sum. aligned, pairs: staged tables."""
    spark, total = aligned.sparkSession, pairs.count()
    slices = max(1, -(-total // slice_pairs) if total <= slice_pairs else -(-total * 5 // (slice_pairs * 4)))  # hashing deals unevenly
    cut = pairs.withColumn("slice", F.pmod(F.xxhash64("a", "b"), F.lit(slices)))

    def reader(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, counts, best = shared.value
            for batch in batches:
                offsets = np.asarray(batch.column("a").offsets)
                a, b, n = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in "abn")
                pair = (b << 32) | a
                at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
                found = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
                sums = []
                for value in (np.where(found, n * best[at], 0), np.where(found, n * counts[at], 0)) if len(keys) else (n * 0, n * 0):
                    running = np.concatenate([[0], np.cumsum(value)])
                    sums.append(running[offsets[1:] - offsets[0]] - running[offsets[:-1] - offsets[0]])
                was = [np.asarray(batch.column(c)) for c in ("n_best", "count_sum")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(w + s) for w, s in zip(was, sums))], names=[*kept, "n_best", "count_sum"])

        return run

    zero = F.lit(0).cast("long")
    out = aligned.withColumns({"n_best": zero, "count_sum": zero})
    for i in range(slices):
        kept = [c for c in aligned.columns if i < slices - 1 or c not in "abn"]
        part = cut.where(F.col("slice") == i).select("a", "b", "count", "best").toArrow()  # a slice at most, about 20 bytes a pair
        keys = (np.asarray(part["b"]).astype(np.int64) << 32) | np.asarray(part["a"])
        order = np.argsort(keys)
        shared = spark.sparkContext.broadcast((keys[order], np.asarray(part["count"])[order], np.asarray(part["best"]).astype(np.int64)[order]))
        types = {f.name: f.dataType.simpleString() for f in out.schema}
        out = out.mapInArrow(reader(shared), ", ".join(f"{c} {types[c]}" for c in (*kept, "n_best", "count_sum")))
        if i < slices - 1:
            out = stage_table(out, "linked")
    return out


def align_and_count(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum for each row of docs."""
    aligned = stage_table(align_documents(docs, a_path, b_path), "aligned")
    return link_texts(aligned, stage_table(pair_counts(aligned), "pair_counts"))
