"""Packing and alignment against the libraries and plain versions."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm import alignment, bytebpe, packing, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CHARS = [" ", "  ", "\n", "\t", "a", "B", "é", "'s", "1", "!", "\x1c", "<|endoftext|>", "▁", "漢", "😀", "\r\n", "\x85", "ing", "\x00", " the", "<s>", "<0x41>", "ﬁ", " ", "ə"]
LONG = "word, " * 20_000 + "x" * 3_000


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ["".join(rng.choices(CHARS, k=rng.randrange(14))) for _ in range(3000)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(A)


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", i) for i, t in enumerate(texts[:300])] + [(7, texts[7], "en", 1), (None, "no id", None, 2), (900, None, "de", 3), (901, "", "de", 4), (902, LONG, "fr", 5), (903, "same text", "fr", 6), (903, "same text", "fr", 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, size string, rank long").repartition(3)


def test_ids_are_the_library_s(texts, library):
    with open(A, encoding="utf-8") as f:
        model = f.read()
    facts = bytebpe.file_facts(model)
    assert len(facts["ranks"]) == 50256
    encoder, plain = bytebpe.Encoder(model, facts, most=50), bytebpe.Encoder(model, facts, added_as_text=True)
    for t in texts:
        assert encoder.encode(t) == bytebpe.packed(library.encode(t, add_special_tokens=False).ids), repr(t)
    library.encode_special_tokens = True
    try:
        for t in texts:
            assert plain.after_space(t) == bytebpe.packed(library.encode(f" {t}", add_special_tokens=False).ids), repr(t)
    finally:
        library.encode_special_tokens = False


def test_a_file_without_the_facts_is_read_whole():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = f.read()
    encoder = bytebpe.Encoder(model, bytebpe.file_facts(model))
    assert encoder.whole and encoder.encode("Hello there") == bytebpe.packed(encoder.library.encode("Hello there", add_special_tokens=False).ids)


def least(counts):
    """Fewest bins, by search over all fillings."""
    cap, sizes = len(counts) - 1, [i for i in range(len(counts)) if counts[i]]
    fills = {tuple(sorted(f)) for k in range(1, cap + 1) for f in combinations_with_replacement(sizes, k) if sum(f) <= cap}
    seen, front, n = set(), {tuple(counts)}, 0
    while not any(not any(c) for c in front):
        nxt = set()
        for c in front:
            top = max(i for i in range(len(c)) if c[i])
            for f in fills:
                need = Counter(f)
                if top in need and all(c[i] >= k for i, k in need.items()):
                    nxt.add(tuple(x - need.get(i, 0) for i, x in enumerate(c)))
        front, seen, n = nxt - seen, seen | nxt, n + 1
    return n


def test_fewest_sequences_of_small_cases():
    rng = np.random.default_rng(4)
    for _ in range(40):
        counts = np.bincount(rng.integers(2, 11, rng.integers(1, 12)), minlength=13)
        found = packing.complete_bins(counts)
        assert sum(n for _, n in found) == least(list(counts)) >= packing.lower_bound(counts)
        used = np.zeros_like(counts)
        for pattern, n in found:
            assert sum(a * b for a, b in pattern) <= 12
            for a, b in pattern:
                used[a] += b * n
        assert (used == counts).all()


def test_search_beats_best_fit():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(200, 701, 5000), minlength=1025)
    assert sum(n for _, n in packing.complete_bins(counts)) < sum(n for _, n in packing.best_fit(counts))


def check_packed(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packed_documents(spark, docs, library):
    packed = packing.pack_documents(docs, A, capacity=256).cache()
    rows = packed.collect()
    used = check_packed(rows, 256)
    given = docs.collect()
    pieces = Counter()
    for d in given:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 256 or min(len(ids), 256)
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 256)], range(first, len(ids) + 1, 256))):
            part = np.array(ids[a:b], "<u4").tobytes()
            pieces[d["doc_id"], k, a, b - a, zlib.crc32(part), tuple(ids[a:b])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in rows) == pieces
    total = sum(r["length"] for r in rows)
    assert used <= -(-total // 256) + 1
    whole = packing.sequences(packed).collect()
    assert len(whole) == used and sum(r["n_tokens"] for r in whole) == total and all(len(r["ids"]) == r["n_tokens"] == sum(r["lengths"]) for r in whole)
    assert packing.pack_documents(docs.limit(0), A).count() == 0


def test_ranks_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_BLOCK", 7)
    pieces = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 40).otherwise(F.col("id") % 60 + 1).alias("length"), F.lit(1).alias("rank"), F.lit(2).alias("first"), F.lit("x").alias("Size"))
    out = packing.pack(pieces, capacity=100)
    assert out.columns == ["id", "length", "rank", "first", "Size", "sequence_id", "offset"]
    rows = out.collect()
    assert len(rows) == 3000 == len({r["id"] for r in rows})
    assert check_packed(rows, 100) <= 1.01 * sum(r["length"] for r in rows) / 100
    with pytest.raises(ValueError):
        packing.pack(pieces, capacity=50)


def plain_alignment(rows, library):
    import sentencepiece

    b = sentencepiece.SentencePieceProcessor(model_file=B)
    names = {i: s for s, i in bytebpe.token_bytes(library).items()}
    library.encode_special_tokens = True
    found = []
    for doc_id, text in rows:
        a_ids = library.encode(f" {text}", add_special_tokens=False).ids if text else []
        b_ids = b.encode(text) if text else []
        a_bytes, b_bytes = [names[i] for i in a_ids], [alignment.piece_bytes(b.id_to_piece(i)) for i in b_ids]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
            a_ids, b_ids, a_bytes, b_bytes = [], [], [], []
        ends = [np.cumsum([len(x) for x in side]).tolist() if side else [] for side in (a_bytes, b_bytes)]
        at = [{e: i for i, e in enumerate(end)} for end in ends]  # no token is empty, so ends differ
        links = [(a_ids[at[0][e]], b_ids[at[1][e]]) for e in sorted({*ends[0]} & {*ends[1]})]
        cuts, groups, low = sorted({*ends[0]} & {*ends[1]}), [], 0
        for cut in cuts if len(a_ids) < 3000 else []:
            inside = [",".join(str(i) for i, e in zip(ids, end) if low < e <= cut) for ids, end in zip((a_ids, b_ids), ends)]
            groups.append("|".join(inside))
            low = cut
        found.append((doc_id, len(a_ids), len(b_ids), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "" if not a_ids else None))
    library.encode_special_tokens = False
    count = Counter(x for f in found for x in f[4])
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return sorted(((d, n_a, n_b, g, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), h) for d, n_a, n_b, g, links, h in found), key=str)


@pytest.mark.parametrize("slice_pairs", [4_000_000, 400])
def test_alignment(docs, library, slice_pairs, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", slice_pairs)
    monkeypatch.setattr(alignment.link_texts, "__defaults__", (slice_pairs,))
    got = sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in alignment.align_and_count(docs, A, B).collect()), key=str)
    want = plain_alignment([(d["doc_id"], d["text"]) for d in docs.collect()], library)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(w[7] in (None, g[7]) for g, w in zip(got, want)) and sum(w[7] is None for w in want) == 1
    assert alignment.align_and_count(docs.limit(0), A, B).count() == 0


def test_tokens_that_end_together_are_linked_each_with_each():
    cuts, a_group, b_group, link_a, link_b = alignment.align(np.array([2, 1, 0, 3]), np.array([3, 0, 1, 2]))
    assert cuts.tolist() == [3, 6] and a_group.tolist() == [0, 0, 0, 1] and b_group.tolist() == [0, 0, 1, 1]
    assert sorted(zip(link_a.tolist(), link_b.tolist())) == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 3)]


def test_queries_on_whole_tables(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = queries.op11_pack(spark, sf).collect()
    used = check_packed(rows, 1024)
    assert used <= -(-sum(r["length"] for r in rows) // 1024) + 1
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in queries.op13_align(spark, sf).collect()), key=str)
    want = plain_alignment([tuple(r) for r in table], library)
    assert [g[:7] for g in got] == [w[:7] for w in want] and all(w[7] in (None, g[7]) for g, w in zip(got, want))
