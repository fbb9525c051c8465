"""Ranked lexical search against plain scores."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import lexsearch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    """Sorted (item_id, rank, doc_id, score)."""
    given = [(d, terms(t)) for d, t in docs]
    n_docs, words = sum(bool(w) for _, w in given), sum(len(w) for _, w in given)
    df = Counter(t for _, w in given for t in set(w))
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, w in given:
            tf = Counter(w)
            m = w and 100 - 25 + (25 * len(w) * n_docs) // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in terms(text) if tf[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


DOCS = [
    (1, "The cat sat on the mat"), (1, "The cat sat on the mat"), (2, "the cat"), (3, None), (4, ""), (5, " .,;- \n"), (6, "word " * 50_000 + "cat"),
    (None, "mat mat mat"), (7, "ÜBER über Straße straße 42x"), (8, "a_b-c [d] {e} `f` ^g"), (9, "\x00cat\x1fMAT 漢字 😀 dog"), (10, "dog"), (11, "dog"),
]
ITEMS = [(1, "cat mat Cat"), (2, None), (None, "dog 漢字"), (3, ""), (4, "unseen words"), (5, "Über straße 😀 b d e"), (5, "Über straße 😀 b d e"), (6, "the " * 3_000 + "word")]


@pytest.mark.parametrize("k", [1, 2, 20])
def test_odd_rows(spark, k):
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in DOCS], "doc_id long, text string, t int, row int, n int").repartition(3)
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id long, text string, q int, term string")
    assert got(lexsearch.search(docs, items, k)) == plain(DOCS, ITEMS, k)
    assert lexsearch.search(docs.limit(0), items, k).count() == lexsearch.search(docs, items.limit(0), k).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_scores(spark, monkeypatch, small):
    if small:  # several slices of terms, no broadcast of lookups, lists in several blocks
        monkeypatch.setattr(lexsearch, "TERMS", 60)
        monkeypatch.setattr(lexsearch, "BROADCAST_ROWS", 3)
        monkeypatch.setattr(lexsearch, "LIST_BLOCK", 10)
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 120)))) for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)]  # ties beyond k
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(25)] + [(99, docs[5][1])]
    made = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string").repartition(3)
    assert got(lexsearch.search(made(docs, "doc_id"), made(items, "item_id"), 10)) == plain(docs, items, 10)


def test_thresholds_leave_lists_unread(spark):
    """A long list of a common word is not fetched once rare words have set the bound."""
    docs = [(i, "common filler" if i % 2 else "common rare other thing") for i in range(300)] + [(1000 + i, "rare gem stone common") for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    named, item_terms = lexsearch.item_terms(spark.createDataFrame([(1, "rare gem stone common")], "item_id long, text string"))
    known = item_terms.select("term").distinct().select("term", F.xxhash64("term").alias("t"))
    lists = lexsearch.weighted(lexsearch.post(frame, known)).cache()
    best = lexsearch.tput(lists, item_terms.join(known, "term").select("q", "t", "times"), 10)
    assert sorted(r["doc_id"] for r in best.collect()) == list(range(1000, 1010))
