"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, clashing column names."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline
from plumbline.llm import decontam, langid, lmscore, mixing, ngramjoin, permindex, secretscan, tokencount, toxicity, urlfilter

DOC = "doc_id long, text string, lang string, source string, n_chars long, n long, h long, fp string, u double, size long, spans string, base int, score double, block long, w string, p int"
LONG = "word " * 120_000
ROWS = [
    (1, "the cat sat on the mat", "en", "s1"), (1, "the cat sat on the mat", "en", "s1"), (2, "the cat sat on the mat", "en", "s2"), (3, None, "en", "s1"), (4, "", None, None), (5, " \t\n ", "de", "s2"),
    (6, LONG, "en", "s1"), (None, "no id here at all", None, "s3"), (7, "42 % 17 ...", "fr", "s1"), (8, "der hund und die katze", "de", "s2"), (9, "ünïcödé \x00 text 😀", "de", None), (10, "a", "en", "s1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 0, 0, "x", 0.0, 0, "y", 0, 0.0, 0, "z", 0) for r in ROWS], DOC).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df, *cols):
    return sorted(([r["doc_id"], *[r[c] for c in cols]] for r in df.collect()), key=str)


def bench(spark):
    return spark.createDataFrame([(1, "cat sat"), (2, None), (None, "the mat"), (3, ""), (4, "cat sat")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (2, 0, None), (None, 1, 1), (8, 0, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")


def test_urls(spark):
    p = spark.createDataFrame([(1, None, None), (2, "no scheme", ""), (3, "http://A.Com/en/x?q#f", None), (3, "http://A.Com/en/x?q#f", None), (None, "://x.net", "<html>"), (5, "http://ex.org?/es/", "z" * 300_000)], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("node", F.lit(2))
    rules = (("block", "com/en/"), ("allow", "net/"))
    got = sorted(map(tuple, urlfilter.filter_urls(p, rules).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == sorted([(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.com", "/en/x", "com/en/", "block"), (3, "a.com", "/en/x", "com/en/", "block"), (None, "x.net", "", None, "allow"), (5, "ex.org", "", None, "allow")], key=str)
    assert urlfilter.filter_urls(p.limit(0), rules).count() == 0


def test_toxicity(spark, docs, none):
    got = toxicity.score_toxicity(docs, toxicity.train(docs, labels(spark))).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels(spark).limit(0))).collect())
    assert toxicity.score_toxicity(none, toxicity.train(none, labels(spark))).count() == 0


def test_language(docs, none):
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert all(got[i]["lang_pred"] == "und" and not got[i]["accepted"] for i in (3, 4, 5, 7))
    assert got[1]["lang_pred"] in ("en", "de", "fr") and 0 < got[1]["score"] <= 1
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(none)).collect()} == {"und"}
    assert langid.identify(none, langid.train(docs)).count() == 0
    kept = langid.keep_identified(docs, langid.train(docs))
    assert kept.columns == docs.columns and {3, 4, 5, 7}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_jaccard(docs, none):
    got = by_id(ngramjoin.jaccard_components(docs), "n_shingles", "component_id")
    assert [1, 3, 1] in got and got.count([1, 3, 1]) == 2 and [2, 3, 1] in got
    assert [3, 0, 3] in got and [4, 0, 4] in got and [5, 0, 5] in got and [6, 1, 6] in got and [10, 1, 10] in got
    assert [None, 2, None] in got
    assert ngramjoin.jaccard_components(none).count() == 0
    kept = [r["doc_id"] for r in ngramjoin.keep_one(docs).collect()]
    assert sorted(x for x in kept if x) == [1, 3, 4, 5, 6, 7, 8, 9, 10] and None in kept


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [3.0, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (1, [0.5, 0.0])], "vec_id long, embedding array<double>").withColumn("score", F.lit(0)).withColumn("b", F.lit(0))
    got = [tuple(r) for r in permindex.nearest(v, v.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 7, 3.0), (0, 2, 1, 1.0), (0, 3, 1, 0.5)]
    assert permindex.nearest(v.limit(0), v).count() == 0 and permindex.nearest(v, v.limit(0)).count() == 0


def test_secrets(docs, none):
    assert secretscan.find_secrets(docs).count() == len(ROWS)
    assert secretscan.find_secrets(none).count() == 0
    assert secretscan.redact(docs).columns == docs.columns
    assert sorted(map(str, secretscan.redact(docs).select("text").collect())) == sorted(map(str, docs.select("text").collect()))


def test_tokens(docs, none):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    got = by_id(tokencount.count_tokens(docs, model), "n_bytes", "n_tokens")
    assert [3, 0, 0] in got and [4, 0, 0] in got and len(got) == len(ROWS)
    assert tokencount.count_tokens(none, model).count() == 0


def test_contamination(spark, docs, none):
    got = by_id(decontam.find_contamination(docs, bench(spark)), "n_words", "n_hit", "items")
    assert got.count([1, 6, 4, ["1", "4"]]) == 2 and [3, 0, 0, []] in got and [5, 0, 0, []] in got
    assert decontam.find_contamination(none, bench(spark)).count() == 0
    assert all(r["n_hit"] == 0 for r in decontam.find_contamination(docs, bench(spark).limit(0)).collect())
    cut = decontam.decontaminate(docs, bench(spark))
    assert cut.columns == docs.columns and {r["text"] for r in cut.where("doc_id = 1").collect()} == {"the  on "}
    assert decontam.decontaminate(docs, bench(spark).limit(0)).count() == len(ROWS)


def test_mixture(docs, none):
    got = mixing.pareto_mix(docs).collect()
    assert len(got) == len(ROWS) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.pareto_mix(none).count() == 0


def test_language_model(docs, none):
    got = lmscore.score_texts(docs, block_words=50).collect()
    assert len(got) == len(ROWS) and {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    assert all(r["score"] <= 0 and r["base_score"] <= 0 for r in got)
    assert lmscore.score_texts(none).count() == 0


def test_pipeline_on_odd_tables(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and {1, 6} <= set(ids) and {2, 3, 4, 5, 7}.isdisjoint(ids)


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    """Each stage against a plain version, on what the stage before it kept."""
    import random
    import re

    from test_methods import brute_components, secrets_brute

    rng = random.Random(11)
    vocabulary = {"en": "the cat sat on a warm mat while rain fell over green hills and birds sang", "de": "der hund lief durch den wald und die katze schlief im warmen haus am fluss"}
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = []
    for i in range(160):
        lang = "de" if i % 3 == 0 else "en"
        text = " ".join(rng.choice(vocabulary[lang].split()) for _ in range(rng.randrange(30, 60)))
        if i % 10 == 4:
            text = rows[-1][1] + " again"
        if i % 10 == 6:
            text += f" {item}, and more"
        if i % 10 == 8:
            text += f" password = hunter{i:06d} end"
        rows.append((i, text, lang, f"s{i % 3}" if i % 7 else None, len(text)))
    rows += [(200, "1234 5678 !!", "en", "s1", 12), (201, None, "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    spark.createDataFrame([(1, item), (None, "no such words here at all in any of the documents")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    state, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, str(tmp_path))
        seen.append(sorted(map(tuple, state.collect()), key=str))
        if len(seen) < 5:
            assert state.columns == docs.columns
            state = spark.createDataFrame(seen[-1], docs.schema)
    kept, single, cut, masked, mixed = seen
    assert {200, 201}.isdisjoint({r[0] for r in kept}) and len(kept) >= 155 and set(kept) <= set(rows)

    kept = sorted(kept)
    groups = {}
    for r, (_, c) in zip(kept, brute_components([r[1] for r in kept], 80, 5)):
        groups.setdefault(c, r)  # rows come by id
    assert sorted(single) == sorted(groups.values()) and len(single) < len(kept)

    def without_item(text):
        return re.sub(item.replace(" ", r"\W+"), "", text)

    assert sorted(cut) == sorted((i, without_item(t), lang, s, len(without_item(t))) for i, t, lang, s, _ in single) and sum(r[1] != o[1] for r, o in zip(sorted(cut), sorted(single))) >= 10

    def mask(text):
        out, at = "", 0
        for start, _, end in secrets_brute(text):
            if start >= at:
                out += text[at:start] + "[SECRET]"
            at = max(at, end)
        return out + text[at:]

    assert sorted(masked) == sorted((i, mask(t), lang, s, n) for i, t, lang, s, n in cut) and sum("[SECRET]" in r[1] for r in masked) >= 10

    by = {}
    for (i, t, _, s, _), r in zip(sorted(masked), sorted(mixed)):
        assert (r[0], r[1], r[2]) == (i, s, len(t.split())) and r[-1] == r[-2] * r[2] <= 3 * r[2]
        by.setdefault(s, []).append(r)
    for group in by.values():
        assert sum(r[2] for r in group) == group[0][3] and abs(sum(r[-1] for r in group) - group[0][4]) <= 0.02 * group[0][4] + 30
