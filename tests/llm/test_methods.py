"""The operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import components, decontam, langid, lmscore, mixing, ngramjoin, permindex, queries, secretscan, tokencount, toxicity, urlfilter
from plumbline.llm.common import table

SF = "/root/testdata/sf0.001"


def make_docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 300
    e = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([120, 200, 400]))] + [(0, i) for i in range(200, 260)] + [(i, i + 1) for i in range(100, 140)]
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in e:
        parent[root(a)] = root(b)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert set(got) == {x for a, b in e if a != b for x in (a, b)}
    assert all((got[a] == got[b]) == (root(a) == root(b)) for a in list(got)[::3] for b in list(got)[::5])


RULES = (("block", "com/en/"), ("allow", "net/de/"))


def verdicts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["verdict"] for r in urlfilter.filter_urls(pages, RULES).collect()}


def test_aliases_take_decisions_and_allow_precedes(spark):
    rows = [
        (1, "https://bad.com/en/x", '<link rel="canonical" href="https://a.org/1">'), (2, "HTTPS://A.org:443/1#part", ""), (3, "https://b.org/2", '<meta http-equiv="refresh" content="0; url=/3">'),
        (4, "https://b.org/3", '<LINK href=//a.org/1 rel=canonical>'), (5, "https://ok.net/de/1", '<link rel=canonical href="http://c.org/9">'), (6, "http://c.org/9", ""),
        (7, "http://bad.com/en/y", '<link rel=canonical href="http://c.org/9">'), (8, "http://lone.org/", ""),
    ]
    assert verdicts(spark, rows) == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "block", 8: "allow"}


def test_only_links_make_aliases(spark):
    """Another scheme, a "www." or a tracking parameter is another URL."""
    rows = [(1, "https://bad.com/en/x", '<link rel=canonical href="https://a.org/1">'), (2, "http://a.org/1", ""), (3, "https://www.a.org/1", ""), (4, "https://a.org/1?utm_source=z", ""), (5, "https://a.org/1/", ""), (6, "https://a.org/1", "")]
    assert verdicts(spark, rows) == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "block"}


def test_references_are_resolved(spark):
    rows = [
        (1, "https://bad.com/en/x", '<link rel=canonical href="https://a.org/p?a=1&amp;b=2">'), (2, "https://a.org/p?a=1&b=2", ""),
        (3, "https://bad.com/en/d/y", '<base href="https://b.org/k/"><link rel="canonical" href="../m/./n">'), (4, "https://b.org/m/n", ""),
        (5, "https://bad.com/en/z", '<link rel=canonical href="https://c.org/1"><link rel=canonical href="https://c.org/2"><meta http-equiv=refresh content="0; URL=\'https://c.org/3?x=1&amp;y=2\'">'),
        (6, "https://c.org/1", ""), (7, "https://c.org/2", ""), (8, "https://c.org/3?x=1&y=2", ""), (9, "https://bad.com/en/q?n=1", '<link rel=canonical href="?n=2">'), (10, "https://bad.com/en/m", '<link rel=canonical href="mailto:x@y.org">'),
    ]
    got = verdicts(spark, rows)
    assert all(got[i] == "block" for i in (2, 4, 6, 7, 8))
    links = {tuple(r) for r in urlfilter.page_links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert ("https://bad.com/en/q?n=1", "https://bad.com/en/q?n=2") in links and not any("mailto" in d for _, d in links)


def test_pairs_count_in_toxicity():
    """An insult with a group mention is toxic, either alone is not: no additive weights can tell."""
    rng = random.Random(1)
    rows, y = [], []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(50)}" for _ in range(6)] + ["insult"] * a + ["group"] * b
        rows.append(toxicity.features(" ".join(words)))
        y.append(float(a and b))
    m = toxicity.fit(rows, np.array(y), epochs=40)
    z = toxicity.logits(m, [toxicity.features(t) for t in ("insult group w1 w2", "insult w1 w2", "group w1 w2", "w1 w2")])
    assert z[0] > 0 > max(z[1:])
    v, flat = m["v"], toxicity.features("insult group w1")
    own = m["slot_of"][flat]
    brute = sum(v[i] @ v[j] for k, i in enumerate(own) for j in own[k + 1 :] if i >= 0 and j >= 0) + m["w"][own[own >= 0]].sum() + m["b"]
    assert toxicity.logits(m, [flat])[0] == pytest.approx(brute)


def test_terms_that_matter_in_pairs_only_are_kept():
    """Either word alone is toxic, both together or neither are not: no word by itself tells anything."""
    rng = random.Random(2)
    rows, y = [], []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(toxicity.features(" ".join([f"w{rng.randrange(50)}" for _ in range(6)] + ["left"] * a + ["right"] * b)))
        y.append(float(a != b))
    kept = toxicity.fit(rows, np.array(y), epochs=1)["slot_of"]
    assert (kept[toxicity.features("left right")] >= 0).all() and (kept >= 0).sum() < 10


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    s = np.concatenate([np.zeros(4, np.int64), rng.integers(0, 4, 500)])
    keys, counts = np.unique(langid.gram_keys(s), return_counts=True)
    m = langid.fit_kneser_ney(keys, counts, 3)
    for ctx in (keys[:5] >> langid.BITS).tolist() + [0]:
        p = 2 ** -langid.gram_bits(m, np.array([(ctx << langid.BITS) | i for i in range(5)], np.int64))
        assert p.sum() == pytest.approx(1, abs=1e-5)


def test_language_on_held_out_texts(spark):
    d = table(spark, SF, "documents")
    m = langid.train(d)
    r = langid.identify(d, m).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(x["lang"] == x["lang_pred"] for x in r) / len(r) > 0.95
    odd = langid.identify(make_docs(spark, ["zqx jvk wzq qqj xkz vvq zjx kqz wxq jzv " * 30]), m).first()
    assert not odd["accepted"]
    assert langid.identify(d, m).where("not accepted and lang_pred != 'und'").count() <= 2


def test_a_language_left_out_of_training_is_rejected(spark):
    d = table(spark, SF.replace("sf0.001", "sf0.01"), "documents")
    got = langid.identify(d, langid.train(d.where("lang != 'es'"))).where("lang_pred != 'und'").join(d.select("doc_id", "lang"), "doc_id").collect()
    unseen, own = [r["accepted"] for r in got if r["lang"] == "es"], [r["accepted"] for r in got if r["lang"] != "es"]
    assert sum(unseen) <= 0.1 * len(unseen) and sum(own) >= 0.98 * len(own)


def brute_components(texts, percent=85, width=4):
    sets = []
    for t in texts:
        w = (t or "").encode().translate(ngramjoin.LOWER_BYTES).split()
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def near_texts(seed, n=160):
    rng = random.Random(seed)
    shared = " ".join(f"p{i}" for i in range(25))
    out, bases = [], [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 90))] for _ in range(6)]
    for i in range(n):
        w = list(bases[i % 6 if i % 3 else 0])
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(30)}"
        out.append(" ".join(w) + (" " + shared if i % 4 == 0 else ""))
    return out + ["A b", "a B", "a", "", None, "one two three four", "ONE two three four"]


@pytest.mark.parametrize("seed, unit", [(0, 3_000_000), (1, 3_000_000), (2, 1500), (3, 300)])
def test_jaccard_components_equal_brute_force(spark, seed, unit):
    texts = near_texts(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(make_docs(spark, texts), unit_shingles=unit).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_one_row_of_each_group_stays(spark):
    """Against brute force, with ids that repeat, with the same text and with others."""
    texts = near_texts(7, 90)
    rng = random.Random(3)
    rows = [(rng.randrange(60), t) for t in texts] + [(3, "A b c d e f"), (5, "a B c d e f"), (5, "another text that links with nothing"), (5, "a B c d e f"), (61, ""), (61, ""), (None, "a b c d e f")]
    got = sorted(map(tuple, ngramjoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=5, percent=80).collect()), key=str)
    own = [r for r in rows if r[0] is not None]
    comp = [c for _, c in brute_components([t for _, t in own], 80, 5)]
    best = {}
    for (i, t), c in zip(own, comp):
        if (t or "").split():
            best.setdefault(c, []).append((i, t))
    want_ids = sorted(min(i for i, _ in group) for group in best.values())
    kept = [r for r in got if r[0] is not None and (r[1] or "").split()]
    assert sorted(i for i, _ in kept) == want_ids and len(kept) == len(best)
    assert all(sum(r in group for r in kept) >= 1 for group in best.values())
    assert (5, "another text that links with nothing") in got and got.count((61, "")) == 2 and (None, "a b c d e f") in got


def test_other_width_and_threshold(spark):
    texts = near_texts(5, 60)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(make_docs(spark, texts), width=5, percent=80).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 80, 5)


@pytest.mark.parametrize("n, width", [(3000, 24), (20_000, 64)])
def test_recall_of_nearest_neighbours(spark, n, width):
    """With pruning at work: 60 and 75 rows in 1,000 are reranked at most."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, width)) * rng.uniform(0.5, 2, (n, 1))
    x[100:400] = x[100]  # many equal vectors: ties go to the smaller id
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = df.where(f"vec_id % {n // 60} = 0")
    found = collections.defaultdict(list)
    for r in permindex.nearest(df, q).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = total = 0
    for i, got in found.items():
        s = x @ x[i]
        order = [j for j in np.lexsort((np.arange(len(x)), -np.round(s, 9))) if j != i][:20]
        hit += len({j for j, _ in got} & set(order))
        total += 20
        assert all(abs(v - s[j]) < 1e-9 for j, v in got) and got == sorted(got, key=lambda p: (-p[1], p[0]))
    assert len(found) >= 60 and hit / total >= 0.9
    assert permindex.rerank_count(8192, 20) < 0.12 * 8192 and permindex.rerank_count(65_536, 20) < 0.04 * 65_536


def test_credits_rank_like_the_footrule():
    rng = np.random.default_rng(2)
    x, pivots = rng.normal(size=(50, 8)), rng.normal(size=(16, 8))
    full = permindex.orders(x, pivots, 16)
    place = np.argsort(full, axis=1)  # place of each pivot
    files = permindex.inverted_files(x, pivots, 16).astype(int)
    footrule = np.abs(place - place[0]).sum(axis=1)
    shared = np.minimum(files, files[:, :1]).sum(axis=0)
    assert (footrule == 16 * 17 - 2 * shared).all()


def secrets_brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secret_spans(spark):
    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [
        'API_KEY = "abcdefgh1" and Token:short secret=token:abcdefghij', "😀 password: 'hunter2hunter2' é " + hexes(40), "AKIA" + "A1" * 8 + " AKIASHORT AKIAAKIAAKIAAKIA12", hexes(31) + " " + hexes(32) + "g" + hexes(33),
        "passwd=aaaaaaaa,passwd=bbbbbbbb", "plain text", "",
    ]
    got = {r["doc_id"]: [tuple(b) for b in r["base"]] for r in secretscan.find_secrets(make_docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [secrets_brute(t) for t in texts]
    clean = {r["doc_id"]: r["text"] for r in secretscan.redact(make_docs(spark, texts)).collect()}
    assert clean[4] == "[SECRET],[SECRET]" and clean[5] == "plain text" and clean[1].startswith("😀 [SECRET]")


def test_masked_rows_keep_their_columns(spark):
    """Whatever the columns are called."""
    docs = spark.createDataFrame([(1, "secret=abcdefgh1 x", 7, "r", 0.5), (2, None, 8, "s", 1.5)], "doc_id long, text string, base int, runs string, spans double")
    assert sorted(map(tuple, secretscan.redact(docs).collect())) == [(1, "[SECRET] x", 7, "r", 0.5), (2, None, 8, "s", 1.5)]
    assert [tuple(r)[:2] for r in secretscan.find_secrets(docs, keep=("doc_id", "runs")).select("doc_id", "runs").orderBy("doc_id").collect()] == [(1, "r"), (2, "s")]


def test_many_matches_in_a_long_text(spark):
    text = " ".join(f"token={i:08d}" for i in range(3000))
    got = secretscan.find_secrets(make_docs(spark, [text])).first()["base"]
    assert [tuple(b) for b in got] == secrets_brute(text)


def test_battery_tells_random_from_structured(spark):
    rng = random.Random(3)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rand = ["".join(rng.choice(b64) for _ in range(44)) for _ in range(60)]
    rand = [r for r in rand if re.search("[0-9]", r)]
    dull = [f"section_{i}_of_the_long_report_about_things_{i}" for i in range(60)] + [f"src/main/java/org/example/module{i}/service" for i in range(60)] + ["0123456789" * 3 + "ab" * i for i in range(1, 20)]
    d = make_docs(spark, [f"x {t} y" for t in rand + dull])
    got = {r["doc_id"]: [s["k"] for s in r["spans"]] for r in secretscan.find_secrets(d).collect()}
    assert sum(3 in got[i] for i in range(len(rand))) >= 0.9 * len(rand)
    assert sum(3 in got[i] for i in range(len(rand), len(rand) + len(dull))) <= 1


def test_long_letter_only_and_partly_covered_secrets(spark):
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    b64 = letters + "0123456789+/"
    long, plain_letters, tail = draw(b64, 2001), [draw(letters, 44) for _ in range(20)], draw(b64, 44)
    texts = [f"x {long} y", f"{draw('0123456789abcdef', 32)}/{tail} y", "word " * 500 + "a/b/" * 400] + [f"x {t} y" for t in plain_letters]
    d = make_docs(spark, texts)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secretscan.find_secrets(d).collect()}
    assert got[0] == [(2, 3, 2003)] and got[1] == [(0, 2, 32), (32, 3, 77)] and got[2] == []
    assert sum(got[i + 3] == [(2, 3, 46)] for i in range(20)) >= 18
    clean = {r["doc_id"]: r["text"] for r in secretscan.redact(d).collect()}
    assert clean[0] == "x [SECRET] y" and clean[1] == "[SECRET][SECRET] y"


@pytest.mark.parametrize("name", ["sf0.001", "odd"])
def test_token_counts_equal_the_library(spark, name):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    odd = [" ", "  a", "a  ", "\n\n a\tb\r\n", "▁x ▁▁ y", "a▁", "　x", "<s> </s> <unk> <0x0A>", "😀 a\x00b", "a" * 300, "\r", ";\r\n x", " \n \n", "日本語 テキスト", "é" * 90]
    texts = odd if name == "odd" else [r["text"] for r in table(spark, SF, "documents").select("text").collect()]
    enc = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokencount.count_tokens(make_docs(spark, texts), path).collect()}
    assert [got[i] for i in range(len(texts))] == [(len(t.encode()), len(enc.encode(t))) for t in texts]
    facts = tokencount.model_facts(open(path, "rb").read())
    assert len(facts["whole"]) > 30_000 and all(len(enc.encode(p[1:])) == 1 for p in list(facts["whole"])[500:30_000:997] if p[0] == "▁" and len(p) > 1)


def test_fm_index(spark):
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 5, 4000)
    seq[-1] = 0
    index = decontam.FMIndex(seq, 5)
    pats = [tuple(p) for p in rng.integers(1, 5, (60, 4)).tolist()] + [(1,), (2, 2), (3, 1, 4)]
    m = np.zeros((len(pats), 4), np.int64)
    for i, p in enumerate(pats):
        m[i, 4 - len(p) :] = p
    lo, hi = index.search(m, np.array([len(p) for p in pats]))
    for p, a, b in zip(pats, lo, hi):
        want = [i for i in range(len(seq) - len(p) + 1) if tuple(seq[i : i + len(p)]) == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("shard, per_pass", [(40, 8), (10_000, 8), (400, 1)])
def test_contamination_equals_brute_force(spark, shard, per_pass):
    """Also where the test set takes several passes."""
    rng = random.Random(6)
    word = lambda: rng.choice(["a", "b", "Cé", "d1", "E"])
    items = [" ".join(word() for _ in range(rng.choice([2, 3, 6, 9]))) for _ in range(25)]
    texts = [" ".join(word() if rng.random() < 0.9 else "zz" for _ in range(rng.randrange(0, 60))) + (", ".join(items[:2]) if i % 9 == 0 else "") for i in range(120)]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    wins = collections.defaultdict(set)
    for i, t in enumerate(items):
        w = split(t)
        for k in range(max(1, len(w) - 5)):
            wins[tuple(w[k : k + 6])].add(str(i))
    got = {r["doc_id"]: r for r in decontam.find_contamination(make_docs(spark, texts), b, window=6, shard_words=shard, block_words=30, pass_blocks=per_pass).collect()}
    for i, t in enumerate(texts):
        w, hit, its = split(t), set(), set()
        for p, ids in wins.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    its |= ids
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(its))
        assert {x for s in got[i]["spans"] for x in range(s["start"], s["end"])} == hit


def test_passes_cut_the_same_texts(spark):
    docs = make_docs(spark, ["x one two three y", None, "four five", "one two THREE four-five z", ""]).withColumn("spans", F.lit("own")).withColumn("n_chars", F.lit(1))
    bench = spark.createDataFrame([(1, "one two three"), (None, "four five"), (2, "")], "item_id long, text string")
    for per_pass in (1, 8):
        got = {r["doc_id"]: (r["text"], r["spans"], r["n_chars"]) for r in decontam.decontaminate(docs, bench, window=3, block_words=1, pass_blocks=per_pass).collect()}
        assert got == {0: ("x  y", "own", 4), 1: (None, "own", 1), 3: (" z", "own", 2), 4: ("", "own", 1)}


def test_mixture_meets_its_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 40, 300])), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = mixing.pareto_mix(d).collect(), mixing.pareto_mix(d.repartition(9, "text")).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    by = collections.defaultdict(list)
    for r in a:
        by[r["source"]].append(r)
        assert r["taken"] <= 3 * r["size"]
    total = sum(r["size"] for r in a)
    assert sum(x[0]["target"] for x in by.values()) == pytest.approx(total)
    for x in by.values():
        # one closing document: off by half of the largest size at most
        assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= 150 and x[0]["target"] <= 3 * x[0]["source_size"] + 1e-6


def test_inclusion_follows_the_odds(spark):
    """Documents of two sizes: how often each is taken follows its rate, over many seeds."""
    d = spark.createDataFrame([(i, "w " * (4 if i % 2 else 64), "a" if i % 4 < 2 else "b") for i in range(400)], "doc_id long, text string, source string").cache()
    rate, took, n = collections.Counter(), collections.Counter(), 12
    for seed in range(n):
        rows = mixing.pareto_mix(d, weights=(1, 1), share=0.4, seed=f"s{seed}").collect()
        for r in rows:
            rate[r["source"], r["size"]] += r["rate"]
            took[r["source"], r["size"]] += r["copies"]
        assert all(r["rate"] - 1 < r["copies"] < r["rate"] + 1 for r in rows)
    assert len({round(x / 100 / n, 9) for x in rate.values()}) == 2  # unequal in a source, alike in equal sources
    for k, x in rate.items():
        assert abs(took[k] - x) < 0.1 * x, (k, took[k], x)
    # the rates of a source hold its target
    by = collections.Counter()
    for r in rows:
        by[r["source"]] += r["rate"] * r["size"]
    assert all(abs(by[r["source"]] - r["target"]) < 1e-6 * r["target"] for r in rows)


def test_language_model_scores(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the cat", "a dog", "The mat", "red"]) for _ in range(rng.randrange(0, 40))) + f" rare{i}" * (i % 5 == 0) for i in range(200)]
    got = {r["doc_id"]: r for r in lmscore.score_texts(make_docs(spark, texts), block_words=300, filter_bits=1 << 18).collect()}
    toks = {i: [*t.encode().translate(lmscore.LOWER_BYTES).split(), b"\n"] for i, t in enumerate(texts)}
    c = collections.Counter(w for i, ws in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        r = got[i]
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def brute_language_model(texts):
    """Scores with exact counts put on the filter's scale."""
    toks = [[*t.encode().translate(lmscore.LOWER_BYTES).split(), b"\n"] for t in texts]
    train = [ws for i, ws in enumerate(toks) if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = collections.Counter(w for ws in train for w in ws), collections.Counter(p for ws in train for p in zip([b"\n", *ws], ws))
    value = lmscore.level_values()
    scale = lambda c: value[lmscore.level_of(np.array([c]))[0]]
    mass = sum(scale(c) for c in one.values()) + len(one) + 1
    lam = min(0.9, 1 - sum(c == 1 for c in two.values()) / sum(two.values()))
    p = lambda u, v: (scale(one[v]) + 1) / mass if not one[u] else (1 - lam) * (scale(one[v]) + 1) / mass + lam * min(1, scale(two[u, v]) / scale(one[u]))
    return [sum(np.log10(min(1, p(u, v))) for u, v in zip([b"\n", *ws], ws)) for ws in toks]


@pytest.mark.parametrize("bits", [1 << 10, 1 << 26])
def test_every_training_gram_is_in_the_filter(spark, bits):
    """Also those seen once, however small a part of the filter is."""
    rng = random.Random(12)
    texts = [" ".join(f"w{min(int(rng.paretovariate(0.6)), 3000)}" for _ in range(20)) for _ in range(300)]
    got = {r["doc_id"]: r["score"] for r in lmscore.score_texts(make_docs(spark, texts), block_words=700, filter_bits=bits).collect()}
    want = brute_language_model(texts)
    # false positives of the filter raise a few scores, and the sum that normalises by less than a thousandth
    off = np.abs([got[i] - w for i, w in enumerate(want)])
    assert np.mean(off < 0.02) > 0.8, np.quantile(off, [0.1, 0.5, 0.8, 0.9, 1])


def test_pairs_of_rare_words_have_counts(spark):
    """The same rare words score higher in pairs that were seen; both texts are held out."""
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    texts = [" ".join(["the"] * 9 + [f"a{i % 100}", f"b{i % 100}"]) for i in range(400)]
    texts[held[0]] = " ".join(f"a{i} b{i}" for i in range(100))
    texts[held[1]] = " ".join(f"a{i} b{(i + 50) % 100}" for i in range(100))
    got = {r["doc_id"]: r for r in lmscore.score_texts(make_docs(spark, texts)).collect()}
    seen, unseen = (got[i] for i in held)
    assert seen["base_score"] == pytest.approx(unseen["base_score"]) and seen["score"] > unseen["score"] + 50


def test_filter_reads_back_levels(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-(1 << 62), 1 << 62, 3000)
    counts = np.minimum(rng.zipf(1.5, 3000), 10**6)
    rows = spark.createDataFrame([(int(k), int(q)) for k, q in zip(keys, lmscore.level_of(counts))], "key long, level int")
    filt = lmscore.build_filter(rows, 1 << 19)
    read = lmscore.read_levels(filt, keys.view(np.uint64))
    assert (read >= lmscore.level_of(counts)).all() and (read == lmscore.level_of(counts)).mean() > 0.97
    assert (lmscore.read_levels(filt, rng.integers(0, 1 << 62, 3000).view(np.uint64)) == 0).mean() > 0.97
    value = lmscore.level_values()
    assert all(abs(np.log2(value[lmscore.level_of(np.array([x]))[0]] / x)) < 0.51 for x in (1, 2, 3, 7, 50, 999, 123_456))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    plain = lambda rs: sorted(tuple("\0" if v is None else str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rs)
    r = con.sql(queries.SQL[name])
    assert sorted(r.columns) == cols
    assert plain(df.select(*cols).collect()) == plain(r.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())


def test_digests_follow_the_contract(spark, tmp_path):
    make_docs(spark, ["token = " + "ab12" * 9]).write.parquet(str(tmp_path / "documents.parquet"))
    r = queries.op6_secret_scan(spark, str(tmp_path)).first()
    assert (r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) == (1, 0, 1, "assign:0:44,hex:8:44")
    assert r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()
    none = queries.op8_decontaminate(spark, SF).where("not contaminated").first()
    assert none["items_sha256"] == hashlib.sha256(b"").hexdigest() and none["n_items"] == 0
