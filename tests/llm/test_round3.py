"""What is hidden in a page declares nothing; no language is lost to the sample."""

import random

from plumbline.llm import langid, urlfilter


def test_comments_scripts_and_text_areas_declare_nothing(spark):
    link = '<link rel="canonical" href="http://good.org/x">'
    pages = [("http://blocked.com/a", f"<!-- {link} -->"), ("http://blocked.com/b", f"<script>var x = '{link}'</script>"), ("http://blocked.com/c", f"<TEXTAREA rows=2>{link}</textarea >"), ("http://blocked.com/d", f"<!-- a --> {link}"), ("http://blocked.com/e", f"<!-- never ended {link}"), ("http://good.org/x", "")]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    assert [tuple(r) for r in urlfilter.page_links(df).collect()] == [("http://blocked.com/d", "http://good.org/x")]


def test_no_language_is_lost(spark):
    rng = random.Random(1)
    letters = {f"l{k}": [chr(0x3400 + 40 * k + i) for i in range(12)] for k in range(61)}
    rows = [(61 * n + k, " ".join("".join(rng.choices(a, k=6)) for _ in range(12)), lang) for n in range(9) for k, (lang, a) in enumerate(letters.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.train(docs)
    assert set(model["names"]) == {r["lang"] for r in docs.where(langid.fold("doc_id", 4) != 2).select("lang").distinct().collect()} and len(model["names"]) == 61
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.95 * got.count() > 0
