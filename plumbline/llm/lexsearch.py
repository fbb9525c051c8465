"""Ranked lexical search by TPUT (three-phase uniform threshold) over term-partitioned postings.

Only terms of the items are posted: their words go to the workers in slices of `TERMS`, each a bounded broadcast and a pass
over the texts. A term's list is its postings by contribution (weight times saturated frequency), dealt by term and, for long
lists, by blocks of rows, highest first, in the shared folder. Lists are shared by the items; the three phases are:

1. the heads of all lists give each item candidates; the exact scores of the best of them bound its k-th score from below;
2. that bound over the number of the item's lists is a uniform threshold: every posting that reaches it is fetched. What was
   not fetched adds less than the threshold a list, so a document with no fetched posting is out, and a document's fetched
   sum and what its other lists could still add tell whether it can reach the bound, which the exact scores of the highest
   sums raise. Lists are shared, so a posting is sent once, however many items ask for it;
3. exact scores of the documents left are looked up, and the k highest stay.

Null text has no term; such documents, and those without words, count nowhere. Repeated rows are documents of their own, on
either side; a null doc_id or item_id stays null (last among ties). Equal scores go by ascending doc_id. Items without
documents give no rows; empty tables give none. Very long texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, broadcast_if_small, lower_ascii, stage_table

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: bytes.translate table: A-Z in lower case, ASCII characters that are in no word as spaces
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
#: words of a broadcast; rows of a lookup that may be broadcast
TERMS, BROADCAST_ROWS = 1_000_000, 1_000_000
#: a list's rows in one block: this many, or a 2,048th of all postings if that is less
LIST_BLOCK, LIST_BLOCKS = 65_536, 2_048
#: rows of a list's head and exactly scored candidates, in multiples of k
HEADS, CANDIDATES = 50, 5
#: the uniform threshold is this part of what would do: postings are sent once for all items, so more of them cost little, and
#: what is left unread bounds documents the closer
FINER = 8


def item_terms(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(q, item_id) of each row of items, and (q, term, times) of its distinct terms."""
    rows = stage_table(items.select(F.monotonically_increasing_id().alias("q"), "item_id", F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0)).alias("terms")), "items")
    return rows.select("q", "item_id"), rows.select("q", F.explode("terms").alias("term")).groupBy("q", "term").agg(F.count("*").alias("times"))


def post(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """t, row, doc_id, tf, n for each document and term of terms (term, t) in it, and rows of t -1 with numbers of documents
    that have words (row) and of their words (n). row tells documents apart once the result is written."""
    known = {bytes(r["term"], "utf-8"): r["t"] for r in terms.collect()}  # at most about TERMS rows
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        get, row = shared.value.get, TaskContext.get().partitionId() << 33
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            some = words = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = (text.as_py() or b"").translate(WORD_BYTES).split()
                row += 1
                some, words = some + bool(found), words + len(found)
                counts = Counter(map(get, found))
                counts.pop(None, None)
                for column, values in zip(out, (counts, [row] * len(counts), [doc_id] * len(counts), counts.values(), [len(found)] * len(counts))):
                    column.extend(values)
            for column, value in zip(out, (-1, some, None, 0, words)):
                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["t", "row", "doc_id", "tf", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "t long, row long, doc_id long, tf long, n long")


def weighted(postings: DataFrame) -> DataFrame:
    """t, row, doc_id, c (what the term adds to the document's score), dealt by term and block, highest first."""
    total = postings.where("t = -1").agg(F.coalesce(F.sum("row"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    docs, words = F.lit(total["docs"]).cast("long"), F.lit(max(1, total["words"])).cast("long")
    held = stage_table(postings.where("t >= 0").groupBy("t").agg(F.count("*").alias("df")), "df")
    posted = held.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"]
    block = max(1, min(LIST_BLOCK, posted // LIST_BLOCKS))
    ratio = (2 * docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    held = held.select(F.col("t").alias("term"), F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("w"), F.ceil(F.col("df") / F.lit(block)).alias("blocks")).where("w > 0")
    div = lambda a, b: F.call_function("div", a, b)
    m = F.lit(75).cast("long") + div(F.lit(25).cast("long") * F.col("n") * docs, words)
    c = F.col("w") * div(F.lit(1_000_000_000).cast("long") * F.col("tf"), 1000 * F.col("tf") + 12 * m)
    rows = postings.where("t >= 0").join(broadcast_if_small(held, BROADCAST_ROWS), F.col("t") == F.col("term"))
    rows = rows.select("t", "row", "doc_id", c.alias("c"), F.pmod(F.xxhash64("row"), F.col("blocks")).alias("block")).where("c > 0")
    return rows.repartition("t", "block").sortWithinPartitions("t", F.col("c").desc()).drop("block")


def kth_highest(scored: DataFrame, score: str, k: int, name: str) -> DataFrame:
    """(qk, name) of each q: the k-th highest score; q with fewer rows have none."""
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.col(score).desc()))
    return scored.select("q", score).withColumn("r", rank).where(F.col("r") <= k).where(F.col("r") == k).select(F.col("q").alias("qk"), F.col(score).alias(name))


def exact_scores(lists: DataFrame, wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """q, row, doc_id, score of candidates (q, row), a staged table."""
    rows = broadcast_if_small(candidates.select("row").distinct(), BROADCAST_ROWS)
    found = lists.join(rows, "row", "left_semi").join(broadcast_if_small(candidates, BROADCAST_ROWS), "row")
    found = found.join(broadcast_if_small(wanted.select("q", "t", "times"), BROADCAST_ROWS), ["q", "t"])
    return found.groupBy("q", "row", "doc_id").agg(F.sum(F.col("times") * F.col("c")).alias("score"))


def likeliest(seen: DataFrame, k: int) -> DataFrame:
    """(q, row) of the highest partial sums s of each q, as a staged table."""
    first = F.row_number().over(W.partitionBy("q").orderBy(F.col("s").desc(), "row"))
    return stage_table(seen.withColumn("r", first).where(F.col("r") <= CANDIDATES * k).select("q", "row"), "candidates")


def tput(lists: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """q, doc_id, score, rank of each q's k highest rows. lists: t, row, doc_id, c; wanted: q, t, times; staged tables."""
    by_c = W.partitionBy("t").orderBy(F.col("c").desc(), "row")
    heads = stage_table(lists.withColumn("r", F.row_number().over(by_c)).where(F.col("r") <= HEADS * k), "heads")
    highest = heads.where("r = 1").select(F.col("t").alias("th"), F.col("c").alias("most"))
    wanted = stage_table(wanted.join(highest, F.col("t") == F.col("th")).drop("th"), "wanted")  # lists that are empty add nothing

    # first phase
    added = F.col("times") * F.col("c")
    seen = heads.join(broadcast_if_small(wanted, BROADCAST_ROWS), "t").groupBy("q", "row").agg(F.sum(added).alias("s"))
    bound = stage_table(kth_highest(exact_scores(lists, wanted, likeliest(seen, k)), "score", k, "bound"), "bounds")

    # second phase: the threshold is bound / lists / FINER, kept as a product so that nothing is rounded
    number = wanted.groupBy("q").agg(F.count("*").alias("lists")).join(bound, F.col("q") == F.col("qk"), "left")
    number = number.select(F.col("q").alias("qn"), "lists", F.coalesce("bound", F.lit(0)).alias("bound"))
    under = F.least(F.col("times") * F.col("most"), F.ceil(F.col("bound") / (FINER * F.col("lists"))))  # an unfetched posting adds no more
    limits = wanted.join(number, F.col("q") == F.col("qn")).drop("qn").withColumn("under", under)
    limits = stage_table(limits.withColumn("all", F.sum("under").over(W.partitionBy("q"))), "limits")
    # A posting that any item asks for is sent once, to its row's partition; what it adds to each item is summed there.
    least = limits.groupBy(F.col("t").alias("tl")).agg(F.min(F.col("bound") / (FINER * F.col("lists") * F.col("times"))).alias("least"))
    fetched = lists.join(broadcast_if_small(least, BROADCAST_ROWS), F.col("t") == F.col("tl")).where(F.col("c") + 1 >= F.col("least")).select("t", "row", "c").repartition("row")
    fetched = fetched.join(broadcast_if_small(limits, BROADCAST_ROWS), "t").where(added * FINER * F.col("lists") >= F.col("bound"))
    sums = fetched.groupBy("q", "row").agg(F.sum(added).alias("s"), F.sum(added - F.col("under")).alias("more"), F.first("all").alias("all"), F.first("bound").alias("bound"))
    able = stage_table(sums.where(F.col("all") + F.col("more") >= F.col("bound")).select("q", "row", "s", (F.col("all") + F.col("more")).alias("most")), "able")
    raised = kth_highest(exact_scores(lists, wanted, likeliest(able, k)), "score", k, "raised")
    able = able.join(broadcast_if_small(stage_table(raised, "raised"), BROADCAST_ROWS), F.col("q") == F.col("qk"), "left").where("raised is null or most >= raised")

    # third phase
    scored = exact_scores(lists, wanted, stage_table(able.select("q", "row"), "survivors"))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest documents of each row of items, by scores above 0."""
    named, terms = item_terms(items)
    known = stage_table(terms.select("term").distinct().select("term", F.monotonically_increasing_id().alias("t")), "terms")
    slices = -(-known.count() * 5 // (4 * TERMS)) or 1  # hashing deals unevenly
    postings = None
    for i in range(slices):
        part = stage_table(post(docs, known.where(F.pmod(F.xxhash64("term"), F.lit(slices)) == i)), "postings")
        postings = part if postings is None else postings.union(part.where("t >= 0"))
    lists = stage_table(weighted(postings), "lists")
    wanted = stage_table(terms.join(known, "term").select("q", "t", "times"), "item_terms")
    best = tput(lists, wanted, k)
    return best.join(named, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


