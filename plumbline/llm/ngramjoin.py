"""N-gram Jaccard self-join and its connected components: prefix filtering finds the candidates, whose overlaps are counted in
vertical fragments of the shingle order and summed per pair (inside a unit, not as fragments dealt over the cluster).

A document's set holds its distinct shingles of `width` words (64-bit hashes); one of fewer words is a single
shingle, one without words has an empty set. Two documents link when 100 * common >= percent * union.
The result is exact (up to hash collisions: one in 10**9 at 10**5 distinct texts); no link is lost.

1. Documents with equal sets form a class, known by a fingerprint of the set; copies are never compared.
2. Shingles have a global order (by hash). In a class of n shingles, the first n - ceil(p n) + L(n), with
   L(n) = 1 + n // 20, are posted: linked sets must share L of the smaller set there. Shingles that one class
   alone posts are dropped; a class stays only if enough of its posted shingles are shared.
3. The whole sets of what stays are posted the same way. A class stays only if others have ceil(p n) of its
   shingles; from here on sets hold shared shingles only, ordered by rising count, then hash.
4. Candidates that share one of their first n - ceil(p n) + 1 shingles in this order are joined by star edges to the
   least of each shingle's classes; the components of these edges are independent groups.
5. Groups are packed to units of bounded size. In a unit the shingle order is cut into fragments; the overlap
   with each candidate is counted fragment by fragment and summed per pair, and a pair is left as soon as the
   rest cannot reach the bound. Pairs whose ends are connected already need no count.
6. A group larger than a unit is cut into blocks: each block meets the first block, then the texts that are not
   connected to the group's largest component (the only ones that can still add links) meet every block.

Null text has an empty set. Empty sets link with nothing. Rows with a null doc_id take no part and have a null
component. Repeated rows link like copies. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER_BYTES, broadcast_if_small, fresh, give_back, stage_table
from .components import connected_components

WIDTH, PERCENT = 4, 85
FRAGMENTS = 8
UNIT_SHINGLES = 1_000_000
BROADCAST_ROWS = 500_000
WORD_MEMO = 500_000
TASK_POSTS = 8_000_000
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes | None, memo: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    ws = text.translate(LOWER_BYTES).split() if text else []
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(len(h), width)))
    for i in range(min(width, len(h))):
        out = mix(out * GOLD + h[i : i + n])
    return np.unique(out)


def fingerprint(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def first_shared(n, percent: int = PERCENT):
    """Linked sets share a shingle among their first so many."""
    return n - (n * percent + 99) // 100 + 1


def posted(n: int, percent: int) -> int:
    return min(n, first_shared(n, percent) + n // 20)


def split_posts(posts: list[np.ndarray]) -> tuple[list, list, list]:
    """What a task's texts send about each of their shingles: those no other text of the task has; those they stand for
    (the first of the texts that share one); those they share."""
    if not posts:
        return [], [], []
    flat, cut = np.concatenate(posts), np.cumsum([len(p) for p in posts])[:-1]
    _, first, place, n = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
    many = n[place] > 1
    lead = np.zeros(len(flat), bool)
    lead[first] = True
    pick = lambda m: [x[k].view(np.int64) for x, k in zip(np.split(flat, cut), np.split(m, cut))]
    return pick(~many), pick(many & lead), pick(many)


POSTS = "alone array<long>, stands array<long>, shares array<long>"


def read_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Staged (doc_id, t, n, fp, alone, stands, shares): t is a hash of the text; posts only for the first document of a
    class in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = WordHashes(), set()
        held: list[tuple] = []
        size = 0
        for b in batches:
            for i, h, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1)):
                s = shingles(t.as_py(), memo, width)
                fp = fingerprint(s) if len(s) else None
                new = fp is not None and i is not None and fp not in seen
                if new:
                    seen.add(fp)
                posts = s[: posted(len(s), percent)].copy() if new else s[:0]
                held.append((i, h, len(s), fp, posts))
                size += len(posts)
            if size > TASK_POSTS:
                yield pack(held)
                held, seen, size = [], set(), 0
        if held:
            yield pack(held)
        del held, seen, memo
        give_back()

    def pack(held: list[tuple]) -> pa.RecordBatch:
        lists = [pa.array(x, pa.list_(pa.int64())) for x in split_posts([p for *_, p in held])]
        ids = [pa.array([h[j] for h in held], pa.int64()) for j in range(4)]
        return pa.RecordBatch.from_arrays([*ids, *lists], names=["doc_id", "t", "n", "fp", "alone", "stands", "shares"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text"))
    return stage_table(rows.mapInArrow(run, f"doc_id long, t long, n long, fp long, {POSTS}"), "sets")


def shared_posts(sets: DataFrame) -> DataFrame:
    """Distinct (fp, h) of posts that two classes have, dealt by fp. A shingle that many texts of a task share was
    seen to be shared there: it sends one row per task, so a very common shingle has no more rows than there are tasks."""
    sent = sets.select("fp", F.explode("alone").alias("h"), F.lit(True).alias("own")).union(sets.select("fp", F.explode("stands"), F.lit(False)))
    w = W.partitionBy("h")
    found = sent.withColumn("a", F.min("fp").over(w)).withColumn("b", F.max("fp").over(w)).where("a != b and own").select("fp", "h")
    return found.union(sets.select("fp", F.explode("shares"))).repartition("fp").distinct()


def read_members(docs: DataFrame, sets: DataFrame, survivors: DataFrame, width: int) -> DataFrame:
    """Staged (fp, n, alone, stands, shares) over the whole sets of the surviving classes, each from its first document."""
    first = sets.join(survivors.select("fp"), "fp").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    first = broadcast_if_small(stage_table(first, "first"), BROADCAST_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(first, "doc_id").select("fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, fps, held, size = WordHashes(), [], [], 0
        for b in batches:
            for fp, t in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingles(t.as_py(), memo, width)
                # Rows that repeat a doc_id may hold another text; theirs is not the class asked for.
                if len(s) and fingerprint(s) == fp and fp not in fps[-1:]:
                    fps.append(fp)
                    held.append(s)
                    size += len(s)
            if size > TASK_POSTS:
                yield pack(fps, held)
                fps, held, size = [], [], 0
        if held:
            yield pack(fps, held)
        del held, memo
        give_back()

    def pack(fps: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
        lists = [pa.array(x, pa.list_(pa.int64())) for x in split_posts(held)]
        return pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array([len(s) for s in held], pa.int64()), *lists], names=["fp", "n", "alone", "stands", "shares"])

    return stage_table(rows.mapInArrow(run, f"fp long, n long, {POSTS}"), "members")


def candidate_groups(docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """Staged (fp, n, component, set): classes that may have links, by independent group, with the shingles of theirs
    that another such class has."""
    n = F.col("n")
    least = F.floor((n * percent + 99) / 100)
    sizes = sets.where("fp is not null").select("fp", "n").distinct()
    posted_shared = shared_posts(sets).groupBy("fp").agg(F.count("*").alias("c"))
    survivors = stage_table(posted_shared.join(sizes, "fp").where(F.col("c") >= 1 + F.floor(least / 20)).select("fp", "n"), "survivors")
    by_class = W.partitionBy("fp")
    whole = shared_posts(read_members(docs, sets, survivors, width)).withColumn("c", F.count("*").over(by_class)).join(survivors, "fp")
    whole = stage_table(whole.where(F.col("c") >= least).select("fp", "n", "h"), "whole")
    # Once more among what is left: a shingle's count is now that of possible partners, and orders the shingles.
    df = whole.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    ranked = whole.join(df, "h").withColumn("c", F.count("*").over(by_class)).where(F.col("c") >= least)
    ranked = ranked.withColumn("r", F.row_number().over(by_class.orderBy("df", "h")))
    base = n - F.col("c") + F.col("r") <= n - least + 1
    ranked = stage_table(ranked.select("fp", "n", "h", base.alias("base")), "ranked")
    live = ranked.where("base").select("h", "fp")
    hubs = live.groupBy("h").agg(F.min("fp").alias("hub"), F.max("fp").alias("other")).where("hub != other").select("h", "hub")
    edges = live.join(hubs, "h").where("fp != hub").select(F.col("fp").alias("src"), F.col("hub").alias("dst"))
    groups = connected_components(edges).select(F.col("node").alias("fp"), "component")
    sets_of = ranked.join(groups, "fp").groupBy("fp", "n", "component").agg(F.collect_list("h").alias("set"))
    return stage_table(sets_of, "groups")


def roots(label: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The root of each place in a forest of labels; what was asked for then points to its root."""
    root = label[at]
    while (up := label[root]).tobytes() != root.tobytes():
        root = up
    label[at] = root
    return root


def link_unit(fps: np.ndarray, n: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT, fragments: int = FRAGMENTS) -> np.ndarray:
    """For each class the least fp of those it is connected with inside the unit. n: sizes of the whole sets; sets: the
    shingles that others have too (the rest cannot be common, and stands first in the order)."""
    n_sets = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n_sets), size)
    prefix = np.maximum(0, first_shared(n, percent) - (n - size))
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # The unit's shingle order: rare first, then by hash.
    place = np.empty(len(df), np.int64)
    place[np.lexsort((np.arange(len(df)), df))] = np.arange(len(df))
    ranks = place[token]
    by_owner = np.lexsort((ranks, owner))
    ranks, start = ranks[by_owner], np.concatenate(([0], np.cumsum(size)))
    cuts = np.quantile(ranks, np.arange(1, fragments) / fragments) if len(ranks) else np.zeros(0)
    piece = np.searchsorted(cuts, ranks, side="right")
    counts = np.bincount(owner * fragments + piece, minlength=n_sets * fragments).reshape(n_sets, fragments)
    offset = np.concatenate((np.zeros((n_sets, 1), np.int64), np.cumsum(counts, axis=1)), axis=1)

    inside = np.arange(len(ranks)) - start[owner] < prefix[owner]
    common = inside & (np.bincount(ranks, minlength=len(df))[ranks] > 1)
    post_rank, post_set = ranks[common], owner[common]
    order = np.argsort(post_rank, kind="stable")
    post_rank, post_set = post_rank[order], post_set[order]
    keys, first = np.unique(post_rank, return_index=True)
    end = np.append(first[1:], len(post_rank))
    where = np.full(len(df), -1, np.int64)
    where[keys] = np.arange(len(keys))

    label = np.arange(n_sets)
    mark = np.zeros(len(df), np.uint8)
    for x in range(n_sets):
        own = ranks[start[x] : start[x + 1]]
        lists = where[own[: prefix[x]]]
        parts = [post_set[first[k] : end[k]] for k in lists[lists >= 0]]
        if not parts:
            continue
        y = np.unique(np.concatenate(parts))
        y = y[y > x]
        y = y[roots(label, y) != roots(label, np.array([x]))]
        y = y[percent * np.maximum(n[y], n[x]) <= 100 * np.minimum(n[y], n[x])]
        if not len(y):
            continue
        need = -(-percent * (n[x] + n[y]) // (100 + percent))
        got = np.zeros(len(y), np.int64)
        mark[own] = 1
        for f in range(fragments):
            a, m = start[y] + offset[y, f], counts[y, f]
            flat = np.repeat(a - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(int(m.sum()))
            got += np.bincount(np.repeat(np.arange(len(y)), m), mark[ranks[flat]], len(y)).astype(np.int64)
            rest = np.minimum(size[y] - offset[y, f + 1], size[x] - offset[x, f + 1])
            keep = got + rest >= need
            y, need, got = y[keep], need[keep], got[keep]
            if not len(y):
                break
        mark[own] = 0
        if len(y):
            joined = np.unique(roots(label, np.append(y, x)))
            label[joined] = joined[0]
    label = roots(label, np.arange(n_sets))
    least = np.full(n_sets, np.iinfo(np.int64).max)
    np.minimum.at(least, label, fps)
    return least[label]


def link_units(members: DataFrame, percent: int) -> DataFrame:
    """(src, dst) edges between connected classes. members: unit long, fp long, n long, set array<long>."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("fp").sort_values("fp")
        fps = pdf["fp"].to_numpy()
        root = link_unit(fps, pdf["n"].to_numpy(np.int64), [np.asarray(s, np.int64) for s in pdf["set"]], percent)
        give_back()
        return pd.DataFrame({"src": fps[root != fps], "dst": root[root != fps]})

    return members.groupBy("unit").applyInPandas(run, "src long, dst long")


def find_links(groups: DataFrame, percent: int, unit_shingles: int) -> DataFrame:
    """(node, component) of the classes that link with another. groups: as candidate_groups."""
    weight = groups.groupBy("component").agg(F.sum(F.size("set")).alias("weight"))
    total = weight.agg(F.sum("weight"), F.max("weight")).first()
    if total[0] is None:
        return connected_components(groups.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).limit(0))
    buckets = max(int(-(-total[0] * 4 // unit_shingles)), groups.sparkSession.sparkContext.defaultParallelism * 4)
    blocks = F.ceil(F.col("weight") / unit_shingles).cast("int")
    bucket = F.pmod(F.xxhash64("component"), F.lit(buckets))
    if total[1] <= unit_shingles:
        edges = link_units(groups.select(bucket.alias("unit"), "fp", "n", "set"), percent)
        return connected_components(stage_table(edges, "links"))
    small = weight.where(F.col("weight") <= unit_shingles).select("component")
    edges = link_units(groups.join(small, "component").select(bucket.alias("unit"), "fp", "n", "set"), percent)
    large = weight.where(F.col("weight") > unit_shingles).select("component", blocks.alias("blocks"))
    cut = groups.join(large, "component").withColumn("block", F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int"))
    meets = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    unit = F.xxhash64("component", "unit_block")
    with_first = cut.withColumn("unit_block", F.explode(meets)).select(unit.alias("unit"), "fp", "n", "set")
    seen = stage_table(link_units(with_first, percent), "blocks")
    so_far = connected_components(seen).select(F.col("node").alias("fp"), F.col("component").alias("class"))
    named = cut.join(so_far, "fp", "left").withColumn("class", F.coalesce("class", "fp"))
    main = named.groupBy("component", "class").count().groupBy("component").agg(F.max_by("class", F.struct("count", "class")).alias("main"))
    apart = named.join(main, "component").where("class != main")
    parts = stage_table(apart.groupBy("component").agg(F.ceil(F.sum(F.size("set")) / unit_shingles).cast("int").alias("parts")), "parts")
    apart = apart.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).cast("int"))
    unit = F.xxhash64("component", "unit_block", "part", F.lit("apart"))
    visitors = apart.withColumn("unit_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(unit.alias("unit"), "fp", "n", "set")
    hosts = cut.join(parts, "component").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("unit_block", F.col("block"))
    # A text apart is a host in its own block too; it counts once in each unit.
    met = visitors.unionByName(hosts.select(unit.alias("unit"), "fp", "n", "set"))
    edges = edges.unionByName(seen).unionByName(link_units(met, percent))
    return connected_components(stage_table(edges, "links"))


def linked_rows(docs: DataFrame, width: int, percent: int, unit_shingles: int) -> DataFrame:
    """doc_id, t, n, fp, component (a name, null for an empty set or a row without id) and component_id of each row of docs."""
    sets = read_sets(docs, width, percent)
    linked = find_links(candidate_groups(docs, sets, width, percent), percent, unit_shingles)
    classes = sets.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = classes.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = stage_table(named, "classes")
    joined = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = named.join(joined, "component").select("fp", "component", "component_id")
    out = sets.select("doc_id", "t", "n", "fp").join(by_class, "fp", "left")
    own = F.col("doc_id").isNotNull()
    return out.select("doc_id", "t", "n", "fp", F.when(own, F.col("component")).alias("component"), F.when(own, F.coalesce("component_id", "doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, unit_shingles: int = UNIT_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    return linked_rows(docs, width, percent, unit_shingles).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, unit_shingles: int = UNIT_SHINGLES) -> DataFrame:
    """docs with one row of each linked group: the one of smallest doc_id, then of smallest text hash. A row is known by
    doc_id and text, so rows that repeat an id with a text of their own are kept or dropped on their own. Rows without an
    id or without words link with nothing, and stay, also where they repeat."""
    found = linked_rows(docs, width, percent, unit_shingles).where("component is not null").groupBy("doc_id", "t").agg(F.min("component").alias("component"), F.count("*").alias("copies"))
    found = stage_table(found, "components")
    # Only groups of several rows lose any, so a large group is no hot key of the join while these fit a broadcast.
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "t")).alias("first"), F.count("*").alias("rows"), F.max("copies").alias("most")).where("rows > 1 or most > 1").drop("rows", "most")
    first = broadcast_if_small(stage_table(first, "first"), BROADCAST_ROWS)
    dropped = found.join(first, "component").where(F.struct("doc_id", "t") != F.col("first")).select("doc_id", "t")
    text_hash = fresh(docs, "text_hash")[0]
    # ids may be of another type than the links' whole numbers
    key = lambda rows: (F.col("doc_id").cast("long") == rows["drop_id"]) & (F.col(text_hash) == rows["drop_t"])
    named = lambda rows: broadcast_if_small(rows.select(F.col("doc_id").alias("drop_id"), F.col("t").alias("drop_t")), BROADCAST_ROWS)
    hashed = docs.withColumn(text_hash, F.xxhash64(F.col("text")))
    dropped = named(stage_table(dropped, "dropped"))
    out = hashed.join(dropped, key(dropped), "left_anti")
    again = stage_table(found.where("copies > 1").join(first, "component").where(F.struct("doc_id", "t") == F.col("first")).select("doc_id", "t"), "again")
    if not again.isEmpty():
        # Rows that repeat id and text: the least of them stays, by an aggregate with map-side combine.
        again = named(again)
        row = F.struct(*docs.columns)
        repeats = out.join(again, key(again), "left_semi").groupBy(F.col("doc_id").alias("repeated_id"), F.col(text_hash).alias("repeated_t")).agg(F.min(row).alias("row")).select("row.*")
        return out.join(again, key(again), "left_anti").select(*docs.columns).unionByName(repeats)
    return out.select(*docs.columns)
