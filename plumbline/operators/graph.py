"""Traversal over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_HOPS, MAX_PATHS, MAX_BRANCHING = 30, 50, 50
#: fixed values: confidences of an edge, best first; an edge without one counts as confirmed
CONFIDENCES = ("confirmed", "high", "probable", "candidate")
FORWARD, REVERSE = "forward", "reverse"


def closure(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(seed, node, hops) for nodes that seeds reach, by fewest hops; each seed reaches itself at 0. Without max_hops
    rounds go on until one finds nothing new.

    Semi-naive: a round joins only what the last one found, and drops what is known. Each round's front is checkpointed
    (the session needs a checkpoint folder) and known is the union of the fronts, so no row is written twice."""
    e = edges.select(F.col("src").alias("node"), F.col("dst")).where("node is not null and dst is not null").distinct().checkpoint()
    front = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hops")).where("node is not null").distinct().checkpoint()
    known, hop = front, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        found = front.join(e, "node").select("seed", F.col("dst").alias("node"), F.lit(hop).alias("hops")).distinct()
        front = found.join(known.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", "hops").checkpoint()
        if front.isEmpty():
            break
        known = known.union(front)
    return known


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node: every node that any start reaches, the starts themselves included, each once; semi-naive like `closure`, but no row
    carries its start. Sides are merged, never broadcast: there may be many rounds, and each would pass the driver."""
    e = edges.select(F.col("src").alias("node"), "dst").where("node is not null and dst is not null").distinct().checkpoint().hint("merge")
    front = starts.select("node").where("node is not null").distinct().checkpoint()
    known = front
    while not front.isEmpty():
        front = front.join(e, "node").select(F.col("dst").alias("node")).join(known.hint("merge"), "node", "left_anti").distinct().checkpoint()
        known = known.union(front)
    return known


def attribute_paths(edges: DataFrame, starts: DataFrame, direction: str = FORWARD, minimum_confidence: str = "probable", max_hops: int = MAX_HOPS, max_paths: int = MAX_PATHS, max_branching: int = MAX_BRANCHING) -> DataFrame:
    """paths over edges (src, dst, confidence) of the least confidence or better, along them or against them."""
    if direction not in (FORWARD, REVERSE) or minimum_confidence not in CONFIDENCES:
        raise ValueError("direction is forward or reverse, and the confidence a known one")
    good = edges.where(F.coalesce("confidence", F.lit(CONFIDENCES[0])).isin(*CONFIDENCES[: CONFIDENCES.index(minimum_confidence) + 1]))
    ends = ("src", "dst") if direction == FORWARD else ("dst", "src")
    return paths(good.select(F.col(ends[0]).alias("src"), F.col(ends[1]).alias("dst")), starts, max_hops, max_paths, max_branching)


def paths(edges: DataFrame, starts: DataFrame, max_hops: int = MAX_HOPS, max_paths: int = MAX_PATHS, max_branching: int = MAX_BRANCHING) -> DataFrame:
    """(start, end, path, hops, truncated): simple paths from each start, without repeated nodes.

    A node's first max_branching edges by target are followed; each start keeps max_paths paths a round, least
    first; truncated marks starts that had more. Bounds are part of the feature."""
    rank = F.row_number().over(W.partitionBy("src").orderBy("dst"))
    e = edges.select("src", "dst").distinct().withColumn("n", rank).withColumn("cut", F.max("n").over(W.partitionBy("src")) > max_branching)
    e = e.where(F.col("n") <= max_branching).select(F.col("src").alias("end"), "dst", "cut")
    front = starts.select(F.col("node").alias("start"), F.col("node").alias("end"), F.array("node").alias("path"), F.lit(False).alias("truncated")).distinct().checkpoint()
    out = None
    for hop in range(1, max_hops + 1):
        grown = front.join(e, "end").where(~F.array_contains("path", F.col("dst")))
        grown = grown.select("start", F.col("dst").alias("end"), F.concat("path", F.array("dst")).alias("path"), (F.col("truncated") | F.col("cut")).alias("truncated"))
        order = W.partitionBy("start").orderBy("path")
        grown = grown.withColumn("k", F.row_number().over(order)).withColumn("more", F.max("k").over(W.partitionBy("start")) > max_paths)
        front = grown.where(F.col("k") <= max_paths).select("start", "end", "path", (F.col("truncated") | F.col("more")).alias("truncated")).checkpoint()
        if front.isEmpty():
            break
        done = front.withColumn("hops", F.lit(hop))
        out = done if out is None else out.union(done)
    if out is None:
        return front.withColumn("hops", F.lit(0)).limit(0)
    return out.select("start", "end", "path", "hops", "truncated")


#: numbers of paths are held here, so that no sum overflows
MOST_PATHS = 10**15
#: nodes that edges lead to are broadcast up to about this number, estimated before
FEW_TARGETS = 500_000


def few_targets(e: DataFrame) -> DataFrame | None:
    """end: the nodes that edges (end, dst) lead to, to be broadcast; nothing, if they are many."""
    if e.agg(F.approx_count_distinct("dst")).first()[0] > FEW_TARGETS:
        return None
    return F.broadcast(e.select(F.col("dst").alias("end")).distinct().checkpoint())


def shortest_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, end, hops, path_count, path) for every node that starts reach: the fewest hops, how many paths have that many (at
    most MOST_PATHS), and the first of them, by their names joined with ">".

    Numbers are summed per node and round instead of listing paths: a round extends the last one's nodes, and every node carries one
    path, without its ends; each is checkpointed. The first round is the starts' own edges, marked when edges are made distinct (both
    lie by their source), and the last one finds nothing new.
    While edges lead to few nodes, a round meets only those that the edges of the round before lead to, and there is none without any."""
    e = edges.select(F.col("src").alias("end"), "dst").where("end is not null and dst is not null").repartition("end").distinct()
    asked = starts.select(F.col("node").alias("end"), F.lit(True).alias("asked")).where("end is not null").distinct()
    e = e.join(asked, "end", "left").checkpoint()
    front = e.where("asked and end != dst").select(F.col("end").alias("start"), F.col("dst").alias("end"), F.lit(1).alias("hops"), F.lit(1).cast("long").alias("path_count"), F.array().cast("array<string>").alias("via"))
    e = e.drop("asked")
    known, hop, left, targets = front, 1, e.count(), few_targets(e)
    while not front.isEmpty():
        hop += 1
        if targets is not None:
            e, before = e.join(targets, "end", "left_semi").checkpoint(), left
            left = e.count()
            if left == 0:
                break
            targets = few_targets(e) if left < before else targets
        # what no edge of the round leads to cannot be found again
        seen = known if targets is None else known.join(targets, "end", "left_semi")
        way = F.concat("via", F.array("end"))
        found = front.join(e, "end").where("start != dst").groupBy("start", "dst").agg(F.least(F.sum("path_count"), F.lit(MOST_PATHS)).alias("path_count"), F.min_by(way, F.concat(F.array_join(way, ">"), F.lit(">"))).alias("via"))
        found = found.join(seen.select("start", F.col("end").alias("dst")), ["start", "dst"], "left_anti")
        front = found.select("start", F.col("dst").alias("end"), F.lit(hop).alias("hops"), "path_count", "via").checkpoint()
        known = known.union(front)
    return known.select("start", "end", "hops", "path_count", F.concat(F.array("start"), "via", F.array("end")).alias("path"))


def shortest_unique(found: DataFrame, keys: list[str]) -> DataFrame:
    """The path with fewest hops of each key if just one has that length; path_count says how many have."""
    w = W.partitionBy(*keys)
    best = found.withColumn("least", F.min("hops").over(w)).where("hops = least")
    best = best.withColumn("path_count", F.count("*").over(w)).drop("least")
    return best.withColumn("status", F.when(F.col("path_count") == 1, "confirmed").otherwise("ambiguous"))
