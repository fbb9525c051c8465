"""Source mixing to target weights by Pareto order sampling.

A source's target is its weighted share of the budget, held at `cap` times its own size; what is cut off is
shared again among the others. Documents of a source have unequal rates (expected copies): r = the source's factor
times the square root of the size, held at `cap`, so that the rates' words sum to the target; longer documents are
likelier, as a mix by words with equal rates would mostly be made of closing remarks and other short texts. A document
gets floor(r) certain copies. The rest of the target is a fixed-size sample (in words) without replacement: documents
are ranked by random odds divided by inclusion odds, (u / (1 - u)) / (p / (1 - p)) with p = r - floor(r), and taken in
that order while they fit; then up to `CLOSINGS` closing documents, each the one left whose size is nearest to the gap, are
added where that comes nearer to the target. u comes from a hash of seed and doc_id (of the text where there is no id), so reruns
and other partitionings give the same mix.

No source is gathered in one task: the factor comes from the histogram of its sizes, and words are summed per source and
rank bin, in two levels of 1,024 bins; only the bin in which the target is reached is sorted.

Null text has size 0 and is not taken; a null source is a source of its own, last in order; empty tables give no rows;
rows with equal rank, id, size and text are taken or left together; very long texts count whole; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, stage_table

WORD = r"[^\x20\x09-\x0D]+"
BINS = 1024
CLOSINGS = 3
#: square roots of sizes are counted in sixteenths, so that sums of weights are whole numbers
GRAIN = 16
BROADCAST_SOURCES = 50_000
UNIT = 4503599627370496.0  # 2**52
EPSILON = 1e-9


def source_targets(sizes: DataFrame, weights=(5, 2, 1), cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from one (source, source_size) row per source."""
    k = len(weights)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(k)) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = W.orderBy((F.col("most") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    s = s.withColumn("ord", F.row_number().over(order)).withColumn(
        "rate",
        (F.sum("source_size").over(W.partitionBy(F.lit(1))) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after),
    )
    s = s.withColumn("full", F.col("most") / F.col("w") <= F.col("rate"))
    s = s.withColumn("rate", F.min_by(F.col("rate"), F.when(~F.col("full"), F.col("ord"))).over(W.partitionBy(F.lit(1))))
    return s.select("source", "source_size", F.when(F.col("full") | F.col("rate").isNull(), F.col("most")).otherwise(F.col("w") * F.col("rate")).alias("target"))


def rate_factors(rows: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """targets with factor: rates least(cap, factor * weight) times the sizes sum to the target. The windows see one row
    per source and size."""
    hist = rows.where("size > 0").groupBy("source", "size", "weight").agg(F.count("*").alias("n"))
    j = hist.join(targets.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    down = W.partitionBy("source").orderBy(F.col("size").desc())
    above, rest = down.rowsBetween(W.unboundedPreceding, -1), down.rowsBetween(0, W.unboundedFollowing)
    held = F.coalesce(F.sum(F.col("n") * F.col("size")).over(above), F.lit(0))
    j = j.withColumn("factor", (F.col("target") - F.lit(float(cap)) * held) / F.sum(F.col("n") * F.col("size") * F.col("weight")).over(rest))
    # the largest size that its own rate leaves under the cap
    found = j.where(F.col("factor") * F.col("weight") <= F.lit(float(cap)) * (1 + EPSILON)).groupBy("source").agg(F.max_by("factor", "size").alias("factor"))
    return targets.join(found.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def edge_bins(rows: DataFrame, column: str) -> DataFrame:
    """(s, bin, before) of the rank bin in which a source's rest is passed. rows: s, column, size, rest, base (words before)."""
    bins = rows.groupBy("s", column).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("base").alias("base"))
    bins = bins.withColumn("cum", F.col("base") + F.sum("words").over(W.partitionBy("s").orderBy(column)))
    edge = bins.where("cum > rest").groupBy("s").agg(F.min_by(F.struct(column, (F.col("cum") - F.col("words")).alias("before")), column).alias("e"))
    edge = edge.select(F.col("s").alias("es"), F.col("e")[column].alias(f"edge_{column}"), F.col("e.before").alias(f"before_{column}"))
    return broadcast_if_small(stage_table(edge, f"edge_{column}"), BROADCAST_SOURCES)


def pareto_mix(docs: DataFrame, weights=(5, 2, 1), cap: float = 3.0, share: float = 1.0, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for each row of docs. cap: a whole number."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(UNIT)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), u.alias("u"), F.xxhash64("text").alias("t"))
    rows = stage_table(rows.withColumn("weight", F.floor(F.sqrt(F.col("size").cast("double")) * GRAIN).cast("long")), "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap, share)
    targets = rate_factors(rows, stage_table(targets, "targets"), cap).withColumnRenamed("source", "s")
    targets = broadcast_if_small(stage_table(targets, "factors"), BROADCAST_SOURCES)
    rate = F.least(F.lit(float(cap)), F.coalesce(F.col("factor") * F.col("weight"), F.lit(0.0)))
    ranked = rows.join(targets, F.col("source").eqNullSafe(F.col("s")))
    ranked = ranked.withColumn("rate", F.when(F.abs(rate - F.round(rate)) < EPSILON, F.round(rate)).otherwise(rate)).withColumn("copies", F.floor("rate").cast("long"))
    certain = ranked.groupBy(F.col("s").alias("ks")).agg(F.sum(F.col("copies") * F.col("size")).alias("certain"))
    certain = broadcast_if_small(stage_table(certain, "certain"), BROADCAST_SOURCES)
    p = F.col("rate") - F.col("copies")
    ranked = ranked.join(certain, F.col("s").eqNullSafe(F.col("ks"))).withColumn("rest", F.col("target") - F.col("certain"))
    ranked = ranked.withColumn("q", F.when(p > 0, (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))))
    x = F.col("q") / (1 + F.col("q")) * BINS
    ranked = ranked.withColumn("bin", F.floor(x).cast("int")).withColumn("sub", F.floor((x - F.floor(x)) * BINS).cast("int")).withColumn("base", F.lit(0.0))
    key = F.struct("q", "doc_id", "size", "t")

    first = edge_bins(ranked.where("q is not null"), "bin")
    ranked = ranked.join(first, F.col("s").eqNullSafe(F.col("es")), "left").drop("es")
    second = edge_bins(ranked.where("bin = edge_bin").withColumn("base", F.col("before_bin")), "sub")
    ranked = ranked.join(second, F.col("s").eqNullSafe(F.col("es")), "left").drop("es")
    in_edge = F.coalesce((F.col("bin") == F.col("edge_bin")) & (F.col("sub") == F.col("edge_sub")), F.lit(False))
    leaf = ranked.where(in_edge).withColumn("key", key)
    leaf = leaf.withColumn("prior", F.col("before_sub") + F.coalesce(F.sum("size").over(W.partitionBy("s").orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    last = leaf.where(F.col("prior") + F.col("size") <= F.col("rest")).groupBy("s").agg(F.max(F.struct("key", (F.col("prior") + F.col("size")).alias("sum"))).alias("l"))
    last = broadcast_if_small(stage_table(last.select(F.col("s").alias("ls"), F.col("l.key").alias("last"), F.col("l.sum").alias("sum")), "last"), BROADCAST_SOURCES)
    ranked = ranked.join(last, F.col("s").eqNullSafe(F.col("ls")), "left").withColumn("key", key)
    before = F.col("edge_bin").isNull() | (F.col("bin") < F.col("edge_bin")) | ((F.col("bin") == F.col("edge_bin")) & (F.col("sub") < F.col("edge_sub")))
    extra = F.col("q").isNotNull() & F.coalesce(before | (in_edge & (F.col("key") <= F.col("last"))), F.lit(False))
    ranked = ranked.withColumn("gap", F.col("rest") - F.coalesce("sum", "before_sub")).withColumn("extra", extra)
    for i in range(CLOSINGS):
        miss = F.abs(F.col("size") - F.col("gap"))
        left = ranked.where(F.col("q").isNotNull() & ~F.col("extra") & (miss < F.col("gap")))
        closing = left.groupBy("s").agg(F.min(F.struct(miss.alias("miss"), "key")).alias("c")).select(F.col("s").alias("cs"), F.col("c.key").alias("closing"))
        closing = broadcast_if_small(stage_table(closing, f"closing{i}"), BROADCAST_SOURCES)
        ranked = ranked.join(closing, F.col("s").eqNullSafe(F.col("cs")), "left").drop("cs")
        ranked = ranked.withColumn("extra", F.col("extra") | F.coalesce(F.col("key") == F.col("closing"), F.lit(False)))
        ranked = ranked.withColumn("gap", F.col("gap") - F.coalesce(F.col("closing.size"), F.lit(0))).drop("closing")
    copies = F.col("copies") + F.when(F.col("extra"), 1).otherwise(0)
    return ranked.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
