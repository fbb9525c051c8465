"""Connected components by repeated contraction, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of a non-loop edge; component is some node of the class.

    Each round points every node at its smallest neighbour under a hashed order (an aggregate with
    map-side combine, so a node of any degree is safe), jumps pointers twice, and relabels the edges.
    Edges inside a class vanish; the rest shrink by a constant factor a round. Each round is written to
    the shared folder, so lineage stays short. Null ends and loops are ignored; an empty input gives
    an empty result.
    """
    a, b = F.col(src), F.col(dst)
    live = stage_table(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(a.alias("u"), b.alias("v")).distinct(), "edges"
    )
    kind = live.schema["u"].dataType
    labels = None
    for _ in range(MAX_ROUNDS):
        if live.isEmpty():
            break
        both = live.union(live.select("v", "u"))
        ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("n"))
        parent = (
            both.groupBy("u")
            .agg(F.min(ranked(F.col("v"))).alias("m"))
            .select("u", F.least("m", ranked(F.col("u")))["n"].alias("p"))
        )
        parent = stage_table(parent, "parent")
        for _ in range(2):
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p").select("u", F.col("pp").alias("p"))
        parent = stage_table(parent, "jumped")
        left = parent.select("u", F.col("p").alias("pu"))
        right = parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        live = stage_table(
            live.join(left, "u").join(right, "v").where("pu != pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(),
            "edges",
        )
        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            step = parent.select(F.col("u").alias("component"), F.col("p").alias("next"))
            labels = labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
            labels = stage_table(labels, "labels")
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return edges.sparkSession.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    return labels
