"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.operators.graph.build import node_set, undirected
from riskgraph.plans.lineage import cut, release


def _signature(e: DataFrame):
    h = F.xxhash64("src", "dst").cast("decimal(38,0)")
    return tuple(e.agg(F.count(F.lit(1)), F.sum(h)).first())


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``id, component``: the smallest id of each node's component.

    Both steps need only the minimum over a node's neighbours, an aggregate that combines before
    the shuffle; neighbour lists are never gathered.  The rounds are logarithmic in the number of
    nodes also on long chains, and go on until nothing changes.
    """
    cur = cut(edges.select("src", "dst").filter("src <> dst").select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "cc")
    before = None
    while True:
        both = undirected(cur)
        low = both.groupBy(F.col("src").alias("_u")).agg(F.min("dst").alias("_m")).select(
            "_u", F.least("_u", "_m").alias("_m"))
        large = both.filter("dst > src").join(low, F.col("src") == F.col("_u")).select(
            F.col("dst").alias("src"), F.col("_m").alias("dst")).distinct()
        low2 = large.groupBy(F.col("src").alias("_u")).agg(F.min("dst").alias("_m"))
        small = large.join(low2, F.col("src") == F.col("_u")).select(
            F.col("dst").alias("src"), F.col("_m").alias("dst")).filter("src <> dst").unionByName(
            low2.select(F.col("_u").alias("src"), F.col("_m").alias("dst"))).distinct()
        nxt = cut(small, "cc")
        sig = _signature(nxt)
        release(cur)
        cur = nxt
        if sig == before:
            break
        before = sig
    ids = nodes.select("id").distinct() if nodes is not None else node_set(edges)
    return ids.join(cur.select(F.col("src").alias("_s"), F.col("dst").alias("_c")), F.col("id") == F.col("_s"), "left").select(
        "id", F.coalesce("_c", "id").alias("component"))


def component_sizes(labelled: DataFrame) -> DataFrame:
    """``component, size``."""
    return labelled.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def communities(labelled: DataFrame, scores: DataFrame) -> DataFrame:
    """Component list with size and worst score, largest first; ``scores`` is ``id, score``."""
    s = scores.groupBy(F.col("id").alias("_i")).agg(F.max("score").alias("_s"))
    return labelled.join(s, F.col("id") == F.col("_i"), "left").groupBy("component").agg(
        F.count(F.lit(1)).alias("size"), F.max("_s").alias("worst_score"))
