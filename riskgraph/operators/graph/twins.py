"""Classes of nodes with one closed neighbourhood (true twins), and the graph between classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.operators.graph.build import undirected
from riskgraph.plans.lineage import cut
from riskgraph.plans.scan import row_index


def twin_classes(edges: DataFrame, alike: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(``id, v, m``: class number and class size of every node with a link; ``src, dst, m_src,
    m_dst``: links between different classes, both ways).

    Twins have the same neighbours and each other, so one member's links stand for its class.  A
    neighbourhood is known by two 64-bit sums over its nodes and its size, without gathering it.
    Classes are numbered along their least neighbour, so that close ones have close numbers.

    With ``alike`` (``id, rep``) the edges are those between ``rep`` nodes, each standing for linked nodes that are
    known to be twins; classes are then made of theirs.
    """
    both = cut(undirected(edges.select("src", "dst")).filter("src <> dst").distinct(), "links")

    def mark(seed, c):
        return F.xxhash64(F.lit(seed), c)

    a, b = (F.bit_xor(mark(s, "dst")).bitwiseXOR(mark(s, "src")) for s in (1, 2))
    own = both.groupBy("src").agg(
        a.alias("_a"), b.alias("_b"), F.count(F.lit(1)).alias("_n"), F.least(F.min("dst"), "src").alias("_low"))
    if alike is None:
        own = own.withColumn("_m", F.lit(1))
    else:
        size = alike.groupBy(F.col("rep").alias("_r")).agg(F.count(F.lit(1)).alias("_m"))
        linked = F.col("src").isNotNull()
        own = own.join(size, F.col("src") == F.col("_r"), "right").filter(linked | (F.col("_m") > 1)).select(
            F.col("_r").alias("src"), *[F.coalesce(c, mark(s, "_r")).alias(c) for s, c in ((1, "_a"), (2, "_b"))],
            F.coalesce("_n", F.lit(0)).alias("_n"), F.coalesce("_low", "_r").alias("_low"), "_m")
    own = cut(own, "marks")
    sets = cut(own.groupBy("_a", "_b", "_n").agg(
        F.sum("_m").alias("m"), F.min("src").alias("_rep"), F.xxhash64(F.min("_low")).alias("_o")), "classes")
    classes = cut(row_index(sets, "_o", "_a", "v"), "classes")
    members = cut(own.join(classes.select("_a", "_b", "_n", "v", "m"), ["_a", "_b", "_n"]).select(
        F.col("src").alias("id"), "v", "m"), "members")
    if alike is not None:
        members = cut(alike.join(members.withColumnRenamed("id", "rep"), "rep").select("id", "v", "m"), "members")
    x = classes.select(F.col("_rep").alias("src"), F.col("v").alias("v_src"), F.col("m").alias("m_src"))
    y = classes.select(F.col("_rep").alias("dst"), F.col("v").alias("v_dst"), F.col("m").alias("m_dst"))
    links = both.join(x, "src").join(y, "dst").select(
        F.col("v_src").alias("src"), F.col("v_dst").alias("dst"), "m_src", "m_dst")
    return members, cut(links, "classlinks")
