"""Core numbers: how dense a group a card belongs to, by rounds of aggregates.

The core number of a node is the largest k such that it lies in a part of the graph where everyone has k
neighbours.  Every node starts with its degree; in a round it takes the largest h for which h of its
neighbours stand at h or more.  The figures only fall and end at the core numbers, so rounds go on
until nothing falls.  A round is one join and two aggregates: neighbours are counted per (node,
figure) before they meet, and a figure above the node's own counts as its own, so what a node gathers is at
most as many counts as its own figure, not its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.operators.graph.build import undirected
from riskgraph.plans.lineage import cut, release


def core_numbers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, core`` for all nodes; loops and repeated edges do not count, and isolated nodes have 0."""
    links = cut(undirected(edges.select("src", "dst")).filter("src <> dst").distinct(), "links")
    state = cut(links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("core")), "cores")
    total = state.agg(F.sum("core")).first()[0]
    while total is not None:
        own = state.select(F.col("id").alias("src"), F.col("core").alias("_own"))
        near = state.select(F.col("id").alias("dst"), "core")
        met = links.join(near, "dst").join(own, "src").groupBy("src", F.least("core", "_own").alias("_at")).agg(
            F.count(F.lit(1)).alias("_n"))
        # From the highest figure down: the largest h that is reached by the figure and by the count so far.
        steps = F.sort_array(F.collect_list(F.struct("_at", "_n")), asc=False)
        zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("best"))
        best = F.aggregate(steps, zero, lambda a, s: F.struct(
            (a["sum"] + s["_n"]).alias("sum"), F.greatest(a["best"], F.least(a["sum"] + s["_n"], s["_at"])).alias("best")))
        before, state = state, cut(met.groupBy(F.col("src").alias("id")).agg(best["best"].alias("core")), "cores")
        release(before)
        total, last = state.agg(F.sum("core")).first()[0], total
        if total == last:
            break
    own = state.select(F.col("id").alias("_id"), "core")
    return nodes.select("id").distinct().join(own, F.col("id") == F.col("_id"), "left").select(
        "id", F.coalesce("core", F.lit(0)).cast("long").alias("core"))


def core_members(edges: DataFrame, nodes: DataFrame, k: int = 2) -> DataFrame:
    """``id, core, ring_member``: members of a ring stand in a core of at least ``k``."""
    return core_numbers(edges, nodes).withColumn("ring_member", (F.col("core") >= k).cast("int"))
