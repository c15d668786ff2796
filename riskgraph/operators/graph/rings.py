"""Ring signal per card: triangles, or the largest clique on small projections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.operators.graph.build import undirected
from riskgraph.operators.graph.twins import twin_classes
from riskgraph.plans.lineage import cut


def oriented(edges: DataFrame) -> DataFrame:
    """``lo, hi``: each undirected edge once, from the end of smaller (degree, id) to the larger.

    No node keeps more than about sqrt(2 E) out-edges, so the wedge join below stays small on hubs.
    """
    both = undirected(edges.select("src", "dst")).filter("src <> dst").distinct()
    d = both.groupBy(F.col("src").alias("_n")).agg(F.count(F.lit(1)).alias("_d"))
    a = d.select(F.col("_n").alias("_a"), F.col("_d").alias("_da"))
    b = d.select(F.col("_n").alias("_b"), F.col("_d").alias("_db"))
    j = both.join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b"))
    return j.filter(F.struct("_da", "src") < F.struct("_db", "dst")).select(
        F.col("src").alias("lo"), F.col("dst").alias("hi"), F.struct("_db", "dst").alias("ord"))


def triangle_list(edges: DataFrame) -> DataFrame:
    """``u, v, w``: every triangle once, u its lowest node."""
    e = cut(oriented(edges), "oriented")
    x = e.select(F.col("lo").alias("u"), F.col("hi").alias("v"), F.col("ord").alias("_ov"))
    y = e.select(F.col("lo").alias("_u"), F.col("hi").alias("w"), F.col("ord").alias("_ow"))
    wedge = x.join(y, F.col("u") == F.col("_u")).filter("_ov < _ow").select("u", "v", "w")
    close = e.select(F.col("lo").alias("v"), F.col("hi").alias("w"))
    return wedge.join(close, ["v", "w"], "left_semi").select("u", "v", "w")


def triangles(edges: DataFrame, nodes: DataFrame, *, twins: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``id, triangles`` for all nodes.

    Triangles are listed between classes of nodes with one closed neighbourhood and weighted by
    their sizes; those with two or three corners in one class follow from the sizes alone.
    """
    members, links = twins or twin_classes(edges)
    links = links.withColumns({c: F.col(c).cast("long") for c in ("m_src", "m_dst")})
    size = links.select(F.col("src").alias("_c"), F.col("m_src").alias("_m")).distinct()
    t = triangle_list(links.select("src", "dst"))
    for c in "uvw":
        t = t.join(size.withColumnsRenamed({"_c": f"_{c}", "_m": f"m_{c}"}), F.col(c) == F.col(f"_{c}")).drop(f"_{c}")
    corner = F.explode(F.array(*[F.struct(F.col(c).alias("c"), (F.col(f"m_{x}") * F.col(f"m_{y}")).alias("t"))
                                 for c, x, y in ("uvw", "vuw", "wuv")]))
    across = t.select(corner.alias("p")).select("p.c", "p.t")
    m = F.col("m_dst")
    paired = links.select(F.col("src").alias("c"), ((F.col("m_src") - 1) * m + (m * (m - 1) / 2).cast("long")).alias("t"))
    per = across.unionByName(paired).groupBy("c").agg(F.sum("t").alias("_t"))
    m = F.col("m")
    inside = ((m - 1) * (m - 2) / 2).cast("long")
    t = members.join(per, F.col("v") == F.col("c"), "left").select(
        F.col("id").alias("_i"), (F.coalesce("_t", F.lit(0)) + inside).alias("_t"))
    return nodes.select("id").distinct().join(t, F.col("id") == F.col("_i"), "left").select(
        "id", F.coalesce("_t", F.lit(0)).alias("triangles"))


def _largest_with(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one lowest node u and the edges among its out-neighbours: the largest clique that holds
    u and each neighbour.  Depth-first over candidates, cut off where no member could improve."""
    u = pdf["u"].iloc[0]
    adj: dict = {}
    for v, w in zip(pdf["v"], pdf["w"]):
        adj.setdefault(v, set()).add(w)
        adj.setdefault(w, set()).add(v)
    best = dict.fromkeys(adj, 0)
    stack = [((), frozenset(adj), frozenset())]
    while stack:
        chosen, open_, done = stack.pop()
        room = len(chosen) + len(open_)
        if not open_:
            if not done:
                for m in chosen:
                    best[m] = max(best[m], len(chosen))
            continue
        if all(best[m] >= room for m in (*chosen, *open_)):
            continue
        pivot = max(open_ | done, key=lambda x: len(adj[x] & open_))
        rest, gone = set(open_), set(done)
        for v in open_ - adj[pivot]:
            stack.append(((*chosen, v), frozenset(rest & adj[v]), frozenset(gone & adj[v])))
            rest.discard(v)
            gone.add(v)
    top = max(best.values(), default=0)
    rows = [(u, top + 1)] + [(m, s + 1) for m, s in best.items()]
    return pd.DataFrame(rows, columns=["id", "size"])


def largest_cliques(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, clique``: size of the largest clique of each node (1 for an isolated one).

    Every clique lies in the out-neighbourhood of its lowest node, so the search runs per lowest
    node on a neighbourhood of at most about sqrt(2 E) nodes.
    """
    node_type = nodes.schema["id"].dataType.simpleString()
    found = triangle_list(edges).groupBy("u").applyInPandas(_largest_with, f"id {node_type}, size long")
    pairs = undirected(edges.select("src", "dst")).filter("src <> dst").select(
        F.col("src").alias("id"), F.lit(2).cast("long").alias("size"))
    best = found.unionByName(pairs).groupBy(F.col("id").alias("_i")).agg(F.max("size").alias("_s"))
    return nodes.select("id").distinct().join(best, F.col("id") == F.col("_i"), "left").select(
        "id", F.coalesce("_s", F.lit(1)).alias("clique"))


def rings(edges: DataFrame, nodes: DataFrame, mode: str = "triangles", *,
          twins: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``id, ring_size, ring_member``: 1 + triangles, or the largest clique with ``mode="cliques"``."""
    if mode == "cliques":
        c = largest_cliques(edges, nodes)
        return c.select("id", F.col("clique").alias("ring_size"), (F.col("clique") >= 3).cast("int").alias("ring_member"))
    t = triangles(edges, nodes, twins=twins)
    return t.select("id", (F.col("triangles") + 1).alias("ring_size"), (F.col("triangles") >= 1).cast("int").alias("ring_member"))
