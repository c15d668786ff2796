"""Betweenness (Brandes 2001, level by level for all sources) and closeness centrality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.operators.graph.build import undirected
from riskgraph.operators.graph.twins import twin_classes
from riskgraph.plans.lineage import cut, release
from riskgraph.plans.scan import row_index


LANES = 32  # sources a row of the search carries side by side
WORDS = 8  # 64-bit words a row of the reached sets carries side by side


def betweenness(edges: DataFrame, nodes: DataFrame, *, k: int | None = 200, seed: int = 42,
                twins: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``id, betweenness`` (normalised), from ``k`` seeded sources or from all with ``None``.

    Nodes of one closed neighbourhood are one class with their number as its weight: no shortest
    path holds two of them, so path counts and dependencies are weighted sums over classes, equal
    to those over nodes.  The breadth-first levels of all sources advance together, one join and
    one sum per level; the dependencies then flow back level by level.  State is one row per
    (reached class, :data:`LANES` sources).  ``twins`` is what :func:`twin_classes` gave, if it was asked before.
    """
    ids = cut(nodes.select("id").distinct(), "ids")
    n = ids.count()
    if n <= 2:
        return ids.select("id", F.lit(0.0).alias("betweenness"))
    members, links = twins or twin_classes(edges)
    sources = ids if k is None or k >= n else ids.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k)
    k_used = n if k is None else min(k, n)
    starts = sources.join(members, "id").groupBy("v", "m").agg(F.count(F.lit(1)).cast("double").alias("q"))
    starts = cut(row_index(cut(starts, "starts"), "v", "v", "_i").select(
        "v", "m", "q", F.floor(F.col("_i") / LANES).alias("b"), (F.col("_i") % LANES).alias("lane")), "starts")
    lanes = range(LANES)
    zero = F.lit(0.0)
    weights = cut(starts.groupBy(F.col("b").alias("_b")).agg(F.array(*[
        F.sum(F.when(F.col("lane") == i, F.col("q")).otherwise(zero)) for i in lanes]).alias("q")), "weights")
    level = cut(starts.select("v", "b", "m", *[
        F.when(F.col("lane") == i, F.lit(1.0)).otherwise(zero).alias(f"f{i}") for i in lanes]), "level")
    levels = [level]
    while True:
        # A class next to level d lies in level d - 1, d or d + 1; only the last is new.
        known = None
        for old in levels[-2:]:
            bits = sum((F.when(F.col(f"f{i}") > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in lanes),
                       F.lit(0).cast("long"))
            part = old.select(F.col("v").alias("_v"), F.col("b").alias("_b"), bits.alias("_bits"))
            known = part if known is None else known.unionByName(part)
        known = known.groupBy("_v", "_b").agg(F.bit_or("_bits").alias("_bits"))
        times = F.lit(1.0) if len(levels) == 1 else F.col("m").cast("double")
        out = level.select(F.col("v").alias("_s"), "b", *[(F.col(f"f{i}") * times).alias(f"f{i}") for i in lanes])
        step = out.join(links, F.col("_s") == F.col("src")).groupBy("dst", "b", "m_dst").agg(
            *[F.sum(f"f{i}").alias(f"f{i}") for i in lanes])
        seen = F.coalesce("_bits", F.lit(0).cast("long"))
        step = step.join(known, (F.col("dst") == F.col("_v")) & (F.col("b") == F.col("_b")), "left").select(
            F.col("dst").alias("v"), "b", F.col("m_dst").alias("m"), *[
                F.when(seen.bitwiseAND(F.lit(1 << i).cast("long")) == 0, F.col(f"f{i}")).otherwise(zero).alias(f"f{i}")
                for i in lanes])
        nxt = cut(step.filter(F.greatest(*[f"f{i}" for i in lanes]) > 0), "level")
        if nxt.limit(1).count() == 0:
            break
        levels.append(nxt)
        level = nxt
    # d<i> is the dependency of all sources of the lane's class together, q times that of one.
    total, delta = None, None
    for d in range(len(levels) - 1, 1, -1):
        here = levels[d] if delta is None else delta
        here = here.join(weights, F.col("b") == F.col("_b"))
        coef = here.select(F.col("v").alias("_s"), "b", *[
            F.when(F.col(f"f{i}") > 0, F.col("m") * (F.col("q")[i] + (zero if delta is None else F.col(f"d{i}")))
                   / F.col(f"f{i}")).otherwise(zero).alias(f"c{i}") for i in lanes])
        up = coef.join(links, F.col("_s") == F.col("src")).groupBy(
            F.col("dst").alias("_v"), F.col("b").alias("_u")).agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in lanes])
        above = levels[d - 1]
        delta = cut(above.join(up, (above["v"] == up["_v"]) & (above["b"] == up["_u"]), "left").select(
            "v", "b", "m", *[f"f{i}" for i in lanes], *[
                (F.col(f"f{i}") * F.coalesce(f"c{i}", zero)).alias(f"d{i}") for i in lanes]), "delta")
        part = delta.select("v", sum((F.col(f"d{i}") for i in lanes), zero).alias("delta"))
        total = part if total is None else total.unionByName(part)
    scale = n / (k_used * (n - 1.0) * (n - 2.0))
    if total is None:
        return ids.select("id", F.lit(0.0).alias("betweenness"))
    agg = total.groupBy(F.col("v").alias("_v")).agg(F.sum("delta").alias("_d"))
    agg = members.join(agg, F.col("v") == F.col("_v")).select(F.col("id").alias("_id"), "_d")
    return ids.join(agg, F.col("id") == F.col("_id"), "left").select(
        "id", (F.coalesce("_d", zero) * scale).alias("betweenness"))


def closeness(edges: DataFrame, nodes: DataFrame, *, twins: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``id, closeness``: exact, scaled by the reached share of the graph.

    Breadth-first search from all nodes at once with bit sets: a row is (class of nodes with one
    closed neighbourhood, 64 x :data:`WORDS` sources), so a level is a join and a bitwise or, and
    a class's distance sum grows by level times the number of new bits.
    """
    ids = cut(nodes.select("id").distinct(), "ids")
    n = ids.count()
    members, links = twins or twin_classes(edges)
    at = row_index(members.withColumn("_h", F.xxhash64("id")), "v", "_h", "i")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("i") % 64).cast("int"))
    zero = F.lit(0).cast("long")
    words = range(WORDS)
    # One row per (class, block of sources): all sources seen, those new in this round, their count and distances.
    start = at.groupBy("v", F.floor(F.col("i") / (64 * WORDS)).alias("block")).agg(*[
        F.bit_or(F.when(F.floor(F.col("i") / 64) % WORDS == j, bit).otherwise(zero)).alias(f"s{j}") for j in words])
    state = cut(start.select("v", "block", *[f"s{j}" for j in words], *[F.col(f"s{j}").alias(f"f{j}") for j in words],
                             zero.alias("r"), zero.alias("d")), "reach")
    fresh = F.expr(" OR ".join(f"f{j} <> 0" for j in words))
    depth, grown = 0, 1
    while grown:
        depth += 1
        active = state.filter(fresh).select(F.col("v").alias("_s"), F.col("block").alias("_w"), *[f"f{j}" for j in words])
        near = active.join(links, F.col("_s") == F.col("src")).groupBy(F.col("dst").alias("_v"), "_w").agg(
            *[F.bit_or(f"f{j}").alias(f"b{j}") for j in words])
        j2 = state.drop(*[f"f{j}" for j in words]).join(
            near, (F.col("v") == F.col("_v")) & (F.col("block") == F.col("_w")), "full_outer")
        j2 = j2.select(F.coalesce("v", "_v").alias("v"), F.coalesce("block", "_w").alias("block"), "r", "d", *[
            F.coalesce(f"s{j}", zero).alias(f"s{j}") for j in words], *[F.coalesce(f"b{j}", zero).alias(f"b{j}") for j in words])
        new = [F.col(f"b{j}").bitwiseAND(F.bitwise_not(F.col(f"s{j}"))) for j in words]
        count = sum((F.bit_count(x).cast("long") for x in new), zero)
        nxt = cut(j2.select(
            "v", "block", *[F.col(f"s{j}").bitwiseOR(F.col(f"b{j}")).alias(f"s{j}") for j in words],
            *[new[j].alias(f"f{j}") for j in words],
            (F.coalesce("r", zero) + count).alias("r"), (F.coalesce("d", zero) + depth * count).alias("d")), "reach")
        release(state)
        state = nxt
        grown = state.filter(fresh).limit(1).count()
    t = state.groupBy(F.col("v").alias("_v")).agg(F.sum("r").alias("_r"), F.sum("d").alias("_d"))
    # The other members of its class are one step from a node.
    t = members.join(t, F.col("v") == F.col("_v")).select(
        F.col("id").alias("_i"), (F.col("_r") + F.col("m") - 1).alias("_r"), (F.col("_d") + F.col("m") - 1).alias("_d"))
    c = F.when(F.col("_d") > 0, F.col("_r") / F.col("_d") * F.col("_r") / F.lit(max(n - 1, 1)))
    return ids.join(t, F.col("id") == F.col("_i"), "left").select("id", F.coalesce(c, F.lit(0.0)).alias("closeness"))


def closeness_sketched(edges: DataFrame, nodes: DataFrame, *, lg_k: int = 12) -> DataFrame:
    """Closeness from distinct-count sketches instead of bit sets, for very large projections.

    A node's sketch after t rounds holds the nodes within t hops; the growth between rounds is the
    number at distance t.  Approximate by construction; :func:`closeness` is the exact form.
    """
    links = cut(undirected(edges.select("src", "dst")).filter("src <> dst").distinct(), "links")
    ids = cut(nodes.select("id").distinct(), "ids")
    n = ids.count()
    cur = cut(ids.groupBy("id").agg(F.hll_sketch_agg("id", lg_k).alias("sk")).select(
        "id", "sk", F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("dist")), "hll")
    depth = 0
    while True:
        depth += 1
        near = links.join(cur.select(F.col("id").alias("_n"), "sk"), F.col("dst") == F.col("_n")).select(
            F.col("src").alias("id"), "sk").unionByName(cur.select("id", "sk"))
        m = near.groupBy("id").agg(F.hll_union_agg("sk").alias("sk2"))
        est = F.hll_sketch_estimate("sk2")
        nxt = cut(cur.join(m, "id").select(
            "id", F.col("sk2").alias("sk"), F.greatest(est, F.col("size")).alias("size"),
            (F.col("dist") + depth * F.greatest(est - F.col("size"), F.lit(0))).alias("dist")), "hll")
        grown = nxt.agg(F.sum("size")).first()[0] - cur.agg(F.sum("size")).first()[0]
        cur = nxt
        if grown <= 0:
            break
    r = F.col("size") - 1
    return cur.select("id", F.when(F.col("dist") > 0, r / F.col("dist") * r / max(n - 1, 1)).otherwise(0.0).alias("closeness"))
