"""PageRank on the undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.operators.graph.build import at_nodes
from riskgraph.plans.lineage import cut, release

STRIDE = 3  # rounds between two written tables
#: Nodes of at most so many edges, all to larger nodes, are not carried through the rounds.
LOW = 8


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, *, alpha: float = 0.85,
             max_iter: int = 100, tol: float = 1e-4) -> DataFrame:
    """``id, rank``; stops once the summed change is below ``n * tol``.

    Ranks that have not settled after ``max_iter`` rounds are an error; ``tol=0`` asks for exactly
    ``max_iter`` rounds.

    Small nodes between larger ones, as transactions between entities, are left out of the rounds: what
    such a node passes on is what its neighbours had one round before.  It becomes the pairs of its at
    most ``LOW`` neighbours, added up over all small nodes once, and a round joins those pairs with the
    ranks of the larger nodes alone; ranks of small nodes follow from the last round.  That is the same
    sum in another order, nothing is left away.  Sums are combined before the shuffle and hubs are joined
    apart (:func:`at_nodes`), so a hub's edges never meet in one task.  Nodes without edges spread their
    rank evenly; all of them have the same one.  The ranks are written every few rounds with the values
    of each round, so the stop rule is applied to every round and a lost executor costs only those since
    the last table.
    """
    links = cut(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "links")
    deg = links.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("id")).groupBy("id").agg(
        F.count(F.lit(1)).alias("degree"))
    if nodes is not None:
        deg = nodes.select("id").distinct().join(deg, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    ids = cut(deg.withColumn("num", F.monotonically_increasing_id()), "ids")
    n, ends, alone = ids.agg(F.count(F.lit(1)), F.sum("degree"), F.count_if(F.col("degree") == 0)).first()
    if n == 0:
        return ids.select("id", F.lit(0.0).alias("rank"))
    low = LOW if nodes is None else 0
    kept = ids.filter(F.col("degree") > low)
    found = cut(_numbered(links, kept, ends), "found")
    if low:
        small = found.filter("na IS NULL AND nb IS NULL").select(F.explode(F.array("a", "b")).alias("id")).distinct()
        if not small.isEmpty():  # neighbours among small nodes stay in the rounds
            kept = cut(kept.unionByName(ids.join(small, "id", "left_semi")), "kept")
            found = cut(_numbered(links, kept, ends), "found")
    release(links)
    plain = found.filter("na IS NOT NULL AND nb IS NOT NULL").select(
        F.explode(F.array_distinct(F.array(F.struct(F.col("na").alias("s"), F.col("nb").alias("t")),
                                           F.struct(F.col("nb").alias("s"), F.col("na").alias("t"))))).alias("e")).select("e.s", "e.t")
    stars = pairs = None
    if low:
        stars = cut(found.filter("(na IS NULL) <> (nb IS NULL)").select(
            F.when(F.col("na").isNull(), F.col("a")).otherwise(F.col("b")).alias("id"), F.coalesce("na", "nb").alias("num")).groupBy(
                "id").agg(F.array_sort(F.collect_list("num")).alias("nums")), "stars")
        half = stars.select("nums", (1.0 / F.size("nums")).alias("w"), F.explode("nums").alias("s")).select(
            "s", F.explode("nums").alias("t"), "w").filter("s <= t").groupBy("s", "t").agg(F.sum("w").alias("w"))
        pairs = cut(half, "pairs")
    # A link passes on ``now`` of the rank of its source, and ``late`` of the rank one round before.
    flows = plain.select("s", "t", F.lit(1.0).alias("now"), F.lit(0.0).alias("late"))
    cur = kept
    if low:
        flows = flows.unionByName(pairs.select("s", "t", F.lit(0.0).alias("now"), F.col("w").alias("late"))).unionByName(
            pairs.filter("s < t").select(F.col("t").alias("s"), F.col("s").alias("t"), F.lit(0.0).alias("now"), F.col("w").alias("late")))
        own = pairs.filter("s = t").select(F.col("s").alias("num"), F.col("w").alias("small"))
        cur = kept.join(own, "num", "left").withColumn("small", F.coalesce("small", F.lit(0.0)))
    else:
        cur = kept.withColumn("small", F.lit(0.0))
    flows = cut(flows, "flows")
    # ``r_i``: ranks after i rounds.  ``lone[i]``: that of a node without edges; ``base[i]``: what each node gets in round i.
    cur = cur.select("id", "num", "degree", "small", F.lit(0.0).alias("r_-1"), F.lit(1.0 / n).alias("r_0"))
    base, lone, done, old = [], [1.0 / n], 0, None
    while True:
        steps = min(STRIDE, max_iter - done)
        for i in range(done, done + steps):
            base.append((1 - alpha) / n + alpha * alone * lone[i] / n)
            lone.append(base[i])
            sent = cur.select(F.col("num").alias("s"), (F.col(f"r_{i}") / F.col("degree")).alias("_now"),
                              (alpha * F.col(f"r_{i - 1}") / F.col("degree")).alias("_late"))
            part = flows.join(sent, "s").groupBy(F.col("t").alias("num")).agg(
                F.sum(F.col("now") * F.col("_now") + F.col("late") * F.col("_late")).alias("_in"))
            cur = cur.join(part, "num", "left").withColumn(f"r_{i + 1}", F.lit(base[i]) + alpha * (
                F.coalesce("_in", F.lit(0.0)) + F.col("small") * (base[i - 1] if i else 1.0 / n))).drop("_in")
        nxt = cut(cur, "rank")
        stop = None
        if tol > 0:
            errs = nxt.agg(*[F.sum(F.abs(F.col(f"r_{i + 1}") - F.col(f"r_{i}"))) for i in range(done, done + steps)]).first()
            for i in range(done, done + steps):
                err = (errs[i - done] or 0.0) + alone * abs(lone[i + 1] - lone[i])
                if err < n * tol and low:
                    both = _small_ranks(stars, nxt, [i, i + 1], base, alpha, n, ends)
                    err += both.agg(F.sum(F.abs(F.col(f"r_{i + 1}") - F.col(f"r_{i}")))).first()[0] or 0.0
                if err < n * tol:
                    stop = i + 1
                    break
        release(old)
        old, done = nxt, done + steps
        if stop is None and done >= max_iter and tol > 0:
            raise RuntimeError(f"ranks did not settle in {max_iter} rounds")
        if stop is not None or done >= max_iter:
            last = stop or done
            out = nxt.select("id", F.col(f"r_{last}").alias("rank"))
            if low:
                out = out.unionByName(_small_ranks(stars, nxt, [last], base, alpha, n, ends).select("id", F.col(f"r_{last}").alias("rank")))
            return out.unionByName(ids.filter("degree = 0").select("id", F.lit(lone[last]).alias("rank"))) if alone else out
        cur = nxt.select("id", "num", "degree", "small", f"r_{done - 1}", f"r_{done}")


def _numbered(links: DataFrame, kept: DataFrame, ends: int) -> DataFrame:
    """``a, b, na, nb``: the links with the numbers of their ends, null where an end is not ``kept``."""
    for end in ("a", "b"):
        links = at_nodes(links, end, kept.select(F.col("id").alias(end), "degree", F.col("num").alias(f"n{end}")), ends, "left").drop("degree")
    return links


def _small_ranks(stars: DataFrame, ranks: DataFrame, rounds: list[int], base: list[float], alpha: float, n: int, ends: int) -> DataFrame:
    """``id, r_i`` of the small nodes after each of ``rounds``, from their neighbours' ranks one round before."""
    sent = ranks.select("num", "degree", *[(F.col(f"r_{i - 1}") / F.col("degree")).alias(f"_{i}") for i in rounds])
    got = at_nodes(stars.select("id", F.explode("nums").alias("num")), "num", sent, ends)
    return got.groupBy("id").agg(*[
        (F.lit(base[i - 1]) + alpha * F.sum(f"_{i}")).alias(f"r_{i}") if i else F.max(F.lit(1.0 / n)).alias("r_0") for i in rounds])
