"""Exact order statistics of two samples by counting in ever finer intervals; nothing is sorted.

A round cuts every open interval of values into ``SPLIT`` equal parts and counts both samples in
them, with the smallest and largest value of each part.  Those are sums and extremes, combined
before the shuffle, so a round moves at most ``SPLIT`` rows per open interval and task, whatever
the number of values.  Between rounds only the parts that can still matter stay open:

* for quantiles, the parts that hold a wanted rank of the first sample;
* for the Kolmogorov-Smirnov distance, the parts inside which the two distribution functions could
  be further apart than the largest gap already seen at an edge.

A part whose smallest and largest value are equal is a value, so its counts are exact and it is
closed.  Each round leaves at least two parts of an open interval, and normally hundreds.  Where
the gap stays at its largest over a long range, the parts there are followed down to their values,
so the counts may then have as many rows as there are different values in that range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.plans.lineage import cut, release

SPLIT = 1024


def totals_of(values: DataFrame) -> DataFrame:
    """``feature, nr, nc, lo, hi, sr, sc``: counts, range and sums of ``feature, v, r, c``."""
    return values.groupBy("feature").agg(
        F.sum("r").alias("nr"), F.sum("c").alias("nc"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.sum(F.col("v") * F.col("r")).alias("sr"), F.sum(F.col("v") * F.col("c")).alias("sc"))


def _part(split: int):
    """Number of the part of [lo, hi] that ``v`` is in; never falls as ``v`` grows."""
    # Halves keep the widest ranges finite; where the width vanishes, the largest value stands alone.
    width = F.col("hi") / 2 - F.col("lo") / 2
    at = F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * split)
    return F.when(width > 0, F.least(at, F.lit(split - 1))).otherwise(
        (F.col("v") == F.col("hi")).cast("long") * (split - 1)).cast("int").alias("part")


def levels(values: DataFrame, totals: DataFrame, probs=(), *, gaps: bool = False, split: int = SPLIT) -> DataFrame:
    """All parts counted on the way: ``feature, lo, hi, r, c, cr, cc, nr, nc, ranks, gap``.

    ``values`` is ``feature, v, r, c`` with weights of the first and second sample, ``totals`` comes
    from :func:`totals_of`.  ``cr, cc`` are running counts up to the part's largest value.
    """
    wanted = [f(F.lit(float(p)) * (F.col("nr") - 1)) for p in probs for f in (F.floor, F.ceil)]
    ranks = F.when(F.col("nr") > 0, F.array_distinct(F.array(*wanted))) if wanted else F.lit(None)
    per = cut(totals.select(F.col("feature").alias("_t"), "nr", "nc", ranks.cast("array<bigint>").alias("ranks")), "per")
    zero = F.lit(0).cast("long")
    start = totals.select(F.col("feature").alias("_f"), "lo", "hi")
    rows = values.join(start, F.col("feature") == F.col("_f")).select(
        "feature", "v", "r", "c", F.lit("").alias("id"), "lo", "hi", zero.alias("r0"), zero.alias("c0"))
    before = Window.partitionBy("feature", "id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    held, written, best = F.exists("ranks", lambda k: (k >= F.col("cr") - F.col("r")) & (k < F.col("cr"))), None, None
    found = None
    while True:
        counted = rows.select("*", _part(split)).groupBy("feature", "id", "part").agg(
            F.sum("r").alias("r"), F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"),
            F.first("r0").alias("r0"), F.first("c0").alias("c0"), F.first("lo").alias("plo"), F.first("hi").alias("phi"))
        # At most ``split`` rows per window.
        running = counted.select(
            "feature", "id", "part", "lo", "hi", "plo", "phi", "r", "c",
            (F.col("r0") + F.sum("r").over(before)).alias("cr"), (F.col("c0") + F.sum("c").over(before)).alias("cc"))
        level = cut(running.join(F.broadcast(per), F.col("feature") == F.col("_t")).drop("_t").withColumn(
            "gap", F.abs(F.try_divide("cr", "nr") - F.try_divide("cc", "nc"))), "level")
        kept = level.drop("id", "part", "plo", "phi")
        found = kept if found is None else found.unionByName(kept)
        top = level.groupBy(F.col("feature").alias("_b")).agg(F.max("gap").alias("_g"))
        best = cut(top if best is None else top.unionByName(best).groupBy("_b").agg(F.max("_g").alias("_g")), "gaps")
        may = F.greatest(
            F.try_divide("cr", "nr") - F.try_divide(F.col("cc") - F.col("c"), "nc"),
            F.try_divide("cc", "nc") - F.try_divide(F.col("cr") - F.col("r"), "nr"))
        matters = F.coalesce(held, F.lit(False))
        if gaps:
            matters = matters | F.coalesce(may > F.col("_g"), F.lit(False))
        open_ = cut(level.join(F.broadcast(best), F.col("feature") == F.col("_b")).filter(
            (F.col("lo") < F.col("hi")) & matters).select(
                F.col("feature").alias("_f"), F.col("id").alias("_i"), F.col("part").alias("_p"),
                F.concat_ws(".", "id", "part").alias("_n"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                (F.col("cr") - F.col("r")).alias("_r0"), (F.col("cc") - F.col("c")).alias("_c0")), "open")
        if open_.isEmpty():
            release(written)
            return found
        keyed = rows.select("*", _part(split))
        nxt = cut(keyed.join(
            open_, (F.col("feature") == F.col("_f")) & (F.col("id") == F.col("_i")) & (F.col("part") == F.col("_p"))).select(
                "feature", "v", "r", "c", F.col("_n").alias("id"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"),
                F.col("_r0").alias("r0"), F.col("_c0").alias("c0")), "inside")
        release(written)
        rows = written = nxt


def quantiles_of(found: DataFrame, probs) -> DataFrame:
    """``feature, q``: quantiles of the first sample, linear between ranks, from :func:`levels`."""
    single = found.filter((F.col("lo") == F.col("hi")) & (F.col("nr") > 0))
    out = []
    for p in probs:
        h = F.lit(float(p)) * (F.col("nr") - 1)

        def at(rank):
            return F.max(F.when((rank >= F.col("cr") - F.col("r")) & (rank < F.col("cr")), F.col("lo")))

        low, high = at(F.floor(h)), at(F.ceil(h))
        out.append(low + (high - low) * F.max(h - F.floor(h)))
    return single.groupBy("feature").agg(F.array(*out).alias("q"))


def gaps_of(found: DataFrame) -> DataFrame:
    """``feature, ks``: the largest gap of the two distribution functions, from :func:`levels`."""
    return found.groupBy("feature").agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("ks"))
