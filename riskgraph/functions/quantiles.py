"""Exact quantiles (linear interpolation) per group that also hold for very large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.plans.hot import MIN_ROWS
from riskgraph.plans.scan import running_sums


def quantiles(
    df: DataFrame,
    keys,
    value: str,
    probs,
    name: str = "q",
    *,
    max_group: int = MIN_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """One row per group with ``name``: array of the quantiles ``probs`` of ``value``.

    ``percentile`` keeps one counter per distinct value of a group in memory, which is fine up to
    ``max_group`` rows.  Beyond that the values are counted, the counts are summed along the values
    with :func:`running_sums` (which splits large groups), and each wanted rank is looked up; no
    task holds a group.  ``rows``, when the caller knows it, bounds the size of any group and
    saves the counting job.
    """
    keys = list(keys)
    probs = [float(p) for p in probs]
    x = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if rows is None or rows > max_group:
        rows = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    if rows <= max_group:
        return x.groupBy(*keys).agg(F.percentile("_v", probs).alias(name))
    counted = x.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    cum = running_sums(counted, keys, "_v", {"_upto": F.col("_c")}, min_rows=max_group, totals=True)
    return cum.groupBy(*keys).agg(ranked_values(probs, "_v", "_upto", "_upto_total").alias(name))


def ranked_values(probs, value: str, upto: str, total: str):
    """Quantiles as an aggregate over distinct values with their running counts and the total.

    The value at rank r (from 0) is the smallest one whose running count exceeds r.
    """
    out = []
    for p in probs:
        h = F.lit(float(p)) * (F.col(total) - 1)
        low = F.min(F.when(F.col(upto) > F.floor(h), F.col(value)))
        high = F.min(F.when(F.col(upto) > F.ceil(h), F.col(value)))
        out.append(low + (high - low) * F.max(h - F.floor(h)))
    return F.array(*out)


def quantile_list(df: DataFrame, value: str, probs, **kw) -> list[float] | None:
    """Quantiles of a whole column, read to the driver (as many numbers as ``probs``)."""
    row = quantiles(df, [], value, probs, "q", **kw).first()
    return None if row is None or row["q"] is None else [float(x) for x in row["q"]]
