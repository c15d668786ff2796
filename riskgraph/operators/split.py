"""Chronological split by exact row rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.plans.hot import MIN_ROWS
from riskgraph.plans.scan import row_index
from riskgraph.schema import ID, TARGET, TIME


def temporal_split(df: DataFrame, fractions=(0.6, 0.2, 0.2), *, time: str = TIME, ident: str = ID,
                   min_rows: int = MIN_ROWS) -> DataFrame:
    """Add ``row_idx`` and ``split`` (train, val, test) by rank of ``(time, id)``."""
    if abs(sum(fractions) - 1.0) > 1e-6:
        raise ValueError("fractions must sum to 1")
    if time not in df.columns:
        raise ValueError(f"no time column {time}")
    n, nulls = df.agg(F.count(F.lit(1)), F.count_if(F.col(time).isNull())).first()
    if n == 0:
        raise ValueError("nothing to split")
    if nulls:
        raise ValueError(f"{nulls} rows without time")
    a = int(n * fractions[0])
    b = a + int(n * fractions[1])
    i = F.col("row_idx")
    return row_index(df, time, ident, min_rows=min_rows).withColumn(
        "split", F.when(i < a, "train").when(i < b, "val").otherwise("test"))


def split_summary(df: DataFrame, *, time: str = TIME, target: str = TARGET) -> DataFrame:
    """Rows, time bounds and label rate per split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("first_time"), F.max(time).alias("last_time"),
        F.sum(target).alias("n_fraud"), F.avg(F.col(target).cast("double")).alias("fraud_rate"),
    )


def assert_ordered(summary: DataFrame) -> None:
    """Splits may touch in time but not overlap."""
    at = {r["split"]: r for r in summary.collect()}
    order = [at[s] for s in ("train", "val", "test") if s in at]
    for left, right in zip(order, order[1:]):
        if left["last_time"] > right["first_time"]:
            raise ValueError(f"{left['split']} overlaps {right['split']}")


def mark_split(df: DataFrame, membership: DataFrame, *, ident: str = ID) -> DataFrame:
    """Attach the split of another table by id; rows without one keep null."""
    m = membership.select(F.col(ident).alias("_mid"), "split")
    return df.join(m, df[ident] == m["_mid"], "left").drop("_mid")


def in_split(df: DataFrame, membership: DataFrame, name: str, *, ident: str = ID) -> DataFrame:
    """Rows whose id belongs to one split."""
    return df.join(membership.filter(F.col("split") == name).select(ident), ident, "left_semi")
