"""Exploratory aggregates: class balance, volume, rates, correlations, histograms, latency."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.functions import scalar as S
from riskgraph.functions.quantiles import quantiles
from riskgraph.operators.clean import families
from riskgraph.plans.hot import MIN_ROWS
from riskgraph.plans.scan import row_index
from riskgraph.schema import AMOUNT, DAY, TARGET, TIME


def class_summary(df: DataFrame, *, target: str = TARGET, amount: str = AMOUNT) -> DataFrame:
    """Per class: rows and amount mean, median, sample deviation, maximum."""
    base = df.groupBy(target).agg(
        F.count(F.lit(1)).alias("n"), F.avg(amount).alias("mean_amt"),
        F.stddev_samp(amount).alias("std_amt"), F.max(amount).alias("max_amt"))
    med = quantiles(df, [target], amount, [0.5]).select(
        F.col(target).alias("_t"), F.col("q")[0].alias("median_amt"))
    return base.join(med, base[target] == med["_t"], "left").drop("_t")


def daily_volume(df: DataFrame, *, time: str = TIME, target: str = TARGET) -> DataFrame:
    return df.groupBy(F.floor(F.col(time) / DAY).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(target).cast("double")).alias("fraud_rate"))


def rate_by(df: DataFrame, col: str, n: int | None = None, *, target: str = TARGET) -> DataFrame:
    """Rows and target rate per category (null is a category), largest first."""
    g = df.groupBy(F.col(col).alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(target).cast("double")).alias("fraud_rate"))
    return g if n is None else g.orderBy(F.desc("n"), F.col("category").asc_nulls_first()).limit(n)


def dataset_profile(df: DataFrame, *, target: str = TARGET, amount: str = AMOUNT) -> DataFrame:
    fam = families(df.schema)
    x = F.lit(0)
    for c in df.columns:
        x = x + F.col(c).isNull().cast("int")
    base = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
        *[F.lit(len(fam[f])).alias(f"n_{f}") for f in ("v", "d", "c", "m")],
        F.avg(F.col(target).cast("double")).alias("fraud_rate"), F.avg(amount).alias("mean_amt"),
        (F.sum(x) / F.greatest(F.count(F.lit(1)) * len(df.columns), F.lit(1))).alias("missing_share"), F.lit(1).alias("_one"))
    q = quantiles(df, [], amount, [0.5, 0.99]).select(
        F.col("q")[0].alias("median_amt"), F.col("q")[1].alias("p99_amt"), F.lit(1).alias("_one"))
    return base.join(q, "_one").drop("_one")


def target_correlation(df: DataFrame, cols, n: int | None = None, *, target: str = TARGET) -> DataFrame:
    """``feature, corr`` with the target, largest absolute value first; one aggregation."""
    y = F.col(target).cast("double")
    one = df.agg(*[F.corr(F.col(c).cast("double"), y).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in cols])
    out = one.select(F.explode(pairs).alias("p")).select("p.*")
    out = out.withColumn("abs_corr", F.coalesce(F.abs("corr"), F.lit(0.0)))
    return out if n is None else out.orderBy(F.desc("abs_corr"), "feature").limit(n)


def node_feature_columns(df: DataFrame, *, target: str = TARGET, n_v: int = 47, width: int = 50) -> list[str]:
    """Columns of the transaction node: best V columns, then the fixed extras, at most ``width``.

    V columns rank by absolute correlation with the target, by variance when there is none.
    """
    v = [c for c in df.columns if re.fullmatch(r"V\d+", c)]
    rank: dict[str, float] = {}
    if v:
        two = target in df.columns and df.select(target).distinct().limit(2).count() > 1
        y = F.col(target).cast("double") if two else None
        row = df.agg(*[(F.abs(F.corr(F.col(c).cast("double"), y)) if two else F.var_samp(c)).alias(c)
                       for c in v]).first()
        rank = {c: float(row[c] or 0.0) for c in v}
    top = sorted(v, key=lambda c: (-rank[c], v.index(c)))[:n_v]
    # Extras in order of preference.
    extras = [c for c in ("TransactionAmt__log1p", "TransactionAmt", "TransactionDT", "C1", "C13",
                          "C14", "D1", "D15") if c in df.columns]
    return (top + extras)[:width]


def score_histogram(df: DataFrame, score: str, n: int = 20) -> DataFrame:
    """Counts of scores in ``n`` equal bins of 0..1, the last one clamped; empty bins are 0."""
    got = df.groupBy(F.least(F.floor(F.col(score) * n), F.lit(n - 1)).alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"))
    spark = df.sparkSession
    return spark.range(n).join(got, F.col("id") == F.col("_b"), "left").select(
        F.col("id").alias("bin"), F.coalesce("_n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, value, n: int, by: str) -> DataFrame:
    """Equal-width histogram of ``value`` per class of ``by``, last bin closed."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:
        lo = hi = 0.0
    return df.filter(value.isNotNull()).groupBy(by, S.equal_bin(value, float(lo), float(hi), n).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def latency_summary(df: DataFrame, value: str) -> DataFrame:
    """Interpolated p50, p95, p99 with mean and maximum."""
    q = quantiles(df, [], value, [0.5, 0.95, 0.99]).select(
        *[F.col("q")[i].alias(p) for i, p in enumerate(("p50", "p95", "p99"))], F.lit(1).alias("_one"))
    return df.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.lit(1).alias("_one")).join(
        q, "_one").drop("_one")


def nearest_rank(df: DataFrame, value: str, ident: str, probs=(0.5, 0.95, 0.99), *,
                 min_rows: int = MIN_ROWS) -> DataFrame:
    """``p, value`` at index floor(p * n) of the sorted values."""
    n = df.filter(F.col(value).isNotNull()).count()
    want = df.sparkSession.createDataFrame(
        [(float(p), int(min(n - 1, p * n // 1))) for p in probs], "p double, _want long")
    r = row_index(df.filter(F.col(value).isNotNull()).select(value, ident), value, ident, "_i", min_rows=min_rows)
    return r.join(F.broadcast(want), F.col("_i") == F.col("_want")).select("p", F.col(value).alias("value"))


def predicted_rate(df: DataFrame, score: str, threshold: float = 0.5) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.avg((F.col(score) >= threshold).cast("double")).alias("predicted_rate"))


def risk_counts(df: DataFrame, score: str) -> DataFrame:
    return df.groupBy(S.risk_level(F.col(score)).alias("risk_level")).agg(F.count(F.lit(1)).alias("n"))


def highest_scored(df: DataFrame, score: str, ident: str) -> DataFrame:
    """The row with the highest score (smallest id among equals), without sorting."""
    best = F.max_by(F.struct(*df.columns), F.struct(F.col(score), -F.col(ident)))
    return df.agg(best.alias("b")).select("b.*")
