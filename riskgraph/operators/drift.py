"""Distribution drift between a reference and a current sample, all features in one job.

Both samples are unpivoted to (feature, value, side) once.  Quantiles and the Kolmogorov-Smirnov
distance come from counts in ever finer intervals (``operators/refine``), so no value is sorted
or shuffled.  Bin edges are a few numbers per feature and travel as literals, so binning stays in
generated code and the counts combine before the shuffle.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.functions import scalar as S
from riskgraph.operators.refine import gaps_of, levels, quantiles_of, totals_of
from riskgraph.plans.lineage import cut

EPS = 1e-6
JS_EPS = 1e-12


def numeric_values(df: DataFrame, features) -> DataFrame:
    """(feature, v) for the castable values of ``features``."""
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), S.number(F.col(f), None).alias("v")) for f in features])
    return df.select(F.explode(pairs).alias("p")).select(
        F.col("p.f").alias("feature"), F.col("p.v").alias("v")).filter(F.col("v").isNotNull())


def text_values(df: DataFrame, features) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in features])
    return df.select(F.explode(pairs).alias("p")).select(
        F.col("p.f").alias("feature"), F.col("p.v").alias("v")).filter(F.col("v").isNotNull())


def both_sides(reference: DataFrame, current: DataFrame) -> DataFrame:
    return reference.withColumn("side", F.lit(0)).unionByName(current.withColumn("side", F.lit(1)))


def common_columns(a: DataFrame, b: DataFrame, wanted=None) -> list[str]:
    have = [c for c in a.columns if c in b.columns and (wanted is None or c in wanted)]
    if not have:
        raise ValueError("no common columns")
    return have


def infer_kinds(df: DataFrame, features) -> dict[str, str]:
    """Numeric if at least 60 % of all values cast to a number, else categorical; one pass."""
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(S.number(F.col(f), None)).alias(f"c_{i}") for i, f in enumerate(features)]).first()
    need = max(1, int(0.6 * max(row["_n"], 1)))
    return {f: "numeric" if row[f"c_{i}"] >= need else "categorical" for i, f in enumerate(features)}


def _increasing(edges: list[float]) -> list[float]:
    out = [edges[0]]
    for e in edges[1:]:
        out.append(e if e > out[-1] else out[-1] + 1e-9)
    return out


def _per_feature(features, make):
    """Column that depends on the row's feature: one branch per feature."""
    col = None
    for f in features:
        cond = F.col("feature") == f
        col = F.when(cond, make(f)) if col is None else col.when(cond, make(f))
    return col


def _share_sums(counts: DataFrame, keys, eps: float, term) -> DataFrame:
    """Sum ``term(p, q)`` over the bins of each feature, p and q being reference and current shares."""
    total = counts.groupBy(*keys).agg(F.sum("r").alias("_nr"), F.sum("c").alias("_nc"))
    j = counts.join(total.select(*[F.col(k).alias(f"_t{k}") for k in keys], "_nr", "_nc"),
                    [F.col(k) == F.col(f"_t{k}") for k in keys])
    p = F.col("r") / F.greatest(F.col("_nr"), F.lit(1))
    q = F.col("c") / F.greatest(F.col("_nc"), F.lit(1))
    return j.select(*keys, "_nr", "_nc", term(p, q, eps).alias("_x")).groupBy(*keys).agg(
        F.when((F.first("_nr") > 0) & (F.first("_nc") > 0), F.sum("_x")).otherwise(0.0).alias("value"))


def _floor(x, eps):
    return F.when(x == 0, F.lit(eps)).otherwise(x)


def _psi_term(p, q, eps):
    p, q = _floor(p, eps), _floor(q, eps)
    return (q - p) * F.log(q / p)


def _js_term(p, q, eps):
    m = _floor((p + q) / 2.0, eps)
    p, q = _floor(p, eps), _floor(q, eps)
    return 0.5 * (p * F.log(p / m) + q * F.log(q / m))


def _fill_bins(counts: DataFrame, features, n: int) -> DataFrame:
    """All (feature, bin) rows, empty bins as zero."""
    spark = counts.sparkSession
    grid = spark.createDataFrame([(f,) for f in features], "feature string").select(
        F.col("feature").alias("_f"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_b"))
    return grid.join(counts, (F.col("_f") == F.col("feature")) & (F.col("_b") == F.col("bin")), "left").select(
        F.col("_f").alias("feature"), F.col("_b").alias("bin"),
        F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("c", F.lit(0)).alias("c"))


def _bin_counts(values: DataFrame, bin_col) -> DataFrame:
    return values.groupBy("feature", bin_col.alias("bin")).agg(
        F.sum("r").alias("r"), F.sum("c").alias("c"))


def value_rows(reference: DataFrame, current: DataFrame, features) -> DataFrame:
    """``feature, v, r, c`` per value, ``r`` or ``c`` being 1; the table that all numeric measures count."""
    long = both_sides(numeric_values(reference, features), numeric_values(current, features))
    return cut(long.select("feature", "v", (F.col("side") == 0).cast("long").alias("r"),
                           (F.col("side") == 1).cast("long").alias("c")), "values")


def _probs(n_bins: int) -> list[float]:
    return [i / n_bins for i in range(n_bins + 1)]


def _psi(values: DataFrame, quantiles: DataFrame, n_bins: int) -> DataFrame:
    edges = {r["feature"]: _increasing(r["q"]) for r in quantiles.collect()}
    have = list(edges)
    if not have:
        return values.sparkSession.createDataFrame([], "feature string, psi double")
    b = _per_feature(have, lambda f: S.bin_index(F.col("v"), edges[f]))
    counts = _fill_bins(_bin_counts(values.filter(F.col("feature").isin(have)), b), have, n_bins)
    return _share_sums(counts, ["feature"], EPS, _psi_term).select("feature", F.col("value").alias("psi"))


def _js(values: DataFrame, totals: DataFrame, n_bins: int) -> DataFrame:
    ranges = {r["feature"]: (float(r["lo"]), float(r["hi"])) for r in totals.select("feature", "lo", "hi").collect()}
    have = list(ranges)
    if not have:
        return values.sparkSession.createDataFrame([], "feature string, js double")
    b = _per_feature(have, lambda f: S.equal_bin(F.col("v"), *ranges[f], n_bins))
    counts = _fill_bins(_bin_counts(values, b), have, n_bins)
    return _share_sums(counts, ["feature"], JS_EPS, _js_term).select("feature", F.col("value").alias("js"))


def _ks(gaps: DataFrame, totals: DataFrame) -> DataFrame:
    n, m = F.col("nr").cast("double"), F.col("nc").cast("double")
    en = F.sqrt(n * m / F.greatest(n + m, F.lit(1.0)))
    lam = (en + 0.12 + F.try_divide(F.lit(0.11), en)) * F.col("ks")
    tail = sum((F.lit(2.0 * (-1) ** (j - 1)) * F.exp(-2.0 * j * j * lam * lam) for j in range(1, 31)),
               F.lit(0.0))
    p = F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))
    both = (n > 0) & (m > 0)
    return totals.select("feature", "nr", "nc").join(gaps, "feature").select(
        "feature", F.when(both, F.col("ks")).otherwise(0.0).alias("ks"), F.when(both, p).alias("ks_pvalue"))


def numeric_psi(reference: DataFrame, current: DataFrame, features, *, n_bins: int = 10) -> DataFrame:
    """``feature, psi`` over reference-quantile bins, repeated edges raised by 1e-9."""
    values = value_rows(reference, current, features)
    probs = _probs(n_bins)
    found = levels(values, cut(totals_of(values), "totals"), probs)
    return _psi(values, quantiles_of(found, probs), n_bins)


def js_divergence(reference: DataFrame, current: DataFrame, features, *, n_bins: int = 30) -> DataFrame:
    """``feature, js`` (nats) over equal bins of the pooled range; a constant feature gives 0."""
    values = value_rows(reference, current, features)
    return _js(values, totals_of(values), n_bins)


def ks_test(reference: DataFrame, current: DataFrame, features) -> DataFrame:
    """``feature, ks, ks_pvalue``: largest gap of the two distribution functions, asymptotic p."""
    values = value_rows(reference, current, features)
    totals = cut(totals_of(values), "totals")
    return _ks(gaps_of(levels(values, totals, gaps=True)), totals)


def category_counts(reference: DataFrame, current: DataFrame, features) -> DataFrame:
    """``feature, value, r, c`` over the union of categories."""
    ref = text_values(reference, features).groupBy("feature", "v").agg(F.count(F.lit(1)).alias("r"))
    cur = text_values(current, features).groupBy("feature", "v").agg(F.count(F.lit(1)).alias("c"))
    return ref.join(cur, ["feature", "v"], "outer").select(
        "feature", F.col("v").alias("value"),
        F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("c", F.lit(0)).alias("c"))


def categorical_psi(counts: DataFrame) -> DataFrame:
    return _share_sums(counts, ["feature"], EPS, _psi_term).select("feature", F.col("value").alias("psi"))


@F.pandas_udf(T.DoubleType())
def chi2_tail(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution; one value per feature."""
    def tail(x: float, k: int) -> float:
        if x <= 0:
            return 1.0
        a, h = k / 2.0, x / 2.0
        scale = math.exp(-h + a * math.log(h) - math.lgamma(a)) if h < 700 + a else 0.0
        if h < a + 1:
            term = total = 1.0 / a
            n = a
            while abs(term) > abs(total) * 1e-15:
                n += 1
                term *= h / n
                total += term
            return 1.0 - total * scale
        b, c = h + 1 - a, 1e300
        d = 1.0 / b
        out = d
        for i in range(1, 10000):
            an = -i * (i - a)
            b += 2
            d = an * d + b
            d = 1.0 / (d if d else 1e-300)
            c = b + an / c
            step = d * (c or 1e-300)
            out *= step
            if abs(step - 1) < 1e-15:
                break
        return scale * out
    return pd.Series([tail(float(x), int(k)) for x, k in zip(stat, dof)])


def chi_square(counts: DataFrame) -> DataFrame:
    """``feature, chi2, dof, chi2_pvalue``: current counts against the scaled reference."""
    total = counts.groupBy("feature").agg(
        F.sum("r").alias("_nr"), F.sum("c").alias("_nc")).withColumnRenamed("feature", "_f")
    j = counts.join(total, F.col("feature") == F.col("_f"))
    scaled = F.when(F.col("_nr") > 0, F.col("r") * (F.col("_nc") / F.col("_nr"))).otherwise(0.0)
    e = _floor(scaled, 1e-6)
    out = j.select("feature", ((F.col("c") - e) ** 2 / e).alias("_x")).groupBy("feature").agg(
        F.sum("_x").alias("chi2"), F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("dof"))
    return out.withColumn("chi2_pvalue", chi2_tail("chi2", "dof"))


def severity(psi, warn: float = 0.10, alert: float = 0.25):
    return F.when(psi >= alert, "severe").when(psi >= warn, "moderate").otherwise("none")


def drift_report(reference: DataFrame, current: DataFrame, *, numeric=None, categorical=None,
                 n_bins: int = 10, js_bins: int = 30) -> DataFrame:
    """One row per common feature with all drift measures; kinds not given are inferred."""
    cols = common_columns(reference, current)
    numeric = [c for c in (numeric or []) if c in cols]
    categorical = [c for c in (categorical or []) if c in cols]
    rest = [c for c in cols if c not in numeric and c not in categorical]
    if rest:
        kinds = infer_kinds(reference, rest)
        numeric += [c for c in rest if kinds[c] == "numeric"]
        categorical += [c for c in rest if kinds[c] == "categorical"]
    parts = []
    if numeric:
        values = value_rows(reference, current, numeric)
        totals = cut(totals_of(values), "totals")
        found = levels(values, totals, _probs(n_bins), gaps=True)
        base = totals.select(
            "feature", F.col("nr").alias("n_reference"), F.col("nc").alias("n_current"),
            (F.try_divide("sc", "nc") - F.try_divide("sr", "nr")).alias("mean_shift"))
        parts.append(base.join(_psi(values, quantiles_of(found, _probs(n_bins)), n_bins), "feature", "left")
                     .join(_ks(gaps_of(found), totals), "feature", "left")
                     .join(_js(values, totals, js_bins), "feature", "left").withColumn("kind", F.lit("numeric")))
    if categorical:
        counts = cut(category_counts(reference, current, categorical), "categories")
        base = counts.groupBy("feature").agg(F.sum("r").alias("n_reference"), F.sum("c").alias("n_current"))
        parts.append(base.join(categorical_psi(counts), "feature", "left")
                     .join(chi_square(counts), "feature", "left").withColumn("kind", F.lit("categorical")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    for c, t in (("mean_shift", "double"), ("ks", "double"), ("ks_pvalue", "double"), ("js", "double"),
                 ("chi2", "double"), ("dof", "bigint"), ("chi2_pvalue", "double")):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    empty = F.col("n_current") == 0
    psi = F.when(empty, 0.0).otherwise(F.coalesce("psi", F.lit(0.0)))

    def seen(c):
        return F.when(~empty, F.col(c)).alias(c)

    return out.select(
        "feature", "kind", psi.alias("psi"), seen("ks"), seen("ks_pvalue"), seen("js"), seen("chi2"),
        seen("chi2_pvalue"), F.when(empty, 0.0).otherwise(F.coalesce("mean_shift", F.lit(0.0))).alias("mean_shift"),
        severity(psi).alias("severity"), "n_reference", "n_current",
        F.when(empty, "no current values").alias("notes"))


def drift_overall(report: DataFrame, combine: str = "max") -> DataFrame:
    psi = F.coalesce(F.max("psi") if combine == "max" else F.avg("psi"), F.lit(0.0))
    return report.agg(
        psi.alias("overall_psi"), F.count(F.lit(1)).alias("n_features"),
        F.count_if(F.col("severity") == "moderate").alias("n_moderate"),
        F.count_if(F.col("severity") == "severe").alias("n_severe"),
    ).withColumn("severity", severity(F.col("overall_psi")))


def top_drifted(report: DataFrame, k: int = 10) -> DataFrame:
    return report.orderBy(F.desc("psi"), "feature").limit(max(1, k))


def label_drift(df: DataFrame, label: str, reference_rate: float = 0.035) -> DataFrame:
    y = F.when(F.col(label) != 0, 1.0).when(F.col(label).isNotNull(), 0.0)
    rate = F.coalesce(F.avg(y), F.lit(0.0))
    n = F.count(F.col(label))
    return df.agg(
        n.alias("n"), rate.alias("production_rate"), F.lit(reference_rate).alias("reference_rate"),
        F.when(n > 0, F.abs(rate - reference_rate)).otherwise(0.0).alias("absolute_drift"))


def score_drift(reference: DataFrame, current: DataFrame, score: str, n_bins: int = 20) -> DataFrame:
    return numeric_psi(reference, current, [score], n_bins=n_bins)
