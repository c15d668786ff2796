"""Order statistics by counting in intervals, against sorted lists."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgraph.operators import drift as D
from riskgraph.operators import refine as R

PROBS = [i / 10 for i in range(11)]


def samples():
    rnd = random.Random(5)
    return {
        "wide": ([rnd.lognormvariate(0, 6) for _ in range(700)], [rnd.lognormvariate(0.3, 6) for _ in range(500)]),
        "ties": ([rnd.choice([0.0, 1.0, 1.0, 1.0, 7.5]) for _ in range(400)], [rnd.choice([0.0, 1.0, 8.0]) for _ in range(300)]),
        "same": ([float(i) for i in range(300)], [float(i) for i in range(300)]),
        "one": ([3.0] * 50, [3.0] * 20),
        "huge": ([-1.7e308, 0.0, 5e-324, 1.0, 1.7e308], [1.7e308, 1e-300, -5e-324]),
        "none": ([], [1.0, 2.0]),
        "left": ([1.0, 2.0, 4.0], []),
    }


def table(spark, side):
    rows = [(f, v, int(i == 0), int(i == 1)) for f, both in samples().items() for i in (0, 1) for v in both[i]]
    rows = [r for r in rows if side is None or r[2 + side]]
    return spark.createDataFrame(rows, "feature string, v double, r long, c long")


def gap(a, b):
    if not a or not b:
        return 0.0
    a, b = np.sort(a), np.sort(b)
    x = np.concatenate([a, b])
    return float(np.abs(np.searchsorted(a, x, "right") / len(a) - np.searchsorted(b, x, "right") / len(b)).max())


@pytest.mark.parametrize("split", [16, R.SPLIT])
def test_quantiles_and_gaps(spark, split):
    values = table(spark, None)
    if split == 16:  # the wide ranges would take a round per four powers of two
        values = values.filter(~F.col("feature").isin("huge", "wide"))
    found = R.levels(values, R.totals_of(values), PROBS, gaps=True, split=split)
    q = {r["feature"]: r["q"] for r in R.quantiles_of(found, PROBS).collect()}
    ks = {r["feature"]: r["ks"] for r in R.gaps_of(found).collect()}
    for f, (a, b) in samples().items():
        if f not in ks:
            continue
        assert ks[f] == pytest.approx(gap(a, b), abs=1e-12), f
        if a and f != "huge":
            assert q[f] == pytest.approx(np.quantile(a, PROBS).tolist(), rel=1e-12), f
    assert "none" not in q


def test_only_open_parts_are_counted_again(spark):
    """The gap has one peak: most values are left behind after the first round."""
    a, b = [float(i) for i in range(3000)], [i * i / 3000 for i in range(3000)]
    rows = [("x", v, 1, 0) for v in a] + [("x", v, 0, 1) for v in b]
    values = spark.createDataFrame(rows, "feature string, v double, r long, c long")
    found = R.levels(values, R.totals_of(values), [0.5], gaps=True, split=256)
    assert R.gaps_of(found).first()["ks"] == pytest.approx(gap(a, b))
    assert R.quantiles_of(found, [0.5]).first()["q"] == [1499.5]
    assert found.agg(F.sum(F.col("r") + F.col("c"))).first()[0] < 1.5 * len(rows)


def test_level_gap_is_followed_to_its_values(spark):
    """A gap that is largest over a third of the values keeps all of them open, and stays exact."""
    rows = [("x", float(i), 1, 0) for i in range(600)] + [("x", float(i), 0, 1) for i in range(200, 800)]
    values = spark.createDataFrame(rows, "feature string, v double, r long, c long")
    assert R.gaps_of(R.levels(values, R.totals_of(values), gaps=True, split=64)).first()["ks"] == pytest.approx(1 / 3)


def test_drift_needs_no_sort_of_values(spark):
    ref = spark.range(2000).select((F.col("id") * 7 % 1013).cast("double").alias("a"), F.lit("k").alias("k"))
    cur = spark.range(1500).select((F.col("id") * 5 % 900 + 40).cast("double").alias("a"), F.lit("k").alias("k"))
    out = D.numeric_psi(ref, cur, ["a"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Sort \[v#|Window|hashpartitioning\([^)]*\bv#", plan)
    a, b = (np.array([r["a"] for r in d.collect()]) for d in (ref, cur))
    edges = np.quantile(a, PROBS)[1:-1]
    p, q = (np.maximum(np.bincount(np.searchsorted(edges, x, "right"), minlength=10) / len(x), 1e-6) for x in (a, b))
    assert out.first()["psi"] == pytest.approx(float(((q - p) * np.log(q / p)).sum()), rel=1e-9)
    report = {r["feature"]: r for r in D.drift_report(ref, cur).collect()}
    assert report["a"]["ks"] == pytest.approx(gap(a.tolist(), b.tolist()))
    assert report["a"]["mean_shift"] == pytest.approx(b.mean() - a.mean())
    assert report["a"]["psi"] == out.first()["psi"]


def test_drift_of_an_empty_side(spark):
    ref = spark.createDataFrame([(1.0,), (2.0,), (None,)], "a double")
    cur = spark.createDataFrame([], "a double")
    row = D.drift_report(ref, cur, numeric=["a"]).first()
    assert (row["psi"], row["n_reference"], row["n_current"], row["notes"]) == (0.0, 2, 0, "no current values")
    assert D.ks_test(ref, cur, ["a"]).first()["ks"] == 0.0
    assert D.numeric_psi(cur, ref, ["a"]).collect() == []
