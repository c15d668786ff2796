"""Causal windows against a plain loop, on ordinary and on split (hot) groups."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from riskgraph.operators import temporal as T
from riskgraph.plans.asof import asof_join, counts_at, window_summary_at
from riskgraph.plans.scan import row_index, running_sums
from riskgraph.functions.quantiles import quantiles
from pyspark.sql import functions as F

W = (3600, 86400)


def frame(spark, rows):
    return spark.createDataFrame(rows, "TransactionID long, TransactionDT long, TransactionAmt double, card1 long")


def naive(rows, windows):
    out = {}
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for i, (tid, t, a, c) in enumerate(ordered):
        own = [r for r in ordered[: i + 1] if r[3] == c]
        gaps = [y[1] - x[1] for x, y in zip(own, own[1:])]
        amts = [r[2] for r in own]
        acc = [0.0] + [y - x for x, y in zip(amts, amts[1:])]
        mean = sum(gaps) / len(gaps) if gaps else 0.0
        out[tid] = {
            "n_seen": len(own), "gap": gaps[-1] if gaps else 0, "gap_mean": mean,
            "gap_std": math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)) if gaps else 0.0,
            "cum_amount": sum(amts), "acceleration": acc[-1],
            "jerk": acc[-1] - acc[-2] if len(acc) > 1 else 0.0, "first_time": own[0][1],
            **{f"n_{w}s": sum(r[1] >= t - w for r in own) for w in windows},
            **{f"sum_{w}s": sum(r[2] for r in own if r[1] >= t - w) for w in windows},
            "g_gap": t - ordered[i - 1][1] if i else 0,
            **{f"g_n_{w}s": sum(r[1] >= t - w for r in ordered[: i + 1]) for w in windows},
            **{f"g_sum_{w}s": sum(r[2] for r in ordered[: i + 1] if r[1] >= t - w) for w in windows},
        }
    return out


def check(got, want):
    assert len(got) == len(want)
    for r in got:
        for k, v in want[r["TransactionID"]].items():
            if k in r.asDict():
                assert r[k] == pytest.approx(v, rel=1e-9, abs=1e-6), (r["TransactionID"], k)


def sample(n=300, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.choice([rnd.randrange(200000), 7200 * rnd.randrange(25)]), round(rnd.uniform(1, 99), 2),
             7 if rnd.random() < 0.4 else rnd.choice([1, 2, 3, None])) for i in range(n)]


@pytest.mark.parametrize("min_rows", [10**6, 20])
def test_card_windows(spark, min_rows):
    rows = sample()
    got = T.card_causal(frame(spark, rows), windows=W, min_rows=min_rows).collect()
    check(got, naive(rows, W))


@pytest.mark.parametrize("min_rows", [10**6, 20])
def test_global_windows(spark, min_rows):
    rows = sample(seed=2)
    got = T.global_causal(frame(spark, rows), windows=(3600, 86400), min_rows=min_rows).collect()
    check(got, naive(rows, W))


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 9000), st.integers(1, 50), st.integers(1, 2)), min_size=1, max_size=25))
def test_any_history(spark, items):
    rows = [(i, t, float(a), c) for i, (t, a, c) in enumerate(items)]
    got = T.card_causal(frame(spark, rows), windows=(3600,), min_rows=4).collect()
    check(got, naive(rows, (3600,)))


def test_lower_bound_is_inclusive(spark):
    rows = [(1, 0, 1.0, 1), (2, 3600, 1.0, 1), (3, 7201, 1.0, 1)]
    got = {r[0]: r["n_3600s"] for r in T.card_causal(frame(spark, rows), windows=(3600,)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_two_row_card_has_jerk_equal_acceleration(spark):
    got = T.card_causal(frame(spark, [(1, 0, 5.0, 1), (2, 10, 9.0, 1)])).orderBy("TransactionID").collect()
    assert (got[0]["jerk"], got[0]["acceleration"]) == (0.0, 0.0)
    assert got[1]["jerk"] == got[1]["acceleration"] == 4.0


@pytest.mark.parametrize("min_rows", [10**6, 15])
def test_running_sums_and_index(spark, min_rows):
    rnd = random.Random(3)
    rows = [(i, "a" if rnd.random() < 0.7 else "b", rnd.randrange(60), rnd.randrange(10)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, o long, v long")
    got = running_sums(df, ["g"], "o", {"s": F.col("v")}, tie="id", min_rows=min_rows, totals=True).collect()
    for r in got:
        upto = sum(v for i, g, o, v in rows if g == r["g"] and (o, i) <= (r["o"], r["id"]))
        assert r["s"] == upto
        assert r["s_total"] == sum(v for _, g, _, v in rows if g == r["g"])
    idx = {r["id"]: r["row_idx"] for r in row_index(df, "o", "id", min_rows=min_rows).collect()}
    assert idx == {i: n for n, (i, _, _, _) in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}


@pytest.mark.parametrize("max_group", [10**6, 30])
def test_quantiles(spark, max_group):
    import numpy as np

    rnd = random.Random(4)
    rows = [("a", rnd.gauss(0, 5)) for _ in range(151)] + [("b", float(rnd.randrange(4))) for _ in range(80)] + [("c", 1.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {r["g"]: r["q"] for r in quantiles(df, ["g"], "v", probs, max_group=max_group).collect()}
    for g in "abc":
        assert got[g] == pytest.approx(list(np.quantile([v for k, v in rows if k == g], probs)))


@pytest.mark.parametrize("min_rows", [10**6, 10])
def test_asof_join(spark, min_rows):
    rnd = random.Random(5)
    left = [(i, rnd.choice([1, 1, 1, 2]), rnd.randrange(500)) for i in range(80)]
    right = list({(rnd.choice([1, 1, 2]), rnd.randrange(500)): 0 for _ in range(40)})
    l = spark.createDataFrame(left, "id long, key long, t long")
    r = spark.createDataFrame([(k, t, f"{k}@{t}") for k, t in right], "key long, rt long, v string")
    got = {x["id"]: x["v"] for x in asof_join(l, r, "key", "t", "rt", ttl=60, min_rows=min_rows).collect()}
    for i, k, t in left:
        ok = [rt for kk, rt in right if kk == k and rt <= t]
        best = max(ok) if ok else None
        assert got[i] == (f"{k}@{best}" if best is not None and t - best <= 60 else None)


@pytest.mark.parametrize("min_rows", [10**6, 20])
def test_windows_at_probes(spark, min_rows):
    rnd = random.Random(6)
    hist = [(rnd.choice([1, 1, 2]), rnd.randrange(2000), float(rnd.randrange(50)), rnd.randrange(2)) for _ in range(200)]
    probes = [(f"p{i}", rnd.choice([1, 2, 3]), rnd.randrange(2500)) for i in range(40)]
    h = spark.createDataFrame(hist, "c long, t long, a double, y int")
    p = spark.createDataFrame(probes, "pid string, c long, at long")
    n = {r["pid"]: (r["n_320s"], r["n_40s"]) for r in counts_at(
        p, h, (320, 40), probe_id="pid", key="c", probe_time="at", time="t", min_rows=min_rows).collect()}
    s = {r["pid"]: r for r in window_summary_at(
        p, h, 320, probe_id="pid", key="c", probe_time="at", time="t", amount="a", label="y").collect()}
    for pid, c, at in probes:
        w = [x for x in hist if x[0] == c and at - 320 <= x[1] <= at]
        assert n[pid] == (len(w), sum(at - 40 <= x[1] for x in w))
        r = s[pid]
        assert (r["n"], r["n_fraud"]) == (len(w), sum(x[3] for x in w))
        if w:
            assert (r["total"], r["max_amount"], r["first_time"]) == (
                sum(x[2] for x in w), max(x[2] for x in w), min(x[1] for x in w))
