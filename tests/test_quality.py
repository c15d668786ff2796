"""Evaluation, drift and rules: exact small cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riskgraph.operators import drift as D
from riskgraph.operators import evaluate as E
from riskgraph.operators import rules as R
from riskgraph.operators import profile as P


def scored(spark, scores, labels):
    return spark.createDataFrame(list(zip(range(len(scores)), scores, labels)), "TransactionID long, s double, y int")


def test_snapshot_counts(spark):
    df = scored(spark, [.9, .8, .7, .3, .2, .1], [1, 1, 0, 1, 0, 0]).withColumn("ts", F.timestamp_seconds("TransactionID"))
    r = E.snapshot(df, score="s", label="y").first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (2, 1, 1, 2)
    assert r["precision"] == r["recall"] == pytest.approx(2 / 3) and r["f1"] == pytest.approx(2 / 3)


def test_no_labels_gives_zero_row(spark):
    df = scored(spark, [.9, .1], [None, None]).withColumn("ts", F.timestamp_seconds("TransactionID"))
    r = E.snapshot(df, score="s", label="y").first()
    assert r["n_total"] == 2 and r["n_labelled"] == 0 and r["auroc"] is None


@pytest.mark.parametrize("min_rows", [10**6, 10])
def test_areas_with_ties(spark, min_rows):
    rnd = random.Random(1)
    s = [round(rnd.random(), 1) for _ in range(80)]
    y = [int(rnd.random() < a) for a in s]
    pos, neg = [a for a, b in zip(s, y) if b], [a for a, b in zip(s, y) if not b]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    ap = 0.0
    for t in sorted(set(s), reverse=True):
        at = [b for a, b in zip(s, y) if a >= t]
        ap += sum(b for a, b in zip(s, y) if a == t) / len(pos) * sum(at) / len(at)
    r = E.areas(E.curve(scored(spark, s, y), "s", "y", min_rows=min_rows)).first()
    assert r["auroc"] == pytest.approx(auc) and r["auprc"] == pytest.approx(ap)


def test_perfect_and_single_class(spark):
    r = E.areas(E.curve(scored(spark, [.1, .2, .3, .7, .8, .9], [0, 0, 0, 1, 1, 1]), "s", "y")).first()
    assert (r["auroc"], r["auprc"], r["best_f1"], r["best_threshold"]) == (1.0, 1.0, 1.0, .7)
    one = E.areas(E.curve(scored(spark, [.1, .2], [0, 0]), "s", "y")).first()
    assert one["auroc"] is None and one["auprc"] is None


def test_top_precision_breaks_ties_by_id(spark):
    df = scored(spark, [.5] * 20, [1] * 2 + [0] * 18)
    got = {r["share"]: (r["k"], r["precision"]) for r in E.top_precision(df, "s", "y").collect()}
    assert got[0.1] == (2, 1.0) and got[0.001] == (1, 1.0)


def test_evaluate_rejects_empty(spark):
    with pytest.raises(ValueError):
        E.evaluate(scored(spark, [], []) if False else spark.createDataFrame([], "TransactionID long, s double, y int"), "s", "y")


def samples(spark, shift=0.0, n=600, product="WWWWWWWCCH"):
    rnd = random.Random(2)
    return spark.createDataFrame([(rnd.gauss(50 + shift, 20), rnd.choice(product), str(rnd.randrange(9))) for _ in range(n)],
                                 "amount double, product string, text_number string")


def test_drift_report(spark):
    ref = samples(spark)
    same = {r["feature"]: r for r in D.drift_report(ref, ref).collect()}
    assert {f: r["kind"] for f, r in same.items()} == {"amount": "numeric", "product": "categorical", "text_number": "numeric"}
    assert all(r["psi"] == pytest.approx(0, abs=1e-12) and r["severity"] == "none" for r in same.values())
    assert same["amount"]["ks"] == 0 and same["amount"]["js"] == pytest.approx(0, abs=1e-9) and same["amount"]["ks_pvalue"] == 1
    moved = {r["feature"]: r for r in D.drift_report(ref, samples(spark, 500, product="W")).collect()}
    assert moved["amount"]["severity"] == "severe" and moved["amount"]["ks"] == 1.0
    assert moved["product"]["severity"] == "severe" and moved["product"]["chi2_pvalue"] < 1e-6
    none = {r["feature"]: r for r in D.drift_report(ref, ref.filter("amount > 1e9")).collect()}
    assert none["amount"]["notes"] == "no current values" and none["amount"]["psi"] == 0
    with pytest.raises(ValueError):
        D.drift_report(ref, ref.select(F.col("amount").alias("other")))


def test_js_of_disjoint_samples_is_log_two(spark):
    a = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    b = spark.createDataFrame([(float(i),) for i in range(100, 110)], "v double")
    assert D.js_divergence(a, b, ["v"]).first()["js"] == pytest.approx(math.log(2), abs=1e-6)


def test_chi2_tail(spark):
    rows = [(3.841459, 1, 0.05), (18.307038, 10, 0.05), (0.0, 3, 1.0), (2.0, 2, math.exp(-1)), (60.0, 4, 2.901e-12)]
    df = spark.createDataFrame(rows, "x double, k long, p double").withColumn("got", D.chi2_tail("x", "k"))
    for r in df.collect():
        assert r["got"] == pytest.approx(r["p"], rel=1e-3)


def test_label_drift(spark):
    df = spark.createDataFrame([(int(i < 200),) for i in range(1000)], "y int")
    r = D.label_drift(df, "y").first()
    assert r["absolute_drift"] == pytest.approx(0.165) and r["n"] == 1000


CTX = ("model_loaded boolean, drift_overall double, drift_severe int, auprc double, recall double, n_labelled long, "
       "production_fraud_rate double, latency_p95 double, error_rate double, shadow_agreement double")


@pytest.mark.parametrize("change,rule", [
    ({}, None), ({"model_loaded": False}, "ModelNotLoaded"), ({"drift_overall": .25}, "DataDriftSevere"),
    ({"drift_severe": 11}, "DataDrift"), ({"auprc": .59}, "ModelDegradation"), ({"recall": .54}, "ModelPerformanceDegraded"),
    ({"production_fraud_rate": .11}, "FraudRateSpike"), ({"latency_p95": .06}, "HighLatency"),
    ({"error_rate": .06}, "HighErrorRate"), ({"shadow_agreement": .89}, "ShadowChallengerDisagreement"),
    ({"recall": None, "auprc": None, "shadow_agreement": None, "drift_overall": None, "model_loaded": None}, None),
])
def test_each_rule_alone(spark, change, rule):
    ok = dict(model_loaded=True, drift_overall=.0, drift_severe=0, auprc=.9, recall=.9, n_labelled=100,
              production_fraud_rate=.03, latency_p95=.01, error_rate=.0, shadow_agreement=.99)
    ctx = spark.createDataFrame([tuple({**ok, **change}.values())], CTX)
    assert [r["name"] for r in R.evaluate_rules(ctx, R.default_rules()).collect()] == ([rule] if rule else [])


def test_broken_rule_warns(spark):
    got = R.evaluate_rules(spark.range(1), [R.Rule("x", "critical", "d", "nope > 1")]).collect()
    assert [(r["name"], r["severity"]) for r in got] == [("x", "warning")]


def test_hold_time(spark):
    on = [0, 1, 1, 1, 0, 1, 1, 0]
    h = spark.createDataFrame([(i * 60, float(v)) for i, v in enumerate(on)], "ts long, error_rate double")
    got = R.evaluate_hold_rules(h, [R.HoldRule("r", "critical", "error_rate > 0.5", 120)]).collect()
    assert [(r["ts"], r["since"]) for r in got] == [(180, 60)]


def test_score_histogram_clamps_the_last_bin(spark):
    h = {r["bin"]: r["n"] for r in P.score_histogram(scored(spark, [0.0, .999, 1.0], [0, 0, 0]), "s").collect()}
    assert h[0] == 1 and h[19] == 2 and sum(h.values()) == 3


def test_nearest_rank_of_few_rows(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, v double")
    got = {r["p"]: r["value"] for r in P.nearest_rank(df, "v", "id").collect()}
    assert got == {0.5: 5.0, 0.95: 9.0, 0.99: 9.0}


def test_unreadable_hold_rule_warns(spark):
    h = spark.createDataFrame([(1, 0.1), (2, 0.2)], "ts long, error_rate double")
    got = R.evaluate_hold_rules(h, [R.HoldRule("typo", "critical", "eror_rate > 0.5", 60)]).collect()
    assert [(r["rule"], r["severity"]) for r in got] == [("typo", "warning")] * 2


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "series string, ts long, v double")
    assert R.absent_windows(none, spark.createDataFrame([("a",)], "series string"), 60).count() == 0
    assert P.histogram(none, none["v"], 5, "series").count() == 0
