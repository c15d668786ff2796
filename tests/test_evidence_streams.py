"""Evidence per alert and the streaming operators."""

import json

import pytest
from pyspark.sql import functions as F

from riskgraph.operators import evidence as V
from riskgraph.operators.temporal import card_causal
from riskgraph.plans.lineage import new_path
from riskgraph.streaming import alerts as A
from riskgraph.streaming import stateful as ST

HIST = "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, isFraud int"
ALERT = "alert_id string, TransactionID long, TransactionDT long, card1 long, fraud_score double, risk_level string"


def test_card_history_fixture(spark):
    h = spark.createDataFrame([(i, 100000 + 600 * i, 12.5 * (i + 1), 99, int(i in (7, 8))) for i in range(10)], HIST)
    a = spark.createDataFrame([("x", 1, 200000, 99, .9, "CRITICAL"), ("y", 2, 200000, 5, .1, "LOW")], ALERT)
    got = {r["alert_id"]: r for r in V.card_history(a, h).collect()}
    r = got["x"]
    assert (r["n_transactions"], r["fraud_count"], r["fraud_rate"], r["max_amount"]) == (10, 2, 0.2, 125.0)
    assert r["velocity_per_hour"] == pytest.approx(10 / (100000 / 3600))
    assert got["y"]["status"] == "skipped" and got["y"]["n_transactions"] == 0


EV = ("alert_id string, TransactionID long, card1 long, risk_level string, fraud_score double, status string, n_transactions long, "
      "total_spend double, avg_amount double, max_amount double, fraud_rate double, velocity_per_hour double, velocity_1h double, "
      "baseline_per_hour double, n_unique_neighbors long, P_emaildomain string")


def evidence(spark, **kw):
    base = dict(alert_id="a", TransactionID=1, card1=9, risk_level="LOW", fraud_score=.05, status="ok", n_transactions=0,
                total_spend=.0, avg_amount=.0, max_amount=.0, fraud_rate=.0, velocity_per_hour=.0, velocity_1h=.0,
                baseline_per_hour=.0, n_unique_neighbors=0, P_emaildomain="gmail.com")
    return spark.createDataFrame([tuple({**base, **kw}.values())], EV)


@pytest.mark.parametrize("kw,names", [
    ({}, ["none"]), ({"velocity_per_hour": 5.0}, ["velocity_spike"]), ({"velocity_1h": 3.0, "baseline_per_hour": 1.0}, ["velocity_spike"]),
    ({"n_transactions": 10, "avg_amount": 5.0}, ["card_testing"]), ({"n_unique_neighbors": 4}, ["collusion_ring"]),
    ({"avg_amount": 10.0, "max_amount": 40.0}, ["account_takeover"]), ({"fraud_score": .7}, ["velocity_spike"]),
    ({"velocity_per_hour": 9.0, "n_unique_neighbors": 5}, ["velocity_spike", "collusion_ring"]),
])
def test_patterns(spark, kw, names):
    r = V.match_patterns(evidence(spark, **kw)).first()
    assert [p["name"] for p in r["matched_patterns"]] == names


def test_entity_risks_order_and_clip(spark):
    r = V.entity_risks(evidence(spark, fraud_score=.95, fraud_rate=.5, velocity_per_hour=9.0, n_unique_neighbors=9,
                                P_emaildomain="mailinator.com")).first()["entity_risks"]
    assert [e["entity_type"] for e in r] == ["card", "device", "email", "ip", "merchant"]
    assert r[0]["risk_score"] == 1.0 and len(r[0]["contributing_factors"]) == 3
    assert r[2]["risk_score"] == pytest.approx(.875)
    assert V.entity_risks(evidence(spark)).first()["entity_risks"][0]["contributing_factors"] == ["nothing stands out"]


def test_report_and_missing_evidence(spark):
    full = V.reports(V.match_patterns(evidence(spark, risk_level="CRITICAL", fraud_score=.93))).first()
    assert full["recommended_action"] == "decline" and full["requires_human_review"] and len(full["tools_used"]) == 8
    bare = V.reports(evidence(spark).select("alert_id", "TransactionID", "risk_level", "fraud_score")).first()
    assert bare["summary"] == bare["narrative"] == "Transaction 1: LOW, score 0.05."


def test_case_upsert_keeps_status_and_opening_time(spark):
    old = spark.createDataFrame([("a", 1, "closed", "s0", 5)], "alert_id string, TransactionID long, status string, summary string, opened_at long")
    rep = spark.createDataFrame([("a", 1, "s1", "approve", 9), ("b", 2, "s2", "escalate", 9)],
                                "alert_id string, TransactionID long, summary string, recommended_action string, reported_at long")
    got = {r["alert_id"]: tuple(r)[2:] for r in V.upsert_cases(old, rep).collect()}
    assert got == {"a": ("closed", "s1", 5), "b": ("escalated", "s2", 9)}


GOOD = {"transaction_id": "1", "fraud_score": .8, "risk_level": "HIGH", "transaction_amt": 1.0, "card_id": "9",
        "timestamp": "2024-01-01T00:00:00Z", "top_features": [{"feature": "f", "value": 1.0, "contribution": .5}]}


def test_decode_rejects_bad_json_and_wrong_schema(spark):
    bad = ["{not json", "", json.dumps({"x": 1}), json.dumps({**GOOD, "fraud_score": "abc"}),
           json.dumps({**GOOD, "fraud_score": 1.5}), json.dumps({**GOOD, "risk_level": "ODD"})]
    df = spark.createDataFrame([(json.dumps(GOOD),), *[(b,) for b in bad]], "value string")
    good, rejected = A.split_valid(A.decode(df))
    r = good.first()
    assert good.count() == 1 and rejected.count() == len(bad) and r["top_features"][0]["contribution"] == .5


def test_stateful_features_equal_batch_over_several_batches(spark):
    rows = [(i, 700 * i + (i % 3), float((i * 37) % 11), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, TransactionAmt double, card1 long")
    src, out, chk = (new_path(spark, t) for t in ("src", "out", "chk"))
    for lo in (0, 20, 40):
        df.filter(F.col("TransactionID").between(lo, lo + 19)).coalesce(1).write.mode("append").parquet(src)
    s = A.file_source(spark, src, df.schema, files_per_trigger=1)
    A.run_to_end(ST.card_features(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", chk))
    got = {r["TransactionID"]: r for r in spark.read.parquet(out).collect()}
    assert len(got) == 60
    for b in card_causal(df).collect():
        g = got[b["TransactionID"]]
        for c in ("gap", "n_3600s", "n_86400s", "gap_mean", "gap_std", "cum_amount", "acceleration", "jerk"):
            assert g[c] == pytest.approx(b[c], abs=1e-6), c


def test_cache_expires(spark):
    u = spark.createDataFrame([("a", 10, 1.0), ("a", 50, 2.0), ("b", 5, 3.0)], "key string, ts long, value double")
    warm = spark.createDataFrame([("c", 60, 9.0)], "key string, ts long, value double")
    got = {r["key"]: r["value"] for r in ST.cache_snapshot(u, 100, 60, warm=warm).collect()}
    assert got == {"a": 2.0, "c": 9.0}


def _play(spark, tmp_path, batches):
    """Rows (id, time, amount, card) of several micro-batches through the keyed state."""
    schema = "TransactionID long, TransactionDT long, TransactionAmt double, card1 long"
    src, out, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        s = A.file_source(spark, src, spark.createDataFrame([], schema).schema)
        A.run_to_end(ST.card_features(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", chk))
    return {r["TransactionID"]: r for r in spark.read.parquet(out).collect()}


def test_state_takes_nulls_and_sets_late_rows_apart(spark, tmp_path):
    got = _play(spark, tmp_path, [
        [(1, 100000, 10.0, 7), (2, 200000, 5.0, 7), (3, 5, None, None)],
        [(4, 150000, None, 7), (5, 200010, 1.0, 7), (6, 9, 2.0, None)]])
    assert got[4]["late"] and got[4]["gap"] is None
    assert (got[5]["late"], got[5]["gap"], got[5]["n_3600s"], got[5]["cum_amount"]) == (False, 10, 2, 16.0)
    assert (got[6]["card1"], got[6]["gap"], got[6]["cum_amount"]) == (None, 4, 2.0)


def test_shadow_pairs(spark):
    df = spark.createDataFrame([(1, 0.9, 0.2), (2, 0.1, 0.4)], "transaction_id long, a double, b double")
    got = A.shadow_pairs(df, df["a"], df["b"]).orderBy("transaction_id").collect()
    assert [(r["agreement"], r["skipped"]) for r in got] == [(False, False), (True, False)]


def test_similar_cases_by_depth(spark):
    al = spark.createDataFrame([("a", 1, "CRITICAL"), ("b", 1, "HIGH"), ("c", 2, "HIGH"), ("d", None, "HIGH")],
                               "alert_id string, card1 long, risk_level string")
    m = spark.createDataFrame([(1, 10 + i, i, 0.9) for i in range(1, 8)], "query_id long, case_id long, rank long, similarity double")
    got = {r["alert_id"]: [c["case_id"] for c in r["similar_cases"]] for r in V.attach_similar_cases(al, m).collect()}
    assert got == {"a": [11, 12, 13, 14, 15], "b": [11, 12, 13], "c": [], "d": []}
