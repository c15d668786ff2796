"""Evaluation, shadow comparison and exploratory aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.functions import scalar as S
from riskgraph.operators import evaluate as E
from riskgraph.operators import profile as P
from riskgraph.queries.registry import query, rounded, rsql
from riskgraph.sources.tables import TX_COLUMNS, TX_SQL, V_COLUMNS, transactions

_CURVE = TX_SQL + """,
per AS (SELECT fraud_score AS score, count(*) AS n, cast(sum("isFraud") AS bigint) AS pos
        FROM tx GROUP BY 1),
cum AS (SELECT *, cast(sum(n) OVER (ORDER BY score DESC) AS bigint) AS n_at,
  cast(sum(pos) OVER (ORDER BY score DESC) AS bigint) AS tp,
  cast(sum(pos) OVER () AS bigint) AS n_pos, cast(sum(n - pos) OVER () AS bigint) AS n_neg FROM per),
cv AS (SELECT score, n, pos, n_at, tp, n_at - tp AS fp, n_pos, n_neg, tp / n_at::double AS p,
  tp / n_pos::double AS r FROM cum),
cf AS (SELECT *, 2 * p * r / greatest(p + r, 1e-9) AS f1 FROM cv),
best AS (SELECT * FROM cf ORDER BY f1 DESC, score LIMIT 1),
ar AS (SELECT sum(n) AS n_total, max(n_pos) AS n_positive,
    sum(pos * (n_neg - fp + (n - pos) / 2.0::double)) / (max(n_pos) * max(n_neg)::double) AS auroc,
    sum(pos / n_pos::double * p) AS auprc FROM cf)
"""


@query("pr_roc_curve", f"""WITH {_CURVE} SELECT {rsql({"score": "score", "precision": "p", "recall": "r",
  "fpr": "fp / n_neg::double", "f1": "f1"}, 9)}, n, pos, n_at, tp, fp, n_pos, n_neg FROM cf""")
def pr_roc_curve(spark, sf_dir):
    return rounded(E.curve(transactions(spark, sf_dir), "fraud_score", "isFraud"), 9)


_EVAL_COLS = {
    "fraud_rate": "n_positive / n_total::double", "auroc": "auroc", "auprc": "auprc",
    "best_threshold": "score", "best_f1": "f1", "best_precision": "p", "best_recall": "r",
    "log_loss": "log_loss", "brier": "brier",
}
_LL = """ll AS (SELECT avg(-("isFraud" * ln(s) + (1 - "isFraud") * ln(1 - s))) AS log_loss,
  avg((fraud_score - "isFraud") ** 2) AS brier
  FROM (SELECT *, least(greatest(fraud_score, 1e-7), 1 - 1e-7) AS s FROM tx))"""


@query("evaluation", f"""WITH {_CURVE}, {_LL}
SELECT cast(n_total AS bigint) AS n_total, n_positive, {rsql(_EVAL_COLS, 8)},
  tp, fp, n_pos - tp AS fn, n_neg - fp AS tn FROM ar CROSS JOIN best CROSS JOIN ll""")
def evaluation(spark, sf_dir):
    return rounded(E.evaluate(transactions(spark, sf_dir), "fraud_score", "isFraud"), 8)


@query("model_comparison", f"""WITH {TX_SQL},
sc AS (SELECT 'base' AS model, "ProductCD" AS split, fraud_score AS s, "isFraud" AS y FROM tx
  UNION ALL SELECT 'amount', "ProductCD", least("TransactionAmt" / 600.0, 1), "isFraud" FROM tx),
per AS (SELECT model, split, s, count(*) AS n, sum(y) AS pos FROM sc GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER w AS n_at, sum(pos) OVER w AS tp,
    sum(pos) OVER g AS np, sum(n - pos) OVER g AS nn FROM per
  WINDOW w AS (PARTITION BY model, split ORDER BY s DESC), g AS (PARTITION BY model, split))
SELECT model, split, cast(sum(n) AS bigint) AS n_total, cast(max(np) AS bigint) AS n_positive,
  {rsql({"auroc": "sum(pos * (nn - (n_at - tp) + (n - pos) / 2.0::double)) / (max(np) * max(nn)::double)",
         "auprc": "sum(pos / np::double * (tp / n_at::double))"}, 8)}
FROM cum GROUP BY model, split""")
def model_comparison(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    a = tx.select(F.lit("base").alias("model"), F.col("ProductCD").alias("split"),
                  F.col("fraud_score").alias("s"), F.col("isFraud").alias("y"))
    b = tx.select(F.lit("amount").alias("model"), F.col("ProductCD").alias("split"),
                  F.least(F.col("TransactionAmt") / 600.0, F.lit(1.0)).alias("s"), F.col("isFraud").alias("y"))
    r = E.evaluate(a.unionByName(b), "s", "y", ("model", "split"))
    return rounded(r.select("model", "split", "n_total", "n_positive", "auroc", "auprc"), 8)


@query("top_precision", f"""WITH {TX_SQL},
r AS (SELECT "isFraud" AS y, row_number() OVER (ORDER BY fraud_score DESC, "TransactionID") AS i,
  count(*) OVER () AS n FROM tx),
s AS (SELECT unnest([0.001::double, 0.01::double, 0.05::double, 0.1::double]) AS share),
k AS (SELECT share, cast(greatest(1, ceil((SELECT count(*) FROM tx) * share)) AS bigint) AS k FROM s)
SELECT share, k, {rsql({"precision": "avg(y)"})} FROM k JOIN r ON i <= k GROUP BY share, k""")
def top_precision(spark, sf_dir):
    return rounded(E.top_precision(transactions(spark, sf_dir), "fraud_score", "isFraud"))


@query("calibration", f"""WITH {TX_SQL}, q AS (SELECT [{", ".join(
  f"quantile_cont(fraud_score, {i / 10})" for i in range(1, 10))}] AS e FROM tx)
SELECT cast(len(list_filter(e, lambda v: v < fraud_score)) AS bigint) AS bin, count(*) AS n,
  {rsql({"mean_score": "avg(fraud_score)", "positive_share": 'avg("isFraud")'})}
FROM tx CROSS JOIN q GROUP BY 1""")
def calibration(spark, sf_dir):
    return rounded(E.calibration(transactions(spark, sf_dir), "fraud_score", "isFraud"))


def _records(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    return tx.select(
        F.col("TransactionID").alias("transaction_id"), F.col("fraud_score").alias("score"),
        F.timestamp_seconds("TransactionDT").alias("ts"),
        F.when(F.col("k") < 60, F.col("isFraud")).alias("label"))


_REC = TX_SQL + """,
rec AS (SELECT "TransactionID" AS transaction_id, fraud_score AS score, "TransactionDT" AS t,
  CASE WHEN k < 60 THEN "isFraud" END AS label FROM tx)
"""


def _snap_sql(src):
    return f"""
, per AS (SELECT score, count(*) AS n, sum(label) AS pos FROM {src} WHERE label IS NOT NULL GROUP BY 1),
cum AS (SELECT *, sum(n) OVER w AS n_at, sum(pos) OVER w AS tp, sum(pos) OVER () AS np,
    sum(n - pos) OVER () AS nn FROM per WINDOW w AS (ORDER BY score DESC)),
ar AS (SELECT sum(pos * (nn - (n_at - tp) + (n - pos) / 2.0::double)) / (max(np) * max(nn)::double) AS auroc,
    sum(pos / np::double * (tp / n_at::double)) AS auprc FROM cum),
m AS (SELECT count(*) AS n_total, count(label) AS n_labelled, count(*) FILTER (label = 1) AS n_positive,
    count(*) FILTER (label IS NOT NULL AND score >= 0.5) AS n_predicted_positive,
    count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp,
    count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn,
    avg((score - label) ** 2) AS brier, min(t) AS w0, max(t) AS w1 FROM {src}),
pr AS (SELECT *, tp / greatest(tp + fp, 1)::double AS p, tp / greatest(tp + fn, 1)::double AS r FROM m)
SELECT n_total, n_labelled, n_positive, n_predicted_positive, tp, fp, fn, tn,
  {rsql({"brier": "brier", "precision": "p", "recall": "r", "f1": "2 * p * r / greatest(p + r, 1e-12)",
         "accuracy": "(tp + tn) / n_labelled::double", "auroc": "auroc", "auprc": "auprc"}, 8)},
  w0 AS window_start, w1 AS window_end
FROM pr CROSS JOIN ar"""


def _snap(df):
    return rounded(df.withColumn("window_start", F.unix_timestamp("window_start"))
                   .withColumn("window_end", F.unix_timestamp("window_end")), 8)


@query("performance_snapshot", f"WITH {_REC} {_snap_sql('rec')}")
def performance_snapshot(spark, sf_dir):
    return _snap(E.snapshot(_records(spark, sf_dir)))


@query("performance_window", f"""WITH {_REC}, win AS (
  SELECT * FROM rec WHERE t >= (SELECT max(t) FROM rec) - 604800) {_snap_sql('win')}""")
def performance_window(spark, sf_dir):
    """Quality over the trailing week."""
    rec = _records(spark, sf_dir)
    return _snap(E.snapshot(rec, now=rec.agg(F.max("ts")).first()[0], window_seconds=604800))


@query("label_attach", f"""WITH {_REC},
l AS (SELECT transaction_id, label FROM rec WHERE label IS NOT NULL)
SELECT rec.transaction_id, {rsql({"score": "score"})}, cast(l.label AS bigint) AS label
FROM rec LEFT JOIN l USING (transaction_id)""")
def label_attach(spark, sf_dir):
    """Labels arrive twice (first as 0, later confirmed); the latest one counts."""
    rec = _records(spark, sf_dir)
    lab = rec.filter(F.col("label").isNotNull()).select("transaction_id", "ts", "label")
    feed = lab.select("transaction_id", F.lit(0).alias("label"), F.col("ts").alias("label_ts")).unionByName(
        lab.select("transaction_id", "label", (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("label_ts")))
    out = E.attach_labels(rec.drop("label"), feed)
    return rounded(out.select("transaction_id", "score", "label"))


_SHADOW = TX_SQL + """,
ch AS (SELECT "TransactionID" AS id, fraud_score AS a, "TransactionDT" AS t,
  least("TransactionAmt" / 300.0::double, 1) AS b, cast(k + 5 AS double) AS ms,
  "DeviceType" IS NOT NULL AS has FROM tx),
pp AS (SELECT *, CASE WHEN has THEN b END AS bb, CASE WHEN has THEN ms > 80 ELSE true END AS skipped FROM ch)
"""


def _pairs(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    champ = tx.select(F.col("TransactionID").alias("transaction_id"), F.col("fraud_score").alias("score"),
                      F.timestamp_seconds("TransactionDT").alias("ts"))
    chall = tx.filter(F.col("DeviceType").isNotNull()).select(
        F.col("TransactionID").alias("transaction_id"),
        F.least(F.col("TransactionAmt") / 300.0, F.lit(1.0)).alias("score"),
        (F.col("k") + 5).cast("double").alias("latency_ms"))
    return E.pair_shadow(champ, chall, budget_ms=80.0)


@query("shadow_pairs", f"""WITH {_SHADOW} SELECT id AS transaction_id,
  {rsql({"champion_score": "a", "challenger_score": "bb", "score_delta": "bb - a"})},
  (a >= 0.5) = (bb >= 0.5) AS agreement, skipped FROM pp""")
def shadow_pairs(spark, sf_dir):
    return rounded(_pairs(spark, sf_dir).select(
        "transaction_id", "champion_score", "challenger_score", "score_delta", "agreement", "skipped"))


@query("shadow_summary", f"""WITH {_SHADOW}, ok AS (SELECT *, (a >= 0.5) = (bb >= 0.5) AS agree
  FROM pp WHERE NOT skipped)
SELECT count(*) AS n_total, count(*) FILTER (agree) AS n_agreement, count(*) FILTER (NOT agree) AS n_disagreement,
  {rsql({"agreement_rate": "avg(agree::int)", "mean_score_delta": "avg(abs(bb - a))",
         "max_score_delta": "max(abs(bb - a))"})},
  (SELECT count(*) FROM pp WHERE skipped) AS challenger_skipped,
  min(t) AS window_start, max(t) AS window_end FROM ok""")
def shadow_summary(spark, sf_dir):
    s = E.shadow_summary(_pairs(spark, sf_dir))
    return rounded(s.withColumn("window_start", F.unix_timestamp("window_start"))
                   .withColumn("window_end", F.unix_timestamp("window_end")))


@query("latest_predictions", f"""WITH {TX_SQL} SELECT "TransactionID" AS transaction_id,
  "TransactionDT" AS ts FROM tx ORDER BY "TransactionDT" DESC, "TransactionID" DESC LIMIT 200""")
def latest_predictions(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    return E.keep_latest(tx.select(F.col("TransactionID").alias("transaction_id"),
                                   F.col("TransactionDT").alias("ts")), 200)


# -- exploratory ------------------------------------------------------------------------------

@query("class_summary", f"""WITH {TX_SQL} SELECT cast("isFraud" AS bigint) AS "isFraud", count(*) AS n,
  {rsql({"mean_amt": 'avg("TransactionAmt")', "std_amt": 'stddev_samp("TransactionAmt")',
         "max_amt": 'max("TransactionAmt")', "median_amt": 'quantile_cont("TransactionAmt", 0.5)'})}
FROM tx GROUP BY 1""")
def class_summary(spark, sf_dir):
    return rounded(P.class_summary(transactions(spark, sf_dir)))


@query("daily_volume", f"""WITH {TX_SQL} SELECT "TransactionDT" // 86400 AS day, count(*) AS n,
  {rsql({"fraud_rate": 'avg("isFraud")'}, 9)} FROM tx GROUP BY 1""")
def daily_volume(spark, sf_dir):
    return rounded(P.daily_volume(transactions(spark, sf_dir)), 9)


@query("rate_by_category", f"""WITH {TX_SQL} SELECT 'email' AS field, "P_emaildomain" AS category,
    count(*) AS n, {rsql({"fraud_rate": 'avg("isFraud")'})} FROM tx GROUP BY 2
  UNION ALL SELECT 'product', "ProductCD", count(*), {rsql({"fraud_rate": 'avg("isFraud")'})}
  FROM tx GROUP BY 2""")
def rate_by_category(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    a = P.rate_by(tx, "P_emaildomain").select(F.lit("email").alias("field"), "*")
    b = P.rate_by(tx, "ProductCD").select(F.lit("product").alias("field"), "*")
    return rounded(a.unionByName(b))


@query("top_devices_by_volume", f"""WITH {TX_SQL} SELECT "DeviceInfo" AS category, count(*) AS n,
  {rsql({"fraud_rate": 'avg("isFraud")'}, 9)} FROM tx GROUP BY 1
ORDER BY n DESC, category NULLS FIRST LIMIT 10""")
def top_devices_by_volume(spark, sf_dir):
    return rounded(P.rate_by(transactions(spark, sf_dir), "DeviceInfo", 10), 9)


@query("dataset_profile", f"""WITH {TX_SQL} SELECT count(*) AS n_rows, {len(TX_COLUMNS)}::bigint AS n_columns,
  10::bigint AS n_v, 1::bigint AS n_d, 3::bigint AS n_c, 3::bigint AS n_m,
  {rsql({"fraud_rate": 'avg("isFraud")', "mean_amt": 'avg("TransactionAmt")',
         "median_amt": 'quantile_cont("TransactionAmt", 0.5)', "p99_amt": 'quantile_cont("TransactionAmt", 0.99)',
         "missing_share": "sum(" + " + ".join(f'("{c}" IS NULL)::int' for c in TX_COLUMNS)
                          + f") / (count(*) * {len(TX_COLUMNS)})::double"})} FROM tx""")
def dataset_profile(spark, sf_dir):
    return rounded(P.dataset_profile(transactions(spark, sf_dir)))


_CORR = (*V_COLUMNS, "C1", "C13", "C14", "TransactionAmt", "k")


@query("target_correlation", f"WITH {TX_SQL} SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {rsql({"corr": f'corr("{c}", "isFraud")',
        "abs_corr": f'abs(corr("{c}", "isFraud"))'})} FROM tx""" for c in _CORR)
       + ") ORDER BY abs_corr DESC LIMIT 10")
def target_correlation(spark, sf_dir):
    return rounded(P.target_correlation(transactions(spark, sf_dir), _CORR, 10))


@query("score_histogram", f"""WITH {TX_SQL}, b AS (SELECT unnest(range(20)) AS bin)
SELECT bin, count("TransactionID") AS n FROM b
LEFT JOIN tx ON bin = least(floor(fraud_score * 20), 19) GROUP BY bin""")
def score_histogram(spark, sf_dir):
    return rounded(P.score_histogram(transactions(spark, sf_dir), "fraud_score"))


def _hist_sql(expr, n):
    return f"""h AS (SELECT "isFraud", {expr} AS v FROM tx), r AS (SELECT min(v) AS lo, max(v) AS hi FROM h),
hb AS (SELECT "isFraud", v, lo, hi, floor((v - lo) / ((hi - lo) / {n})) AS i FROM h CROSS JOIN r)
SELECT cast("isFraud" AS bigint) AS "isFraud", cast(least(greatest(i
    + (v >= (i + 1) * ((hi - lo) / {n}) + lo)::int - (v < i * ((hi - lo) / {n}) + lo)::int, 0), {n - 1}) AS bigint) AS bin,
  count(*) AS n FROM hb GROUP BY ALL"""


@query("amount_histogram", f"""WITH {TX_SQL}, {_hist_sql('"TransactionAmt"', 80)}""")
def amount_histogram(spark, sf_dir):
    return rounded(P.histogram(transactions(spark, sf_dir), F.col("TransactionAmt"), 80, "isFraud"))


@query("log_amount_histogram", f"""WITH {TX_SQL}, {_hist_sql('ln(1 + "TransactionAmt")', 80)}""")
def log_amount_histogram(spark, sf_dir):
    return rounded(P.histogram(transactions(spark, sf_dir), F.log(1 + F.col("TransactionAmt")), 80, "isFraud"))


@query("latency_summary", f"""WITH {TX_SQL} SELECT {rsql({
  "mean": 'avg("TransactionAmt")', "max": 'max("TransactionAmt")', "p50": 'quantile_cont("TransactionAmt", 0.5)',
  "p95": 'quantile_cont("TransactionAmt", 0.95)', "p99": 'quantile_cont("TransactionAmt", 0.99)'})} FROM tx""")
def latency_summary(spark, sf_dir):
    """The amount stands in for a latency."""
    return rounded(P.latency_summary(transactions(spark, sf_dir), "TransactionAmt"))


@query("latency_nearest_rank", f"""WITH {TX_SQL},
r AS (SELECT "TransactionAmt" AS v, row_number() OVER (ORDER BY "TransactionAmt", "TransactionID") - 1 AS i,
  count(*) OVER () AS n FROM tx), p AS (SELECT unnest([0.5::double, 0.95::double, 0.99::double]) AS p)
SELECT p, {rsql({"value": "v"})} FROM p JOIN r ON i = floor(p * n)""")
def latency_nearest_rank(spark, sf_dir):
    return rounded(P.nearest_rank(transactions(spark, sf_dir), "TransactionAmt", "TransactionID"))


@query("predicted_rate", f"""WITH {TX_SQL} SELECT count(*) AS n,
  {rsql({"predicted_rate": "avg((fraud_score >= 0.5)::int)"})} FROM tx""")
def predicted_rate(spark, sf_dir):
    return rounded(P.predicted_rate(transactions(spark, sf_dir), "fraud_score"))


_RISK = """CASE WHEN fraud_score >= 0.9 THEN 'CRITICAL' WHEN fraud_score >= 0.7 THEN 'HIGH'
  WHEN fraud_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"""


@query("risk_counts", f"WITH {TX_SQL} SELECT {_RISK} AS risk_level, count(*) AS n FROM tx GROUP BY 1")
def risk_counts(spark, sf_dir):
    return rounded(P.risk_counts(transactions(spark, sf_dir), "fraud_score"))


@query("highest_scored", f"""WITH {TX_SQL} SELECT "TransactionID", card1, {rsql({"fraud_score": "fraud_score"})}
FROM tx ORDER BY tx.fraud_score DESC, "TransactionID" LIMIT 1""")
def highest_scored(spark, sf_dir):
    tx = transactions(spark, sf_dir).select("TransactionID", "card1", "fraud_score")
    return rounded(P.highest_scored(tx, "fraud_score", "TransactionID"))


@query("risk_decisions", f"""WITH {TX_SQL}, r AS (SELECT *, {_RISK} AS lv FROM tx)
SELECT "TransactionID", lv AS risk_level, CASE WHEN lv = 'LOW' THEN 'MEDIUM' ELSE lv END AS alert_level,
  CASE WHEN lv = 'CRITICAL' THEN 'decline' WHEN lv = 'HIGH' THEN 'escalate'
       WHEN lv = 'MEDIUM' THEN 'review' ELSE 'approve' END AS action,
  CASE lv WHEN 'CRITICAL' THEN 'deep' WHEN 'HIGH' THEN 'standard' ELSE 'quick' END AS depth,
  lv IN ('HIGH', 'CRITICAL') AS human_review FROM r""")
def risk_decisions(spark, sf_dir):
    s = F.col("fraud_score")
    lv = S.risk_level(s)
    return transactions(spark, sf_dir).select(
        "TransactionID", lv.alias("risk_level"), S.alert_level(s).alias("alert_level"),
        S.valid_action(S.recommended_action(lv, s)).alias("action"),
        S.investigation_depth(lv).alias("depth"), S.needs_human_review(lv).alias("human_review"))
