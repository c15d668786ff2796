"""Evidence per alert, as-of lookups, cases and alert rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.functions import scalar as S
from riskgraph.functions.quantiles import quantiles
from riskgraph.operators import evidence as V
from riskgraph.operators import rules as R
from riskgraph.operators.graph import knn as K
from riskgraph.operators.graph.hubs import hub_index, neighbour_counts
from riskgraph.plans.asof import asof_join
from riskgraph.plans.dyadic import range_summary
from riskgraph.plans.lineage import cut
from riskgraph.queries.registry import query, rounded, rsql
from riskgraph.schema import DISPOSABLE_MARKERS
from riskgraph.sources.tables import TX_SQL, table, transactions

AT = 0.45  # lower than the default threshold, for more alerts on the test data

ALERT_SQL = TX_SQL + f""",
lvl AS (SELECT *, CASE WHEN fraud_score >= 0.9 THEN 'CRITICAL' WHEN fraud_score >= 0.7 THEN 'HIGH'
  ELSE 'MEDIUM' END AS risk_level FROM tx),
al AS (SELECT 'alert-' || "TransactionID" AS alert_id, * FROM lvl WHERE fraud_score >= {AT})
"""


def alerts(spark, sf_dir, at=AT):
    return V.alerts_from(transactions(spark, sf_dir), threshold=at)


@query("alert_filter", f"""WITH {TX_SQL} SELECT 'alert-' || "TransactionID" AS alert_id, "TransactionID",
  {rsql({"fraud_score": "fraud_score", "TransactionAmt": '"TransactionAmt"'})},
  CASE WHEN fraud_score >= 0.9 THEN 'CRITICAL' ELSE 'HIGH' END AS risk_level, card1, "TransactionDT"
FROM tx WHERE fraud_score >= 0.7""")
def alert_filter(spark, sf_dir):
    return rounded(alerts(spark, sf_dir, 0.7))


def _contributions():
    parts = {"TransactionAmt": F.col("TransactionAmt") / 100.0, "C1": F.col("C1") / 10.0 - 0.5,
             "C13": F.col("C13") / 13.0 - 0.5, "V307": F.col("V307") / 101.0 - 0.5,
             "V308": F.col("V308") / 101.0 - 0.5, "k": F.col("k") / 100.0 - 0.5}
    return F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"),
                              e.alias("contribution")) for n, e in parts.items()])


_CONTRIB = """(VALUES ('TransactionAmt', "TransactionAmt" / 100.0::double), ('C1', "C1" / 10.0::double - 0.5),
  ('C13', "C13" / 13.0::double - 0.5), ('V307', "V307" / 101.0::double - 0.5),
  ('V308', "V308" / 101.0::double - 0.5), ('k', k / 100.0::double - 0.5)) t(feature, contribution)"""


@query("top_contributions", f"""WITH {TX_SQL}, c AS (SELECT "TransactionID", feature, contribution,
  row_number() OVER (PARTITION BY "TransactionID" ORDER BY abs(contribution) DESC, feature) AS rk
  FROM tx, LATERAL (SELECT * FROM {_CONTRIB}) q)
SELECT "TransactionID", rk, feature, {rsql({"contribution": "contribution"})} FROM c WHERE rk <= 3""")
def top_contributions(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    top = tx.select("TransactionID", V.top_contributions(_contributions(), 3).alias("t"))
    x = top.select("TransactionID", F.posexplode("t").alias("p", "c"))
    return rounded(x.select("TransactionID", (F.col("p") + 1).alias("rk"), "c.feature", "c.contribution"))


@query("transaction_details", f"""WITH {ALERT_SQL}, c AS (SELECT alert_id, feature,
    row_number() OVER (PARTITION BY alert_id ORDER BY abs(contribution) DESC, feature) AS rk
  FROM al, LATERAL (SELECT * FROM {_CONTRIB}) q),
f AS (SELECT alert_id, string_agg(feature, ',' ORDER BY rk) AS features FROM c WHERE rk <= 5 GROUP BY 1)
SELECT alert_id, "TransactionID", {rsql({"fraud_score": "fraud_score"})}, risk_level, "ProductCD", "DeviceType",
  "P_emaildomain", 'v1' AS model_version, fraud_score >= 0.5 AS is_fraud_predicted, features
FROM al JOIN f USING (alert_id)""")
def transaction_details(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    pred = tx.select("TransactionID", F.lit("v1").alias("model_version"),
                     (F.col("fraud_score") >= 0.5).alias("is_fraud_predicted"),
                     V.top_contributions(_contributions(), 6).alias("top_features"))
    d = V.transaction_details(alerts(spark, sf_dir), tx, pred)
    return rounded(d.select(
        "alert_id", "TransactionID", "fraud_score", "risk_level", "ProductCD", "DeviceType", "P_emaildomain",
        "model_version", "is_fraud_predicted",
        F.concat_ws(",", F.transform("top_features", lambda c: c["feature"])).alias("features")))


HIST_SQL = ALERT_SQL + """,
hj AS (SELECT a.alert_id, a."TransactionDT" AS t, h."TransactionDT" AS ht, h."TransactionAmt" AS amt, h."isFraud" AS y
  FROM al a JOIN tx h ON a.card1 = h.card1 AND h."TransactionDT" BETWEEN a."TransactionDT" - 2592000 AND a."TransactionDT"),
hs AS (SELECT alert_id, count(*) AS n, sum(amt) AS total, max(amt) AS mx, sum(y) AS nf,
  count(*) / greatest(greatest(max(t) - min(ht), 1) / 3600.0::double, 1) AS vel FROM hj GROUP BY 1),
vs AS (SELECT alert_id, count(*) FILTER (ht >= t - 3600) AS n1, count(*) FILTER (ht >= t - 21600) AS n6,
  count(*) FILTER (ht >= t - 86400) AS n24, count(*) AS n30 FROM hj GROUP BY 1)
"""


@query("card_history_evidence", f"""WITH {HIST_SQL} SELECT alert_id, 'ok' AS status, n AS n_transactions,
  cast(nf AS bigint) AS fraud_count, {rsql({"total_spend": "total", "avg_amount": "total / n", "max_amount": "mx",
  "fraud_rate": "nf / n::double", "velocity_per_hour": "vel"}, 8)} FROM hs""")
def card_history_evidence(spark, sf_dir):
    return rounded(V.card_history(alerts(spark, sf_dir), transactions(spark, sf_dir)), 8)


@query("card_week_before", f"""WITH {TX_SQL}, w AS (SELECT a."TransactionID" AS id, h.* FROM tx a JOIN tx h ON a.card1 = h.card1
    AND h."TransactionDT" BETWEEN a."TransactionDT" - 604800 AND a."TransactionDT" - 1),
g AS (SELECT id, count(*) AS n, sum("TransactionAmt") AS total, max("TransactionAmt") AS mx, min("TransactionAmt") AS mn,
  sum("isFraud") AS nf, min("TransactionDT") AS first_time FROM w GROUP BY 1)
SELECT "TransactionID", coalesce(n, 0) AS n, coalesce(cast(nf AS bigint), 0) AS n_fraud, cast(first_time AS bigint) AS first_time,
  {rsql({"total": "total", "max_amount": "mx", "min_amount": "mn"}, 6)} FROM tx LEFT JOIN g ON id = "TransactionID"
WHERE card1 IS NOT NULL""")
def card_week_before(spark, sf_dir):
    """Every transaction with its card's rows of the seven days before it, its own second left out."""
    tx = transactions(spark, sf_dir).select("TransactionID", "card1", "TransactionDT", "TransactionAmt", "isFraud")
    at = F.col("TransactionDT")
    return rounded(range_summary(tx, tx, probe_id="TransactionID", key="card1", lo=at - 604800, hi=at - 1, time="TransactionDT",
                                 amount="TransactionAmt", label="isFraud", span=604800))


@query("velocity_evidence", f"""WITH {HIST_SQL} SELECT alert_id, {rsql({"velocity_1h": "n1", "velocity_6h": "n6 / 6.0",
  "velocity_24h": "n24 / 24.0", "baseline_per_hour": "n30 / 720.0"}, 8)} FROM vs""")
def velocity_evidence(spark, sf_dir):
    return rounded(V.velocity(alerts(spark, sf_dir), transactions(spark, sf_dir)), 8)


_NB_SQL = HIST_SQL + """,
dev AS (SELECT DISTINCT card1, "DeviceInfo" AS d FROM tx WHERE "DeviceInfo" IS NOT NULL),
d1 AS (SELECT DISTINCT a.card1 AS s, b.card1 FROM dev a JOIN dev b ON a.d = b.d),
d2 AS (SELECT DISTINCT s, d FROM d1 JOIN dev USING (card1)),
nb AS (SELECT s AS card1, count(DISTINCT dev.card1) AS nn FROM d2 JOIN dev USING (d) WHERE dev.card1 <> s GROUP BY 1),
ev AS (SELECT al.alert_id, al."TransactionID", al.card1, fraud_score AS s, risk_level, "DeviceType", "P_emaildomain",
    id_02, "ProductCD", n, total, total / n AS av, mx, nf / n::double AS fr, vel, n1 AS v1, n30 / 720.0::double AS bl,
    coalesce(nn, 0) AS nn
  FROM al JOIN hs USING (alert_id) JOIN vs USING (alert_id) LEFT JOIN nb ON al.card1 = nb.card1)
"""


def evidence_frame(spark, sf_dir):
    """History, velocity, and cards within two hops by shared devices, of every alert."""
    # History, velocity, peers and details all read these columns, so they are written once.
    tx = cut(transactions(spark, sf_dir).select(
        "TransactionID", "TransactionDT", "TransactionAmt", "card1", "isFraud", "fraud_score", "addr1", "addr2",
        "DeviceType", "DeviceInfo", "P_emaildomain", "id_02", "ProductCD"), "evidence")
    al = cut(V.alerts_from(tx, threshold=AT, keep=("DeviceType", "P_emaildomain", "id_02", "ProductCD")), "alerts")
    index = hub_index(tx.select(F.col("DeviceInfo").alias("key"), F.col("card1").alias("member")))
    peers = neighbour_counts(al.select(F.col("card1").alias("member")), index)
    # The files of the alerts pack well: by their size Spark would broadcast what has a row per alert.
    history, speed = V.card_history(al, tx).hint("merge"), V.velocity(al, tx).hint("merge")
    return (
        al.join(history, "alert_id", "left").join(speed, "alert_id", "left")
        .join(peers, al["card1"] == peers["member"], "left").drop("member"))


_PATTERN_SQL = """p AS (
  SELECT alert_id, 'velocity_spike' AS name, least(0.95, greatest(0.5, vel / 20 + s / 2)) AS confidence FROM ev
    WHERE vel >= 5 OR (v1 >= 3 AND bl > 0 AND v1 >= 3 * bl)
  UNION ALL SELECT alert_id, 'card_testing', least(0.95, 0.5 + n / 100.0) FROM ev WHERE n >= 10 AND av > 0 AND av <= 5
  UNION ALL SELECT alert_id, 'collusion_ring', least(0.95, 0.5 + nn / 20.0) FROM ev WHERE nn >= 4
  UNION ALL SELECT alert_id, 'account_takeover', 0.6 FROM ev WHERE av > 0 AND mx >= 4 * av),
pf AS (SELECT * FROM p UNION ALL SELECT alert_id, CASE WHEN s >= 0.7 THEN 'velocity_spike' ELSE 'none' END,
  CASE WHEN s >= 0.7 THEN s ELSE 1 - s END FROM ev WHERE alert_id NOT IN (SELECT alert_id FROM p))"""


@query("fraud_patterns", f"""WITH {_NB_SQL}, {_PATTERN_SQL}
SELECT alert_id, name, {rsql({"confidence": "confidence"})} FROM pf""")
def fraud_patterns(spark, sf_dir):
    m = V.match_patterns(evidence_frame(spark, sf_dir))
    return rounded(m.select("alert_id", F.explode("matched_patterns").alias("p"))
                   .select("alert_id", "p.name", "p.confidence"))


_DISP = "|".join(DISPOSABLE_MARKERS)


@query("entity_risks", f"""WITH {_NB_SQL}, r AS (
  SELECT alert_id, 'card' AS entity_type, cast(card1 AS varchar) AS entity_id,
    s + CASE WHEN fr > 0 THEN 0.3 * least(1, fr * 5) ELSE 0 END + CASE WHEN vel >= 5 THEN 0.2 ELSE 0 END
      + CASE WHEN nn >= 4 THEN 0.2 ELSE 0 END AS x,
    greatest(1, (fr > 0)::int + (vel >= 5)::int + (nn >= 4)::int) AS nf FROM ev
  UNION ALL SELECT alert_id, 'device', coalesce("DeviceType", 'unknown'),
    s * 0.7 + CASE WHEN nn >= 4 THEN 0.25 ELSE 0 END, 1 + (nn >= 4)::int FROM ev
  UNION ALL SELECT alert_id, 'email', coalesce("P_emaildomain", 'unknown'),
    s * 0.5 + CASE WHEN coalesce(regexp_matches("P_emaildomain", '{_DISP}'), false) THEN 0.4 ELSE 0 END,
    1 + coalesce(regexp_matches("P_emaildomain", '{_DISP}'), false)::int FROM ev
  UNION ALL SELECT alert_id, 'ip', coalesce(cast(id_02 AS varchar), 'unknown'),
    s * 0.6 + CASE WHEN fr > 0 THEN 0.2 ELSE 0 END, 2 FROM ev
  UNION ALL SELECT alert_id, 'merchant', "ProductCD", s * 0.4, 1 FROM ev)
SELECT alert_id, entity_type, entity_id, {rsql({"risk_score": "least(1, greatest(0, x))"})},
  cast(nf AS bigint) AS n_factors FROM r""")
def entity_risks(spark, sf_dir):
    m = V.entity_risks(evidence_frame(spark, sf_dir))
    return rounded(m.select("alert_id", F.explode("entity_risks").alias("e")).select(
        "alert_id", "e.entity_type", "e.entity_id", "e.risk_score",
        F.size("e.contributing_factors").alias("n_factors")))


@query("investigation_reports", f"""WITH {ALERT_SQL} SELECT alert_id, "TransactionID", risk_level,
  CASE risk_level WHEN 'CRITICAL' THEN 'deep' WHEN 'HIGH' THEN 'standard' ELSE 'quick' END AS depth,
  'Transaction ' || "TransactionID" || ': ' || risk_level || ', score ' || printf('%.2f', fraud_score) || '.' AS summary,
  CASE WHEN risk_level = 'CRITICAL' THEN 'decline' WHEN risk_level = 'HIGH' THEN 'escalate' ELSE 'review' END
    AS recommended_action, risk_level <> 'MEDIUM' AS requires_human_review,
  CASE risk_level WHEN 'CRITICAL' THEN 8 WHEN 'HIGH' THEN 6 ELSE 2 END::bigint AS n_tools FROM al""")
def investigation_reports(spark, sf_dir):
    """Reports with narrative, patterns and entity risks built; the plain columns are compared."""
    e = V.entity_risks(V.match_patterns(evidence_frame(spark, sf_dir)))
    r = V.reports(e)
    return rounded(r.select(
        "alert_id", "TransactionID", "risk_level", "depth", "summary", "recommended_action",
        "requires_human_review", F.size("tools_used").alias("n_tools")))


@query("alert_similar_cases", f"""WITH {ALERT_SQL}, p AS (SELECT a.vec_id AS q, b.vec_id AS case_id,
  round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 12) AS c
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (SELECT card1 FROM al)),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, case_id) AS rank FROM p)
SELECT alert_id, rank, case_id, {rsql({"similarity": "greatest(0, least(1, (c + 1) / 2))"}, 8)} FROM al JOIN r ON al.card1 = r.q
WHERE rank <= CASE WHEN risk_level = 'CRITICAL' THEN 5 ELSE 3 END""")
def alert_similar_cases(spark, sf_dir):
    """Nearest vectors of every alerted card, as many as its investigation asks for."""
    al, e = alerts(spark, sf_dir), table(spark, sf_dir, "embeddings")
    asked = e.join(al.select(F.col("card1").alias("vec_id")).distinct(), "vec_id", "left_semi")
    m = K.with_similarity(K.similar_cases(asked, e, k=5, query_id="vec_id", query_vec="embedding", case_id="vec_id",
                                          case_vec="embedding", skip_self=True))
    out = V.attach_similar_cases(al, m).select("alert_id", F.explode("similar_cases").alias("s"))
    return rounded(out.select("alert_id", "s.rank", "s.case_id", "s.similarity"), 8)


@query("report_actions", f"""WITH {ALERT_SQL} SELECT CASE WHEN "TransactionAmt" IS NULL THEN 'review' WHEN fraud_score >= 0.8 THEN 'decline'
  ELSE 'review' END AS recommended_action, count(*) AS n FROM al GROUP BY 1""")
def report_actions(spark, sf_dir):
    """Reports under an action rule of the caller's own, one of whose actions is unknown."""
    own = V.reports(alerts(spark, sf_dir), action=lambda level, score: F.when(score >= 0.8, "Decline ").otherwise("page someone"))
    return own.groupBy("recommended_action").agg(F.count(F.lit(1)).alias("n"))


@query("investigation_routes", f"""WITH {ALERT_SQL} SELECT CASE risk_level WHEN 'CRITICAL' THEN 'deep'
  WHEN 'HIGH' THEN 'standard' ELSE 'quick' END AS branch, count(*) AS n FROM al GROUP BY 1""")
def investigation_routes(spark, sf_dir):
    parts = [b.withColumn("branch", F.lit(n)) for n, b in V.route(alerts(spark, sf_dir)).items()]
    u = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return u.groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


def _cases(spark, sf_dir):
    """Yesterday's cases: alerts with a high score; new reports: all alerts."""
    al = alerts(spark, sf_dir)
    lv, s = F.col("risk_level"), F.col("fraud_score")
    rep = al.select("alert_id", "TransactionID", F.lit("new report").alias("summary"),
                    S.recommended_action(lv, s).alias("recommended_action"),
                    F.col("TransactionDT").alias("reported_at"))
    old = alerts(spark, sf_dir, 0.6).select(
        "alert_id", "TransactionID", F.lit("closed").alias("status"), F.lit("old report").alias("summary"),
        (F.col("TransactionDT") - 86400).alias("opened_at"))
    return V.upsert_cases(old, rep)


_CASE_SQL = ALERT_SQL + """,
cs AS (SELECT alert_id, "TransactionID", CASE WHEN fraud_score >= 0.6 THEN 'closed'
    WHEN risk_level = 'CRITICAL' THEN 'review' WHEN risk_level = 'HIGH' THEN 'escalated' ELSE 'open' END AS status,
  'new report' AS summary, "TransactionDT" - CASE WHEN fraud_score >= 0.6 THEN 86400 ELSE 0 END AS opened_at FROM al)
"""


@query("case_upsert", f"WITH {_CASE_SQL} SELECT * FROM cs")
def case_upsert(spark, sf_dir):
    return _cases(spark, sf_dir)


@query("case_list", f"WITH {_CASE_SQL} SELECT * FROM cs WHERE status = 'open'")
def case_list(spark, sf_dir):
    return V.case_list(_cases(spark, sf_dir), "open")


@query("case_counts", f"WITH {_CASE_SQL} SELECT status, count(*) AS n FROM cs GROUP BY 1")
def case_counts(spark, sf_dir):
    return V.case_counts(_cases(spark, sf_dir))


@query("tool_audit", f"""WITH {ALERT_SQL}, c AS (
  SELECT 'get_transaction_details' AS tool, 'ok' AS status FROM al
  UNION ALL SELECT 'retrieve_similar_cases', CASE WHEN "DeviceType" IS NULL THEN 'skipped' ELSE 'ok' END FROM al)
SELECT tool, status, count(*) AS n FROM c GROUP BY ALL""")
def tool_audit(spark, sf_dir):
    tx = transactions(spark, sf_dir).filter(F.col("fraud_score") >= AT)
    calls = F.array(
        F.struct(F.lit("get_transaction_details").alias("tool"), F.lit("ok").alias("status")),
        F.struct(F.lit("retrieve_similar_cases").alias("tool"),
                 F.when(F.col("DeviceType").isNull(), "skipped").otherwise("ok").alias("status")))
    return V.tool_audit(tx.select(calls.alias("tool_calls")))


@query("point_lookup", f"""WITH {TX_SQL} SELECT "TransactionID", card1 FROM tx
WHERE cast("TransactionID" AS varchar) IN (SELECT cast(o_orderkey AS varchar) FROM orders)""")
def point_lookup(spark, sf_dir):
    """Transactions whose id, as text, is among the order keys."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    return V.find_by_id(transactions(spark, sf_dir).select("TransactionID", "card1"), ids)


# Feature rows per card: its purchases; looked up at every other event of the card.
@query("asof_features", f"""WITH {TX_SQL},
f AS (SELECT card1, "TransactionDT" AS ft, max("TransactionAmt") AS last_amt FROM tx WHERE "ProductCD" = 'purchase'
  GROUP BY ALL),
j AS (SELECT tx."TransactionID", tx."TransactionDT", f.ft, f.last_amt
  FROM tx ASOF LEFT JOIN f ON tx.card1 = f.card1 AND tx."TransactionDT" >= f.ft)
SELECT "TransactionID", {rsql({"last_amt": 'CASE WHEN "TransactionDT" - ft <= 604800 THEN last_amt END'})},
  CASE WHEN "TransactionDT" - ft <= 604800 THEN "TransactionDT" - ft END AS asof_age FROM j""")
def asof_features(spark, sf_dir):
    """Point-in-time lookup with a seven-day time to live."""
    tx = transactions(spark, sf_dir)
    feats = tx.filter(F.col("ProductCD") == "purchase").groupBy(
        "card1", F.col("TransactionDT").alias("ft")).agg(F.max("TransactionAmt").alias("last_amt"))
    left = tx.select("TransactionID", "TransactionDT", "card1")
    out = asof_join(left, feats, "card1", "TransactionDT", "ft", ttl=604800, cols=["last_amt"])
    return rounded(out.select("TransactionID", "last_amt", "asof_age"))


# -- rules and panels --------------------------------------------------------------------------

_HOURLY = TX_SQL + """,
hr AS (SELECT ("TransactionDT" // 3600) * 3600 AS ts, avg("isFraud") AS production_fraud_rate,
  quantile_cont("TransactionAmt", 0.95) / 1000 AS latency_p95, count(*) FILTER ("ProductCD" = 'error') / count(*)::double AS error_rate,
  avg((fraud_score >= 0.4)::int) AS shadow_agreement FROM tx GROUP BY 1)
"""


def hourly_metrics(spark, sf_dir):
    tx = transactions(spark, sf_dir).withColumn("ts", F.floor(F.col("TransactionDT") / 3600) * 3600)
    p95 = quantiles(tx, ["ts"], "TransactionAmt", [0.95]).select("ts", (F.col("q")[0] / 1000).alias("latency_p95"))
    return tx.groupBy("ts").agg(
        F.avg("isFraud").alias("production_fraud_rate"),
        (F.count_if(F.col("ProductCD") == "error") / F.count(F.lit(1))).alias("error_rate"),
        F.avg((F.col("fraud_score") >= 0.4).cast("int")).alias("shadow_agreement")).join(p95, "ts")


@query("alert_rules", f"""WITH {_HOURLY}
SELECT ts, 'FraudRateSpike' AS name, 'critical' AS severity FROM hr WHERE production_fraud_rate > 0.1
UNION ALL SELECT ts, 'HighLatency', 'warning' FROM hr WHERE latency_p95 > 0.05
UNION ALL SELECT ts, 'HighErrorRate', 'critical' FROM hr WHERE error_rate > 0.05
UNION ALL SELECT ts, 'ShadowChallengerDisagreement', 'warning' FROM hr WHERE shadow_agreement < 0.9
UNION ALL SELECT ts, 'BrokenRule', 'warning' FROM hr""")
def alert_rules(spark, sf_dir):
    """The standing rules on every hourly context; a rule on an unknown column must warn."""
    ctx = hourly_metrics(spark, sf_dir).select(
        "*", F.lit(True).alias("model_loaded"), F.lit(0.0).alias("drift_overall"),
        F.lit(0).alias("drift_severe"), F.lit(None).cast("double").alias("auprc"),
        F.lit(None).cast("double").alias("recall"), F.lit(None).cast("bigint").alias("n_labelled"))
    rules = [*R.default_rules(), R.Rule("BrokenRule", "critical", "reads an unknown column", "no_such_column > 1")]
    return R.evaluate_rules(ctx, rules).select("ts", "name", "severity")


def _hold_sql(name, severity, cond, hold):
    return f"""SELECT '{name}' AS rule, '{severity}' AS severity, ts, since FROM (
  SELECT ts, min(ts) OVER (PARTITION BY island, flag) AS since, flag FROM (
    SELECT ts, flag, sum((NOT flag)::int) OVER (ORDER BY ts) AS island FROM (
      SELECT ts, coalesce({cond}, false) AS flag FROM hr))) WHERE flag AND ts - since >= {hold}"""


_HELD = (
    ("FraudRateSpike", "critical", "production_fraud_rate > 0.10", 300),
    ("HighLatency", "warning", "latency_p95 > 0.05", 600),
    ("HighErrorRate", "critical", "error_rate > 0.05", 300),
    ("ShadowChallengerDisagreement", "warning", "shadow_agreement < 0.90", 1800))
_UNREAD = [f"SELECT '{r.name}', 'warning', ts, (SELECT min(ts) FROM hr) FROM hr"
           for r in R.HOLD_RULES if r.name not in {h[0] for h in _HELD}]


@query("hold_rules", f"WITH {_HOURLY} " + " UNION ALL ".join([_hold_sql(*r) for r in _HELD] + _UNREAD))
def hold_rules(spark, sf_dir):
    """All standing rules; those whose series this history lacks fire as warnings."""
    return rounded(R.evaluate_hold_rules(hourly_metrics(spark, sf_dir), R.HOLD_RULES))


@query("absent_series", f"""WITH {TX_SQL}, b AS (SELECT DISTINCT "ProductCD" AS series, "TransactionDT" // 3600 AS w FROM tx),
g AS (SELECT s.series, unnest(range((SELECT min(w) FROM b), (SELECT max(w) FROM b) + 1)) AS w
  FROM (SELECT DISTINCT "ProductCD" AS series FROM tx) s)
SELECT series, w * 3600 AS window_start FROM g WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.series = g.series AND b.w = g.w)""")
def absent_series(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    expected = tx.select(F.col("ProductCD").alias("series")).distinct()
    return rounded(R.absent_windows(tx, expected, 3600, series="ProductCD", ts="TransactionDT"))


def _timed(spark, sf_dir):
    return transactions(spark, sf_dir).withColumn("event_ts", F.timestamp_seconds("TransactionDT"))


def _epoch(df):
    return rounded(df.withColumn("window_start", F.unix_timestamp("window_start")), 8)


@query("rate_panel", f"""WITH {TX_SQL}, w AS (SELECT "ProductCD" AS label,
  unnest(range(("TransactionDT" // 60) * 60 - 240, ("TransactionDT" // 60) * 60 + 60, 60)) AS window_start FROM tx)
SELECT window_start, label, count(*) AS n, {rsql({"rate": "count(*) / 300.0"}, 8)} FROM w GROUP BY 1, 2""")
def rate_panel(spark, sf_dir):
    return _epoch(R.rate_panel(_timed(spark, sf_dir), "ProductCD"))


@query("ratio_panel", f"""WITH {TX_SQL} SELECT ("TransactionDT" // 3600) * 3600 AS window_start, count(*) AS n,
  {rsql({"ratio": "avg((\"ProductCD\" = 'error')::int)"}, 8)} FROM tx GROUP BY 1""")
def ratio_panel(spark, sf_dir):
    return _epoch(R.ratio_panel(_timed(spark, sf_dir), F.col("ProductCD") == "error"))


@query("quantile_panel", f"""WITH {TX_SQL} SELECT ("TransactionDT" // 3600) * 3600 AS window_start,
  {rsql({"value": 'quantile_cont("TransactionAmt", 0.95)'}, 8)} FROM tx GROUP BY 1""")
def quantile_panel(spark, sf_dir):
    return _epoch(R.quantile_panel(_timed(spark, sf_dir), "TransactionAmt"))


@query("topk_panel", f"""WITH {TX_SQL}, n AS (SELECT ("TransactionDT" // 86400) * 86400 AS window_start,
  "ProductCD" AS label, count(*) AS n FROM tx GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, label) AS rank FROM n) WHERE rank <= 3""")
def topk_panel(spark, sf_dir):
    return _epoch(R.topk_panel(_timed(spark, sf_dir), "ProductCD", 3))


@query("latest_metrics", f"""WITH {_HOURLY}, m AS (
  SELECT ts, 'perf_' || n AS name, v FROM hr, LATERAL (VALUES ('production_fraud_rate', production_fraud_rate),
    ('latency_p95', latency_p95), ('error_rate', error_rate), ('shadow_agreement', shadow_agreement)) t(n, v))
SELECT name, '{{"env":"test"}}' AS labels_json, max(ts) AS ts, {rsql({"value": "max_by(v, ts)"}, 8)} FROM m GROUP BY name""")
def latest_metrics(spark, sf_dir):
    m = R.metric_rows(hourly_metrics(spark, sf_dir), "perf", {"env": "test"})
    return rounded(R.latest_metrics(m), 8)
