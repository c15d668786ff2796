"""Entity statistics, lookups and the entity feature view."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.functions import scalar as S
from riskgraph.operators import entity as E
from riskgraph.queries.registry import query, rounded, rsql
from riskgraph.schema import DISPOSABLE_MARKERS, FREE_EMAIL_DOMAINS, HIGH_RISK_TLDS
from riskgraph.sources.tables import TX_SQL, V_COLUMNS, transactions


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


KEYS_SQL = TX_SQL + """,
kx AS (
  SELECT *, coalesce(addr1, -1) AS a1, coalesce(addr2, -1) AS a2,
    CASE WHEN "DeviceType" IS NULL AND "DeviceInfo" IS NULL THEN 'unknown'
      ELSE coalesce("DeviceType", '') || '|' || coalesce("DeviceInfo", '') END AS device,
    coalesce("P_emaildomain", '?') AS em, coalesce("ProductCD", '?') AS pr
  FROM tx
)
"""
_STAT = {
    "mean_amt": 'avg("TransactionAmt")', "median_amt": 'quantile_cont("TransactionAmt", 0.5)',
    "std_amt": 'coalesce(stddev_samp("TransactionAmt"), 0)', "max_amt": 'max("TransactionAmt")',
    "fraud_rate": 'avg("isFraud")',
}
_DAYS = '((max("TransactionDT") - min("TransactionDT")) / 86400.0::double)'
def _card_sql(d):
    return f"""
  SELECT card1 AS key, {rsql(_STAT, d)}, count(*) AS count,
    count(DISTINCT (a1, a2)) AS unique_addr, count(DISTINCT em) AS unique_emails,
    count(DISTINCT device) AS unique_devices, count(DISTINCT pr) AS unique_products,
    {rsql({"days_active": _DAYS, "txn_freq": f"count(*) / greatest({_DAYS}, 1.0::double)",
           "c1_mean": 'avg("C1")', "c13_mean": 'avg("C13")', "c14_mean": 'avg("C14")',
           "m_flag_mean": '(avg("M1") + avg("M2") + coalesce(avg("M3"), 0)) / (2 + CASE WHEN '
                          'count("M3") > 0 THEN 1 ELSE 0 END)'}, d)}
  FROM kx WHERE card1 IS NOT NULL GROUP BY card1"""


@query("card_stats", f"WITH {KEYS_SQL} {_card_sql(6)}")
def card_stats(spark, sf_dir):
    return rounded(E.card_table(E.with_entity_keys(transactions(spark, sf_dir))))


def _email_sql(d):
    return f"""SELECT "P_emaildomain" AS key, {rsql(_STAT, d)}, count(*) AS count,
  count(DISTINCT card1) AS unique_cards, count(DISTINCT (a1, a2)) AS unique_addrs
FROM kx WHERE "P_emaildomain" IS NOT NULL GROUP BY 1"""


@query("email_stats", f"WITH {KEYS_SQL} {_email_sql(6)}")
def email_stats(spark, sf_dir):
    return rounded(E.email_table(E.with_entity_keys(transactions(spark, sf_dir))))


@query("address_stats", f"""WITH {KEYS_SQL} SELECT a1, a2, {rsql(_STAT)}, count(*) AS count,
  count(DISTINCT card1) AS n_cards FROM kx GROUP BY a1, a2""")
def address_stats(spark, sf_dir):
    t = E.shared_table(E.with_entity_keys(transactions(spark, sf_dir)), "_addr")
    return rounded(t.select("key.a1", "key.a2", *[c for c in t.columns if c != "key"]))


@query("device_stats", f"""WITH {KEYS_SQL} SELECT device AS key, {rsql(_STAT)}, count(*) AS count,
  count(DISTINCT card1) AS n_cards FROM kx GROUP BY 1""")
def device_stats(spark, sf_dir):
    return rounded(E.shared_table(E.with_entity_keys(transactions(spark, sf_dir)), "_device"))


def _edges_sql(col):
    return "[" + ", ".join(f"(SELECT quantile_cont({col}, {i / 10}) FROM tx)" for i in range(11)) + "]"


def _risk_cte(col):
    return f"""
e_{col} AS (SELECT list_sort(list_distinct({_edges_sql(col)})) AS e),
b_{col} AS (SELECT tx."TransactionID" AS tid, "isFraud" AS y, {col} AS v,
    CASE WHEN {col} IS NULL THEN -1 ELSE
      least(greatest(len(list_filter(e, lambda q: q <= {col})) - 1, 0), len(e) - 2) END AS bin
  FROM tx CROSS JOIN e_{col}),
r_{col} AS (SELECT bin, avg(y) AS risk, count(*) AS n FROM b_{col} WHERE bin >= 0 GROUP BY bin)
"""


@query("quantile_bin_risk", f"""WITH {TX_SQL}, {_risk_cte('id_01')}, {_risk_cte('id_02')}
SELECT 'id_01' AS feature, cast(bin AS bigint) AS bin, {rsql({"risk": "risk"})} FROM r_id_01
UNION ALL SELECT 'id_02', cast(bin AS bigint), {rsql({"risk": "risk"})} FROM r_id_02""")
def quantile_bin_risk(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    parts = []
    for c in ("id_01", "id_02"):
        edges, _ = E.bin_risk(tx, c)
        parts.append(
            tx.filter(F.col(c).isNotNull()).groupBy(S.bin_index(F.col(c), edges).alias("bin"))
            .agg(F.avg("isFraud").alias("risk")).select(F.lit(c).alias("feature"), "bin", "risk"))
    return rounded(parts[0].unionByName(parts[1]))


def _ft(prefix, names, alias):
    return {f"feat_{prefix}_{n}": f"{alias}.{n}" for n in names}


_F = ("mean_amt", "median_amt", "std_amt", "fraud_rate")
_ENTITY_SQL = f"""WITH {KEYS_SQL}, {_risk_cte('id_01')}, {_risk_cte('id_02')},
g AS (SELECT avg("TransactionAmt") AS am, stddev_pop("TransactionAmt") AS asd, avg("isFraud") AS fr,
  {", ".join(f'avg("{v}") AS m_{v}, stddev_pop("{v}") AS s_{v}' for v in V_COLUMNS)} FROM tx),
cs AS ({_card_sql(None)}),
es AS ({_email_sql(None)}),
ads AS (SELECT a1, a2, {rsql(_STAT, None)}, count(*) AS count, count(DISTINCT card1) AS n_cards
        FROM kx GROUP BY a1, a2),
ds AS (SELECT device, {rsql(_STAT, None)}, count(*) AS count, count(DISTINCT card1) AS n_cards
       FROM kx GROUP BY device)
SELECT kx."TransactionID",
  {rsql({**_ft("card", (*_F, "max_amt", "days_active", "txn_freq"), "cs"),
         **_ft("addr", _F, "ads"), **_ft("device", _F, "ds"),
         "feat_email_mean_amt": "coalesce(es.mean_amt, am)",
         "feat_email_median_amt": "coalesce(es.median_amt, am)",
         "feat_email_std_amt": "coalesce(es.std_amt, 0)",
         "feat_email_fraud_rate": "coalesce(es.fraud_rate, fr)",
         "feat_c1_mean_card": "cs.c1_mean", "feat_c13_mean_card": "cs.c13_mean",
         "feat_c14_mean_card": "cs.c14_mean", "feat_m_flag_mean_card": "cs.m_flag_mean",
         "feat_c_total_per_txn": '"C1" + "C13" + "C14"',
         "feat_id_01_bin_risk": "coalesce(r1.risk, fr)", "feat_id_02_bin_risk": "coalesce(r2.risk, fr)",
         "feat_v_feature_zscore_max": "greatest(" + ", ".join(
             f'abs(("{v}" - m_{v}) / s_{v})' for v in V_COLUMNS) + ")",
         "feat_v_feature_zscore_mean": "(" + " + ".join(
             f'abs(("{v}" - m_{v}) / s_{v})' for v in V_COLUMNS) + f") / {len(V_COLUMNS)}",
  }, 10)},
  cs.count AS feat_card_count, cs.unique_addr AS feat_card_unique_addr,
  cs.unique_emails AS feat_card_unique_emails, cs.unique_devices AS feat_card_unique_devices,
  cs.unique_products AS feat_card_unique_products,
  coalesce(es.count, 0) AS feat_email_count, coalesce(es.unique_cards, 0) AS feat_email_unique_cards,
  coalesce(es.unique_addrs, 0) AS feat_email_unique_addrs,
  ads.count AS feat_addr_count, ads.n_cards AS feat_addr_n_cards,
  ds.count AS feat_device_count, ds.n_cards AS feat_device_n_cards,
  cast(coalesce(lower("DeviceInfo") LIKE '%windows%', false) AS bigint) AS feat_device_is_windows,
  cast(coalesce(regexp_matches(lower("DeviceInfo"), 'iphone|ipad|ios'), false) AS bigint)
    AS feat_device_is_ios,
  cast(coalesce(regexp_matches(lower("DeviceInfo"), 'android|sm-|moto'), false) AS bigint)
    AS feat_device_is_android,
  cast(coalesce("DeviceType" = 'mobile', false) AS bigint) AS feat_device_is_mobile,
  cast(coalesce(id_35 > 0, false) AS bigint) AS feat_is_proxy_heuristic,
  cast(coalesce("P_emaildomain" <> "R_emaildomain", false) AS bigint) AS feat_email_mismatch,
  cast(coalesce(regexp_extract("P_emaildomain", '[^.]*$') IN {_in(HIGH_RISK_TLDS)}, false) AS bigint)
    AS feat_high_risk_tld,
  cast((("TransactionDT" % 86400) // 3600) BETWEEN 2 AND 5 AS bigint) AS feat_suspicious_hour,
  0::bigint AS feat_identity_missing, 0::bigint AS feat_new_device_for_card,
  cast(ds.n_cards > 1 AS bigint) AS feat_multi_card_on_device,
  cast("TransactionAmt" > am + 2 * asd AS bigint) AS feat_amt_outlier_flag
FROM kx CROSS JOIN g
LEFT JOIN cs ON kx.card1 = cs.key LEFT JOIN es ON kx."P_emaildomain" = es.key
LEFT JOIN ads ON kx.a1 = ads.a1 AND kx.a2 = ads.a2 LEFT JOIN ds ON kx.device = ds.device
LEFT JOIN b_id_01 b1 ON b1.tid = kx."TransactionID" LEFT JOIN r_id_01 r1 ON r1.bin = b1.bin
LEFT JOIN b_id_02 b2 ON b2.tid = kx."TransactionID" LEFT JOIN r_id_02 r2 ON r2.bin = b2.bin"""
_INT = ("count", "unique_addr", "unique_emails", "unique_devices", "unique_products",
        "unique_cards", "unique_addrs", "n_cards")


@query("entity_features", _ENTITY_SQL)
def entity_features(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    out = E.fit_entity(tx).transform(tx)
    return rounded(out.select(*[
        F.col(c).cast("bigint").alias(c)
        if any(c == f"feat_{e}_{n}" for e in ("card", "email", "addr", "device") for n in _INT)
        else F.col(c) for c in out.columns]), 10)


_SPLIT_AT = '(SELECT quantile_cont("TransactionDT", 0.6) FROM tx)'


@query("new_device_for_card", f"""WITH {KEYS_SQL},
f AS (SELECT * FROM kx WHERE "TransactionDT" <= {_SPLIT_AT}),
fc AS (SELECT DISTINCT card1 FROM f), fp AS (SELECT DISTINCT card1, device FROM f),
fd AS (SELECT device, count(DISTINCT card1) AS n FROM f GROUP BY device)
SELECT "TransactionID", cast(fc.card1 IS NOT NULL AND fp.card1 IS NULL AS bigint) AS new_device,
  cast(coalesce(fd.n, 0) > 1 AS bigint) AS multi_card
FROM kx LEFT JOIN fc ON kx.card1 = fc.card1
LEFT JOIN fp ON kx.card1 = fp.card1 AND kx.device = fp.device LEFT JOIN fd ON kx.device = fd.device""")
def new_device_for_card(spark, sf_dir):
    """State from the earlier 60 % of the time line, applied to all rows."""
    from riskgraph.functions.quantiles import quantile_list

    tx = transactions(spark, sf_dir)
    cut_at = quantile_list(tx, "TransactionDT", [0.6])[0]
    model = E.fit_entity(tx, F.col("TransactionDT") <= cut_at)
    return rounded(model.transform(tx).select(
        "TransactionID", F.col("feat_new_device_for_card").alias("new_device"),
        F.col("feat_multi_card_on_device").alias("multi_card")))


@query("email_flags", f"""WITH {TX_SQL} SELECT "TransactionID",
  cast(coalesce("P_emaildomain" <> "R_emaildomain", false) AS bigint) AS mismatch,
  regexp_extract("P_emaildomain", '[^.]*$') AS tld,
  cast(coalesce(regexp_extract("P_emaildomain", '[^.]*$') IN {_in(HIGH_RISK_TLDS)}, false) AS bigint)
    AS high_risk,
  cast(coalesce("P_emaildomain" IN {_in(FREE_EMAIL_DOMAINS)}, false) AS bigint) AS free_provider,
  cast(coalesce(regexp_matches("P_emaildomain", '{"|".join(DISPOSABLE_MARKERS)}'), false) AS bigint)
    AS disposable FROM tx""")
def email_flags(spark, sf_dir):
    p, r = F.col("P_emaildomain"), F.col("R_emaildomain")
    return rounded(transactions(spark, sf_dir).select(
        "TransactionID", S.email_mismatch(p, r).alias("mismatch"), S.tld(p).alias("tld"),
        S.is_high_risk_tld(p).alias("high_risk"), S.is_free_provider(p).alias("free_provider"),
        S.is_disposable(p).alias("disposable")))
