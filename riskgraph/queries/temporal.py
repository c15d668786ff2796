"""Causal windows and the temporal feature view."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.functions import scalar as S
from riskgraph.operators import temporal as T
from riskgraph.queries.registry import query, rounded, rsql
from riskgraph.schema import DAY, HOUR, WEEK
from riskgraph.sources.tables import (
    ORDERS_SQL, TX_SQL, orders_as_transactions, transactions,
)

WINDOW_SQL = """
  WINDOW c AS (PARTITION BY card1 ORDER BY "TransactionDT", "TransactionID"),
    ct AS (PARTITION BY card1, "TransactionDT" ORDER BY "TransactionID"),
    ca AS (PARTITION BY card1, "TransactionDT"),
    g AS (ORDER BY "TransactionDT", "TransactionID"),
    gt AS (PARTITION BY "TransactionDT" ORDER BY "TransactionID"),
    ga AS (PARTITION BY "TransactionDT")
"""


def _card_n(w):
    return (f'(count(*) OVER (PARTITION BY card1 ORDER BY "TransactionDT" RANGE BETWEEN {w} PRECEDING '
            "AND CURRENT ROW) - (count(*) OVER ca - row_number() OVER ct))")


def _card_sum(w):
    return (f'(sum("TransactionAmt") OVER (PARTITION BY card1 ORDER BY "TransactionDT" RANGE BETWEEN {w} '
            'PRECEDING AND CURRENT ROW) - (sum("TransactionAmt") OVER ca - sum("TransactionAmt") OVER '
            "(ct ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))")


def _all_n(w):
    return (f'(count(*) OVER (ORDER BY "TransactionDT" RANGE BETWEEN {w} PRECEDING AND CURRENT ROW) '
            "- (count(*) OVER ga - row_number() OVER gt))")


def _all_sum(w):
    return (f'(sum("TransactionAmt") OVER (ORDER BY "TransactionDT" RANGE BETWEEN {w} PRECEDING AND '
            'CURRENT ROW) - (sum("TransactionAmt") OVER ga - sum("TransactionAmt") OVER '
            "(gt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))")


def _causal_sql(src: str) -> str:
    return f"""
, gaps AS (
  SELECT *, "TransactionDT" - lag("TransactionDT") OVER c AS gap0,
    coalesce("TransactionAmt" - lag("TransactionAmt") OVER c, 0) AS acc
  FROM {src} WINDOW c AS (PARTITION BY card1 ORDER BY "TransactionDT", "TransactionID")
)
"""


CARD_COLS = {
    "gap_mean": "coalesce(avg(gap0) OVER (c ROWS UNBOUNDED PRECEDING), 0)",
    "gap_std": "coalesce(stddev_pop(gap0) OVER (c ROWS UNBOUNDED PRECEDING), 0)",
    "cum_amount": 'sum("TransactionAmt") OVER (c ROWS UNBOUNDED PRECEDING)',
    "acceleration": "acc",
    "jerk": "CASE WHEN row_number() OVER c = 1 THEN 0 ELSE acc - lag(acc) OVER c END",
}


def _velocity_sql(cte: str, src: str) -> str:
    return f"""WITH {cte}
SELECT "TransactionID", card1, "TransactionDT",
  coalesce("TransactionDT" - lag("TransactionDT") OVER c, 0) AS gap,
  {_card_n(HOUR)} AS n_1h, {_card_n(DAY)} AS n_24h,
  {rsql({"spend_24h": _card_sum(DAY), "cum_amount": CARD_COLS["cum_amount"]}, 4)},
  CASE WHEN fraud_score >= 0.9 THEN 'CRITICAL' WHEN fraud_score >= 0.7 THEN 'HIGH'
       WHEN fraud_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM {src} {WINDOW_SQL}"""


@query("card_velocity", _velocity_sql(TX_SQL, "tx"))
def card_velocity(spark, sf_dir):
    """Flagship: per-card velocity and spend for every transaction, with its risk level."""
    x = T.card_causal(transactions(spark, sf_dir).select(
        "TransactionID", "TransactionDT", "TransactionAmt", "card1", "fraud_score"))
    return rounded(x.select(
        "TransactionID", "card1", "TransactionDT", "gap",
        F.col(f"n_{HOUR}s").alias("n_1h"), F.col(f"n_{DAY}s").alias("n_24h"),
        F.col(f"sum_{DAY}s").alias("spend_24h"), "cum_amount",
        S.risk_level(F.col("fraud_score")).alias("risk_level"),
    ), 4)


_ORD_WEEK = f"""WITH {ORDERS_SQL} {_causal_sql("ord")}
SELECT "TransactionID", row_number() OVER c AS n_seen,
  {_card_n(WEEK)} AS n_7d, {rsql({"sum_7d": _card_sum(WEEK)}, 2)},
  {rsql(CARD_COLS, 2)}
FROM gaps {WINDOW_SQL}"""


@query("card_history_orders", _ORD_WEEK)
def card_history_orders(spark, sf_dir):
    """Running card history on a table with many equal times."""
    x = T.card_causal(orders_as_transactions(spark, sf_dir), windows=(WEEK,))
    head = rounded(x.select(
        "TransactionID", "n_seen", F.col(f"n_{WEEK}s").alias("n_7d"),
        "gap_mean", "gap_std", "cum_amount", "acceleration", "jerk",
        F.col(f"sum_{WEEK}s").alias("sum_7d")), 2)
    return head


def _global_sql(cte, src):
    return f"""WITH {cte}
SELECT "TransactionID",
  coalesce("TransactionDT" - lag("TransactionDT") OVER g, 0) AS g_gap,
  {_all_n(HOUR)} AS n_1h, {_all_n(DAY)} AS n_24h, {_all_n(WEEK)} AS n_7d,
  {rsql({"sum_1h": _all_sum(HOUR), "sum_24h": _all_sum(DAY), "sum_7d": _all_sum(WEEK)}, 3)}
FROM {src} {WINDOW_SQL}"""


def _global(df):
    x = T.global_causal(df.select("TransactionID", "TransactionDT", "TransactionAmt"))
    return rounded(x.select(
        "TransactionID", "g_gap",
        *[F.col(f"g_n_{w}s").alias(f"n_{n}") for w, n in ((HOUR, "1h"), (DAY, "24h"), (WEEK, "7d"))],
        *[F.col(f"g_sum_{w}s").alias(f"sum_{n}")
          for w, n in ((HOUR, "1h"), (DAY, "24h"), (WEEK, "7d"))],
    ), 3)


@query("global_windows", _global_sql(TX_SQL, "tx"))
def global_windows(spark, sf_dir):
    return _global(transactions(spark, sf_dir))


@query("global_windows_orders", _global_sql(ORDERS_SQL, "ord"))
def global_windows_orders(spark, sf_dir):
    return _global(orders_as_transactions(spark, sf_dir))


_HOUR_SQL = '(("TransactionDT" % 86400) // 3600)'
_DOW_SQL = '(("TransactionDT" // 86400) % 7)'
_TEMPORAL_SQL = f"""WITH {TX_SQL} {_causal_sql("tx")},
st AS (SELECT avg("TransactionAmt") AS m, stddev_pop("TransactionAmt") AS s,
         quantile_cont("TransactionAmt", 0.05) AS p05, quantile_cont("TransactionAmt", 0.95) AS p95
       FROM tx),
cs AS (SELECT card1 AS ck, avg("TransactionAmt") AS cm, max("TransactionAmt") AS cx,
         min("TransactionAmt") AS cn, min("TransactionDT") AS cf FROM tx GROUP BY card1),
x AS (SELECT gaps.*, st.*, cs.*, {_HOUR_SQL} AS h, {_DOW_SQL} AS d
      FROM gaps CROSS JOIN st LEFT JOIN cs ON card1 = ck)
SELECT "TransactionID",
  {rsql({
    "feat_hour_sin": "sin(2 * pi() * h / 24)", "feat_hour_cos": "cos(2 * pi() * h / 24)",
    "feat_dow_sin": "sin(2 * pi() * d / 7)", "feat_dow_cos": "cos(2 * pi() * d / 7)",
    "feat_amt_log1p": 'ln(1 + "TransactionAmt")',
    "feat_amt_cents": '("TransactionAmt" * 100) % 100',
    "feat_amt_zscore": '("TransactionAmt" - m) / s',
    "feat_amt_percentile": 'least(greatest(("TransactionAmt" - p05) / (p95 - p05), 0), 1)',
    "feat_amt_vs_card_mean": '"TransactionAmt" - cm', "feat_amt_vs_card_max": '"TransactionAmt" - cx',
    "feat_amt_ratio_to_card_min": '"TransactionAmt" / greatest(cn, 1e-6)',
    "feat_amt_ratio_to_card_max": '"TransactionAmt" / greatest(cx, 1e-6)',
    "feat_amt_acceleration": "acc", "feat_amt_jerk": CARD_COLS["jerk"],
    "feat_velocity_1h": _all_n(HOUR), "feat_velocity_24h": _all_n(DAY) + "/ 24.0::double",
    "feat_velocity_7d": _all_n(WEEK) + "/ 168.0::double",
  }, 8)},
  {rsql({"feat_interarrival_mean_card": CARD_COLS["gap_mean"],
         "feat_interarrival_std_card": CARD_COLS["gap_std"],
    "feat_amt_cum_1h": _all_sum(HOUR), "feat_amt_cum_24h": _all_sum(DAY),
    "feat_amt_cum_7d": _all_sum(WEEK), "feat_amt_card_cum": CARD_COLS["cum_amount"]}, 3)},
  h AS feat_hour, d AS feat_dow,
  cast(d >= 5 AS bigint) AS feat_is_weekend, cast(h < 6 OR h >= 22 AS bigint) AS feat_is_night,
  cast(h BETWEEN 9 AND 17 AND d < 5 AS bigint) AS feat_is_business_hours,
  coalesce("TransactionDT" - lag("TransactionDT") OVER g, 0) AS feat_seconds_since_last_txn,
  coalesce(gap0, 0) AS feat_seconds_since_last_card_txn,
  coalesce(gap0, 0) AS feat_interarrival_last_card,
  "TransactionDT" - cf AS feat_seconds_since_first_card_txn,
  {_all_n(HOUR)} AS feat_txn_count_1h, {_all_n(DAY)} AS feat_txn_count_24h,
  {_all_n(WEEK)} AS feat_txn_count_7d,
  {_card_n(HOUR)} AS feat_card_txn_count_1h, {_card_n(DAY)} AS feat_card_txn_count_24h,
  cast("TransactionAmt" > p95 AS bigint) AS feat_amt_above_p95,
  cast("TransactionAmt" < p05 AS bigint) AS feat_amt_below_p05
FROM x {WINDOW_SQL}"""


@query("temporal_features", _TEMPORAL_SQL)
def temporal_features(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    return rounded(T.fit_temporal(tx).transform(tx), 8, {
        "feat_interarrival_mean_card": 3, "feat_interarrival_std_card": 3,
        **{f"feat_amt_{c}": 3 for c in ("cum_1h", "cum_24h", "cum_7d", "card_cum")}})


@query("card_amount_stats", f"""WITH {TX_SQL} SELECT card1 AS key, min("TransactionDT") AS first_seen,
  {rsql({"mean_amt": 'avg("TransactionAmt")', "std_amt": 'coalesce(stddev_samp("TransactionAmt"), 0)',
         "max_amt": 'max("TransactionAmt")', "min_amt": 'min("TransactionAmt")'})}
FROM tx WHERE card1 IS NOT NULL GROUP BY card1""")
def card_amount_stats(spark, sf_dir):
    return rounded(T.card_amount_stats(transactions(spark, sf_dir)))


@query("amount_globals", f"""WITH {TX_SQL} SELECT {rsql({
  "amount_mean": 'avg("TransactionAmt")', "amount_std": 'stddev_pop("TransactionAmt")',
  "p05": 'quantile_cont("TransactionAmt", 0.05)', "p95": 'quantile_cont("TransactionAmt", 0.95)'})}
FROM tx""")
def amount_globals(spark, sf_dir):
    from riskgraph.functions.quantiles import quantiles

    tx = transactions(spark, sf_dir).select("TransactionAmt")
    q = quantiles(tx, [], "TransactionAmt", [0.05, 0.95])
    m = tx.agg(F.avg("TransactionAmt").alias("amount_mean"),
               F.stddev_pop("TransactionAmt").alias("amount_std"))
    both = m.withColumn("one", F.lit(1)).join(q.withColumn("one", F.lit(1)), "one")
    return rounded(both.select("amount_mean", "amount_std", F.col("q")[0].alias("p05"),
                               F.col("q")[1].alias("p95")))
