"""Cleaning and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.functions import scalar as S
from riskgraph.operators import clean as C
from riskgraph.operators import split as P
from riskgraph.plans.scan import row_index
from riskgraph.queries.registry import query, rounded, rsql
from riskgraph.sources.readers import join_identity, time_ordered_subset
from riskgraph.sources.tables import (
    ORDERS_SQL, RAW_SQL, TX_SQL, identity, orders_as_transactions, raw_transactions, transactions,
)

_RAW = ("TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD", "card1", "card4",
        "addr1", "addr2", "P_emaildomain", "R_emaildomain", "V307", "V308", "V309", "D1", "C1", "C13",
        "M1")


@query("missing_fractions", f"WITH {RAW_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {rsql({"missing": f'avg(("{c}" IS NULL)::int)'})} FROM raw"""
    for c in _RAW))
def missing_fractions(spark, sf_dir):
    return rounded(C.missing_fractions(raw_transactions(spark, sf_dir)))


# V308 is more than 75 % null and dropped; addr2 and card4 are caught by the catch-all fill.
FILLED_SQL = RAW_SQL + """,
filled AS (
  SELECT "TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD", card1,
    coalesce(card4, 'unknown') AS card4, addr1, coalesce(addr2, -999) AS addr2,
    coalesce("P_emaildomain", 'unknown') AS "P_emaildomain",
    coalesce("R_emaildomain", 'unknown') AS "R_emaildomain",
    coalesce("V307", -999) AS "V307", coalesce("V309", -999) AS "V309", coalesce("D1", -1) AS "D1",
    coalesce("C1", 0) AS "C1", coalesce("C13", 0) AS "C13", coalesce("M1", 'missing') AS "M1",
    cast("V307" IS NULL AS bigint) AS "V307__isna", cast("V309" IS NULL AS bigint) AS "V309__isna",
    cast("D1" IS NULL AS bigint) AS "D1__isna", cast(addr2 IS NULL AS bigint) AS addr2__isna
  FROM raw
)
"""


@query("fill_missing", f"""WITH {FILLED_SQL} SELECT * REPLACE (cast("isFraud" AS bigint) AS "isFraud")
FROM filled""")
def fill_missing(spark, sf_dir):
    raw = raw_transactions(spark, sf_dir)
    return rounded(C.fit_clean(raw).fill(raw))


_CATS = ("M1", "P_emaildomain", "R_emaildomain", "ProductCD", "card4")
CODES_SQL = FILLED_SQL + ", codes AS (" + " UNION ALL ".join(f"""
  SELECT '{c}' AS "column", value, row_number() OVER (ORDER BY f) AS code FROM (
    SELECT "{c}" AS value, min(("TransactionDT", "TransactionID")) AS f FROM filled
    WHERE "{c}" <> 'unknown' GROUP BY 1)""" for c in _CATS) + ")"


@query("category_codes", f"WITH {CODES_SQL} SELECT * FROM codes")
def category_codes(spark, sf_dir):
    return rounded(C.fit_clean(raw_transactions(spark, sf_dir)).codes)


_CODE_JOIN = " ".join(
    f"""LEFT JOIN codes k{i} ON k{i}."column" = '{c}' AND k{i}.value = f."{c}\""""
    for i, c in enumerate(_CATS))
_CODE_COLS = ", ".join(f'coalesce(k{i}.code, 0) AS "{c}"' for i, c in enumerate(_CATS))
_NUM = ("TransactionAmt", "card1", "addr1", "addr2", "V307", "V309", "D1", "C1", "C13",
        "TransactionAmt__log1p")


@query("clean_transform", f"""WITH {CODES_SQL},
cl AS (SELECT quantile_cont("TransactionAmt", 0.999) AS q FROM filled),
n AS (SELECT f.*, ln(1 + greatest("TransactionAmt", 0)) AS "TransactionAmt__log1p" FROM filled f),
n2 AS (SELECT n.* REPLACE (least("TransactionAmt", q) AS "TransactionAmt") FROM n CROSS JOIN cl),
sc AS (SELECT {", ".join(f'avg("{c}") AS "m_{c}", stddev_pop("{c}") AS "s_{c}"' for c in _NUM)} FROM n2)
SELECT f."TransactionID", cast(f."isFraud" AS bigint) AS "isFraud", f."TransactionDT", {_CODE_COLS},
  "V307__isna", "V309__isna", "D1__isna", addr2__isna,
  {rsql({c: f'(f."{c}" - "m_{c}") / CASE WHEN "s_{c}" = 0 THEN 1 ELSE "s_{c}" END' for c in _NUM})}
FROM n2 f CROSS JOIN sc {_CODE_JOIN}""")
def clean_transform(spark, sf_dir):
    raw = raw_transactions(spark, sf_dir)
    return rounded(C.fit_clean(raw).transform(raw))


@query("robust_scale", f"""WITH {FILLED_SQL},
sc AS (SELECT {", ".join(f'quantile_cont("{c}", 0.5) AS "m_{c}", quantile_cont("{c}", 0.75) - quantile_cont("{c}", 0.25) AS "s_{c}"' for c in ("addr1", "C1", "C13", "D1"))} FROM filled)
SELECT "TransactionID", {rsql({c: f'("{c}" - "m_{c}") / CASE WHEN "s_{c}" = 0 THEN 1 ELSE "s_{c}" END'
                              for c in ("addr1", "C1", "C13", "D1")})} FROM filled CROSS JOIN sc""")
def robust_scale(spark, sf_dir):
    raw = raw_transactions(spark, sf_dir)
    m = C.fit_clean(raw, C.CleanConfig(scale="robust"))
    return rounded(m.scale(m.fill(raw)).select("TransactionID", "addr1", "C1", "C13", "D1"))


@query("unseen_categories", f"""WITH {FILLED_SQL},
cut AS (SELECT quantile_cont("TransactionDT", 0.001) AS t FROM filled)
""" + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", cast(coalesce(sum(cast("{c}" <> 'unknown' AND NOT EXISTS (
  SELECT 1 FROM filled g, cut WHERE g."TransactionDT" <= cut.t AND g."{c}" = f."{c}") AS int)), 0)
  AS bigint) AS n_unseen FROM filled f""" for c in _CATS))
def unseen_categories(spark, sf_dir):
    """Codes from the first thousandth of the time line, counted against all rows."""
    from riskgraph.functions.quantiles import quantile_list

    raw = raw_transactions(spark, sf_dir)
    at = quantile_list(raw, "TransactionDT", [0.001])[0]
    model = C.fit_clean(raw)
    filled = model.fill(raw)
    model.codes = C.category_codes(filled.filter(F.col("TransactionDT") <= at), model.categorical)
    return rounded(model.unseen(raw))


@query("identity_join", f"""WITH {TX_SQL}
SELECT "TransactionID", "TransactionAmt", CASE WHEN "DeviceType" IS NOT NULL THEN id_01 END AS id_01,
  CASE WHEN "DeviceType" IS NOT NULL THEN id_02 END AS id_02,
  CASE WHEN "DeviceType" IS NOT NULL THEN 'os ' || k END AS id_30, "DeviceType", "DeviceInfo"
FROM tx""")
def identity_join(spark, sf_dir):
    tx = transactions(spark, sf_dir).select("TransactionID", "TransactionAmt")
    return join_identity(tx, identity(spark, sf_dir))


@query("time_ordered_subset", f"""WITH {TX_SQL} SELECT "TransactionID", "TransactionDT" FROM tx
ORDER BY "TransactionDT", "TransactionID" LIMIT 1000""")
def subset(spark, sf_dir):
    """The subset mode of the loader: the first n rows by time."""
    tx = transactions(spark, sf_dir).select("TransactionID", "TransactionDT")
    return time_ordered_subset(tx, 1000)


@query("temporal_split", f"""WITH {ORDERS_SQL},
r AS (SELECT *, row_number() OVER (ORDER BY "TransactionDT", "TransactionID") - 1 AS row_idx,
        count(*) OVER () AS n FROM ord)
SELECT "TransactionID", row_idx, CASE WHEN row_idx < floor(n * 0.6) THEN 'train'
  WHEN row_idx < floor(n * 0.6) + floor(n * 0.2) THEN 'val' ELSE 'test' END AS split FROM r""")
def temporal_split(spark, sf_dir):
    s = P.temporal_split(orders_as_transactions(spark, sf_dir))
    return rounded(s.select("TransactionID", "row_idx", "split"))


_SPLIT = """,
r AS (SELECT *, row_number() OVER (ORDER BY "TransactionDT", "TransactionID") - 1 AS row_idx,
        count(*) OVER () AS n_all FROM tx),
s AS (SELECT *, CASE WHEN row_idx < floor(n_all * 0.7) THEN 'train'
  WHEN row_idx < floor(n_all * 0.7) + floor(n_all * 0.15) THEN 'val' ELSE 'test' END AS split FROM r)
"""


@query("split_summary", f"""WITH {TX_SQL} {_SPLIT}
SELECT split, count(*) AS n, min("TransactionDT") AS first_time, max("TransactionDT") AS last_time,
  cast(sum("isFraud") AS bigint) AS n_fraud, {rsql({"fraud_rate": 'avg("isFraud")'})}
FROM s GROUP BY split""")
def split_summary(spark, sf_dir):
    s = P.temporal_split(transactions(spark, sf_dir), (0.7, 0.15, 0.15))
    return rounded(P.split_summary(s))


@query("split_membership", f"""WITH {TX_SQL} {_SPLIT}
SELECT tx."TransactionID", tx.card1, s.split FROM tx LEFT JOIN s USING ("TransactionID")""")
def split_membership(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    s = P.temporal_split(tx, (0.7, 0.15, 0.15)).select("TransactionID", "split")
    return P.mark_split(tx.select("TransactionID", "card1"), s)


@query("split_rows", f"""WITH {TX_SQL} {_SPLIT} SELECT "TransactionID", card1 FROM s WHERE split = 'val'""")
def split_rows(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    s = P.temporal_split(tx, (0.7, 0.15, 0.15)).select("TransactionID", "split")
    return P.in_split(tx.select("TransactionID", "card1"), s, "val")


@query("row_index", f"""WITH {ORDERS_SQL} SELECT "TransactionID", row_number() OVER
  (ORDER BY "TransactionDT", "TransactionID") - 1 AS row_idx FROM ord""")
def row_index_query(spark, sf_dir):
    return rounded(row_index(orders_as_transactions(spark, sf_dir), "TransactionDT", "TransactionID")
                   .select("TransactionID", "row_idx"))


@query("amount_transforms", f"""WITH {TX_SQL}, st AS (SELECT quantile_cont("TransactionAmt", 0.999) AS q,
  quantile_cont("TransactionAmt", 0.05) AS lo, quantile_cont("TransactionAmt", 0.95) AS hi FROM tx)
SELECT "TransactionID", {rsql({"log1p": 'ln(1 + greatest("TransactionAmt", 0))',
  "clipped": 'least("TransactionAmt", q)', "cents": '("TransactionAmt" * 100) % 100',
  "position": 'least(greatest(("TransactionAmt" - lo) / (hi - lo), 0), 1)'})} FROM tx CROSS JOIN st""")
def amount_transforms(spark, sf_dir):
    from riskgraph.functions.quantiles import quantile_list

    tx = transactions(spark, sf_dir)
    lo, hi, q = quantile_list(tx, "TransactionAmt", [0.05, 0.95, 0.999])
    a = F.col("TransactionAmt")
    return rounded(tx.select(
        "TransactionID", S.log_amount(a).alias("log1p"), F.least(a, F.lit(q)).alias("clipped"),
        S.cents(a).alias("cents"), S.position_between(a, lo, hi).alias("position")))
