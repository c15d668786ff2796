"""Transaction views over the star-schema test tables.

``events`` become transactions: the card is the user, the amount the event value, the address
comes from ``customer`` and ``nation``; the other columns are integer formulas, so that any SQL
engine derives the same values.  ``TX_SQL`` states the same view in SQL for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Domains and device families the derived columns draw from.
P_DOMAINS = ("gmail.com", "yahoo.com", "mail.ru", "temp-mail.top", "corp.example", None)
R_DOMAINS = ("gmail.com", "hotmail.com", "corp.example", None, "yahoo.com")
FAMILIES = ("Windows", "iPhone", "SM-G960U", "moto", "MacOS", "Linux", "iOS")
V_COLUMNS = tuple(f"V{i}" for i in range(307, 317))
TX_COLUMNS = (
    "TransactionID", "TransactionDT", "TransactionAmt", "ProductCD", "card1", "addr1", "addr2", "k",
    "DeviceType", "DeviceInfo", "P_emaildomain", "R_emaildomain", "id_01", "id_02", "id_35",
    *V_COLUMNS, "C1", "C13", "C14", "M1", "M2", "M3", "D1", "isFraud", "fraud_score",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    base = (
        e.join(c, e.user_id == c.c_custkey, "left")
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    )
    return base.select(*transaction_columns())


def transaction_columns() -> list:
    """Select list that turns (events, customer, nation) rows into transactions."""
    eid, k, user, value = F.col("event_id"), F.col("k"), F.col("user_id"), F.col("value")
    some_id = eid % 10 >= 3
    return [
        eid.alias("TransactionID"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("TransactionDT"),
        value.alias("TransactionAmt"),
        F.col("event_type").alias("ProductCD"),
        user.alias("card1"),
        F.col("c_nationkey").cast("double").alias("addr1"),
        F.col("n_regionkey").cast("double").alias("addr2"),
        k.alias("k"),
        F.when(k < 90, F.when(k < 45, "mobile").otherwise("desktop")).alias("DeviceType"),
        F.when(k < 90, F.concat_ws(
            " ", _pick(user % 7, FAMILIES), ((user + 11 * (k % 3)) % 60).cast("string")
        )).alias("DeviceInfo"),
        _pick(user % 6, P_DOMAINS).alias("P_emaildomain"),
        _pick(eid % 5, R_DOMAINS).alias("R_emaildomain"),
        F.when(some_id, k.cast("double")).alias("id_01"),
        F.when(some_id, (eid % 1000).cast("double")).alias("id_02"),
        F.when(some_id, (k % 5 == 0).cast("double")).alias("id_35"),
        *[((eid * (i - 300) + k * k) % 101).cast("double").alias(f"V{i}") for i in range(307, 317)],
        (k % 10).cast("double").alias("C1"),
        (user % 13).cast("double").alias("C13"),
        (eid % 17).cast("double").alias("C14"),
        (k % 2).cast("double").alias("M1"),
        (eid % 3 == 0).cast("double").alias("M2"),
        F.when(k < 80, (user % 2).cast("double")).alias("M3"),
        F.when(k % 4 != 0, (eid % 30).cast("double")).alias("D1"),
        (((value > 120) & (k % 3 == 0)) | (eid % 97 == 0)).cast("int").alias("isFraud"),
        ((F.floor(value / 10) + F.when(k % 3 == 0, 40).otherwise(0)) / 100.0).alias("fraud_score"),
    ]


def _sql_pick(index: str, values) -> str:
    items = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{items}])[cast({index} as int) + 1]"


TX_SQL = f"""
base AS (
  SELECT e.*, c.c_nationkey, n.n_regionkey,
         cast(regexp_extract(e.props, '[0-9]+') AS int) AS k
  FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
),
tx AS (
  SELECT event_id AS "TransactionID",
    cast(floor(epoch(ts)) AS bigint) AS "TransactionDT",
    value AS "TransactionAmt", event_type AS "ProductCD", user_id AS card1,
    cast(c_nationkey AS double) AS addr1, cast(n_regionkey AS double) AS addr2, k,
    CASE WHEN k < 45 THEN 'mobile' WHEN k < 90 THEN 'desktop' END AS "DeviceType",
    CASE WHEN k < 90 THEN {_sql_pick('user_id % 7', FAMILIES)} || ' '
      || cast((user_id + 11 * (k % 3)) % 60 AS varchar) END AS "DeviceInfo",
    {_sql_pick('user_id % 6', P_DOMAINS)} AS "P_emaildomain",
    {_sql_pick('event_id % 5', R_DOMAINS)} AS "R_emaildomain",
    CASE WHEN event_id % 10 >= 3 THEN cast(k AS double) END AS id_01,
    CASE WHEN event_id % 10 >= 3 THEN cast(event_id % 1000 AS double) END AS id_02,
    CASE WHEN event_id % 10 >= 3 THEN CASE WHEN k % 5 = 0 THEN 1.0::double ELSE 0.0::double END END
      AS id_35,
    {", ".join(f'cast((event_id * {i - 300} + k * k) % 101 AS double) AS "V{i}"'
               for i in range(307, 317))},
    cast(k % 10 AS double) AS "C1", cast(user_id % 13 AS double) AS "C13",
    cast(event_id % 17 AS double) AS "C14",
    cast(k % 2 AS double) AS "M1",
    CASE WHEN event_id % 3 = 0 THEN 1.0::double ELSE 0.0::double END AS "M2",
    CASE WHEN k < 80 THEN cast(user_id % 2 AS double) END AS "M3",
    CASE WHEN k % 4 <> 0 THEN cast(event_id % 30 AS double) END AS "D1",
    CASE WHEN (value > 120 AND k % 3 = 0) OR event_id % 97 = 0 THEN 1 ELSE 0 END AS "isFraud",
    (floor(value / 10) + CASE WHEN k % 3 = 0 THEN 40 ELSE 0 END) / 100.0::double AS fraud_score
  FROM base
)
"""


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as they arrive: text flags, sparse columns, no identity columns."""
    t = transactions(spark, sf_dir)
    k = F.col("k")
    return t.select(
        "TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD", "card1",
        F.when(k < 50, "visa").when(k < 85, "mastercard").alias("card4"),
        "addr1", F.when(k >= 30, F.col("addr2")).alias("addr2"),
        "P_emaildomain", "R_emaildomain",
        "V307", F.when(k < 20, F.col("V308")).alias("V308"),
        F.when(k < 40, F.col("V309")).alias("V309"), "D1", "C1",
        F.when(k >= 2, F.col("C13")).alias("C13"),
        F.when(k < 80, F.when(F.col("M1") == 1, "T").otherwise("F")).alias("M1"),
    )


RAW_SQL = TX_SQL + """,
raw AS (
  SELECT "TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD", card1,
    CASE WHEN k < 50 THEN 'visa' WHEN k < 85 THEN 'mastercard' END AS card4,
    addr1, CASE WHEN k >= 30 THEN addr2 END AS addr2, "P_emaildomain", "R_emaildomain",
    "V307", CASE WHEN k < 20 THEN "V308" END AS "V308", CASE WHEN k < 40 THEN "V309" END AS "V309",
    "D1", "C1", CASE WHEN k >= 2 THEN "C13" END AS "C13",
    CASE WHEN k < 80 THEN CASE WHEN "M1" = 1 THEN 'T' ELSE 'F' END END AS "M1"
  FROM tx
)
"""


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity rows: present for the transactions whose device is known."""
    t = transactions(spark, sf_dir).filter(F.col("DeviceType").isNotNull())
    return t.select(
        "TransactionID", F.col("id_01").alias("id-01"), F.col("id_02").alias("id-02"),
        F.concat(F.lit("os "), F.col("k").cast("string")).alias("id-30"),
        "DeviceType", "DeviceInfo",
    )


def orders_as_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second transaction table, with many rows on equal times (orders have dates only)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("TransactionID"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("TransactionDT"),
        F.col("o_totalprice").alias("TransactionAmt"),
        F.col("o_custkey").alias("card1"),
        F.col("o_orderpriority").alias("ProductCD"),
    )


ORDERS_SQL = """
ord AS (
  SELECT o_orderkey AS "TransactionID", cast(floor(epoch(o_orderdate)) AS bigint) AS "TransactionDT",
         o_totalprice AS "TransactionAmt", o_custkey AS card1, o_orderpriority AS "ProductCD"
  FROM orders
)
"""
