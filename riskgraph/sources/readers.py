"""Batch readers and the identity join."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.schema import CARD, ID, TIME

_DOUBLES = re.compile(r"([VDC]\d+|TransactionAmt|dist[12]|addr[12]|card[235])")
_ID = re.compile(r"id[_-]?\d+")


def csv_schema(header, text_ids: bool = False) -> T.StructType:
    """Types by column family, wide enough for every key; ``text_ids`` leaves the id columns text."""
    def kind(name: str) -> T.DataType:
        if _DOUBLES.fullmatch(name):
            return T.DoubleType()
        if _ID.fullmatch(name):
            return T.StringType() if text_ids else T.DoubleType()
        return {"isFraud": T.ByteType(), TIME: T.LongType(), CARD: T.LongType(),
                ID: T.LongType()}.get(name, T.StringType())
    return T.StructType([T.StructField(c, kind(c)) for c in header])


def _typed(name: str, kind: T.DataType):
    """Checked cast; whole numbers may be written with a zero fraction."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.LongType, T.ByteType)):
        wide = c.try_cast("decimal(38,6)")
        return F.coalesce(c.try_cast(kind), F.when(wide == F.floor(wide), wide.try_cast(kind)))
    return c.try_cast(kind)


def _text(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """All columns as text, named by the header line alone."""
    names = [str(x) for x in spark.read.option("sep", sep).csv(path).limit(1).first()]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return spark.read.options(header="true", sep=sep).schema(schema).csv(path)


def _schema_of(text: DataFrame, text_ids) -> T.StructType:
    """Types of the columns of ``text``.

    Identity columns may hold text.  ``text_ids`` names those that do; without it one aggregate
    over the id columns finds those with a value that is no number.
    """
    ids = [c for c in text.columns if _ID.fullmatch(c)]
    if text_ids is None and ids:
        bad = text.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).alias(c)
                         for c in ids]).first()
        text_ids = [c for c in ids if bad[c]]
    return T.StructType([T.StructField(f.name, T.StringType()) if f.name in (text_ids or ()) else f
                         for f in csv_schema(text.columns).fields])


def read_csv(spark: SparkSession, path: str, sep: str = ",", text_ids=None) -> DataFrame:
    """CSV scan with types by column family.  A cell that does not fit its type is an error of the
    job that reads it, never a silent null; :func:`read_csv_checked` sorts such rows out instead."""
    text = _text(spark, path, sep)
    cols = []
    for f in _schema_of(text, text_ids).fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            cols.append(c)
            continue
        value = _typed(f.name, f.dataType)
        cols.append(F.when(c.isNotNull() & value.isNull(), F.raise_error(
            F.concat(F.lit(f"{path}: column {f.name} cannot hold "), c)).cast(f.dataType)).otherwise(value).alias(f.name))
    return text.select(*cols)


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",", text_ids=None):
    """Rows that match ``schema`` (by default the column families), and as JSON text those with a value that does not."""
    if schema is None:
        text = _text(spark, path, sep)
        schema = _schema_of(text, text_ids)
    else:
        text = spark.read.options(header="true", sep=sep).schema(
            T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])).csv(path)
    ok = F.lit(True)
    for f in schema.fields:
        ok = ok & (F.col(f"`{f.name}`").isNull() | _typed(f.name, f.dataType).isNotNull())
    good = text.filter(ok).select(*[_typed(f.name, f.dataType).alias(f.name) for f in schema.fields])
    return good, text.filter(~ok).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in text.columns])).alias("rejected"))


def load_frame(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV or TSV by suffix."""
    if path.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if path.endswith((".csv", ".csv.gz")):
        return read_csv(spark, path)
    if path.endswith((".tsv", ".txt")):
        return read_csv(spark, path, sep="\t")
    raise ValueError(f"unsupported file type: {path}")


def join_identity(tx: DataFrame, ident: DataFrame | None, *, key: str = ID) -> DataFrame:
    """Left join of the identity table; ``id-NN`` columns become ``id_NN``."""
    if ident is None:
        return tx
    names = [re.sub(r"^id-(\d+)$", r"id_\1", c) for c in ident.columns]
    return tx.join(ident.toDF(*names), key, "left")


def load_raw(spark: SparkSession, transactions: str, identity: str | None, limit: int | None = None):
    """Transactions with identity columns; optionally the first ``limit`` rows by time."""
    df = join_identity(load_frame(spark, transactions), load_frame(spark, identity) if identity else None)
    return df if limit is None else time_ordered_subset(df, limit)


def load_raw_checked(spark: SparkSession, transactions: str, identity: str | None = None, sep: str = ","):
    """(transactions with identity columns, rejects as ``source, rejected``): bad rows of either file are kept apart."""
    good, bad = read_csv_checked(spark, transactions, sep=sep)
    bad = bad.withColumn("source", F.lit("transactions"))
    ident = None
    if identity:
        ident, worse = read_csv_checked(spark, identity, sep=sep)
        bad = bad.unionByName(worse.withColumn("source", F.lit("identity")))
    return join_identity(good, ident), bad.select("source", "rejected")


def time_ordered_subset(df: DataFrame, n: int, *, time: str = TIME, ident: str = ID) -> DataFrame:
    return df.orderBy(time, ident).limit(n)


def card_history(df: DataFrame) -> DataFrame:
    """The six columns of a card's history; rows without a card are left out."""
    return df.filter(F.col(CARD).isNotNull()).select(
        ID, TIME, "TransactionAmt", CARD, "isFraud", "ProductCD")


def sample_rows(df: DataFrame, n: int, seed: int, *, ident: str = ID) -> DataFrame:
    """Exactly ``n`` rows without replacement, the same ones for the same seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(ident)), ident).limit(n)
