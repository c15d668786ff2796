"""Writers: split and feature tables, fitted state, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.operators.drift import top_drifted


def save_splits(df: DataFrame, path: str) -> None:
    """One Parquet table partitioned by ``split``; a reader of one split scans only its files."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("split") == name)


def save_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_model(model, path: str) -> None:
    """Tables of a fitted model as Parquet and its numbers as one JSON row, all on shared storage."""
    if model is None:
        raise RuntimeError("nothing fitted to save")
    tables = model.tables()
    for name, t in tables.items():
        if t is None:
            raise RuntimeError(f"model table {name} is not fitted")
        t.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    text = json.dumps({"values": model.globals(), "tables": sorted(tables)})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/globals")


def load_model(spark: SparkSession, cls, path: str):
    saved = json.loads(spark.read.text(f"{path}/globals").first()[0])
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in saved["tables"]}
    return cls.restore(spark, saved["values"], tables)


def write_report_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_top_table(report: DataFrame, path: str, k: int = 50) -> None:
    """The ranked drift table, as CSV; rendering is left to the reader."""
    top_drifted(report, k).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
