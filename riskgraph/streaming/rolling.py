"""Scoring quality over a moving window of days, from histograms that are added and subtracted.

A micro-batch is reduced to counts per (day, score, label).  The window's histogram moves by adding the
counts of the batch that lie in it and taking away those of the days it leaves, so a batch reads its
own rows and the counts of a few days, never the window's records.  The histogram keeps the
scores as they are, so areas, ties included, equal those of the records.

Every batch writes tables of its own below one folder and reads those of the batch before, so a batch
that is run again after a failure replaces what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.operators.evaluate import areas, curve_of_counts
from riskgraph.schema import DAY

COUNTS = "day long, score double, label int, n long"


def day_counts(records: DataFrame, *, score: str = "score", label: str = "label", ts: str = "ts") -> DataFrame:
    """``day, score, label, n``; rows without score or time are left out, those without a label are kept."""
    day = F.floor(F.unix_timestamp(ts) / DAY).cast("long")
    return records.filter(F.col(score).isNotNull() & F.col(ts).isNotNull()).groupBy(
        day.alias("day"), F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


def quality(counts: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """One row of figures from ``score, label, n``."""
    s, y, n = F.col("score"), F.col("label"), F.col("n")

    def sum_if(cond, value=n):
        return F.coalesce(F.sum(F.when(cond, value)), F.lit(0))

    has, yes = y.isNotNull(), s >= threshold
    m = counts.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n_total"), sum_if(has).alias("n_labelled"), sum_if(y == 1).alias("n_positive"),
        sum_if(yes & (y == 1)).alias("tp"), sum_if(yes & (y == 0)).alias("fp"),
        sum_if(~yes & (y == 1)).alias("fn"), sum_if(~yes & (y == 0)).alias("tn"),
        F.sum(F.when(has, (s - y) ** 2 * n)).alias("_error"))
    one = F.lit(1)
    m = m.select(
        "n_total", "n_labelled", "n_positive", "tp", "fp", "fn", "tn",
        (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one)).alias("precision"),
        (F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one)).alias("recall"),
        F.when(F.col("n_labelled") > 0, F.col("_error") / F.col("n_labelled")).alias("brier"), one.alias("_one"))
    per = counts.filter(has).groupBy("score").agg(F.sum("n").alias("n"), F.sum(F.when(y == 1, n).otherwise(0)).alias("pos"))
    a = areas(curve_of_counts(per)).select(one.alias("_one"), "auroc", "auprc")
    return m.join(a, "_one", "left").drop("_one")


class RollingQuality:
    """Consumer of micro-batches (``f(batch, batch_id)``) that keeps the last ``days`` whole days.

    The window ends with the newest day seen; rows of days before it come too late and are not
    counted.  ``results()`` has one row per batch.
    """

    def __init__(self, spark: SparkSession, folder: str, *, days: int = 7, threshold: float = 0.5, **columns: str):
        self.spark, self.folder, self.days, self.threshold, self.columns = spark, folder.rstrip("/"), days, threshold, columns

    def _path(self, kind: str, batch_id) -> str:
        return f"{self.folder}/{kind}/batch={batch_id}"

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def _read(self, kind: str, batch_id: int, ddl: str) -> DataFrame:
        path = self._path(kind, batch_id)
        return self.spark.read.schema(ddl).parquet(path) if self._exists(path) else self.spark.createDataFrame([], ddl)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        day_counts(batch, **self.columns).write.mode("overwrite").parquet(self._path("days", batch_id))
        new = self._read("days", batch_id, COUNTS)
        before = self._read("ends", batch_id - 1, "last long").agg(F.max("last")).first()[0]
        seen = new.agg(F.max("day")).first()[0]
        last = max((x for x in (before, seen) if x is not None), default=None)
        spark.createDataFrame([(last,)], "last long").write.mode("overwrite").parquet(self._path("ends", batch_id))
        window = self._read("window", batch_id - 1, "score double, label int, n long")
        if last is not None:
            start = last - self.days + 1
            window = window.unionByName(new.filter(F.col("day") >= start).drop("day"))
            if before is not None and before < last:
                # The days that the window leaves, as all batches have counted them and as it held them.
                left = self._kept(spark, batch_id).filter((F.col("day") > before - self.days) & (F.col("day") < start))
                window = window.unionByName(left.select("score", "label", (-F.col("n")).alias("n")))
        window = window.groupBy("score", "label").agg(F.sum("n").alias("n")).filter("n <> 0")
        window.write.mode("overwrite").parquet(self._path("window", batch_id))
        now = self._read("window", batch_id, "score double, label int, n long")
        quality(now, threshold=self.threshold).select(F.lit(batch_id).alias("batch_id"), F.lit(last).cast("long").alias("last_day"), "*") \
            .write.mode("overwrite").parquet(self._path("results", batch_id))

    def _kept(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """What earlier batches have put into the window: rows that came after their day had left it were not."""
        days = spark.read.schema(f"{COUNTS}, batch int").option("basePath", f"{self.folder}/days").parquet(f"{self.folder}/days")
        ends = spark.read.schema("last long, batch int").option("basePath", f"{self.folder}/ends").parquet(f"{self.folder}/ends")
        old = days.filter(F.col("batch") < batch_id).join(ends, "batch")
        return old.filter(F.col("day") > F.col("last") - self.days).select("day", "score", "label", "n")

    def results(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/results").drop("batch")
