"""Alert streams: decode, score, publish, de-duplicate, fan out, replay.

The same transformations run on Kafka or on files; only the source and sink options differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.functions import scalar as S

ALERT = T.StructType([
    T.StructField("transaction_id", T.StringType()), T.StructField("fraud_score", T.DoubleType()),
    T.StructField("risk_level", T.StringType()), T.StructField("transaction_amt", T.DoubleType()),
    T.StructField("card_id", T.StringType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("top_features", T.ArrayType(T.StructType([
        T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType()),
        T.StructField("contribution", T.DoubleType())]))),
])
CORRUPT = "_corrupt"


def kafka_source(spark: SparkSession, servers: str, topic: str, *, starting: str = "latest",
                 max_offsets: int = 5_000_000) -> DataFrame:
    """``key, value`` as text from a topic; needs the Kafka package on the class path.

    ``max_offsets`` bounds a micro-batch, and with it the rows of any one card in it.
    """
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).option("startingOffsets", starting)
           .option("maxOffsetsPerTrigger", max_offsets).load())
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"))


def kafka_sink(alerts: DataFrame, servers: str, topic: str, checkpoint: str, *, key: str = "transaction_id"):
    """At-least-once publishing keyed by transaction; readers de-duplicate by the key."""
    return (encode(alerts, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("kafka.acks", "all").option("kafka.enable.idempotence", "true").option("topic", topic)
            .option("checkpointLocation", checkpoint))


def file_source(spark: SparkSession, path: str, schema: T.StructType, *, fmt: str = "parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    """Files as a stream; ``files_per_trigger`` limits the rate of a replay."""
    r = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


def encode(alerts: DataFrame, key: str = "transaction_id") -> DataFrame:
    """``key, value`` with the row as JSON."""
    return alerts.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*alerts.columns)).alias("value"))


def decode(messages: DataFrame, value: str = "value") -> DataFrame:
    """Parsed alert fields and ``ok``: well-formed JSON, required fields present, score in 0..1."""
    schema = T.StructType([*ALERT.fields, T.StructField(CORRUPT, T.StringType())])
    p = F.from_json(F.col(value).cast("string"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    d = messages.withColumn("a", p)
    ok = (F.col("a").isNotNull() & F.col(f"a.{CORRUPT}").isNull() & F.col("a.transaction_id").isNotNull()
          & F.col("a.fraud_score").between(0.0, 1.0) & F.col("a.risk_level").isin("LOW", "MEDIUM", "HIGH", "CRITICAL"))
    return d.select(F.col(value).cast("string").alias("raw"), "a.*", F.coalesce(ok, F.lit(False)).alias("ok")).drop(CORRUPT)


def split_valid(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    return decoded.filter("ok").drop("raw", "ok"), decoded.filter("NOT ok").select("raw")


def validate_requests(df: DataFrame, *, time: str = "TransactionDT", amount: str = "TransactionAmt") -> DataFrame:
    """Rows with ``reasons``: the broken constraints, empty for a valid row."""
    rules = {"negative time": F.col(time) < 0, "missing time": F.col(time).isNull(),
             "negative amount": F.col(amount) < 0, "missing amount": F.col(amount).isNull()}
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()])))


def score_to_alerts(scored: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """Score stream to alert stream."""
    s = F.col("fraud_score")
    return scored.filter(s >= threshold).withColumn("risk_level", S.alert_level(s))


def score_stream(stream: DataFrame, scorer, *, threshold: float = 0.7) -> DataFrame:
    """Rows to alerts by a fitted scorer inside the stream."""
    return score_to_alerts(scorer.score(stream), threshold=threshold)


def shadow_pairs(rows: DataFrame, champion, challenger, *, ident: str = "transaction_id", threshold: float = 0.5,
                 over_budget=None) -> DataFrame:
    """``ident, champion, challenger, agreement, skipped`` of every row.

    Both models score the same row, so pairing needs no join and no state, on streams and tables
    alike; ``over_budget`` (a condition) marks rows the challenger should have left out.
    """
    skipped = F.lit(False) if over_budget is None else over_budget
    return rows.select(
        F.col(ident), champion.alias("champion"), challenger.alias("challenger"),
        ((champion >= threshold) == (challenger >= threshold)).alias("agreement"), skipped.alias("skipped"))


def dedupe(alerts: DataFrame, *, ts: str = "timestamp", delay: str = "1 hour", key: str = "transaction_id") -> DataFrame:
    """Drop redelivered alerts: the same key within the watermark counts once."""
    return alerts.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def fan_out(stream: DataFrame, consumers, checkpoint: str):
    """Hand every micro-batch to several consumers, ``f(batch, batch_id)``, from one evaluation."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for f in consumers:
                f(batch, batch_id)
        finally:
            batch.unpersist()
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def table_consumer(path: str, transform=None):
    """Consumer that writes each batch to its own folder, so that a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch if transform is None else transform(batch)
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def windowed_counts(scored: DataFrame, *, ts: str = "event_ts", score: str = "fraud_score", delay: str = "10 minutes",
                    width: str = "1 hour", slide: str | None = None, threshold: float = 0.7) -> DataFrame:
    """Predictions and alert rate per event-time window and risk level."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    s = F.col(score)
    return scored.withWatermark(ts, delay).groupBy(w.alias("w"), S.risk_level(s).alias("risk_level")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((s >= threshold).cast("double")).alias("alert_rate")).select(
        F.col("w.start").alias("window_start"), "risk_level", "n", "alert_rate")


def join_labels(predictions: DataFrame, labels: DataFrame, *, days: int = 90, delay: str = "1 day") -> DataFrame:
    """Stream-stream left join of labels that arrive up to ``days`` after their prediction."""
    p = predictions.withWatermark("pred_ts", delay).alias("p")
    l = labels.withWatermark("label_ts", delay).alias("l")
    cond = F.expr(f"p.transaction_id = l.transaction_id AND l.label_ts BETWEEN p.pred_ts AND p.pred_ts + INTERVAL {days} DAYS")
    return p.join(l, cond, "left").select("p.transaction_id", "p.score", "p.pred_ts", "l.label", "l.label_ts")


def run_to_end(writer):
    """Process all available input and stop."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q
