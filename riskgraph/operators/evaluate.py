"""Scoring quality: curves, areas, top-k precision, calibration, windows of labelled records.

Everything that depends on the order of scores works on one table of counts per distinct score,
summed along the score with :func:`running_sums`; no sort of all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.functions.quantiles import quantile_list
from riskgraph.plans.hot import MIN_ROWS
from riskgraph.plans.lineage import cut
from riskgraph.plans.scan import row_index, running_sums
from riskgraph.schema import ID

TOP_SHARES = (0.001, 0.01, 0.05, 0.1)


def curve(df: DataFrame, score: str, label: str, keys=(), *, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per distinct score, from the highest down, with counts at or above it.

    ``score, n, pos`` of the score itself, ``n_at, tp, fp`` at or above, ``n_pos, n_neg`` in all,
    ``precision, recall, fpr, f1`` when flagging scores >= this one.
    """
    keys = list(keys)
    per = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(
        *keys, F.col(score).cast("double").alias("score")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    return curve_of_counts(per, keys, min_rows=min_rows)


def curve_of_counts(per: DataFrame, keys=(), *, min_rows: int = MIN_ROWS) -> DataFrame:
    """:func:`curve` from ``score, n, pos``, one row per distinct score (and key)."""
    keys = list(keys)
    per = per.withColumn("_down", -F.col("score"))
    r = running_sums(per, keys, "_down", {"n_at": F.col("n"), "tp": F.col("pos")},
                     min_rows=min_rows, totals=True)
    r = r.select(
        *keys, "score", "n", "pos", "n_at", "tp", (F.col("n_at") - F.col("tp")).alias("fp"),
        F.col("tp_total").alias("n_pos"), (F.col("n_at_total") - F.col("tp_total")).alias("n_neg"),
    )
    p = F.col("tp") / F.col("n_at")
    rec = F.col("tp") / F.greatest(F.col("n_pos"), F.lit(1))
    return r.select(
        "*", p.alias("precision"), rec.alias("recall"),
        (F.col("fp") / F.greatest(F.col("n_neg"), F.lit(1))).alias("fpr"),
        (2 * p * rec / F.greatest(p + rec, F.lit(1e-9))).alias("f1"),
    )


def areas(points: DataFrame, keys=()) -> DataFrame:
    """AUROC (average ranks for ties), average precision, and the threshold of the best F1."""
    neg = F.col("n") - F.col("pos")
    below = F.col("n_neg") - F.col("fp")
    wins = F.sum(F.col("pos") * (below + neg / 2.0))
    pairs = F.first("n_pos").cast("double") * F.first("n_neg")
    ap = F.sum(F.col("pos") / F.greatest(F.col("n_pos"), F.lit(1)) * F.col("precision"))
    best = F.max_by(F.struct("score", "f1", "precision", "recall", "tp", "fp", "n_pos", "n_neg"),
                    F.struct(F.col("f1"), -F.col("score")))
    out = points.groupBy(*keys).agg(
        F.sum("n").alias("n_total"), F.first("n_pos").alias("n_positive"),
        F.when(pairs > 0, wins / pairs).alias("auroc"),
        F.when(F.first("n_pos") > 0, ap).alias("auprc"), best.alias("_b"),
    )
    return out.select(
        *keys, "n_total", "n_positive", (F.col("n_positive") / F.col("n_total")).alias("fraud_rate"),
        "auroc", "auprc",
        F.col("_b.score").alias("best_threshold"), F.col("_b.f1").alias("best_f1"),
        F.col("_b.precision").alias("best_precision"), F.col("_b.recall").alias("best_recall"),
        F.col("_b.tp").alias("tp"), F.col("_b.fp").alias("fp"),
        (F.col("_b.n_pos") - F.col("_b.tp")).alias("fn"),
        (F.col("_b.n_neg") - F.col("_b.fp")).alias("tn"),
    )


def log_loss(score, label):
    p = F.least(F.greatest(score, F.lit(1e-7)), F.lit(1 - 1e-7))
    return F.avg(-(label * F.log(p) + (1 - label) * F.log(1 - p)))


def top_precision(df: DataFrame, score: str, label: str, shares=TOP_SHARES, *, ident: str = ID,
                  min_rows: int = MIN_ROWS) -> DataFrame:
    """``share, k, precision`` among the k = max(1, ceil(n * share)) best rows; ties by id."""
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        ident, (-F.col(score).cast("double")).alias("_down"), F.col(label).cast("int").alias("_y"))
    ranked = row_index(rows, "_down", ident, "_i", min_rows=min_rows)
    n = rows.count()
    ks = {s: max(1, -int(-(n * s) // 1)) for s in shares}
    agg = ranked.agg(*[F.avg(F.when(F.col("_i") < k, F.col("_y"))).alias(f"s{i}")
                       for i, k in enumerate(ks.values())])
    items = F.array(*[F.struct(F.lit(s).alias("share"), F.lit(k).alias("k"),
                               F.col(f"s{i}").alias("precision"))
                      for i, (s, k) in enumerate(ks.items())])
    return agg.select(F.explode(items).alias("x")).select("x.*")


def evaluate(df: DataFrame, score: str, label: str, keys=(), *, min_rows: int = MIN_ROWS) -> DataFrame:
    """Metric bundle, one row per key (model, split, ...): areas, best F1, confusion, log loss."""
    keys = list(keys)
    if not df.select(score).limit(1).count():
        raise ValueError("no predictions")
    a = areas(curve(df, score, label, keys, min_rows=min_rows), keys)
    y = F.col(label).cast("double")
    ll = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys).agg(
        log_loss(F.col(score), y).alias("log_loss"), F.avg((F.col(score) - y) ** 2).alias("brier"))
    if keys:
        return a.join(ll, keys)
    return a.withColumn("_one", F.lit(1)).join(ll.withColumn("_one", F.lit(1)), "_one").drop("_one")


def calibration(df: DataFrame, score: str, label: str, n_bins: int = 10) -> DataFrame:
    """Quantile bins (closed on the right) with mean score and share of positives."""
    edges = quantile_list(df, score, [i / n_bins for i in range(n_bins + 1)])
    b = F.lit(0)
    for e in edges[1:-1]:
        b = b + (F.col(score) > e).cast("int")
    return df.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"),
        F.avg(F.col(label).cast("double")).alias("positive_share"))


def snapshot(records: DataFrame, *, threshold: float = 0.5, score: str = "score",
             label: str = "label", ts: str = "ts", now=None, window_seconds: int | None = None,
             min_rows: int = MIN_ROWS) -> DataFrame:
    """Classification quality of the records of the last ``window_seconds`` (or of all)."""
    if window_seconds is not None:
        since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(window_seconds)} SECONDS")
        records = records.filter(F.col(ts) >= since)
    y, s = F.col(label), F.col(score)
    has = y.isNotNull()
    yes = s >= threshold
    m = records.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(has).alias("n_labelled"),
        F.count_if(y == 1).alias("n_positive"), F.count_if(has & yes).alias("n_predicted_positive"),
        F.count_if(yes & (y == 1)).alias("tp"), F.count_if(yes & (y == 0)).alias("fp"),
        F.count_if(~yes & (y == 1)).alias("fn"), F.count_if(~yes & (y == 0)).alias("tn"),
        F.avg(F.when(has, (s - y) ** 2)).alias("brier"),
        F.min(ts).alias("window_start"), F.max(ts).alias("window_end"),
    )
    one = F.lit(1)
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one)
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one)
    m = m.select(
        "*", p.alias("precision"), r.alias("recall"),
        (2 * p * r / F.greatest(p + r, F.lit(1e-12))).alias("f1"),
        ((F.col("tp") + F.col("tn")) / F.greatest(F.col("n_labelled"), one)).alias("accuracy"),
    ).withColumn("_one", one)
    a = areas(curve(records, score, label, min_rows=min_rows)).select(
        F.lit(1).alias("_one"), "auroc", "auprc")
    return m.join(a, "_one", "left").drop("_one")


def attach_labels(predictions: DataFrame, labels: DataFrame, *, key: str = "transaction_id") -> DataFrame:
    """Latest label per id onto the earlier predictions; unlabelled rows keep null."""
    latest = labels.groupBy(key).agg(F.max_by("label", "label_ts").alias("label"),
                                     F.max("label_ts").alias("label_ts"))
    return predictions.join(latest, key, "left")


def keep_latest(records: DataFrame, n: int, *, ts: str = "ts", ident: str = "transaction_id") -> DataFrame:
    """The ``n`` newest records, newest first (top-n per partition, then merged)."""
    return records.orderBy(F.col(ts).desc(), F.col(ident).desc()).limit(n)


def pair_shadow(champion: DataFrame, challenger: DataFrame, *, key: str = "transaction_id",
                threshold: float = 0.5, budget_ms: float = 100.0) -> DataFrame:
    """Champion and challenger score per id; ``skipped`` if the challenger is missing or too slow."""
    ch = challenger.select(F.col(key).alias("_k"), F.col("score").alias("challenger_score"),
                           F.col("latency_ms").alias("challenger_latency_ms"))
    j = champion.withColumnRenamed("score", "champion_score").join(ch, F.col(key) == F.col("_k"), "left")
    a, b = F.col("champion_score") >= threshold, F.col("challenger_score") >= threshold
    return j.drop("_k").select(
        "*", (F.col("challenger_score") - F.col("champion_score")).alias("score_delta"),
        a.alias("champion_label"), b.alias("challenger_label"), (a == b).alias("agreement"),
        F.coalesce(F.col("challenger_latency_ms") > budget_ms, F.col("challenger_score").isNull())
        .alias("skipped"),
    )


def shadow_summary(pairs: DataFrame) -> DataFrame:
    ok = ~F.col("skipped")
    delta = F.when(ok, F.abs("score_delta"))
    n = F.count_if(ok)
    return pairs.agg(
        n.alias("n_total"), F.count_if(ok & F.col("agreement")).alias("n_agreement"),
        F.count_if(ok & ~F.col("agreement")).alias("n_disagreement"),
        F.when(n > 0, F.count_if(ok & F.col("agreement")) / n).alias("agreement_rate"),
        F.avg(delta).alias("mean_score_delta"), F.max(delta).alias("max_score_delta"),
        F.count_if("skipped").alias("challenger_skipped"),
        F.min(F.when(ok, F.col("ts"))).alias("window_start"),
        F.max(F.when(ok, F.col("ts"))).alias("window_end"),
    )


def cached_curve(df: DataFrame, score: str, label: str, keys=()) -> DataFrame:
    """The curve as a written table, for several reports from one pass."""
    return cut(curve(df, score, label, keys), "curve")
