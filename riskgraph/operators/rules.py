"""Alert rules as SQL expressions, rules with a hold time, and metric panels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.plans.hot import MIN_ROWS
from riskgraph.plans.scan import running_sums


@dataclass(frozen=True)
class Rule:
    """``predicate`` and ``reason`` are SQL expressions over the columns of the context row."""

    name: str
    severity: str
    description: str
    predicate: str
    reason: str = "'triggered'"


def default_rules(*, psi_alert=0.25, severe_features=10, latency_p95=0.05, error_rate=0.05, recall=0.55,
                  auprc=0.60, fraud_rate=0.10, agreement=0.90) -> list[Rule]:
    """The nine standing rules; every threshold is an argument."""
    f = "format_string"
    return [
        Rule("ModelNotLoaded", "critical", "the model failed to load",
             "NOT coalesce(model_loaded, true)", "'no model at startup'"),
        Rule("DataDriftSevere", "critical", f"overall PSI at or above {psi_alert}",
             f"coalesce(drift_overall, 0) >= {psi_alert}",
             f"{f}('overall PSI %.3f, %d severe features', drift_overall, coalesce(drift_severe, 0))"),
        Rule("DataDrift", "warning", f"more than {severe_features} features drift severely",
             f"coalesce(drift_severe, 0) > {severe_features}", f"{f}('%d severe features', drift_severe)"),
        Rule("ModelDegradation", "critical", f"AUPRC below {auprc}", f"auprc < {auprc}",
             f"{f}('AUPRC %.3f on %d labelled records', auprc, n_labelled)"),
        Rule("ModelPerformanceDegraded", "warning", f"recall below {recall}", f"recall < {recall}",
             f"{f}('recall %.3f on %d labelled records', recall, n_labelled)"),
        Rule("FraudRateSpike", "critical", f"fraud rate above {fraud_rate}",
             f"coalesce(production_fraud_rate, 0) > {fraud_rate}",
             f"{f}('fraud rate %.4f', production_fraud_rate)"),
        Rule("HighLatency", "warning", f"P95 latency above {latency_p95} s",
             f"coalesce(latency_p95, 0) > {latency_p95}", f"{f}('P95 %.4f s', latency_p95)"),
        Rule("HighErrorRate", "critical", f"error rate above {error_rate}",
             f"coalesce(error_rate, 0) > {error_rate}", f"{f}('error rate %.4f', error_rate)"),
        Rule("ShadowChallengerDisagreement", "warning", f"agreement below {agreement}",
             f"shadow_agreement < {agreement}", f"{f}('agreement %.3f', shadow_agreement)"),
    ]


def evaluate_rules(context: DataFrame, rules) -> DataFrame:
    """Fired rules per context row; a rule that cannot be evaluated fires as a warning."""
    items = []
    for r in rules:
        parts = [F.lit(r.name).alias("name"), F.lit(r.description).alias("description")]
        try:
            context.select(F.expr(r.predicate).cast("boolean"), F.expr(r.reason))
            fired = F.coalesce(F.expr(r.predicate).cast("boolean"), F.lit(False))
            parts += [F.lit(r.severity).alias("severity"), F.expr(r.reason).alias("reason"), fired.alias("fired")]
        except AnalysisException as exc:
            text = f"rule evaluation failed: {exc.getCondition() or type(exc).__name__}"
            parts += [F.lit("warning").alias("severity"), F.lit(text).alias("reason"), F.lit(True).alias("fired")]
        items.append(F.struct(*parts))
    keep = [c for c in ("ts",) if c in context.columns]
    return context.select(*keep, F.explode(F.array(*items)).alias("r")).filter("r.fired").select(
        *keep, "r.name", "r.severity", "r.description", "r.reason")


@dataclass(frozen=True)
class HoldRule:
    """Fires once ``condition`` has been true without a break for ``hold`` seconds."""

    name: str
    severity: str
    condition: str
    hold: int


# Conditions and hold times of the standing time rules.
HOLD_RULES = (
    HoldRule("HighErrorRate", "critical", "error_rate > 0.05", 300),
    HoldRule("HighLatency", "warning", "latency_p95 > 0.05", 600),
    HoldRule("FraudRateSpike", "critical", "production_fraud_rate > 0.10", 300),
    HoldRule("LabelDriftHigh", "warning", "label_drift > 0.05", 1800),
    HoldRule("DataDriftSevere", "critical", "drift_overall >= 0.25", 600),
    HoldRule("DataDriftModerate", "warning", "drift_overall >= 0.10 AND drift_overall < 0.25", 1800),
    HoldRule("DataDrift", "warning", "drift_severe > 10", 1800),
    HoldRule("PredictionDistributionDrift", "warning", "score_drift >= 0.25", 1800),
    HoldRule("ModelDegradation", "critical", "auprc < 0.60 AND n_labelled > 50", 3600),
    HoldRule("ModelPerformanceDegraded", "warning", "recall < 0.55 AND n_labelled > 50", 1800),
    HoldRule("ProductionAUROCDrop", "warning", "auroc < 0.85 AND n_labelled > 50", 3600),
    HoldRule("AgentInvestigationsFailing", "warning",
             "agent_errors / greatest(agent_calls, 0.001) > 0.10", 600),
    HoldRule("ShadowChallengerDisagreement", "warning", "shadow_agreement < 0.90", 1800),
    HoldRule("ModelNotLoaded", "critical", "predict_absent", 120),
)


def evaluate_hold_rules(history: DataFrame, rules, *, ts: str = "ts", min_rows: int = MIN_ROWS) -> DataFrame:
    """``rule, severity, ts, since``: every evaluation at which a rule is firing.

    ``history`` has one row per evaluation time (seconds).  An unbroken run of true conditions is
    an island: it is numbered by the running count of false rows before it.  A rule that cannot be
    evaluated on this history fires as a warning, as in :func:`evaluate_rules`.
    """
    known = set(history.columns)
    items = []
    for r in rules:
        try:
            history.select(F.expr(r.condition))
        except AnalysisException:
            # Never silent: a rule that cannot be read fires at every evaluation, as a warning.
            items.append(F.struct(F.lit(r.name).alias("rule"), F.lit("warning").alias("severity"),
                                  F.lit(0).alias("hold"), F.lit(True).alias("on")))
            continue
        items.append(F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.hold).alias("hold"),
            F.coalesce(F.expr(r.condition).cast("boolean"), F.lit(False)).alias("on")))
    assert ts in known
    long = history.select(F.col(ts).alias("ts"), F.explode(F.array(*items)).alias("r")).select("ts", "r.*")
    runs = running_sums(long, ["rule"], "ts", {"island": (~F.col("on")).cast("long")}, min_rows=min_rows)
    on = runs.filter("on")
    start = on.groupBy("rule", "island").agg(F.min("ts").alias("since"))
    return on.join(start, ["rule", "island"]).filter(F.col("ts") - F.col("since") >= F.col("hold")).select(
        "rule", "severity", "ts", "since")


def absent_windows(events: DataFrame, expected: DataFrame, width: int, *, series: str = "series",
                   ts: str = "ts") -> DataFrame:
    """(series, window) pairs of the observed time span in which an expected series is silent."""
    b = events.select(F.col(series).alias("series"), F.floor(F.col(ts) / width).alias("w"))
    lo, hi = b.agg(F.min("w"), F.max("w")).first()
    if lo is None:
        return expected.select("series", F.lit(None).cast("long").alias("window_start")).limit(0)
    grid = expected.select("series", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("w"))
    return grid.join(b.distinct(), ["series", "w"], "left_anti").select(
        "series", (F.col("w") * width).alias("window_start"))


def rate_panel(events: DataFrame, label: str, *, ts: str = "event_ts", width: str = "5 minutes",
               slide: str = "1 minute", seconds: int = 300) -> DataFrame:
    """Events per second by label in sliding windows."""
    return events.groupBy(F.window(ts, width, slide).alias("w"), F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "label", "n", (F.col("n") / seconds).alias("rate"))


def ratio_panel(events: DataFrame, condition, *, ts: str = "event_ts", width: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(condition.cast("double")).alias("ratio")).select(
        F.col("w.start").alias("window_start"), "n", "ratio")


def quantile_panel(events: DataFrame, value: str, prob: float = 0.95, *, ts: str = "event_ts",
                   width: str = "1 hour", max_group: int = MIN_ROWS) -> DataFrame:
    """Exact quantile per tumbling window."""
    from riskgraph.functions.quantiles import quantiles

    w = events.select(F.window(ts, width)["start"].alias("window_start"), value)
    return quantiles(w, ["window_start"], value, [prob], max_group=max_group).select(
        "window_start", F.col("q")[0].alias("value"))


def topk_panel(events: DataFrame, label: str, k: int, *, ts: str = "event_ts", width: str = "1 day") -> DataFrame:
    """The ``k`` most frequent labels per window."""
    n = events.groupBy(F.window(ts, width)["start"].alias("window_start"), F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("window_start").orderBy(F.desc("n"), "label")
    return n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def metric_rows(row: DataFrame, prefix: str, labels: dict[str, str] | None = None, *, ts: str = "ts") -> DataFrame:
    """Numeric columns of a snapshot as ``ts, name, labels, value`` rows for the metrics table."""
    cols = [f.name for f in row.schema.fields if f.name != ts and f.dataType.typeName() in (
        "double", "float", "integer", "long", "short", "byte")]
    items = F.array(*[F.struct(F.lit(f"{prefix}_{c}").alias("name"), F.col(c).cast("double").alias("value"))
                      for c in cols])
    pairs = [x for k, v in (labels or {}).items() for x in (F.lit(k), F.lit(v))]
    lab = F.create_map(*pairs) if pairs else F.expr("cast(map() AS map<string,string>)")
    return row.select(F.col(ts).alias("ts"), F.explode(items).alias("m")).select(
        "ts", "m.name", lab.alias("labels"), "m.value")


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """Latest value per name and label set."""
    key = F.to_json(F.col("labels"))
    return metrics.groupBy("name", key.alias("labels_json")).agg(
        F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))
