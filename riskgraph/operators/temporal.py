"""Causal time features per card and over all transactions, and the 39-column temporal view.

Rows are ordered by (time, id).  A window of w seconds at a row holds the rows up to and
including it whose time is >= t - w.  Spark's RANGE frame would also take later rows of the same
second and re-adds the whole frame for every row, so the windows are sweeps instead: each row
also appears as an expiry at t + w, and running sums over arrivals and expiries give every
window in one sorted pass, whatever its width.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgraph.functions import scalar as S
from riskgraph.functions.quantiles import quantile_list
from riskgraph.plans.hot import (
    MIN_ROWS, PIECE, attach, find_hot, group_window, piece_of, with_edges, with_piece,
)
from riskgraph.plans.lineage import cut
from riskgraph.plans.scan import running_sums
from riskgraph.schema import (
    AMOUNT, AMOUNT_FEATURES, CARD, DAY, HOUR, ID, TEMPORAL_FEATURES, TIME, WEEK,
)


def card_causal(
    df: DataFrame,
    *,
    key: str = CARD,
    time: str = TIME,
    ident: str = ID,
    amount: str = AMOUNT,
    windows=(HOUR, DAY),
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Per-card history of every row, up to and including the row itself.

    Adds ``n_seen, prev_time, first_time, gap, gap_mean, gap_std, cum_amount, acceleration, jerk``
    and ``n_<w>s, sum_<w>s`` per window.  Cards with very many rows are cut into time pieces.
    """
    cols = df.columns
    hot = find_hot(df, [key], time, min_rows=min_rows)
    t, a = F.col(time), F.coalesce(F.col(amount).cast("double"), F.lit(0.0))

    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), t.alias("t")),
        *[F.struct(F.lit(i + 1).alias("kind"), (t + w).alias("t")) for i, w in enumerate(windows)],
    )
    src = with_edges(df, hot)
    if hot is None:
        src = src.withColumn("_edges", F.lit(None))
    ev = src.select(
        F.col(key).alias("_key"), F.col(ident).alias("_id"), a.alias("_amt"), t.alias("_time"),
        "_edges", F.struct(*cols).alias("_row"), F.explode(kinds).alias("_e"),
    ).select(
        "_key", "_id", "_amt", "_time", F.col("_e.kind").alias("_kind"), F.col("_e.t").alias("_t"),
        # Only arrivals carry the row; expiries are narrow.
        F.when(F.col("_e.kind") == 0, F.col("_row")).alias("_row"),
        (F.lit(0) if hot is None else piece_of(F.col("_edges"), F.col("_e.t"))).alias(PIECE),
        F.col("_edges").isNotNull().alias("_hot"),
    )
    order = Window.partitionBy("_key", PIECE).orderBy("_t", "_kind", "_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    here = F.col("_kind") == 0

    def net(kind: int, value):
        return F.when(here, value).when(F.col("_kind") == kind, -value).otherwise(F.lit(0))

    s = ev.select(
        "*",
        F.sum(here.cast("long")).over(upto).alias("n_seen"),
        F.sum(F.when(here, F.col("_amt"))).over(upto).alias("cum_amount"),
        F.first(F.when(here, F.col("_time")), ignorenulls=True).over(upto).alias("first_time"),
        F.last(F.when(here, F.struct(F.col("_time").alias("t"), F.col("_amt").alias("a"))),
               ignorenulls=True).over(before).alias("_prev"),
        *[F.sum(net(i + 1, F.lit(1).cast("long"))).over(upto).alias(f"n_{w}s")
          for i, w in enumerate(windows)],
        *[F.sum(net(i + 1, F.col("_amt"))).over(upto).alias(f"sum_{w}s")
          for i, w in enumerate(windows)],
    )
    if hot is not None:
        s = _add_card_carry(s, df, hot, key, time, ident, a, windows)
    s = s.withColumns({
        "gap": F.when(here & F.col("_prev").isNotNull(), t_minus("_time", "_prev.t")),
        "acceleration": F.when(here, F.coalesce(F.col("_amt") - F.col("_prev.a"), F.lit(0.0))),
    })
    s = s.select(
        "*",
        F.last("acceleration", ignorenulls=True).over(before).alias("_prev_acc"),
        F.sum(F.col("gap").cast("double") * F.col("gap")).over(upto).alias("_gap_sq"),
    )
    if hot is not None:
        s = _add_gap_carry(s)
    m = F.col("n_seen") - 1
    span = F.col("_time") - F.col("first_time")
    gap_var = (m * F.col("_gap_sq") - span.cast("double") * span) / (m.cast("double") * m)
    rows = s.filter(here)
    return rows.select(
        *[F.col(f"_row.{c}").alias(c) for c in cols],
        "n_seen",
        F.col("_prev.t").alias("prev_time"),
        "first_time",
        F.coalesce("gap", F.lit(0)).alias("gap"),
        F.when(m > 0, span / m).otherwise(0.0).alias("gap_mean"),
        F.when(m > 0, F.sqrt(F.greatest(gap_var, F.lit(0.0)))).otherwise(0.0).alias("gap_std"),
        "cum_amount",
        "acceleration",
        F.when(F.col("_prev").isNotNull(), F.col("acceleration") - F.col("_prev_acc"))
        .otherwise(0.0).alias("jerk"),
        *[f"n_{w}s" for w in windows],
        *[f"sum_{w}s" for w in windows],
    )


def t_minus(a: str, b: str):
    return F.col(a) - F.col(b)


def _add_card_carry(s, df, hot, key, time, ident, amount, windows):
    """Add what earlier pieces of a hot card contribute: totals, last row and open windows."""
    base = with_edges(df, hot, "inner").select(
        F.col(key).alias("_key"), F.col(ident).alias("_id"), F.col(time).alias("_time"),
        amount.alias("_amt"), "_edges", piece_of(F.col("_edges"), F.col(time)).alias(PIECE),
    )
    per = base.groupBy("_key", PIECE).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_amt").alias("_a"), F.min("_time").alias("_f"),
        F.max(F.struct("_time", "_id", "_amt")).alias("_l"),
    )
    # Pieces that receive only expiries need a carry row as well.
    grid = hot.table.select(
        F.col(hot.keys[0]).alias("_gk"),
        F.explode(F.sequence(F.lit(0), F.size("_edges"))).alias("_gp"),
    )
    g = group_window(["_gk"]).orderBy("_gp").rowsBetween(Window.unboundedPreceding, -1)
    per = grid.join(per, F.col("_gk").eqNullSafe(F.col("_key")) & (F.col("_gp") == F.col(PIECE)), "left")
    carry = per.select(
        F.col("_gk").alias("_key"), F.col("_gp").alias(PIECE),
        F.sum("_n").over(g).alias("_c_n"), F.sum("_a").over(g).alias("_c_a"),
        F.min("_f").over(g).alias("_c_f"),
        F.last("_l", ignorenulls=True).over(g).alias("_c_l"),
    )
    s = attach(s, carry, ["_key"])
    for w in windows:
        ends = base.withColumn("_to", piece_of(F.col("_edges"), F.col("_time") + w))
        open_ = (
            ends.filter(F.col("_to") > F.col(PIECE))
            .groupBy("_key", PIECE, "_to").agg(F.count(F.lit(1)).alias("_n"), F.sum("_amt").alias("_a"))
            .select("_key", "_n", "_a",
                    F.explode(F.sequence(F.col(PIECE) + 1, F.col("_to"))).alias(PIECE))
            .groupBy("_key", PIECE)
            .agg(F.sum("_n").alias(f"_o_n{w}"), F.sum("_a").alias(f"_o_a{w}"))
        )
        s = attach(s, open_, ["_key"])
    zero = F.lit(0)
    return s.withColumns({
        "n_seen": F.col("n_seen") + F.coalesce("_c_n", zero),
        "cum_amount": F.coalesce("cum_amount", zero) + F.coalesce("_c_a", zero),
        "first_time": F.coalesce("_c_f", "first_time"),
        "_prev": F.coalesce(
            F.col("_prev"),
            F.when(F.col("_c_l").isNotNull(),
                   F.struct(F.col("_c_l._time").alias("t"), F.col("_c_l._amt").alias("a"))),
        ),
        **{f"n_{w}s": F.col(f"n_{w}s") + F.coalesce(f"_o_n{w}", zero) for w in windows},
        **{f"sum_{w}s": F.col(f"sum_{w}s") + F.coalesce(f"_o_a{w}", zero) for w in windows},
    }).drop("_c_n", "_c_a", "_c_f", "_c_l", *[f"_o_{x}{w}" for x in "na" for w in windows])


def _add_gap_carry(s):
    """Second carry of hot cards: squared gaps and the last acceleration of earlier pieces."""
    hot_rows = s.filter((F.col("_kind") == 0) & F.col("_hot"))
    per = hot_rows.groupBy("_key", PIECE).agg(
        F.sum(F.col("gap").cast("double") * F.col("gap")).alias("_g"),
        F.max(F.struct("_time", "_id", "acceleration")).alias("_l"),
    )
    g = Window.partitionBy("_key").orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(
        "_key", PIECE, F.sum("_g").over(g).alias("_c_g"),
        F.last("_l.acceleration", ignorenulls=True).over(g).alias("_c_acc"),
    )
    carry = cut(carry, "gapcarry")
    s = attach(s, carry, ["_key"])
    return s.withColumns({
        "_gap_sq": F.coalesce("_gap_sq", F.lit(0.0)) + F.coalesce("_c_g", F.lit(0.0)),
        "_prev_acc": F.coalesce("_prev_acc", "_c_acc"),
    }).drop("_c_g", "_c_acc")


def second_windows(df: DataFrame, *, time: str = TIME, amount: str = AMOUNT,
                   windows=(HOUR, DAY, WEEK)) -> DataFrame:
    """Window counts and sums over *all* rows, one row per distinct second.

    The table is bounded by the time span, not by the rows.  It is swept per day; what the
    windows hold at midnight comes from a table of day pairs.  Columns: ``second`` with its own
    ``second_n, second_sum``, ``prev_second`` (previous non-empty one) and
    ``second_n_<w>s, second_sum_<w>s`` at its end.
    """
    a = F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    # Read three times below, so written once: one row per distinct second.
    per = cut(df.groupBy(F.col(time).alias("_time")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(a).alias("_s")
    ), "seconds")
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("_time").alias("t")),
        *[F.struct(F.lit(i + 1).alias("kind"), (F.col("_time") + w).alias("t"))
          for i, w in enumerate(windows)],
    )
    ev = per.select("*", F.explode(kinds).alias("_e")).select(
        "_time", "_n", "_s", F.col("_e.kind").alias("_kind"), F.col("_e.t").alias("_t"),
        F.floor(F.col("_e.t") / DAY).alias("_day"),
    )
    order = Window.partitionBy("_day").orderBy("_t", "_kind")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    here = F.col("_kind") == 0

    def net(kind: int, value: str):
        return F.when(here, F.col(value)).when(F.col("_kind") == kind, -F.col(value)).otherwise(0)

    out = ev.select(
        "*",
        F.last(F.when(here, F.col("_time")), ignorenulls=True).over(before).alias("prev_second"),
        *[F.sum(net(i + 1, "_n")).over(upto).alias(f"n_{w}s") for i, w in enumerate(windows)],
        *[F.sum(net(i + 1, "_s")).over(upto).alias(f"sum_{w}s") for i, w in enumerate(windows)],
    ).filter(here)

    day = F.floor(F.col("_time") / DAY)
    # One row per day of history and window: the parts of earlier days still open at midnight.
    ends = F.array(*[
        F.struct(F.lit(i).alias("w"), F.floor((F.col("_time") + w) / DAY).alias("to"))
        for i, w in enumerate(windows)
    ])
    open_ = (
        per.select(day.alias("_from"), "_n", "_s", F.explode(ends).alias("_x"))
        .groupBy("_from", F.col("_x.w").alias("_w"), F.col("_x.to").alias("_to"))
        .agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
        .filter(F.col("_to") > F.col("_from"))
        .select("_w", "_n", "_s", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))).alias("_day"))
        .groupBy("_day").agg(
            *[F.sum(F.when(F.col("_w") == i, F.col("_n"))).alias(f"_on{i}") for i in range(len(windows))],
            *[F.sum(F.when(F.col("_w") == i, F.col("_s"))).alias(f"_os{i}") for i in range(len(windows))],
        )
    )
    last = per.groupBy(day.alias("_day")).agg(F.max("_time").alias("_last"))
    g = Window.partitionBy(F.lit(0)).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    prev = last.select("_day", F.last("_last").over(g).alias("_prev_day_last"))
    zero = F.lit(0)
    return (
        out.join(open_, "_day", "left").join(prev, "_day", "left")
        .select(
            F.col("_time").alias("second"), F.col("_n").alias("second_n"),
            F.col("_s").alias("second_sum"),
            F.coalesce("prev_second", "_prev_day_last").alias("prev_second"),
            *[(F.col(f"n_{w}s") + F.coalesce(f"_on{i}", zero)).alias(f"second_n_{w}s")
              for i, w in enumerate(windows)],
            *[(F.col(f"sum_{w}s") + F.coalesce(f"_os{i}", zero)).alias(f"second_sum_{w}s")
              for i, w in enumerate(windows)],
        )
    )


def global_causal(
    df: DataFrame,
    *,
    time: str = TIME,
    ident: str = ID,
    amount: str = AMOUNT,
    windows=(HOUR, DAY, WEEK),
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Window counts and sums over all transactions, up to and including each row.

    Adds ``g_gap`` (seconds since the previous transaction) and ``g_n_<w>s, g_sum_<w>s``.
    """
    per = second_windows(df, time=time, amount=amount, windows=windows)
    a = F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    ranked = running_sums(df, [time], ident, {"_rank": F.lit(1), "_run": a}, min_rows=min_rows)
    j = ranked.join(per, ranked[time] == per["second"], "left")
    later_n = F.col("second_n") - F.col("_rank")
    later_s = F.col("second_sum") - F.col("_run")
    return j.select(
        *[ranked[c] for c in df.columns],
        F.when(F.col("_rank") == 1, F.coalesce(ranked[time] - F.col("prev_second"), F.lit(0)))
        .otherwise(0).alias("g_gap"),
        *[(F.col(f"second_n_{w}s") - later_n).alias(f"g_n_{w}s") for w in windows],
        *[(F.col(f"second_sum_{w}s") - later_s).alias(f"g_sum_{w}s") for w in windows],
    )


@dataclass
class TemporalModel:
    """Fitted amount statistics: a few numbers and one table keyed by card."""

    amount_mean: float
    amount_std: float
    p05: float
    p95: float
    cards: DataFrame

    def transform(self, df: DataFrame, *, min_rows: int = MIN_ROWS) -> DataFrame:
        """The 39 temporal and amount columns plus ``TransactionID``."""
        need = df.select(ID, TIME, CARD, F.coalesce(F.col(AMOUNT).cast("double"), F.lit(0.0)).alias(AMOUNT))
        x = card_causal(need, min_rows=min_rows)
        x = global_causal(x, min_rows=min_rows)
        st = self.cards.select(F.col("key").alias("_k"), "mean_amt", "max_amt", "min_amt", "first_seen")
        x = x.join(st, x[CARD].eqNullSafe(F.col("_k")), "left")
        t, a = F.col(TIME), F.col(AMOUNT)
        hour, dow = S.hour_of(t), S.day_of_week(t)
        hour_sin, hour_cos = S.cycle(hour, 24)
        dow_sin, dow_cos = S.cycle(dow, 7)
        known = F.col("mean_amt").isNotNull()

        def rel(value):
            return F.when(known, value).otherwise(0.0)

        out = {
            "feat_hour_sin": hour_sin, "feat_hour_cos": hour_cos,
            "feat_dow_sin": dow_sin, "feat_dow_cos": dow_cos,
            "feat_hour": hour, "feat_dow": dow,
            "feat_is_weekend": S.flag(dow >= 5),
            "feat_is_night": S.is_night(hour),
            "feat_is_business_hours": S.is_business_hours(hour, dow),
            "feat_seconds_since_last_txn": F.col("g_gap"),
            "feat_seconds_since_last_card_txn": F.col("gap"),
            "feat_seconds_since_first_card_txn":
                t - F.coalesce(F.col("first_seen"), F.col("first_time")),
            "feat_txn_count_1h": F.col(f"g_n_{HOUR}s"),
            "feat_txn_count_24h": F.col(f"g_n_{DAY}s"),
            "feat_txn_count_7d": F.col(f"g_n_{WEEK}s"),
            "feat_card_txn_count_1h": F.col(f"n_{HOUR}s"),
            "feat_card_txn_count_24h": F.col(f"n_{DAY}s"),
            "feat_velocity_1h": F.col(f"g_n_{HOUR}s") / 1.0,
            "feat_velocity_24h": F.col(f"g_n_{DAY}s") / 24.0,
            "feat_velocity_7d": F.col(f"g_n_{WEEK}s") / 168.0,
            "feat_interarrival_mean_card": F.col("gap_mean"),
            "feat_interarrival_std_card": F.col("gap_std"),
            "feat_interarrival_last_card": F.col("gap"),
            "feat_amt_log1p": S.log_amount(a),
            "feat_amt_cents": S.cents(a),
            "feat_amt_zscore": (a - self.amount_mean) / max(self.amount_std, 1e-9),
            "feat_amt_percentile": S.position_between(a, self.p05, self.p95),
            "feat_amt_cum_1h": F.col(f"g_sum_{HOUR}s"),
            "feat_amt_cum_24h": F.col(f"g_sum_{DAY}s"),
            "feat_amt_cum_7d": F.col(f"g_sum_{WEEK}s"),
            "feat_amt_card_cum": F.col("cum_amount"),
            "feat_amt_vs_card_mean": rel(a - F.col("mean_amt")),
            "feat_amt_vs_card_max": rel(a - F.col("max_amt")),
            "feat_amt_ratio_to_card_min": rel(a / F.greatest(F.col("min_amt"), F.lit(1e-6))),
            "feat_amt_ratio_to_card_max": rel(a / F.greatest(F.col("max_amt"), F.lit(1e-6))),
            "feat_amt_above_p95": S.flag(a > self.p95),
            "feat_amt_below_p05": S.flag(a < self.p05),
            "feat_amt_acceleration": F.col("acceleration"),
            "feat_amt_jerk": F.col("jerk"),
        }
        return x.select(ID, *[out[c].alias(c) for c in TEMPORAL_FEATURES + AMOUNT_FEATURES])

    def globals(self) -> dict[str, float]:
        return {"amount_mean": self.amount_mean, "amount_std": self.amount_std,
                "p05": self.p05, "p95": self.p95}

    def tables(self) -> dict[str, DataFrame]:
        return {"cards": self.cards}

    @classmethod
    def restore(cls, spark: SparkSession, values: dict, tables: dict) -> TemporalModel:
        return cls(**values, **tables)


def fit_temporal(df: DataFrame, fit_filter=None) -> TemporalModel:
    """Learn amount statistics from ``df`` (or from its rows under ``fit_filter``)."""
    if fit_filter is not None:
        df = df.filter(fit_filter)
    a = F.coalesce(F.col(AMOUNT).cast("double"), F.lit(0.0))
    rows = df.select(CARD, TIME, a.alias(AMOUNT), F.col(AMOUNT).alias("_raw"))
    mean, std = rows.agg(F.avg(AMOUNT), F.stddev_pop(AMOUNT)).first()
    p05, p95 = quantile_list(rows, AMOUNT, [0.05, 0.95])
    return TemporalModel(float(mean), float(std) or 1.0, p05, p95, card_amount_stats(df))


def card_amount_stats(df: DataFrame) -> DataFrame:
    """Per card: mean, sample deviation (0 for one row), extremes and first time."""
    return (
        df.filter(F.col(CARD).isNotNull()).groupBy(F.col(CARD).alias("key")).agg(
            F.avg(AMOUNT).alias("mean_amt"),
            F.coalesce(F.stddev_samp(AMOUNT), F.lit(0.0)).alias("std_amt"),
            F.max(AMOUNT).alias("max_amt"), F.min(AMOUNT).alias("min_amt"),
            F.min(TIME).alias("first_seen"),
        )
    )
