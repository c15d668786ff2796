"""As-of lookups and trailing windows at given times, without pairing rows inside a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.plans.dyadic import range_summary
from riskgraph.plans.hot import MIN_ROWS, PIECE, attach, find_hot, group_window, piece_of, with_edges, with_piece


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, *,
              ttl: int | None = None, cols=None, min_rows: int = MIN_ROWS) -> DataFrame:
    """Latest ``right`` row per ``left`` row with the same key and ``right_time <= left_time``.

    Both sides are merged in time order and the last right row is carried forward; matches older
    than ``ttl`` seconds are dropped.  Adds ``cols`` of ``right`` and ``asof_age``.  ``right``
    needs one row per (key, time); of several, the largest struct wins.
    """
    cols = list(cols or [c for c in right.columns if c not in (key, right_time)])
    r = right.select(
        F.col(key).alias("_key"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"),
        F.struct(F.col(right_time).alias("_rt"), *cols).alias("_right"))
    l = left.select(
        F.col(key).alias("_key"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"),
        F.struct(*left.columns).alias("_left"))
    ev = l.unionByName(r, allowMissingColumns=True)
    hot = find_hot(ev.select("_key", "_t"), ["_key"], "_t", min_rows=min_rows)
    ev = with_piece(ev, hot)
    order = Window.partitionBy("_key", PIECE).orderBy("_t", "_side", F.col("_right").asc_nulls_last())
    m = ev.withColumn("_m", F.last("_right", ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_side") == 1)
    if hot is not None:
        last = with_piece(r, hot, "inner").groupBy("_key", PIECE).agg(
            F.max(F.struct("_t", "_right")).alias("_l"))
        grid = hot.table.select(
            F.col("_key"), F.explode(F.sequence(F.lit(0), F.size("_edges"))).alias(PIECE))
        last = grid.join(last, ["_key", PIECE], "left")
        g = group_window(["_key"]).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
        carry = last.select("_key", PIECE, F.last("_l._right", ignorenulls=True).over(g).alias("_c"))
        m = attach(m, carry, ["_key"]).withColumn("_m", F.coalesce("_m", "_c"))
    age = F.col("_t") - F.col("_m._rt")
    ok = age.isNotNull() if ttl is None else (age <= ttl)
    return m.select(
        *[F.col(f"_left.{c}").alias(c) for c in left.columns],
        *[F.when(ok, F.col(f"_m.{c}")).alias(c) for c in cols],
        F.when(ok, age).alias("asof_age"))


def counts_at(probes: DataFrame, history: DataFrame, windows, *, probe_id: str, key: str,
              probe_time: str, time: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """``probe_id, n_<w>s``: history rows of the same key with t - w <= time <= t, both ends in.

    A sweep: arrivals count up, expiries after time + w count down, a probe reads the sums after
    the arrivals and before the expiries of its second.
    """
    h = history.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(time).alias("_time"))
    hot = find_hot(h, ["_key"], "_time", min_rows=min_rows)
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("_time").alias("t")),
        *[F.struct(F.lit(i + 2).alias("kind"), (F.col("_time") + w).alias("t"))
          for i, w in enumerate(windows)])
    moves = h.select("_key", F.explode(kinds).alias("_e")).select(
        "_key", F.col("_e.kind").alias("_kind"), F.col("_e.t").alias("_time"))
    p = probes.select(F.col(key).alias("_key"), F.lit(1).alias("_kind"), F.col(probe_time).alias("_time"),
                      F.col(probe_id).alias("_pid"))
    # Equal moves of one key and second are counted before they travel.
    moves = moves.groupBy("_key", "_kind", "_time").agg(F.count(F.lit(1)).alias("_n"))
    ev = with_piece(p.withColumn("_n", F.lit(0).cast("long")).unionByName(moves, allowMissingColumns=True), hot)
    w_ = Window.partitionBy("_key", PIECE).orderBy("_time", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    s = ev.select("_key", PIECE, "_pid", "_kind", *[
        F.sum(F.when(F.col("_kind") == 0, F.col("_n")).when(F.col("_kind") == i + 2, -F.col("_n"))
              .otherwise(0)).over(w_).alias(f"n_{w}s") for i, w in enumerate(windows)])
    s = s.filter(F.col("_kind") == 1)
    if hot is not None:
        base = with_edges(h, hot, "inner").withColumn(PIECE, piece_of(F.col("_edges"), F.col("_time")))
        for w in windows:
            open_ = (
                base.withColumn("_to", piece_of(F.col("_edges"), F.col("_time") + w))
                .filter(F.col("_to") > F.col(PIECE)).groupBy("_key", PIECE, "_to")
                .agg(F.count(F.lit(1)).alias("_n"))
                .select("_key", "_n", F.explode(F.sequence(F.col(PIECE) + 1, F.col("_to"))).alias(PIECE))
                .groupBy("_key", PIECE).agg(F.sum("_n").alias("_o")))
            s = attach(s, open_, ["_key"]).withColumn(
                f"n_{w}s", F.col(f"n_{w}s") + F.coalesce("_o", F.lit(0))).drop("_o")
    return s.select(F.col("_pid").alias(probe_id), *[f"n_{w}s" for w in windows])


def window_summary_at(probes: DataFrame, history: DataFrame, window: int, *, probe_id: str, key: str,
                      probe_time: str, time: str, amount: str, label: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """Count, sum, extremes and labels of the trailing window at each probe, both ends inclusive."""
    at = F.col(probe_time).cast("long")
    return range_summary(probes, history, probe_id=probe_id, key=key, lo=at - window, hi=at, time=time, amount=amount,
                         label=label, span=window, min_rows=min_rows)
