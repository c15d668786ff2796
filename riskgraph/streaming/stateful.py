"""Keyed state: per-card rolling features, and an entity cache with a time to live."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskgraph.schema import DAY, HOUR

OUT = ("TransactionID long, card1 long, TransactionDT long, gap long, n_3600s long, n_86400s long, gap_mean double, "
       "gap_std double, cum_amount double, acceleration double, jerk double, late boolean")
STATE = T.StructType([
    T.StructField("times", T.ArrayType(T.LongType())), T.StructField("n", T.LongType()),
    T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("gap_sq", T.DoubleType()),
    T.StructField("amount", T.DoubleType()), T.StructField("last_amount", T.DoubleType()),
    T.StructField("last_acc", T.DoubleType()),
])


def _advance(key, batches, state: GroupState):
    """Advance one card by its new rows in (time, id) order; keeps 24 hours of times and totals.

    Nulls count as in the batch windows: rows without a card are a card of their own, a missing
    amount is 0.  A row older than the card's last one comes too late for the features of the rows
    after it: it is returned with ``late`` set and no features, and leaves the state as it is.
    """
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(batches)).sort_values(["TransactionDT", "TransactionID"], kind="stable")
    if state.exists:
        times, n, first, last, gap_sq, amount, last_amt, last_acc = state.get
        times = deque(times)
    else:
        times, n, first, last, gap_sq, amount, last_amt, last_acc = deque(), 0, None, None, 0.0, 0.0, None, 0.0
    card = None if pd.isna(key[0]) else int(key[0])
    hour = deque(t for t in times if last is not None and t >= last - HOUR)
    out = []
    for tid, t, a in zip(rows["TransactionID"], rows["TransactionDT"], rows["TransactionAmt"], strict=True):
        t, a = int(t), 0.0 if pd.isna(a) else float(a)
        seen = n > 0
        if seen and t < last:
            out.append((int(tid), card, t, *[None] * 8, True))
            continue
        gap = t - last if seen else 0
        first = first if seen else t
        acc = a - last_amt if seen else 0.0
        jerk = acc - last_acc if seen else 0.0
        n, amount, gap_sq = n + 1, amount + a, gap_sq + float(gap) * gap
        for kept, width in ((times, DAY), (hour, HOUR)):
            kept.append(t)
            while kept[0] < t - width:
                kept.popleft()
        m, span = n - 1, t - first
        var = (m * gap_sq - float(span) * span) / (float(m) * m) if m else 0.0
        out.append((int(tid), card, t, gap, len(hour), len(times),
                    span / m if m else 0.0, max(var, 0.0) ** 0.5, amount, acc, jerk, False))
        last, last_amt, last_acc = t, a, acc
    state.update((list(times), n, first, last, gap_sq, amount, last_amt, last_acc))
    kinds = {"long": "Int64", "double": "Float64", "boolean": "boolean"}
    fields = [c.split() for c in OUT.split(", ")]
    yield pd.DataFrame(out, columns=[c for c, _ in fields]).astype({c: kinds[k] for c, k in fields})


def card_features(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Per-card rolling features on a stream of ``TransactionID, TransactionDT, TransactionAmt, card1``.

    Equal to the batch windows for all rows that are not ``late``.  A card's rows of one
    micro-batch are held together, so the source must bound the batch (``maxOffsetsPerTrigger``,
    ``maxFilesPerTrigger``); between batches only 24 hours of times and a few totals are kept, and
    with ``idle_ms`` those of a card unseen for so long are dropped.  Large backfills belong to the
    batch operator, which splits hot cards.
    """
    x = stream.select("TransactionID", "TransactionDT", "TransactionAmt", "card1")
    if idle_ms is None:
        return x.groupBy("card1").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)

    def advance(key, batches, state):
        yield from _advance(key, batches, state)
        if state.exists:
            state.setTimeoutDuration(idle_ms)

    return x.groupBy("card1").applyInPandasWithState(advance, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def cache_snapshot(updates: DataFrame, now: int, ttl: int = HOUR, *, key: str = "key", ts: str = "ts",
                   warm: DataFrame | None = None) -> DataFrame:
    """Latest value per key not older than ``ttl`` seconds; ``warm`` adds earlier entries."""
    u = updates if warm is None else updates.unionByName(warm)
    fresh = u.filter((F.col(ts) >= now - ttl) & (F.col(ts) <= now))
    return fresh.groupBy(key).agg(F.max_by("value", ts).alias("value"), F.max(ts).alias(ts))
