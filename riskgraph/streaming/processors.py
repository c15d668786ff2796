"""Keyed state with timers: per-card features in event order, and an entity cache that expires.

Both are stateful processors over value and map state, which lives in the state store (RocksDB) and
not in a task's memory; :func:`state_store` names that store to the session.  A call to the store costs far
more than a row, so :class:`Shard` keeps the small state of many keys in one entry, read and written once a call.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskgraph.schema import DAY, HOUR

STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, as these processors need."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STORE, before)



def _text(column: str) -> Column:
    """Ids as text to group by: a null key would not be told apart in state.  (Spark renames columns that begin with ``_``.)"""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("entity")


def _id(key) -> int | None:
    return int(key[0]) if key[0] else None


# -- many keys in one entry of state -----------------------------------------------------------------

#: Groups that the keys are dealt to by their hash.
SHARDS = 1024
#: Rows of a key's map value that lie in the shard's entry; a value with more has an entry of its own.
INLINE = 64


class _Value:
    """Value state of the key in hand."""

    def __init__(self, shard: Shard, name: str):
        self.shard, self.name = shard, name

    def exists(self) -> bool:
        return self.name in self.shard.now

    def get(self) -> tuple:
        return self.shard.now[self.name]

    def update(self, value: tuple) -> None:
        self.shard.now[self.name] = value

    def clear(self) -> None:
        self.shard.now.pop(self.name, None)


class _Map:
    """Map state of the key in hand, by whole numbers, with values that are tuples of lists; ``None`` marks one with an entry of its own."""

    def __init__(self, shard: Shard, name: str):
        self.shard, self.name = shard, name

    def _items(self) -> dict:
        return self.shard.now.setdefault(self.name, {})

    def _apart(self, at: tuple) -> tuple:
        return (self.shard.key, self.name, at[0])

    def keys(self) -> list[tuple]:
        return [(k,) for k in self._items()]

    def containsKey(self, at: tuple) -> bool:
        return at[0] in self._items()

    def getValue(self, at: tuple) -> tuple:
        value = self._items()[at[0]]
        return pickle.loads(self.shard.large.getValue(self._apart(at))[0]) if value is None else value

    def updateValue(self, at: tuple, value: tuple) -> None:
        items = self._items()
        if len(value[0]) > INLINE:
            self.shard.large.updateValue(self._apart(at), (pickle.dumps(value),))
            items[at[0]] = None
            return
        if at[0] in items and items[at[0]] is None:
            self.shard.large.removeKey(self._apart(at))
        items[at[0]] = value

    def removeKey(self, at: tuple) -> None:
        if self._items().pop(at[0]) is None:
            self.shard.large.removeKey(self._apart(at))


class Shard(StatefulProcessor):
    """Runs one processor for all keys of a shard: it is the handle of that processor, for the key in hand.

    ``packed``: the state and the timers of all keys of the shard.  ``large``: map values of more than
    ``INLINE`` rows, so a busy key adds a bounded part for each of its map keys.  The shard has one timer, the
    first of its keys'.
    """

    def __init__(self, make: Callable[[], StatefulProcessor]):
        self.make = make

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.packed = handle.getValueState("packed", "held binary, wake long")
        self.large = handle.getMapState("large", "key string, name string, item long", "held binary")
        self.states: dict[str, dict] = {}
        self.key, self.now, self.wake = "", {}, None
        self.each = self.make()
        self.each.init(self)

    def close(self) -> None:
        pass

    # the handle of the processor of one key

    def getValueState(self, name: str, schema: str) -> _Value:
        return _Value(self, name)

    def getMapState(self, name: str, key_schema: str, schema: str) -> _Map:
        return _Map(self, name)

    def registerTimer(self, at: int) -> None:
        self.now.setdefault("", set()).add(at)

    # the state of the shard

    def _load(self) -> None:
        self.states, self.wake = {}, None
        if self.packed.exists():
            held, self.wake = self.packed.get()
            self.states = pickle.loads(held)

    def _take(self, key: str) -> None:
        self.key, self.now = key, self.states.setdefault(key, {})

    def _store(self) -> None:
        self.states = {k: s for k, s in self.states.items() if any(s.values())}
        wake = min((t for s in self.states.values() for t in s.get("", ())), default=None)
        if wake != self.wake:
            if self.wake is not None:
                self.handle.deleteTimer(self.wake)
            if wake is not None:
                self.handle.registerTimer(wake)
        if self.states or self.packed.exists():
            self.packed.update((pickle.dumps(self.states), wake))
        self.states = {}

    def _due(self, timerValues, expiredTimerInfo) -> Iterator[tuple[str, int]]:
        """Loads the shard; each key with a timer that has passed, taken in hand, and the time that has passed."""
        self._load()
        at = expiredTimerInfo.getExpiryTimeInMs()
        passed = max(at, timerValues.getCurrentWatermarkInMs())
        if self.wake == at:
            self.wake = None  # it is gone by itself
        for key in list(self.states):
            self._take(key)
            timers = self.now.get("", set())
            if any(t <= passed for t in timers):
                self.now[""] = {t for t in timers if t > passed}
                yield key, passed


def _by_shard(df: DataFrame):
    return df.withColumn("shard", F.pmod(F.xxhash64("entity"), F.lit(SHARDS)).cast("int")).groupBy("shard")


def _by_key(some: pd.DataFrame, columns: list[str]) -> dict[str, list[tuple]]:
    out: dict[str, list] = {}
    for key, *row in zip(some["entity"].tolist(), *[some[c].tolist() for c in columns], strict=True):
        out.setdefault(key, []).append(tuple(row))
    return out


# -- per-card features ------------------------------------------------------------------------------

#: Seconds of one bucket: rows are put in order, and written to state, a bucket at a time.
WIDTH = 60
#: Results handed on at once, about.
OUT_ROWS = 4096
FEATURES = ("TransactionID long, card1 long, TransactionDT long, gap long, n_3600s long, n_86400s long, gap_mean double,"
            " gap_std double, cum_amount double, acceleration double, jerk double")
_KINDS = {"long": "Int64", "double": "Float64"}
_WINDOWS = (HOUR, DAY)


class OrderedCard(StatefulProcessor):
    """Rows wait in buckets of event time until the watermark has passed their bucket; then they are
    taken in (time, id) order.

    ``waiting``: rows by bucket.  ``kept``: times of the last 24 hours by bucket.  ``totals``: running
    figures, and for each window the first bucket it reaches and the rows from there on.  A call holds
    the rows of one bucket and the two that the windows begin in, the numbers of the buckets and at most
    ``OUT_ROWS`` results and one bucket's, however busy the card is; it asks the state for what it needs of
    each bucket once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "ids array<long>, times array<long>, amounts array<double>")
        self.kept = handle.getMapState("kept", "bucket long", "times array<long>")
        self.totals = handle.getValueState(
            "totals", "n long, first long, last long, gap_sq double, amount double, last_amount double, last_acc double,"
                      " from_hour long, in_hour long, from_day long, in_day long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for some in rows:
            amounts = some["TransactionAmt"].astype("float64").fillna(0.0)
            new = self.add(zip(some["TransactionID"].tolist(), some["TransactionDT"].tolist(), amounts.tolist(), strict=True))
            first = new if first is None else min(first, new)
        self._wake(first)
        return iter(())

    def add(self, rows) -> int:
        """Lets rows ``(id, time, amount)`` wait; the first of their buckets."""
        new: dict[int, list] = {}
        for r in rows:
            new.setdefault(int(r[1]) // WIDTH, []).append(r)
        for bucket, part in new.items():
            at = (bucket,)
            had = self.waiting.getValue(at) if self.waiting.containsKey(at) else ([], [], [])
            self.waiting.updateValue(at, tuple([*h, *n] for h, n in zip(had, zip(*part, strict=True), strict=True)))
        return min(new)

    def _wake(self, bucket: int | None) -> None:
        """A timer for the first of the waiting buckets; the others get theirs when it has passed."""
        if bucket is not None:
            self.handle.registerTimer((bucket + 1) * WIDTH * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for out in self.due(_id(key), passed):
            yield self._frame(out)

    def due(self, card: int | None, passed: int) -> Iterator[list[tuple]]:
        """Results of the buckets that lie before ``passed`` (milliseconds)."""
        waiting = sorted(k[0] for k in self.waiting.keys())
        due = [b for b in waiting if (b + 1) * WIDTH * 1000 <= passed]
        self._wake(next(iter(waiting[len(due):]), None))
        if not due:
            return
        totals = self.totals.get() if self.totals.exists() else None
        sizes = dict.fromkeys(k[0] for k in self.kept.keys())  # rows of a kept bucket, once they are known
        out: list[tuple] = []
        for bucket in due:
            rows = sorted(zip(*self.waiting.getValue((bucket,)), strict=True), key=lambda r: (r[1], r[0]))
            self.waiting.removeKey((bucket,))
            totals = self._advance(card, bucket, rows, totals, sizes, out)
            if len(out) >= OUT_ROWS:
                yield out
                out = []
        self.totals.update(totals)
        if out:
            yield out

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        fields = [c.split() for c in FEATURES.split(", ")]
        return pd.DataFrame({c: pd.array(v, dtype=_KINDS[k]) for (c, k), v in zip(fields, zip(*out, strict=True), strict=True)})

    def _leave(self, start: int, reach: int, drop: bool, sizes: dict) -> int:
        """Rows of the buckets from ``start`` to before ``reach``, which a window no longer holds."""
        gone = 0
        for b in [b for b in sizes if start <= b < reach]:
            if sizes[b] is None:
                sizes[b] = len(self.kept.getValue((b,))[0])
            gone += sizes[b]
            if drop:
                self.kept.removeKey((b,))
                del sizes[b]
        return gone

    def _advance(self, card, bucket: int, rows: list, totals: tuple | None, sizes: dict, out: list) -> tuple:
        """Adds the results of a bucket's rows to ``out`` and returns the new totals."""
        if totals is not None:
            n, first, last, gap_sq, amount, last_amt, last_acc, *spans = totals
        else:
            t = rows[0][1]
            n, first, last, gap_sq, amount, last_amt, last_acc = 0, t, t, 0.0, 0.0, 0.0, 0.0
            spans = [x for w in _WINDOWS for x in ((t - w) // WIDTH, 0)]
        begin: list[list[int]] = [[], []]  # times in the bucket where each window begins
        at = [None, None]
        for i, (tid, t, a) in enumerate(rows):
            counts = []
            for j, w in enumerate(_WINDOWS):
                reach = (t - w) // WIDTH
                if reach > spans[2 * j]:
                    spans[2 * j + 1] -= self._leave(spans[2 * j], reach, w == DAY, sizes)
                    spans[2 * j] = reach
                if at[j] != reach:
                    at[j], begin[j] = reach, self.kept.getValue((reach,))[0] if reach in sizes else []
                counts.append(spans[2 * j + 1] - sum(x < t - w for x in begin[j]) + i + 1)
            gap = t - last if n else 0
            acc = a - last_amt if n else 0.0
            jerk = acc - last_acc if n else 0.0
            n, amount, gap_sq = n + 1, amount + a, gap_sq + float(gap) * gap
            m, span = n - 1, t - first
            var = (m * gap_sq - float(span) * span) / (float(m) * m) if m else 0.0
            out.append((tid, card, t, gap, *counts, span / m if m else 0.0, max(var, 0.0) ** 0.5, amount, acc, jerk))
            last, last_amt, last_acc = t, a, acc
        self.kept.updateValue((bucket,), ([r[1] for r in rows],))
        sizes[bucket] = len(rows)
        for j in range(len(_WINDOWS)):
            spans[2 * j + 1] += len(rows)
        return (n, first, last, gap_sq, amount, last_amt, last_acc, *spans)


class OrderedCards(Shard):
    """:class:`OrderedCard` for the cards of a shard."""

    def __init__(self):
        super().__init__(OrderedCard)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        for some in rows:
            some["TransactionAmt"] = some["TransactionAmt"].astype("float64").fillna(0.0)
            for card, part in _by_key(some, ["TransactionID", "TransactionDT", "TransactionAmt"]).items():
                self._take(card)
                self.each._wake(self.each.add(part))
        self._store()
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        for card, passed in self._due(timerValues, expiredTimerInfo):
            for some in self.each.due(_id((card,)), passed):
                out.extend(some)
                if len(out) >= OUT_ROWS:
                    yield OrderedCard._frame(out)
                    out = []
        self._store()
        if out:
            yield OrderedCard._frame(out)


def ordered_card_features(stream: DataFrame, *, delay: str = "2 hours") -> DataFrame:
    """Per-card rolling features on a stream of ``TransactionID, TransactionDT, TransactionAmt, card1, event_ts``.

    Equal to the batch windows whatever order rows come in, as long as none is more than ``delay``
    behind the newest; such rows are dropped by the watermark, and counted in the query's progress.
    A row is returned once the watermark has passed its bucket.  Rows without a card are a card of
    their own, and a missing amount is 0.
    """
    x = stream.withWatermark("event_ts", delay).select("TransactionID", "TransactionDT", "TransactionAmt", _text("card1"), "event_ts")
    return _by_shard(x).transformWithStateInPandas(OrderedCards(), FEATURES, "append", "eventTime")


# -- cache ------------------------------------------------------------------------------------------

REQUEST = ["ts", "request", "op", "value", "ttl"]
ANSWERS = "request long, key long, ts long, status string, value double"


class ExpiringValue(StatefulProcessor):
    """One cached value per key with the second it expires; a timer removes it once the watermark is past."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value double, expires long")

    def _put(self, value, expires: int) -> None:
        self.entry.update((None if pd.isna(value) else float(value), expires))
        self.handle.registerTimer((expires + 1) * 1000)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for value, expires in zip(initialState["value"], initialState["expires"], strict=True):
            if not self.entry.exists() or int(expires) > self.entry.get()[1]:
                self._put(value, int(expires))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(rows))
        out = self.act(_id(key), zip(*[some[c].tolist() for c in REQUEST], strict=True))
        if out:
            yield self._frame(out)

    def act(self, key: int | None, rows) -> list[tuple]:
        """Answers to the reads among the requests of a key."""
        out = []
        for ts, request, op, value, ttl in sorted(rows, key=lambda r: (r[0], pd.isna(r[1]), r[1])):
            ts = int(ts)
            if op == "set":
                self._put(value, ts + (self.ttl if pd.isna(ttl) else int(ttl)))
            elif op == "delete":
                self.entry.clear()
            elif not self.entry.exists():
                out.append((int(request), key, ts, "miss", None))
            else:
                held, expires = self.entry.get()
                # Read only: rows of a later batch may be older and still find it alive.
                out.append((int(request), key, ts, *(("expired", None) if expires < ts else ("hit", held))))
        return out

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["request", "key", "ts", "status", "value"]).astype(
            {"request": "Int64", "key": "Int64", "ts": "Int64", "value": "Float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.expire(expiredTimerInfo.getExpiryTimeInMs())
        return iter(())

    def expire(self, passed: int) -> None:
        # A later write has moved the end; only what has ended goes.
        if self.entry.exists() and (self.entry.get()[1] + 1) * 1000 <= passed:
            self.entry.clear()

    def close(self) -> None:
        pass


class ExpiringValues(Shard):
    """:class:`ExpiringValue` for the keys of a shard."""

    def __init__(self, ttl: int):
        super().__init__(lambda: ExpiringValue(ttl))

    def registerTimer(self, at: int) -> None:
        self.now[""] = {at}  # the end of the last write is the only one that counts

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._load()
        for name, part in initialState.groupby("entity", sort=False):
            self._take(name)
            self.each.handleInitialState((name,), part, timerValues)
        self._store()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        asked: dict[str, list] = {}
        for some in rows:
            for name, part in _by_key(some, REQUEST).items():
                asked.setdefault(name, []).extend(part)
        out = []
        for name, part in asked.items():
            self._take(name)
            out.extend(self.each.act(_id((name,)), part))
        self._store()
        if out:
            yield ExpiringValue._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for _, passed in self._due(timerValues, expiredTimerInfo):
            self.each.expire(passed)
        self._store()
        return iter(())


def cache_stream(requests: DataFrame, *, ttl: int = HOUR, delay: str = "10 minutes", warm: DataFrame | None = None) -> DataFrame:
    """Answers to the reads of a cache: ``request, key, ts, status, value``, status hit, expired or miss.

    ``requests`` is a stream of ``request, key, op, ts, value, ttl, event_ts``; ``op`` is set, delete or
    get, times are seconds, and a null ``ttl`` takes the cache's.  A value holds to the end of its
    last second.  The requests of one key and micro-batch act in the order of (ts, request), so the
    source bounds the batch.  Requests without
    a key share one entry.  ``warm`` (``key, value, expires``) is what the cache begins with; of
    several rows of a key the longest-lived counts.
    """
    x = requests.withWatermark("event_ts", delay).select("request", _text("key"), "op", "ts", "value", "ttl", "event_ts")
    begin = None if warm is None else warm.select(_text("key"), F.col("value").cast("double").alias("value"), F.col("expires").cast("long").alias("expires"))
    begin = None if begin is None else _by_shard(begin)
    return _by_shard(x).transformWithStateInPandas(ExpiringValues(ttl), ANSWERS, "append", "eventTime", initialState=begin)
