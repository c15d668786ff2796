import random
import uuid

import pytest
from pyspark.sql import functions as F

from riskgraph.operators.temporal import card_causal
from riskgraph.schema import DAY, HOUR
from riskgraph.streaming import alerts as A
from riskgraph.streaming import processors as P

TX = "TransactionID long, TransactionDT long, TransactionAmt double, card1 long"


def run(spark, tmp_path, batches, schema, build):
    """Feeds each batch as one file per trigger and returns all output rows."""
    path, out, chk = (str(tmp_path / f"{n}-{uuid.uuid4().hex}") for n in ("in", "out", "chk"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = A.file_source(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    with P.state_store(spark):
        A.run_to_end(build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", chk))
    return spark.read.parquet(out)


def test_shuffled_rows_equal_the_batch(spark, tmp_path):
    draw = random.Random(4)
    t, rows = 1_000_000, []
    for i in range(700):
        t += draw.choice([0, 0, 1, 30, 59, 61, 600, 3600, 40_000])
        rows.append((i, t, draw.choice([None, 5.0, 7.25, 100.0]), draw.choice([1, 1, 1, 2, None])))
    end = 9 * DAY + t
    order = sorted(rows, key=lambda r: r[1] + draw.randrange(7000))
    batches = [order[k : k + 150] for k in range(0, len(order), 150)] + [[(9999, end, 1.0, 77)]]
    got = run(spark, tmp_path, batches, TX, lambda s: P.ordered_card_features(
        s.withColumn("event_ts", F.timestamp_seconds("TransactionDT")), delay="2 hours"))
    want = {r["TransactionID"]: r for r in card_causal(spark.createDataFrame(rows, TX)).collect()}
    got = got.collect()
    assert sorted(r["TransactionID"] for r in got) == list(range(700))
    for r in got:
        w = want[r["TransactionID"]]
        for c in r.asDict():
            if c in w.asDict():
                assert r[c] == pytest.approx(w[c], abs=1e-6), (c, r, w)


REQ = "request long, key long, op string, ts long, value double, ttl long"


def cached(stream, **kw):
    return P.cache_stream(stream.withColumn("event_ts", F.timestamp_seconds("ts")), **kw)


def test_hit_miss_expiry_and_warm_up_over_batches(spark, tmp_path):
    first = [(1, 1, "get", 1000, None, None), (2, 1, "set", 1010, 5.0, None), (3, 1, "get", 1010, None, None),
             (4, 2, "get", 1000, None, None), (5, 3, "set", 1000, 9.0, 50), (6, 3, "get", 1050, None, None),
             (7, 3, "get", 1051, None, None), (8, 4, "get", 1000, None, None), (9, 5, "set", 1000, None, None)]
    second = [(11, 1, "get", 1100, None, None), (12, 1, "get", 1111, None, None), (13, 1, "set", 1112, 6.0, None),
              (14, 1, "get", 1113, None, None), (15, 1, "delete", 1114, None, None), (16, 1, "get", 1115, None, None),
              (17, 2, "get", 1200, None, None), (18, 4, "get", 2001, None, None), (19, 5, "get", 1050, None, None)]
    warm = spark.createDataFrame([(2, 0.5, 1100), (2, 0.75, 1150), (4, 4.0, 2000)], "key long, value double, expires long")
    got = run(spark, tmp_path, [first, second], REQ, lambda s: cached(s, ttl=100, warm=warm))
    assert {r.request: (r.status, r.value) for r in got.collect()} == {
        1: ("miss", None), 3: ("hit", 5.0), 4: ("hit", 0.75), 6: ("hit", 9.0), 7: ("expired", None), 8: ("hit", 4.0),
        11: ("hit", 5.0), 12: ("expired", None), 14: ("hit", 6.0), 16: ("miss", None), 17: ("expired", None),
        18: ("expired", None), 19: ("hit", None)}


def test_timers_remove_what_has_ended(spark, tmp_path):
    """A value whose end the watermark has passed is gone, so a read finds nothing."""
    batches = [[(1, 1, "set", 1000, 5.0, None)], [(2, 9, "get", 1000 + 2 * HOUR, None, None)],
               [(3, 9, "get", 1001 + 2 * HOUR, None, None)], [(4, 1, "get", 1002 + 2 * HOUR, None, None)]]
    got = run(spark, tmp_path, batches, REQ, lambda s: cached(s, ttl=100, delay="1 minute"))
    assert {r.request: r.status for r in got.collect()} == {2: "miss", 3: "miss", 4: "miss"}


def test_a_stretch_of_time_is_one_batch(spark, tmp_path):
    """However many partitions the rows lie in: otherwise the rest of a stretch comes behind the watermark."""
    from riskgraph.queries.pipelines import _dealt

    rows = spark.range(0, 1000, numPartitions=7).select("id", (F.col("id") * 10).alias("t"))
    seen = []

    def note(batch, batch_id):
        seen.append(batch.agg(F.min("t"), F.max("t"), F.count("t")).first())

    A.run_to_end(_dealt(spark, rows, "t", 1).writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "chk")))
    assert sum(r[2] for r in seen) == 1000 and len(seen) == 5
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))


def test_ordered_features_ask_the_state_once_a_bucket(spark):
    """Many buckets due at once: one frame, and one reading and writing of the totals."""
    calls = []

    class Value:
        held = None

        def exists(self):
            calls.append("exists")
            return self.held is not None

        def get(self):
            return self.held

        def update(self, v):
            calls.append("update")
            self.held = v

    class Map(dict):
        containsKey = dict.__contains__
        getValue = dict.__getitem__
        updateValue = dict.__setitem__
        removeKey = dict.__delitem__

    class Handle:
        def __init__(self):
            self.timers = []

        def getMapState(self, *a):
            return Map()

        def getValueState(self, *a):
            return Value()

        def registerTimer(self, at):
            self.timers.append(at)

    class Now:
        def __init__(self, at):
            self.at = at

        def getExpiryTimeInMs(self):
            return self.at

        getCurrentWatermarkInMs = getExpiryTimeInMs

    import pandas as pd

    h, p = Handle(), P.OrderedCard()
    p.init(h)
    rows = pd.DataFrame({"TransactionID": range(50), "TransactionDT": [600 * i for i in range(50)], "TransactionAmt": [1.0] * 50})
    list(p.handleInputRows(("1",), iter([rows]), Now(0)))
    assert h.timers == [60_000]
    frames = list(p.handleExpiredTimer(("1",), Now(40 * 600_000), Now(60_000)))
    assert [len(f) for f in frames] == [40] and frames[0]["n_3600s"].tolist()[-1] == 7
    assert calls == ["exists", "update"] and h.timers[-1] == (40 * 10 + 1) * 60_000


def test_a_shard_reads_and_writes_its_state_once_a_call():
    """Fifty cards: before, each read and wrote its own entries; a minute of many rows lies apart."""
    import pandas as pd

    calls = []

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, v):
            calls.append("update")
            self.held = v

    class Map(dict):
        getValue = dict.__getitem__
        updateValue = dict.__setitem__
        removeKey = dict.__delitem__

    class Handle:
        timers, large = set(), Map()

        def getMapState(self, *a):
            return self.large

        def getValueState(self, *a):
            return Value()

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Now:
        def __init__(self, at):
            self.at = at

        def getExpiryTimeInMs(self):
            return self.at

        getCurrentWatermarkInMs = getExpiryTimeInMs

    h, p = Handle(), P.OrderedCards()
    p.init(h)
    cards, n = [str(c) for c in range(50)], P.INLINE + 1
    rows = pd.DataFrame({"TransactionID": range(50 + n), "TransactionDT": [60 * c for c in range(50)] + [90] * n,
                         "TransactionAmt": [1.0] * (50 + n), "entity": cards + ["7"] * n})
    list(p.handleInputRows((1,), iter([rows]), Now(0)))
    assert calls == ["update"] and h.timers == {60_000} and list(h.large) == [("7", "waiting", 1)]
    h.timers.remove(60_000)  # as a timer that has passed
    frames = list(p.handleExpiredTimer((1,), Now(30 * 60_000), Now(60_000)))
    assert [len(f) for f in frames] == [30 + n] and calls == ["update", "get", "update"]
    assert h.timers == {31 * 60_000} and list(h.large) == [("7", "kept", 1)]
    busy = frames[0][frames[0]["card1"] == 7]
    assert busy["n_3600s"].tolist() == list(range(1, n + 2))
