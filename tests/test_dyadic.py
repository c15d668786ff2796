"""Range aggregates by the block tree against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from riskgraph.plans.dyadic import cover, levels_for, range_summary, tree

ARGS = dict(probe_id="pid", key="c", time="t", amount="a", label="y")


@pytest.mark.parametrize("bits", [1, 3, 4])
def test_cover_is_the_range_without_overlap(spark, bits):
    rng = random.Random(bits)
    ranges = [(lo, lo + w) for lo, w in [(0, 0), (0, 63), (-5, 9), (-64, 63), (7, 1), (15, 1), (16, 15)]]
    ranges += [(lo, lo + rng.randrange(700)) for lo in (rng.randrange(-900, 900) for _ in range(60))]
    top = levels_for(300, bits)
    df = spark.createDataFrame(ranges, "lo long, hi long").withColumn("z", cover(F.col("lo"), F.col("hi"), top, bits))
    for r in df.collect():
        got = [s for e in r["z"] for s in range(e["_block"] << bits * e["_level"], (e["_block"] + 1) << bits * e["_level"])]
        assert sorted(got) == list(range(r["lo"], r["hi"] + 1))
        below = sum(e["_level"] < top for e in r["z"])
        assert below <= top * 2 * (2 ** bits - 1)


@pytest.mark.parametrize("min_rows", [2, 2_000_000])
def test_one_card_with_nine_tenths_of_the_rows(spark, min_rows):
    rng = random.Random(4)
    cards = [1] * 9 + [2, 3, None]
    hist = [(rng.choice(cards), rng.randrange(-2000, 9000), rng.choice([None, 0.5, 1.25, 30.0]), rng.choice([0, 1, None]))
            for _ in range(1500)]
    hist += [(1, 500, 2.0, 1)] * 20  # ties
    hist += [(1, None, 2.0, 1)]
    probes = [(f"p{i}", rng.choice([1, 1, 1, 2, 3, 9]), lo := rng.randrange(-3000, 9000), lo + rng.choice([0, 3, 90, 800, 4000]))
              for i in range(150)]
    probes += [("null", None, 0, 10), ("back", 1, 10, 9), ("open", 1, None, 9), ("all", 1, -5000, 20000)]
    h = spark.createDataFrame(hist, "c long, t long, a double, y int").repartition(3)
    p = spark.createDataFrame(probes, "pid string, c long, lo long, hi long")
    got = {r["pid"]: r for r in range_summary(p, h, lo=F.col("lo"), hi=F.col("hi"), span=800, min_rows=min_rows, share=0.0005, **ARGS).collect()}
    assert set(got) == {x[0] for x in probes if x[1] is not None}
    for pid, c, lo, hi in probes:
        if c is None:
            continue
        rows = [x for x in hist if x[0] == c and lo is not None and x[1] is not None and lo <= x[1] <= hi]
        amounts = [x[2] for x in rows if x[2] is not None]
        r = got[pid]
        assert (r["n"], r["n_fraud"]) == (len(rows), sum(x[3] or 0 for x in rows)), pid
        assert (r["total"], r["max_amount"], r["min_amount"]) == (
            (sum(amounts), max(amounts), min(amounts)) if amounts else (None, None, None))
        assert r["first_time"] == min((x[1] for x in rows), default=None)


def test_empty_sides(spark):
    h = spark.createDataFrame([], "c long, t long, a double, y int")
    p = spark.createDataFrame([("x", 1, 0, 5)], "pid string, c long, lo long, hi long")
    (r,) = range_summary(p, h, lo=F.col("lo"), hi=F.col("hi"), span=10, **ARGS).collect()
    assert (r["n"], r["total"], r["first_time"]) == (0, None, None)
    assert range_summary(p.limit(0), h, lo=F.col("lo"), hi=F.col("hi"), span=10, **ARGS).collect() == []


def test_a_key_is_neither_sorted_nor_scanned(spark):
    """Nodes are hashed by (key, level, block), so a hot key is spread like any other."""
    h = spark.createDataFrame([(1, 1, 1.0, 0)], "c long, t long, a double, y int")
    plan = tree(h, key="c", time="t", amount="a", label="y", top=3)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan.replace("SortAggregate", "")
    assert "hashpartitioning(_key" in plan and "_block" in plan.split("hashpartitioning(_key")[1].split(")")[0]


def test_requests_are_never_broadcast(spark):
    """They are a hundred rows a probe, which the planner does not see."""
    h = spark.range(200).select(F.col("id").alias("TransactionID"), (F.col("id") % 5).alias("card1"), (F.col("id") * 977).alias("t"),
                                F.lit(1.0).alias("a"), F.lit(0).alias("y"))
    s = range_summary(h, h, probe_id="TransactionID", key="card1", lo=F.col("t") - 604800, hi=F.col("t"), time="t", amount="a",
                      label="y", span=604800)
    assert "BroadcastExchange" not in s._jdf.queryExecution().executedPlan().toString()
    assert s.agg(F.sum("n")).first()[0] == sum((i // 5) + 1 if 977 * (i - i % 5) <= 604800 else min(i // 5, 604800 // (977 * 5)) + 1 for i in range(200))


def test_alerts_keep_columns_of_their_rows(spark):
    from riskgraph.operators.evidence import alerts_from

    rows = spark.createDataFrame([(1, 0.9, 5.0, 7, 10, "x"), (2, 0.1, 5.0, 7, 11, "y")],
                                 "TransactionID long, fraud_score double, TransactionAmt double, card1 long, TransactionDT long, ProductCD string")
    assert [r["ProductCD"] for r in alerts_from(rows, keep=("ProductCD",)).collect()] == ["x"]
