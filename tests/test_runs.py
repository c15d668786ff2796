"""Runs of the block tree against its plain cover."""

import random

import pytest
from pyspark.sql import functions as F

from riskgraph.plans.dyadic import cover, levels_for, reaches


@pytest.mark.parametrize("bits", [1, 3, 4])
def test_runs_are_the_cover_in_few_requests(spark, bits):
    rng = random.Random(bits)
    ranges = [(lo, lo + w) for lo, w in [(0, 0), (0, 63), (-5, 9), (-64, 63), (7, 1), (16, 15)]]
    ranges += [(lo, lo + rng.randrange(700)) for lo in (rng.randrange(-900, 900) for _ in range(60))]
    ranges += [(10_000_000 + lo, 10_000_000 + lo + 604_799) for lo in range(0, 100_000, 7919)]
    for span, part in ((300, ranges[:-13]), (604_800, ranges[-13:])):
        top = levels_for(span, bits)
        at = (F.col("lo"), F.col("hi"), top, bits)
        df = spark.createDataFrame(part, "lo long, hi long").withColumns({"z": cover(*at), "r": reaches(*at)})
        for row in df.collect():
            got = [(r["_level"], b) for r in row["r"] for b in range(r["_from"], r["_to"]) if b >> bits == r["_parent"]]
            assert sorted(got) == sorted((e["_level"], e["_block"]) for e in row["z"])
            assert sum(r["_level"] < top for r in row["r"]) <= 2 * top
            if span == 604_800:
                assert sum(r["_level"] == top for r in row["r"]) <= 3
