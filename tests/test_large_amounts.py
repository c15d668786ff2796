"""Streams over amounts beyond those of the test data, against their SQL."""

import datetime

import pytest
from compare import compare

from riskgraph.queries import load

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def large(spark, sf, tmp_path_factory):
    """The small tables with amounts whose score formula passes 1."""
    import shutil

    from compare import TABLES

    at = tmp_path_factory.mktemp("large")
    for t in TABLES:
        if t != "events":
            shutil.copy(f"{sf}/{t}.parquet", at)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=37 * i), i % 30, "view", 1.0 + 9 * i, f'{{"k": {i % 100}}}') for i in range(200)]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    e.toPandas().to_parquet(at / "events.parquet", coerce_timestamps="us")
    return str(at)


@pytest.mark.parametrize("name", ["stream_decode", "stream_dedupe"])
def test_messages_of_large_amounts(spark, large, name):
    ok, message, _ = compare(spark, QUERIES[name], ORACLES[name], large)
    assert ok, message
