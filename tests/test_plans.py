"""Plans of the main operators, and registered queries against their SQL."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare
from riskgraph.operators import drift as D
from riskgraph.operators import evaluate as E
from riskgraph.operators import temporal as T
from riskgraph.operators.entity import fit_entity
from riskgraph.operators.graph.build import card_projection, homogeneous_keys
from riskgraph.plans.lineage import shared_root
from riskgraph.sources.tables import transactions

SAMPLE = ("card_velocity", "card_history_orders", "global_windows_orders", "clean_transform", "temporal_split", "evaluation",
          "performance_snapshot", "drift_report", "card_history_evidence", "asof_features", "hold_rules", "peer_cards",
          "graph_nodes", "similar_cases", "stream_card_features", "stream_decode")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(spark, sf):
    tx = transactions(spark, sf)
    yield "card", T.card_causal(tx)
    yield "global", T.global_causal(tx)
    yield "entity", fit_entity(tx).transform(tx)
    yield "curve", E.curve(tx, "fraud_score", "isFraud")
    yield "psi", D.category_counts(tx, tx, ["ProductCD"])
    yield "projection", card_projection(homogeneous_keys(tx, None))


def test_no_python_no_cross_join(spark, sf):
    for name, df in operators(spark, sf):
        p = plan(df)
        assert "Python" not in p and "Pandas" not in p, name
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_global_windows_put_only_the_table_of_days_into_one_partition(spark, sf):
    lines = plan(T.global_causal(transactions(spark, sf))).splitlines()
    single = [i for i, x in enumerate(lines) if "Exchange SinglePartition" in x]
    assert len(single) == 1
    assert "HashAggregate" in lines[single[0] + 1] and "output=[_day" in lines[single[0] + 1]


def test_scan_reads_needed_columns_only(spark, sf):
    p = plan(transactions(spark, sf).select("TransactionID").filter("TransactionID > 5"))
    scan = [x for x in p.splitlines() if "FileScan" in x and "event_id" in x][0]
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in scan or "ReadSchema: struct<event_id:bigint>" in scan
    assert "GreaterThan(event_id,5)" in p


def test_shared_root_reads_the_session(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert before or shared_root(spark).startswith("/tmp")


def test_every_query_has_a_callable():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 120


@pytest.mark.parametrize("name", list(entry.queries()) if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query_equals_sql(spark, sf, name):
    ok, msg, _ = compare(spark, entry.queries()[name], entry.oracle_sql().get(name), sf)
    assert ok, msg


def test_entry(spark):
    assert entry.entry(spark).count() == 1000
