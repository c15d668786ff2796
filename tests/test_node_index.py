"""Numbering of graph nodes by their first row, and merchants without it."""

from pyspark.sql import functions as F

from riskgraph.operators.graph import build as B
from riskgraph.schema import TX_EDGES


def keyed(spark, kind="long"):
    rows = [(i, None if i % 7 == 0 else (i * 37) % 5 - 2, f"k{i % 3}") for i in [*range(-20, 20), 2**62, -(2**63)]]
    df = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, k string").withColumn(
        "TransactionDT", F.col("TransactionDT").cast(kind))
    return rows, df.withColumns({f"k_{n}": F.col("k") for _, n in TX_EDGES})


def test_first_rows_are_found_by_a_hash_and_numbered_in_order(spark):
    for kind in ("long", "double"):
        rows, df = keyed(spark, kind)
        got = {(r["ntype"], r["key"]): r["idx"] for r in B.node_index(df).collect()}
        order = [r for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))]
        assert [got["transaction", str(r[0])] for r in order] == list(range(len(rows)))
        seen = list(dict.fromkeys(r[2] for r in order))
        assert [got["card", k] for k in seen] == [0, 1, 2]


def test_no_row_is_sorted_to_find_the_first(spark, monkeypatch):
    plans, cut = [], B.cut

    def keep(df, tag="cut"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, tag)

    monkeypatch.setattr(B, "cut", keep)
    B.node_index(keyed(spark)[1])
    assert plans and all("SortAggregate" not in p and "HashAggregate" in p for p in plans)
