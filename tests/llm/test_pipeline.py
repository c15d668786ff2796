import re

import brute
import corpus_pipeline
import pytest

from riskgraph.llm import pii, quality_rules


def test_stages(spark, sf):
    """Each stage against plain loops on what the one before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, docs = docs.columns, [r.asDict() for r in docs.collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, spark.createDataFrame(docs, schema), sf)
        rows = [r.asDict() for r in got.collect()]
        if name == "packing":
            assert {r["doc_id"] for r in rows} == {d["doc_id"] for d in docs}
            break
        assert got.columns == columns
        if name == "quality rules":  # no line is frequent in so small a table
            want = [d for d in docs if not brute.rules(d["text"])[5]]
        elif name == "near duplicates":
            prints = [(d["doc_id"], brute.fingerprint(d["text"])) for d in docs]
            want = [d for d, c in zip(docs, brute.linked(prints), strict=True) if d["doc_id"] == c]
        elif name == "benchmark decontamination":
            want = [d for d, x in zip(docs, brute.contamination([d["text"] for d in docs], bench), strict=True) if not x[4]]
        else:
            want = docs
            assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"]) for r in rows)
            found = {r.doc_id for r in pii.find(spark.createDataFrame(docs, schema)).filter("size(found) > 0").collect()}
            before = {d["doc_id"]: d for d in docs}
            assert found and all((r != before[r["doc_id"]]) == (r["doc_id"] in found) for r in rows)
        assert sorted(r["doc_id"] for r in rows) == sorted(d["doc_id"] for d in want), name
        docs = rows


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_stages_on_odd_rows(spark, sf, which, request):
    docs = request.getfixturevalue(which)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        else:
            assert (out.count() > 0) == (which == "odd")


def test_repeated_rows_share_a_verdict(odd):
    kept = quality_rules.keep_passing(odd)
    assert kept.filter("doc_id = 2").count() == 2


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
