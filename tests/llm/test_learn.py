import math

from riskgraph.llm import quality_classifier as qc
from riskgraph.llm.common import fold_of
from riskgraph.llm.learn import FOLDS, labelled_sample

TRAIN = [i for i in range(400) if fold_of(i, FOLDS)]


def frames(spark, docs, labels):
    return (spark.createDataFrame(docs, "doc_id long, text string, label int"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"))


def test_a_labelled_id_counts_once(spark):
    many = TRAIN[0]
    docs, labels = frames(spark, [(i, f"text {i}", 0) for i in TRAIN] + [(many, f"copy {k}", 0) for k in range(3000)] + [(None, "x", 1)],
                          [(i, i % 2, 0, "") for i in TRAIN] + [(TRAIN[1], 1, 0, ""), (None, 1, 1, ""), (TRAIN[2], None, 0, "")])
    got = labelled_sample(docs, labels, "quality", 10_000).collect()
    assert sorted(r.doc_id for r in got) == TRAIN
    assert {r.doc_id: r.text for r in got}[many] == "copy 0"
    assert {r.doc_id: r.y for r in got}[TRAIN[1]] == 1
    assert 10 < labelled_sample(docs, labels, "quality", 60).count() < 140


def test_classes_alike_in_all_ngrams_give_even_scores(spark, given):
    docs, labels = frames(spark, [(i, "the same words in every text", 0) for i in TRAIN[:200]],
                          [(i, k % 2, 0, "") for k, i in enumerate(TRAIN[:200])])
    given(qc, documents=docs, labels=labels)
    rows = qc.op7_quality_classifier(spark, "").collect()
    assert len(rows) == 200
    for r in rows:
        assert math.isfinite(r.score) and 0 <= r.score <= 1
        assert abs(r.score - 0.5) < 0.1
