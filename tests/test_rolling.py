import random
import uuid

import pytest
from pyspark.sql import functions as F

from riskgraph.operators.evaluate import snapshot
from riskgraph.schema import DAY
from riskgraph.streaming.rolling import RollingQuality

REC = "transaction_id long, score double, label int, at long"


def records(spark, rows):
    return spark.createDataFrame(rows, REC).withColumn("ts", F.timestamp_seconds("at"))


def test_every_batch_equals_the_window_of_its_records(spark, tmp_path):
    draw = random.Random(8)
    roll = RollingQuality(spark, str(tmp_path / uuid.uuid4().hex), days=3)
    seen, last, i = [], None, 0
    for batch, first in enumerate([0, 1, 1, 4, 5, 14]):
        new = []
        for _ in range(60):
            i += 1
            at = int((first + draw.random() * 2 - draw.choice([0, 0, 0, 3])) * DAY) + 40 * DAY
            new.append((i, round(draw.random(), 1), draw.choice([0, 0, 1, None]), at))
        last = max([r[3] // DAY for r in new] + ([] if last is None else [last]))
        # A row whose day has left the window by the end of its batch is not counted, then or later.
        seen += [r for r in new if r[3] // DAY > last - 3]
        for _ in range(2):  # a batch that is run again replaces itself
            roll(records(spark, new), batch)
        kept = [r for r in seen if r[3] // DAY > last - 3]
        want = snapshot(records(spark, kept)).first()
        got = roll.results().filter(F.col("batch_id") == batch).first()
        assert got["last_day"] == last
        for c in ("n_total", "n_labelled", "n_positive", "tp", "fp", "fn", "tn", "precision", "recall", "brier", "auroc", "auprc"):
            assert got[c] == pytest.approx(want[c]), (batch, c)


def test_empty_and_unlabelled(spark, tmp_path):
    roll = RollingQuality(spark, str(tmp_path / "r"), days=2)
    roll(records(spark, []), 0)
    roll(records(spark, [(1, 0.5, None, DAY), (2, None, 1, DAY)]), 1)
    got = {r.batch_id: r for r in roll.results().collect()}
    assert (got[0].n_total, got[0].last_day, got[0].auroc) == (0, None, None)
    assert (got[1].n_total, got[1].n_labelled, got[1].last_day, got[1].auroc, got[1].brier) == (1, 0, 1, None, None)
