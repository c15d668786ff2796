"""Quality classifier: naive Bayes support vectors over n-grams.

Indicators of the n-grams of a text (words and marks up to two, their shapes up to three) are
hashed into ``DIMS`` columns and scaled by the columns' class log-count ratios; a linear model with
hinge loss is fitted on them by dual coordinate descent, mixed with the plain ratios, and its
margins are turned into chances by a logistic fit on labelled rows that the model did not see.

At most ``TRAIN_ROWS`` labelled rows are learned from, none of the held-out fold.

Edge cases: null and empty texts have one n-gram, that of the empty text; without labelled rows
of both kinds every score is the share of good labels (0.5 if there are none); repeated rows each
get their score.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import fold, per_row, read, texts, utf8
from riskgraph.llm.learn import FOLDS, chance, labelled_sample, logistic

TRAIN_ROWS = 8_000
DIMS = 1 << 18
EPOCHS = 8
COST = 1.0
MIX = 0.25
PREDICT = 0.3

_TOKEN = re.compile(r"\w+|[^\w\s]+|\n")


def grams(text: str) -> list[int]:
    """Sorted columns of the n-grams of a text."""
    tokens = _TOKEN.findall(text)
    words = [t.lower() for t in tokens]
    shapes, last = [], ""
    for t, w in zip(tokens, words, strict=True):
        shape = ("=" if w == last else "") + (
            "9" if t.isdigit() else t if not t[0].isalnum() else "A" if len(t) > 1 and t.isupper() else "T" if t[0].isupper() else "a")
        shapes.append(shape)
        last = w
    out = set(words) or {""}
    out.update(map(" ".join, zip(words, words[1:], strict=False)))
    out.update("\t" + s for s in set(shapes))
    out.update("\t" + s for s in set(map(" ".join, zip(shapes, shapes[1:], strict=False))))
    out.update("\t" + s for s in set(map(" ".join, zip(shapes, shapes[1:], shapes[2:], strict=False))))
    return sorted({zlib.crc32(g.encode()) % DIMS for g in out})


def _labelled_grams():
    def rows(batch):
        for d, text, y in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            yield d, y, grams(text.decode())

    return rows


def log_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log ratio of smoothed, normalised document counts of both classes, per column."""
    sides = []
    for side in (1, 0):
        chosen = [r for r, v in zip(rows, y, strict=True) if v == side]
        n = np.bincount(np.concatenate(chosen), minlength=DIMS) + 1.0
        sides.append(np.log(n / n.sum()))
    return sides[0] - sides[1]


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 7):
    """Weights (and bias, last) of a linear hinge-loss model by dual coordinate descent."""
    rng = np.random.default_rng(seed)
    sign = np.where(y == 1, 1.0, -1.0)
    norm = np.array([scale[r] @ scale[r] + 1.0 for r in rows])
    # Both classes get the same total cost.
    limit = np.where(y == 1, cost * len(y) / (2 * max(1, (y == 1).sum())), cost * len(y) / (2 * max(1, (y == 0).sum())))
    alpha, w, bias = np.zeros(len(rows)), np.zeros(DIMS), 0.0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r = rows[i]
            v = scale[r]
            slope = sign[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[r] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS):
    """``weights, bias, calibration``: one number per hashed column, whatever the input's size."""
    sample = labelled_sample(docs, labels, "quality", train_rows)
    table = per_row(sample.select("doc_id", "text", "y"), "doc_id long, y int, g array<int>", _labelled_grams).toArrow()
    table = table.sort_by("doc_id").combine_chunks()
    y = table["y"].to_numpy()
    if not len(y) or len(np.unique(y)) < 2:
        rate = float(y.mean()) if len(y) else 0.5
        return np.zeros(DIMS, np.float32), 0.0, np.array([0.0, np.clip(np.log((rate + 1e-9) / (1 - rate + 1e-9)), -30, 30)])
    columns = table["g"].combine_chunks()
    columns = columns.chunk(0) if isinstance(columns, pa.ChunkedArray) else columns
    ends, flat = columns.offsets.to_numpy(), columns.values.to_numpy()
    rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    apart = np.arange(len(y)) % 5 == 0  # for the calibration
    if len(np.unique(y[~apart])) < 2 or len(np.unique(y[apart])) < 2:
        apart = np.zeros(len(y), bool)
    kept = [r for r, a in zip(rows, apart, strict=True) if not a]
    ratio = log_ratios(kept, y[~apart])
    w, bias = descend(kept, y[~apart], ratio)
    used = np.abs(w[w != 0])
    w = ((1 - MIX) * (used.mean() if len(used) else 0.0) + MIX * w) * ratio
    told = rows if not apart.any() else [r for r, a in zip(rows, apart, strict=True) if a]
    margin = np.array([margin_of(r, w, bias) for r in told])
    spread = margin.std() or 1.0
    w, bias, margin = w / spread, bias / spread, margin / spread
    return w.astype(np.float32), float(bias), logistic(margin[:, None], y[apart].astype(float) if apart.any() else y.astype(float), ridge=0.1)


def margin_of(r: np.ndarray, w: np.ndarray, bias: float) -> float:
    """Margin for the mean n-gram, so that long texts are not more certain than short ones."""
    return float(w[r].sum() / np.sqrt(len(r)) + bias)


def _scores(shared):
    w, bias, calibration = shared.value

    def rows(batch):
        for d, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            margin = margin_of(np.array(grams(text.decode()), np.int64), w, bias)
            yield d, float(chance(np.array([margin]), calibration))

    return rows


def score(docs: DataFrame, model) -> DataFrame:
    """``doc_id, score``."""
    return per_row(texts(docs), "doc_id long, score double", _scores, docs.sparkSession.sparkContext.broadcast(model))


def op7_quality_classifier(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= PREDICT).cast("int").alias("predicted"))
