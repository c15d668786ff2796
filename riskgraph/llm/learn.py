"""Labelled rows for classifiers: a bounded sample, split by the id's fold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import fold
from riskgraph.plans.lineage import cut

FOLDS = 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``doc_id, text, y`` of about ``rows`` labelled documents whose fold is not 0.

    The labels are thinned by the hash of their id first, so that the side sent to all tasks has
    about ``rows`` rows at most, whatever the size of the table.
    """
    given = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).filter(
        F.col("_id").isNotNull() & F.col("y").isin(0, 1) & (fold("_id", FOLDS) != 0))
    n = given.count()
    share = int(min(1.0, rows / max(n, 1)) * (1 << 20))
    # A repeated label counts once; an id with both labels has the larger one.
    chosen = given.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < share).groupBy("_id").agg(F.max("y").alias("y"))
    chosen = cut(chosen, "labels")
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["_id"])
    return cut(found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y"), "sample")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 100) -> np.ndarray:
    """Weights of a logistic model by damped Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if not len(y):
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3

    def loss(w):
        z = x @ w
        return (np.logaddexp(0, z) - y * z).sum() + (penalty * w * w).sum() / 2

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-9:
            break
    return w


def chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
