"""Scoring models as Spark ML jobs: boosted trees, stacking on embeddings, importance, PCA."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.functions import scalar as S
from riskgraph.plans.lineage import cut, release
from riskgraph.schema import ID, TARGET

# Default training parameters.
TREES, DEPTH, STEP, POSITIVE_WEIGHT = 500, 8, 0.05, 27.6


@dataclass
class Scorer:
    """A fitted pipeline with its input columns and decision threshold."""

    pipeline: PipelineModel
    columns: list[str]
    threshold: float = 0.5
    version: str = "gbt-1"
    emb_dim: int = 0

    def rows(self, df: DataFrame) -> DataFrame:
        """Exactly the model's columns; a missing or non-numeric one counts as 0, others are dropped."""
        have = dict(df.dtypes)
        keep = [c for c in (ID,) if c in have]
        emb = ["embedding"] if self.emb_dim and "embedding" in have else []
        return df.select(*keep, *emb, *[
            (S.number(F.col(c), kind=have[c]) if c in have else F.lit(0.0)).alias(c) for c in self.columns])

    def score(self, df: DataFrame) -> DataFrame:
        """``TransactionID, fraud_score, risk_level, is_fraud_predicted, threshold, model_version``."""
        x = self.rows(df)
        if self.emb_dim:
            x = _embedded(x, self.emb_dim)
        p = self.pipeline.transform(x).withColumn("fraud_score", vector_to_array("probability")[1])
        s = F.col("fraud_score")
        return p.select(
            ID, "fraud_score", S.risk_level(s).alias("risk_level"),
            (s >= self.threshold).alias("is_fraud_predicted"), F.lit(self.threshold).alias("threshold"),
            F.lit(self.version).alias("model_version"))

    def importance(self, spark, k: int | None = None) -> DataFrame:
        """``feature, importance``, largest first."""
        gbt = self.pipeline.stages[-1]
        names = [*[f"emb_{i}" for i in range(self.emb_dim)], *self.columns]
        values = gbt.featureImportances.toArray()
        df = spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")
        df = df.orderBy(F.desc("importance"), "feature")
        return df if k is None else df.limit(k)

    def save(self, path: str) -> None:
        """The fitted pipeline and, as one JSON row beside it, columns, threshold, version and width."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        head = {k: getattr(self, k) for k in ("columns", "threshold", "version", "emb_dim")}
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scorer:
        head = json.loads(spark.read.text(f"{path}/head").first()[0])
        return cls(PipelineModel.load(f"{path}/pipeline"), **head)


def _embedded(df: DataFrame, dim: int) -> DataFrame:
    zero = F.array_repeat(F.lit(0.0), dim)
    e = F.col("embedding").cast("array<double>") if "embedding" in df.columns else F.lit(None).cast("array<double>")
    ok = F.when(F.size(e) == dim, e).otherwise(zero)
    return df.withColumn("emb_vec", array_to_vector(ok))


def fit_scorer(df: DataFrame, columns, *, target: str = TARGET, trees: int = TREES, depth: int = DEPTH,
               step: float = STEP, positive_weight: float = POSITIVE_WEIGHT, subsample: float = 0.8,
               validation: str | None = None, emb_dim: int = 0, seed: int = 42, threshold: float = 0.5) -> Scorer:
    """Boosted trees on numeric ``columns``, stacked behind an ``embedding`` column if ``emb_dim``.

    ``validation`` names a boolean column; boosting stops early when its loss no longer falls.
    """
    columns, kinds = list(columns), dict(df.dtypes)
    x = df.select(
        *[S.number(F.col(c), kind=kinds.get(c)).alias(c) for c in columns],
        F.col(target).cast("double").alias("_y"),
        F.when(F.col(target) == 1, float(positive_weight)).otherwise(1.0).alias("_w"),
        *(["embedding"] if emb_dim else []),
        *([F.col(validation).alias("_val")] if validation else []))
    if emb_dim:
        x = _embedded(x, emb_dim)
    inputs = [*(["emb_vec"] if emb_dim else []), *columns]
    gbt = GBTClassifier(
        featuresCol="features", labelCol="_y", weightCol="_w", maxIter=trees, maxDepth=depth, stepSize=step,
        subsamplingRate=subsample, seed=seed, cacheNodeIds=False,
        **({"validationIndicatorCol": "_val"} if validation else {}))
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    # Training reads its rows several times, so they are put together once.
    x = cut(assembler.transform(x).select("features", "_y", "_w", *(["_val"] if validation else [])), "training")
    model = PipelineModel([assembler, gbt.fit(x)])
    release(x)
    return Scorer(model, columns, threshold, emb_dim=emb_dim)


def pca2(df: DataFrame, ident: str, vec: str) -> DataFrame:
    """First two principal components of an array column."""
    x = df.select(ident, array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    m = PCA(k=2, inputCol="v", outputCol="p").fit(x)
    p = vector_to_array("p")
    return m.transform(x).select(ident, p[0].alias("pc1"), p[1].alias("pc2"))
