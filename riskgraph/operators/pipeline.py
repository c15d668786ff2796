"""The 119-column feature pipeline, its three views, and their storage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.operators.entity import EntityModel, fit_entity
from riskgraph.operators.graph.features import GraphFeatureModel, fit_graph_features
from riskgraph.operators.temporal import TemporalModel, fit_temporal
from riskgraph.schema import (
    AMOUNT_FEATURES, CARD, ENTITY_FEATURES, GRAPH_FEATURES, ID, TARGET, TEMPORAL_FEATURES, TIME,
)

EPOCH = 1483228800  # fixed value: 2017-01-01 00:00:00 UTC, time zero of the feature store
TTL = 7 * 86400
FLAGS = tuple(c for c in (*TEMPORAL_FEATURES, *AMOUNT_FEATURES, *ENTITY_FEATURES)
              if c.startswith(("feat_is_", "feat_device_is_")) or c.endswith(("_flag", "_p95", "_p05"))
              or c in ("feat_email_mismatch", "feat_high_risk_tld", "feat_suspicious_hour",
                       "feat_identity_missing", "feat_new_device_for_card", "feat_multi_card_on_device"))
COUNTS = ("feat_txn_count_1h", "feat_txn_count_24h", "feat_txn_count_7d", "feat_card_txn_count_1h",
          "feat_card_txn_count_24h")
VIEWS = {
    "temporal": TEMPORAL_FEATURES + AMOUNT_FEATURES,
    "aggregated": ENTITY_FEATURES,
    "graph": GRAPH_FEATURES,
}


@dataclass
class FeatureModel:
    temporal: TemporalModel
    entity: EntityModel
    graph: GraphFeatureModel

    def transform(self, df: DataFrame) -> DataFrame:
        """Ids, target and 119 ``feat_*`` columns, joined by transaction id, in narrow types."""
        head = [c for c in (ID, TARGET, TIME, CARD) if c in df.columns]
        out = df.select(*head)
        for part in (self.temporal, self.entity, self.graph):
            out = out.join(part.transform(df), ID)
        kind = {**dict.fromkeys(FLAGS, "tinyint"), **dict.fromkeys(COUNTS, "int")}
        names = [c for v in VIEWS.values() for c in v]
        return out.select(*head, *[F.col(c).cast(kind.get(c, "float")).alias(c) for c in names])

    def _parts(self) -> dict:
        return {"temporal": self.temporal, "entity": self.entity, "graph": self.graph}

    def globals(self) -> dict:
        return {name: part.globals() for name, part in self._parts().items()}

    def tables(self) -> dict[str, DataFrame]:
        return {f"{name}.{t}": df for name, part in self._parts().items() for t, df in part.tables().items()}

    @classmethod
    def restore(cls, spark: SparkSession, values: dict, tables: dict) -> FeatureModel:
        kinds = {"temporal": TemporalModel, "entity": EntityModel, "graph": GraphFeatureModel}
        return cls(**{name: kind.restore(spark, values[name], {
            t.split(".", 1)[1]: df for t, df in tables.items() if t.startswith(name + ".")})
            for name, kind in kinds.items()})


def fit_features(df: DataFrame, fit_filter=None, **graph_options) -> FeatureModel:
    """Fit all three builders on the rows under ``fit_filter`` (all rows without one)."""
    fit = df if fit_filter is None else df.filter(fit_filter)
    return FeatureModel(fit_temporal(fit), fit_entity(fit), fit_graph_features(fit, **graph_options))


def with_event_time(features: DataFrame, *, time: str = TIME, epoch: int = EPOCH) -> DataFrame:
    """Add ``event_timestamp``: seconds since the feature store's time zero."""
    return features.withColumn("event_timestamp", F.timestamp_seconds(F.col(time) + F.lit(epoch)))


def feature_view(features: DataFrame, name: str, *, key: str = ID) -> DataFrame:
    """One of the three views over the same table: key, event time and its columns."""
    return features.select(key, "event_timestamp", *[c for c in VIEWS[name] if c in features.columns])
