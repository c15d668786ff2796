"""The 28 graph columns per transaction."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.operators.graph.build import (
    ENTITIES, alike_cards, card_projection, entity_edges, homogeneous_keys, id01_bucket_edges,
)
from riskgraph.operators.graph.components import components
from riskgraph.operators.graph.paths import betweenness, closeness
from riskgraph.operators.graph.rank import pagerank
from riskgraph.operators.graph.rings import rings
from riskgraph.operators.graph.twins import twin_classes
from riskgraph.plans.lineage import cut
from riskgraph.schema import GRAPH_FEATURES, ID, TARGET

TX_DEGREE = 6.0  # fixed: a transaction counts six entities, one of them the merchant


@dataclass
class GraphFeatureModel:
    id01_edges: list[float] | None
    fraud_rate: float
    entities: DataFrame = field(repr=False)
    cards: DataFrame = field(repr=False)

    def transform(self, df: DataFrame) -> DataFrame:
        """One left join per entity type brings all its metrics; unknown entities give 0."""
        x = homogeneous_keys(df, self.id01_edges)
        for e in ENTITIES:
            t = self.entities.filter(F.col("etype") == e).select(
                F.col("key").alias("_k"), *[F.col(c).alias(f"{e}_{c}") for c in ("degree", "pagerank", "fraud_rate")])
            x = x.join(t, x[e] == t["_k"], "left").drop("_k")
        c = self.cards.select(F.col("key").alias("_k"), "betweenness", "closeness", "component_size",
                              "ring_member", "ring_size")
        x = x.join(c, x["card"] == c["_k"], "left").drop("_k")

        def v(name):
            return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

        def near(e):
            # All neighbours of an entity are transactions, and each of them has one edge per type.
            return F.when(F.col(f"{e}_degree").isNotNull(), F.lit(float(len(ENTITIES)))).otherwise(0.0)

        zero = F.lit(0.0)
        out = {
            "feat_gr_tx_degree": F.lit(TX_DEGREE),
            **{f"feat_gr_{e}_degree": v(f"{e}_degree") for e in ENTITIES},
            **{f"feat_gr_{e}_pagerank": v(f"{e}_pagerank") for e in ENTITIES},
            "feat_gr_card_betweenness": v("betweenness"), "feat_gr_addr_betweenness": zero,
            "feat_gr_email_betweenness": zero, "feat_gr_device_betweenness": zero,
            "feat_gr_card_closeness": v("closeness"), "feat_gr_addr_closeness": zero,
            "feat_gr_component_size": v("component_size"),
            **{f"feat_gr_nbr_fraud_{e}_1h": v(f"{e}_fraud_rate") for e in ("card", "addr", "email", "device")},
            "feat_gr_nbr_fraud_card_2h": v("addr_fraud_rate"), "feat_gr_nbr_fraud_addr_2h": v("card_fraud_rate"),
            "feat_gr_ring_member": v("ring_member"), "feat_gr_ring_size": v("ring_size"),
            "feat_gr_avg_nbr_deg_card": near("card"), "feat_gr_avg_nbr_deg_addr": near("addr"),
        }
        return x.select(ID, *[out[c].alias(c) for c in GRAPH_FEATURES])

    def globals(self) -> dict:
        return {"id01_edges": self.id01_edges, "fraud_rate": self.fraud_rate}

    def tables(self) -> dict[str, DataFrame]:
        return {"entities": self.entities, "cards": self.cards}

    @classmethod
    def restore(cls, spark: SparkSession, values: dict, tables: dict) -> GraphFeatureModel:
        return cls(**values, **tables)


def target_rates(long: DataFrame, overall: float) -> DataFrame:
    """``etype, key, degree, fraud_rate``: rows and the rate among training rows, else the overall."""
    return long.groupBy("etype", "key").agg(
        F.count(F.lit(1)).alias("degree"),
        F.coalesce(F.avg(F.when(F.col("_train"), F.col("_y"))), F.lit(overall)).alias("fraud_rate"))


def entity_rates(df: DataFrame, keys: DataFrame, training=None, *, target: str = TARGET, entities=ENTITIES):
    """(table of :func:`target_rates`, overall training rate)."""
    train = F.lit(True) if training is None else F.coalesce(training, F.lit(False))
    y = F.col(target).cast("double") if target in df.columns else F.lit(0.0)
    rows = df.select(F.col(ID).alias("_id"), y.alias("_y"), train.alias("_train"))
    overall = float(rows.filter("_train").agg(F.avg("_y")).first()[0] or 0.0)
    pairs = F.array(*[F.struct(F.lit(e).alias("etype"), F.col(e).alias("key")) for e in entities])
    long = keys.join(rows, keys[ID] == rows["_id"]).select("_y", "_train", F.explode(pairs).alias("p")).select(
        "p.etype", "p.key", "_y", "_train")
    return target_rates(long, overall), overall


def fit_graph_features(df: DataFrame, training=None, *, betweenness_k: int | None = 200, hub_cap: int | None = None,
                       ring_mode: str = "triangles") -> GraphFeatureModel:
    """Learn entity metrics; ``training`` (a condition) restricts only the target rates.

    Rings are counted as triangles at every size; ``ring_mode="cliques"`` is for small graphs only.
    The projection holds all cards that share an entity, unless ``hub_cap`` leaves out entities of so many
    cards.  Without it one card stands for all with the same entities, so pairs are formed between those.
    """
    edges01 = id01_bucket_edges(df)
    keys = cut(homogeneous_keys(df, edges01), "keys")
    rates, overall = entity_rates(df, keys, training)
    pr = pagerank(entity_edges(keys))
    pr = pr.filter(~F.col("id").startswith("transaction-")).select(
        F.substring_index("id", "-", 1).alias("_e"), F.expr("substring(id, instr(id, '-') + 1)").alias("_k"), F.col("rank").alias("pagerank"))
    ent = cut(rates.join(pr, (rates["etype"] == pr["_e"]) & (rates["key"] == pr["_k"]), "left").drop("_e", "_k"), "entities")

    cards = cut(keys.select(F.col("card").alias("id")).distinct(), "cards")
    alike = None
    if hub_cap is None and ring_mode != "cliques":
        alike = cut(alike_cards(keys), "alike")
    offered = keys if alike is None else keys.join(alike.select(F.col("rep").alias("card")).distinct(), "card", "left_semi")
    proj = cut(card_projection(offered, hub_cap=hub_cap).select(F.col("card_a").alias("src"), F.col("card_b").alias("dst")), "projection")
    twins = twin_classes(proj, alike)
    metrics = betweenness(proj, cards, k=betweenness_k, twins=twins).join(closeness(proj, cards, twins=twins), "id").join(
        rings(proj, cards, ring_mode, twins=twins), "id").join(component_of_cards(keys), "id", "left")
    return GraphFeatureModel(edges01, overall, ent, cut(metrics.withColumnRenamed("id", "key"), "cardmetrics"))


def component_of_cards(keys: DataFrame) -> DataFrame:
    """``id`` (card), ``component_size`` in the transaction-entity graph.

    Transactions only tie the entities of one row together, so components are found on the distinct
    card-entity pairs, a graph without transaction nodes; their sizes count entities and rows.
    """
    pairs = F.array(*[F.concat(F.lit(f"{e}-"), F.col(e)) for e in ENTITIES if e != "card"])
    card = F.concat(F.lit("card-"), F.col("card"))
    small = keys.select(card.alias("src"), F.explode(pairs).alias("dst")).distinct()
    label = cut(components(small), "labels")
    tx = keys.groupBy(card.alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    sized = label.join(tx, F.col("id") == F.col("_c"), "left").groupBy("component").agg(
        (F.count(F.lit(1)) + F.coalesce(F.sum("_n"), F.lit(0))).alias("component_size"))
    return label.filter(F.col("id").startswith("card-")).join(sized, "component").select(
        F.expr("substring(id, 6)").alias("id"), "component_size")
