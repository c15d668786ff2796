"""Neighbours through hubs, without a cap."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.operators.graph.build import memberships
from riskgraph.operators.graph.hubs import hub_index, neighbour_counts
from riskgraph.queries.evidence import alerts
from riskgraph.queries.graph import _AL, HK_SQL, _keys
from riskgraph.queries.registry import query


def _members(spark, sf_dir):
    """All memberships of the card projection, hubs and the unknown device included."""
    return memberships(_keys(spark, sf_dir)).select(F.concat_ws(":", "etype", "key").alias("key"), F.col("card").alias("member"))


@query("hub_neighbours", f"""WITH {HK_SQL}, s AS (SELECT etype, key, list(card) AS l FROM mem GROUP BY 1, 2),
u AS (SELECT m.card AS a, unnest(s.l) AS b FROM mem m JOIN s USING (etype, key))
SELECT id AS member, count(DISTINCT b) FILTER (b <> id) AS n_unique_neighbors FROM cards LEFT JOIN u ON a = id GROUP BY 1""")
def hub_neighbours(spark, sf_dir):
    """Degree of every card in the whole projection: what the cap leaves out counts too."""
    index = hub_index(_members(spark, sf_dir), hops=1)
    return neighbour_counts(_keys(spark, sf_dir).select(F.col("card").alias("member")), index, hops=1)


@query("two_hop_neighbours", f"""WITH {HK_SQL}, {_AL}, k1 AS (SELECT DISTINCT sa.id AS s, etype, key FROM sa JOIN mem ON card = sa.id),
n1 AS (SELECT DISTINCT s, card FROM k1 JOIN mem USING (etype, key)),
k2 AS (SELECT DISTINCT s, etype, key FROM n1 JOIN mem USING (card)),
n2 AS (SELECT DISTINCT s, card FROM k2 JOIN mem USING (etype, key))
SELECT sa.id AS member, count(card) AS n_unique_neighbors FROM sa LEFT JOIN n2 ON s = sa.id AND card <> sa.id GROUP BY 1""")
def two_hop_neighbours(spark, sf_dir):
    """Different cards within two hops of every alerted card."""
    starts = alerts(spark, sf_dir).select(F.col("card1").cast("string").alias("member"))
    return neighbour_counts(starts, hub_index(_members(spark, sf_dir)))


@query("two_hop_device_neighbours", f"""WITH {HK_SQL}, dm AS (SELECT * FROM mem WHERE etype = 'device' AND key <> '|'),
k1 AS (SELECT DISTINCT id AS s, key FROM cards JOIN dm ON card = id),
n1 AS (SELECT DISTINCT s, card FROM k1 JOIN dm USING (key)),
k2 AS (SELECT DISTINCT s, key FROM n1 JOIN dm USING (card)),
n2 AS (SELECT DISTINCT s, card FROM k2 JOIN dm USING (key))
SELECT id AS member, count(card) AS n_unique_neighbors FROM cards LEFT JOIN n2 ON s = id AND card <> id GROUP BY 1""")
def two_hop_device_neighbours(spark, sf_dir):
    """The same over known devices for every card, with keys of ten cards as hubs, so that both forms meet."""
    keys = _keys(spark, sf_dir)
    m = memberships(keys, ("device",)).filter(F.col("key") != "|").select("key", F.col("card").alias("member"))
    return neighbour_counts(keys.select(F.col("card").alias("member")), hub_index(m, heavy=10))
