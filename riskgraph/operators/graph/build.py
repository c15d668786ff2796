"""Building the entity graph: nodes, edges, node features, card projection, peers, neighbourhoods."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgraph.functions import scalar as S
from riskgraph.functions.quantiles import quantile_list
from riskgraph.operators.profile import node_feature_columns
from riskgraph.plans.hot import MIN_ROWS
from riskgraph.plans.lineage import cut
from riskgraph.plans.scan import running_sums
from riskgraph.schema import (
    ADDR, AMOUNT, CARD, DEVICE, EMAIL, ID, NODE_DIMS, NODE_RISK_TLDS, TARGET, TIME, TX_EDGES,
)

HUB_CAP = 500
PAIR_CAP = 200
#: Members of a key that meet in one group of a join of pairs.
PAIR_BLOCK = 1024


def bin_edges(df: DataFrame, col: str, n_bins: int = 10) -> list[float]:
    """Quantile bin edges of a column; at least two, strictly increasing."""
    if col not in df.columns:
        return [0.0, 1.0]
    q = quantile_list(df, col, [i / n_bins for i in range(n_bins + 1)])
    if q is None or df.filter(F.col(col).isNotNull()).limit(2).count() < 2:
        return [0.0, 1.0]
    e = sorted(set(q))
    return e if len(e) > 1 else [e[0], e[0] + 1]


def text_key(c):
    return F.coalesce(c.cast("string"), F.lit("unknown"))


def address_text(a, b):
    """Address pair as text; a missing part is -1."""
    return F.concat_ws("|", F.coalesce(a.cast("double"), F.lit(-1.0)).cast("string"),
                       F.coalesce(b.cast("double"), F.lit(-1.0)).cast("string"))


def homogeneous_keys(df: DataFrame, id01_edges: list[float] | None) -> DataFrame:
    """Per transaction the text keys of card, addr, email, device and the id_01 bucket (ip)."""
    if id01_edges is None or len(id01_edges) < 2:
        ip = F.lit("ip_unknown")
    else:
        v = F.coalesce(F.col("id_01").cast("double"), F.lit(-9e9))
        ip = F.concat(F.lit("ip_"), S.bin_index(v, id01_edges).cast("string"))

    def have(c):
        return F.col(c) if c in df.columns else F.lit(None).cast("string")

    return df.select(
        ID, text_key(F.col(CARD)).alias("card"), address_text(have(ADDR[0]), have(ADDR[1])).alias("addr"),
        text_key(have(EMAIL)).alias("email"),
        S.device_key(have(DEVICE[0]), have(DEVICE[1]), unknown="|").alias("device"), ip.alias("ip"))


def id01_bucket_edges(df: DataFrame) -> list[float] | None:
    """Decile edges of id_01 with missing values far below all others."""
    if "id_01" not in df.columns:
        return None
    v = df.select(F.coalesce(F.col("id_01").cast("double"), F.lit(-9e9)).alias("v"))
    return sorted(set(quantile_list(v, "v", [i / 10 for i in range(11)])))


ENTITIES = ("card", "addr", "email", "device", "ip")


def entity_edges(keys: DataFrame, entities=ENTITIES) -> DataFrame:
    """Distinct ``src`` (transaction) - ``dst`` (entity) edges with their entity type."""
    pairs = F.array(*[F.struct(F.lit(e).alias("etype"), F.col(e).alias("key")) for e in entities])
    return keys.select(F.concat(F.lit("transaction-"), F.col(ID).cast("string")).alias("src"),
                       F.explode(pairs).alias("p")).select(
        "src", F.concat_ws("-", "p.etype", "p.key").alias("dst"), "p.etype", "p.key")


def node_set(edges: DataFrame) -> DataFrame:
    """All nodes of an edge table, each once."""
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    both = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
                   F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.explode(both).alias("e"), *rest).select(
        F.col("e.a").alias("src"), F.col("e.b").alias("dst"), *rest)


def degrees(edges: DataFrame) -> DataFrame:
    """``id, degree`` over undirected edges."""
    return undirected(edges.select("src", "dst")).groupBy(F.col("src").alias("id")).agg(
        F.count(F.lit(1)).alias("degree"))


HUB_SHARE = 4096


def at_nodes(rows: DataFrame, key: str, nodes: DataFrame, ends: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``nodes`` (``key``, ``degree``, ...), of whose degrees the sum is ``ends``.

    A hub's rows would meet in one task of a sorted join.  Nodes above 1 / ``HUB_SHARE`` of all ends are
    fewer than ``HUB_SHARE`` whatever the input, so those are broadcast; the others are joined plainly.
    """
    hub = F.col("degree") > ends // HUB_SHARE
    hubs = F.broadcast(nodes.filter(hub))
    rest = rows.join(F.broadcast(nodes.filter(hub).select(key)), key, "left_anti").join(nodes.filter(~hub), key, how)
    return rows.join(hubs, key).unionByName(rest)


def average_neighbour_degree(edges: DataFrame) -> DataFrame:
    d = cut(degrees(edges).withColumnRenamed("id", "dst"), "degrees")
    ends = d.agg(F.sum("degree")).first()[0] or 0
    return at_nodes(undirected(edges.select("src", "dst")), "dst", d, ends).groupBy(F.col("src").alias("id")).agg(
        F.avg("degree").alias("avg_neighbour_degree"))


def memberships(keys: DataFrame, entities=("addr", "device", "email")) -> DataFrame:
    """Distinct (etype, key, card)."""
    pairs = F.array(*[F.struct(F.lit(e).alias("etype"), F.col(e).alias("key")) for e in entities])
    return keys.select("card", F.explode(pairs).alias("p")).select("p.etype", "p.key", "card").distinct()


def card_projection(keys: DataFrame, entities=("addr", "device", "email"), hub_cap: int | None = HUB_CAP) -> DataFrame:
    """``card_a < card_b, weight``: shared entities, those with ``hub_cap`` or more cards left out.

    With a cap, hubs are removed before the join, so a key never has more than ``hub_cap`` cards in it;
    the cap is then part of the definition.  Without one all pairs are formed, in blocks of a key's cards.
    """
    m = memberships(keys, entities)
    size = m.groupBy("etype", "key").agg(F.count(F.lit(1)).alias("n"))
    kept = F.col("n") >= 2
    m = m.join(size.filter(kept if hub_cap is None else kept & (F.col("n") < hub_cap)), ["etype", "key"])
    return pairs_of(m, "card").filter("src < dst").groupBy(
        F.col("src").alias("card_a"), F.col("dst").alias("card_b")).agg(F.count(F.lit(1)).alias("weight"))


def alike_cards(keys: DataFrame, entities=("addr", "device", "email")) -> DataFrame:
    """``id, rep``: every card and the least card with the same entities, which stands for it.

    A set of entities is known by two 64-bit sums over it and its size, without gathering it.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(s), "etype", "key")) for s in (1, 2)]
    own = cut(memberships(keys, entities).groupBy(F.col("card").alias("id")).agg(
        marks[0].alias("_a"), marks[1].alias("_b"), F.count(F.lit(1)).alias("_n")), "alike")
    first = own.groupBy("_a", "_b", "_n").agg(F.min("id").alias("rep"))
    return own.join(first, ["_a", "_b", "_n"]).select("id", "rep")


def peer_cards(df: DataFrame, kinds=("address", "device"), limit: int | None = 100,
               hub_cap: int = HUB_CAP) -> DataFrame:
    """``card, peer``: cards sharing an address or device (both known).

    With ``limit``, the ``limit`` smallest peers of every card: they are among the ``limit + 1``
    smallest cards of each key, so only those are offered to a key's members, however many there
    are.  Without it, all peers through keys of fewer than ``hub_cap`` cards, as in the projection.
    """
    by = {
        "address": (address_text(F.col(ADDR[0]), F.col(ADDR[1])), F.col(ADDR[0]).isNotNull()),
        "device": (S.device_key(F.col(DEVICE[0]), F.col(DEVICE[1])), F.col(DEVICE[1]).isNotNull()),
        "device_info": (F.col(DEVICE[1]), F.col(DEVICE[1]).isNotNull()),
    }
    m = None
    for kind in kinds:
        key, known = by[kind]
        one = df.filter(known & F.col(CARD).isNotNull()).select(
            F.lit(kind).alias("etype"), key.alias("key"), F.col(CARD).alias("card")).distinct()
        m = one if m is None else m.unionByName(one)
    if limit is None:
        size = m.groupBy("etype", "key").agg(F.count(F.lit(1)).alias("_n")).filter(
            (F.col("_n") >= 2) & (F.col("_n") < hub_cap)).drop("_n")
        m = m.join(size, ["etype", "key"])
        offered = m
    else:
        w = Window.partitionBy("etype", "key").orderBy("card")
        offered = m.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit + 1).drop("_r")
    pairs = m.join(offered.withColumnRenamed("card", "peer"), ["etype", "key"]).filter(
        F.col("card") != F.col("peer")).select("card", "peer").distinct()
    if limit is None:
        return pairs
    w = Window.partitionBy("card").orderBy("peer")
    return pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def neighbourhood(starts: DataFrame, edges: DataFrame, n_hops: int = 2) -> DataFrame:
    """``start, node, hop`` of all nodes within ``n_hops``, each at its smallest hop, for all starts.

    One join per hop for the whole frontier; visited nodes are removed by an anti join.
    """
    both = cut(undirected(edges.select("src", "dst")).distinct(), "hops")
    seen = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, max(1, n_hops) + 1):
        nxt = front.join(both, front["node"] == both["src"]).select("start", F.col("dst").alias("node")).distinct()
        nxt = nxt.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hop", F.lit(hop))
        front = cut(nxt, "front")
        seen = seen.unionByName(front)
    return seen.filter(F.col("hop") > 0)


def sample_neighbours(starts: DataFrame, edges: DataFrame, fanouts=(15, 10, 5), seed: int = 42) -> DataFrame:
    """``start, hop, src, dst``: at most ``fanout`` neighbours per node and hop, seeded."""
    both = undirected(edges.select("src", "dst")).distinct()
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct()
    out = None
    for hop, k in enumerate(fanouts, 1):
        j = front.join(both, front["node"] == both["src"])
        w = Window.partitionBy("start", "node").orderBy(F.xxhash64(F.lit(seed), "start", "node", "dst"), "dst")
        picked = j.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).select(
            "start", F.lit(hop).alias("hop"), F.col("node").alias("src"), "dst")
        picked = cut(picked, "sampled")
        out = picked if out is None else out.unionByName(picked)
        front = picked.select("start", F.col("dst").alias("node")).distinct()
    return out


def induced_subgraph(edges: DataFrame, matched: DataFrame) -> DataFrame:
    """Edges whose two ends are both among the matched ids."""
    ids = matched.select("id").distinct()
    e = edges.join(ids, edges["src"] == ids["id"], "left_semi")
    return e.join(ids, e["dst"] == ids["id"], "left_semi")


def neighbour_mean(edges: DataFrame, feats: DataFrame, dims: int, rounds: int = 2) -> DataFrame:
    """``id, embedding``: own features followed by ``rounds`` rounds of neighbour means.

    ``feats`` is ``id, features array<double>`` of length ``dims``.  Each round is one join and one
    average per dimension, combined before the shuffle.
    """
    both = cut(undirected(edges.select("src", "dst")).distinct(), "nm")
    cur = feats.select("id", F.col("features").alias("cur"), F.col("features").alias("emb"))
    for _ in range(rounds):
        msg = both.join(cur.select(F.col("id").alias("_n"), "cur"), both["dst"] == F.col("_n")).groupBy(
            F.col("src").alias("_id")).agg(F.array(*[F.avg(F.col("cur")[i]) for i in range(dims)]).alias("_m"))
        zero = F.array_repeat(F.lit(0.0), dims)
        nxt = cur.join(msg, cur["id"] == msg["_id"], "left").select(
            "id", F.coalesce("_m", zero).alias("cur"), F.concat("emb", F.coalesce("_m", zero)).alias("emb"))
        cur = cut(nxt, "nm")
    return cur.select("id", F.col("emb").alias("embedding"))


# -- heterogeneous graph ------------------------------------------------------------------------

@dataclass
class GraphModel:
    """Fitted parts of the graph: bin edges, merchant centres and the node index table."""

    id01_edges: list[float]
    id02_edges: list[float]
    merchant_cols: list[str]
    centers: list[list[float]]
    nodes: DataFrame | None = field(default=None, repr=False)

    def keyed(self, df: DataFrame) -> DataFrame:
        """Add the text key of every entity type of the heterogeneous graph."""
        def num(c):
            return F.col(c).cast("double") if c in df.columns else F.lit(0.0)

        ip = F.concat_ws("|", S.bin_index(num("id_01"), self.id01_edges).cast("string"),
                         S.bin_index(num("id_02"), self.id02_edges).cast("string"))
        return df.withColumns({
            "k_card": text_key(F.col(CARD)), "k_address": address_text(F.col(ADDR[0]), F.col(ADDR[1])),
            "k_email": text_key(F.col(EMAIL)), "k_device": S.device_key(F.col(DEVICE[0]), F.col(DEVICE[1])),
            "k_ip_address": ip, "k_merchant": self.merchant().cast("string")})

    def globals(self) -> dict:
        return {k: getattr(self, k) for k in ("id01_edges", "id02_edges", "merchant_cols", "centers")}

    def tables(self) -> dict[str, DataFrame]:
        return {"nodes": self.nodes}

    @classmethod
    def restore(cls, spark: SparkSession, values: dict, tables: dict) -> GraphModel:
        return cls(**values, **tables)

    def merchant(self):
        """Index of the nearest centre (the smallest among equals)."""
        if len(self.centers) < 2:
            return F.lit(0)
        dist = []
        for i, c in enumerate(self.centers):
            d = sum(((F.coalesce(F.col(n).cast("double"), F.lit(0.0)) - x) ** 2
                     for n, x in zip(self.merchant_cols, c, strict=True)), F.lit(0.0))
            dist.append(F.struct(d.alias("d"), F.lit(i).alias("i")))
        return F.least(*dist)["i"]


def fit_graph(df: DataFrame, *, n_clusters: int = 20, n_bins: int = 10, seed: int = 42,
              min_rows: int = MIN_ROWS) -> GraphModel:
    """Learn bins and ``n_clusters`` merchants (fewer if the rows differ less), then number all nodes."""
    cols, centers = fit_merchants(df, n_clusters=n_clusters, seed=seed)
    m = GraphModel(bin_edges(df, "id_01", n_bins), bin_edges(df, "id_02", n_bins), cols, centers)
    m.nodes = node_index(m.keyed(df), min_rows=min_rows)
    return m


def fit_merchants(df: DataFrame, *, n_clusters: int = 20, seed: int = 42) -> tuple[list[str], list[list[float]]]:
    """(columns, centres) of the k-means merchants; without two columns there are no centres."""
    v = [c for c in df.columns if re.fullmatch(r"V\d+", c)]
    cols = [c for c in v if 307 <= int(c[1:]) <= 316]
    if len(cols) < 2:
        cols = v[:10]
    if len(cols) < 2:
        return cols, []
    x = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    vec = VectorAssembler(inputCols=cols, outputCol="features").transform(x)
    km = KMeans(k=n_clusters, seed=seed, maxIter=20, featuresCol="features").fit(vec)
    return cols, [[float(z) for z in c] for c in km.clusterCenters()]


def node_index(keyed: DataFrame, *, min_rows: int = MIN_ROWS) -> DataFrame:
    """``ntype, key, idx``: transactions by (time, id), entities in first-seen order, each from 0.

    Time and id are one decimal number, so the first row of a key is found by a hash aggregate; a
    struct of both would be sorted, all rows of all entity types.  First rows are written once, as
    the numbering reads them several times.
    """
    step, least = Decimal(2 * 10**19), Decimal(-93 * 10**17)
    whole = all(keyed.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") for c in (TIME, ID))
    if whole:
        # Null comes first, as in a struct.  Times stay below 4.9e18 in size.
        t = F.coalesce(F.col(TIME).cast("decimal(19,0)"), F.lit(-4_900_000_000_000_000_000).cast("decimal(19,0)"))
        at = (t * F.lit(step) + F.coalesce(
            F.col(ID).cast("decimal(19,0)"), F.lit(least))).cast("decimal(38,0)")
    else:
        at = F.struct(F.col(TIME).alias("_t"), F.col(ID).alias("_id"))
    items = F.array(*[F.struct(F.lit(n).alias("ntype"), F.col(f"k_{n}").alias("key")) for _, n in TX_EDGES])
    own = keyed.select(at.alias("_at"), F.lit("transaction").alias("ntype"), F.col(ID).cast("string").alias("key"))
    ents = keyed.select(at.alias("_at"), F.explode(items).alias("p")).select("_at", "p.ntype", "p.key")
    first = own.unionByName(ents).groupBy("ntype", "key").agg(F.min("_at").alias("_f"))
    if whole:
        r = running_sums(cut(first, "firsts"), ["ntype"], "_f", {"idx": F.lit(1)}, min_rows=min_rows)
    else:
        first = first.select("ntype", "key", F.col("_f._t").alias("_t"), F.col("_f._id").alias("_id"))
        r = running_sums(cut(first, "firsts"), ["ntype"], "_t", {"idx": F.lit(1)}, tie="_id", min_rows=min_rows)
    return r.select("ntype", "key", (F.col("idx") - 1).alias("idx"))


def transaction_edges(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``etype, src, dst``: one edge per transaction and entity type, as node indices."""
    t = nodes.filter(F.col("ntype") == "transaction").select(F.col("key").alias("_tk"), F.col("idx").alias("src"))
    items = F.array(*[F.struct(F.lit(e).alias("etype"), F.lit(n).alias("ntype"), F.col(f"k_{n}").alias("key"))
                      for e, n in TX_EDGES])
    x = keyed.select(F.col(ID).cast("string").alias("_id"), F.explode(items).alias("p")).select("_id", "p.*")
    ent = nodes.filter(F.col("ntype") != "transaction").withColumnRenamed("idx", "dst")
    return x.join(ent, ["ntype", "key"]).join(t, F.col("_id") == F.col("_tk")).select("etype", "src", "dst")


def pairs_of(m: DataFrame, member: str, block: int | None = None) -> DataFrame:
    """``etype, key, src, dst``: all ordered pairs of two members of a key, from rows ``etype, key, n, member``.

    A key of ``n`` members is cut into blocks of about ``block``, and each pair of blocks is a group of its
    own, so a group holds few members however large the key is and a member is copied ``n / block`` times.
    """
    nb = F.ceil(F.col("n") / F.lit(block or PAIR_BLOCK)).cast("int")
    mine, others = F.pmod(F.xxhash64(member), nb).cast("int"), F.explode(F.sequence(F.lit(0), nb - 1))
    a = m.select("etype", "key", F.col(member).alias("src"), mine.alias("_i"), others.alias("_j"))
    b = m.select("etype", "key", F.col(member).alias("dst"), others.alias("_i"), mine.alias("_j"))
    return a.join(b, ["etype", "key", "_i", "_j"]).filter("src <> dst").drop("_i", "_j")


def shared_card_edges(keyed: DataFrame, nodes: DataFrame, *, cap: int | None = PAIR_CAP, seed: int = 42,
                      hubs: bool = True) -> DataFrame:
    """``etype, src, dst``: card-card edges through a shared address or device, both directions.

    Without ``cap`` every key gives all pairs of its cards: the edges of a key are the square of its
    cards, formed in blocks, so no task holds a key.  With ``cap`` a key with at most so many pairs gives
    all of them.  A larger key gives ``cap`` draws of two of its cards with replacement (equal cards
    dropped): draws are made as rank numbers, so the pairs of a hub are never formed.  Without ``hubs``
    only the exact edges of the smaller keys are returned.
    """
    cards = nodes.filter(F.col("ntype") == "card").select(F.col("key").alias("_ck"), "idx")
    items = F.array(F.struct(F.lit("shared_address").alias("etype"), F.col("k_address").alias("key")),
                    F.struct(F.lit("shared_device").alias("etype"), F.col("k_device").alias("key")))
    m = keyed.select("k_card", F.explode(items).alias("p")).select("p.etype", "p.key", "k_card").distinct()
    m = m.join(cards, m["k_card"] == cards["_ck"]).select("etype", "key", "idx")
    size = m.groupBy("etype", "key").agg(F.count(F.lit(1)).alias("n"))
    m = cut(m.join(size, ["etype", "key"]), "members")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    s = pairs_of(m if cap is None else m.filter(pairs <= cap), "idx").select("etype", "src", "dst")
    if cap is None or not hubs:
        return s
    big = running_sums(m.filter(pairs > cap), ["etype", "key"], "idx", {"_rank": F.lit(1)})
    hub_sizes = big.groupBy("etype", "key").agg(F.first("n").alias("n"))

    def draw(side):
        h = F.xxhash64(F.lit(seed), "etype", "key", "t", F.lit(side))
        return (F.pmod(h, F.col("n")) + 1).alias(f"r{side}")

    draws = hub_sizes.select("etype", "key", "n", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))).alias("t")).select(
        "etype", "key", draw(1), draw(2))
    ranks = big.select("etype", "key", "_rank", "idx")
    d = draws.join(ranks.withColumnsRenamed({"_rank": "r1", "idx": "src"}), ["etype", "key", "r1"]).join(
        ranks.withColumnsRenamed({"_rank": "r2", "idx": "dst"}), ["etype", "key", "r2"]).filter(
        "src <> dst").select("etype", "src", "dst")
    return s.unionByName(undirected(d))


def node_features(keyed: DataFrame, model: GraphModel, *, target: str = TARGET) -> DataFrame:
    """``ntype, key, features``: float array of the declared width per node type."""
    have = set(keyed.columns)

    def num(c):
        return F.col(c).try_cast("double") if c in have else F.lit(None).cast("double")

    def zero(c):
        return F.coalesce(c, F.lit(0.0))

    y = F.avg(F.col(target).cast("double")) if target in have else F.lit(0.0)
    tx_cols = node_feature_columns(keyed.select([c for c in keyed.columns if not c.startswith("k_")]))
    out = [keyed.select(F.lit("transaction").alias("ntype"), F.col(ID).cast("string").alias("key"),
                        F.array(*[zero(num(c)) for c in tx_cols]).alias("x"))]

    def per(ntype, *cols):
        g = keyed.groupBy(F.col(f"k_{ntype}").alias("key")).agg(F.array(*cols).alias("x"))
        out.append(g.select(F.lit(ntype).alias("ntype"), "key", "x"))

    per("card", *[zero(F.avg(num(f"card{i}"))) for i in range(2, 7)], F.count(F.lit(1)).cast("double"),
        zero(F.log1p(F.avg(zero(num(AMOUNT))))), zero(y))
    per("address", zero(F.max(num(ADDR[0]))), zero(F.max(num(ADDR[1]))),
        F.avg(zero(num("dist1"))), F.avg(zero(num("dist2"))))
    emails = keyed.groupBy(F.col("k_email").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    top = emails.agg(F.max("n")).first()[0] or 1
    out.append(emails.select(F.lit("email").alias("ntype"), "key", F.array(
        F.col("n") / F.lit(float(top)), S.is_free_provider(F.col("key")).cast("double"),
        S.is_high_risk_tld(F.col("key"), NODE_RISK_TLDS).cast("double")).alias("x")))
    low = F.lower(F.col("key"))
    dev = keyed.groupBy(F.col("k_device").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    out.append(dev.select(F.lit("device").alias("ntype"), "key", F.array(
        F.col("n"), low.contains("windows").cast("double"), low.rlike("iphone|ipad").cast("double"),
        low.contains("android").cast("double")).alias("x")))
    per("ip_address", *[zero(F.avg(num(f"id_{i:02d}"))) for i in range(1, 7)])
    centers = model.centers or [[0.0] * NODE_DIMS["merchant"]]
    spark = keyed.sparkSession
    cen = spark.createDataFrame([(str(i), [float(x) for x in c[:10]]) for i, c in enumerate(centers)],
                                "key string, x array<double>")
    seen = keyed.select(F.col("k_merchant").alias("key")).distinct()
    out.append(cen.join(seen, "key", "left_semi").select(F.lit("merchant").alias("ntype"), "key", "x"))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    width = F.create_map(*[x for k, v in NODE_DIMS.items() for x in (F.lit(k), F.lit(v))])[F.col("ntype")]
    padded = F.slice(F.concat("x", F.array_repeat(F.lit(0.0), 50)), F.lit(1), width)
    return res.select("ntype", "key", padded.cast("array<float>").alias("features"))


def graph_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes and edges by type."""
    n = nodes.groupBy(F.col("ntype").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    e = edges.groupBy(F.col("etype").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.lit("node").alias("kind"), "*").unionByName(e.select(F.lit("edge").alias("kind"), "*"))
