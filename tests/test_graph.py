"""Graph operators against plain implementations on small graphs."""

import itertools
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgraph.operators.graph import build as B
from riskgraph.operators.graph import components as C
from riskgraph.operators.graph import knn as K
from riskgraph.operators.graph import paths as P
from riskgraph.operators.graph import rings as R
from riskgraph.operators.graph.features import component_of_cards, fit_graph_features
from riskgraph.operators.graph.rank import pagerank


def edges_of(spark, pairs):
    return spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")


def nodes_of(spark, names):
    return spark.createDataFrame([(str(n),) for n in names], "id string")


def adjacency(pairs, names):
    adj = {str(n): set() for n in names}
    for a, b in pairs:
        adj[str(a)].add(str(b))
        adj[str(b)].add(str(a))
    return adj


def random_graph(n=18, m=30, seed=0):
    rnd = random.Random(seed)
    pairs = {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(m)}
    return sorted(pairs), range(n + 1)


def bfs(adj, s):
    dist, sigma, order = {s: 0}, {s: 1}, []
    q = deque([s])
    while q:
        u = q.popleft()
        order.append(u)
        for v in adj[u]:
            if v not in dist:
                dist[v], sigma[v] = dist[u] + 1, 0
                q.append(v)
            if dist[v] == dist[u] + 1:
                sigma[v] += sigma[u]
    return dist, sigma, order


def test_pagerank(spark):
    pairs, names = random_graph()
    adj = adjacency(pairs, names)
    n = len(adj)
    r = dict.fromkeys(adj, 1 / n)
    for _ in range(100):
        lone = sum(r[v] for v in adj if not adj[v])
        new = {v: 0.15 / n + 0.85 * (sum(r[u] / len(adj[u]) for u in adj[v]) + lone / n) for v in adj}
        err = sum(abs(new[v] - r[v]) for v in adj)
        r = new
        if err < n * 1e-4:
            break
    got = {x["id"]: x["rank"] for x in pagerank(edges_of(spark, pairs), nodes_of(spark, names)).collect()}
    assert got == pytest.approx(r)
    assert sum(got.values()) == pytest.approx(1.0)


def stars(spark):
    """40 small nodes between 5 hubs, two linked small nodes, a loop, a repeated and a turned edge."""
    pairs = [(f"t{i}", f"h{j}") for i in range(40) for j in range(5) if (i * 7 + j * 3) % 4]
    return pairs + [("t1", "t2"), ("h1", "h1"), ("t3", "h0"), ("h0", "t3"), ("h0", "h2"), ("x", "x"), ("x", "h4")]


@pytest.mark.parametrize("rounds", [1, 4])
def test_pagerank_leaves_small_nodes_out_of_the_rounds(spark, monkeypatch, rounds):
    from riskgraph.operators.graph import rank

    pairs, written, real = stars(spark), [], rank.cut

    def cut(df, tag="cut"):
        out = real(df, tag)
        written.extend([out.count()] if tag == "rank" else [])
        return out

    monkeypatch.setattr(rank, "cut", cut)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = dict.fromkeys(near, 1 / len(near))
    for _ in range(rounds):
        want = {v: 0.15 / len(near) + 0.85 * sum(want[u] / len(near[u]) for u in near[v]) for v in near}
    got = spark.createDataFrame(pairs, "src string, dst string")
    got = {x["id"]: x["rank"] for x in pagerank(got, max_iter=rounds, tol=0.0).collect()}
    assert got == pytest.approx(want, abs=1e-14)
    assert set(written) == {8}  # five hubs, the linked t1 and t2, and x with its loop


def test_pagerank_of_small_nodes_counts_in_the_stop_rule(spark):
    edges = spark.createDataFrame(stars(spark), "src string, dst string")
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    for tol in (1e-2, 1e-4):
        a = {x["id"]: x["rank"] for x in pagerank(edges, tol=tol).collect()}
        b = {x["id"]: x["rank"] for x in pagerank(edges, nodes, tol=tol).collect()}
        assert a == pytest.approx(b, abs=1e-14)


def test_hubs_do_not_meet_in_a_sorted_join(spark):
    from riskgraph.operators.graph import build

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(9000).select(F.col("id").alias("v"), F.when(F.col("id") < 8000, 1).otherwise(F.col("id")).alias("k"))
        nodes = rows.groupBy("k").agg(F.count("*").alias("degree"))
        got = build.at_nodes(rows, "k", nodes, 9000)
        assert sorted(tuple(r) for r in got.select("v", "degree").collect()) == [(i, 8000 if i < 8000 else 1) for i in range(9000)]
        assert "BroadcastHashJoin" in build.average_neighbour_degree(
            spark.createDataFrame([("a", "b")], "src string, dst string"))._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pagerank_stops_at_the_same_round_with_and_without_isolated_nodes(spark):
    pairs = [(0, 1), (1, 2), (2, 3), (1, 3)]
    a = {x["id"]: x["rank"] for x in pagerank(edges_of(spark, pairs), tol=1e-3).collect()}
    b = {x["id"]: x["rank"] for x in pagerank(edges_of(spark, pairs), nodes_of(spark, range(4)), tol=1e-3).collect()}
    assert a == pytest.approx(b)


@pytest.mark.parametrize("pairs,n", [
    ([(i, i + 1) for i in range(20)], 22), ([(0, i) for i in range(1, 9)], 9),
    ([(0, 1), (1, 2), (3, 4)], 6),
])
def test_components(spark, pairs, n):
    adj = adjacency(pairs, range(n))
    got = {x["id"]: x["component"] for x in C.components(edges_of(spark, pairs), nodes_of(spark, range(n))).collect()}
    for v in adj:
        assert got[v] == min(bfs(adj, v)[0])


def test_closeness_and_betweenness(spark):
    pairs, names = random_graph(n=66, m=160, seed=3)
    adj = adjacency(pairs, names)
    n = len(adj)
    want_c, want_b = {}, dict.fromkeys(adj, 0.0)
    for s in adj:
        dist, sigma, order = bfs(adj, s)
        total = sum(dist.values())
        want_c[s] = (len(dist) - 1) / total * (len(dist) - 1) / (n - 1) if total else 0.0
        delta = dict.fromkeys(dist, 0.0)
        for w in reversed(order):
            for v in adj[w]:
                if dist.get(v) == dist[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                want_b[w] += delta[w]
    want_b = {v: x / ((n - 1) * (n - 2)) for v, x in want_b.items()}
    e, nd = edges_of(spark, pairs), nodes_of(spark, names)
    assert {x[0]: x[1] for x in P.closeness(e, nd).collect()} == pytest.approx(want_c)
    assert {x[0]: x[1] for x in P.betweenness(e, nd, k=None).collect()} == pytest.approx(want_b)
    near = {x[0]: x[1] for x in P.closeness_sketched(e, nd).collect()}
    assert near == pytest.approx(want_c, rel=0.15, abs=0.02)


def test_rings(spark):
    pairs = [*itertools.combinations(range(4), 2), (3, 4), (4, 5), (5, 3), (6, 7)]
    names = range(9)
    adj = adjacency(pairs, names)
    tri = dict.fromkeys(adj, 0)
    for t in itertools.combinations(adj, 3):
        if all(b in adj[a] for a, b in itertools.combinations(t, 2)):
            for v in t:
                tri[v] += 1
    e, nd = edges_of(spark, pairs), nodes_of(spark, names)
    assert {x[0]: x[1] for x in R.triangles(e, nd).collect()} == tri
    got = {x[0]: (x[1], x[2]) for x in R.rings(e, nd, "cliques").collect()}
    assert got == {**{str(i): (4, 1) for i in range(4)}, "4": (3, 1), "5": (3, 1), "6": (2, 0), "7": (2, 0), "8": (1, 0)}


def test_largest_clique_matches_search_over_all_subsets(spark):
    pairs, names = random_graph(n=9, m=24, seed=9)
    adj = adjacency(pairs, names)
    best = dict.fromkeys(adj, 1)
    for k in range(2, 7):
        for c in itertools.combinations(adj, k):
            if all(b in adj[a] for a, b in itertools.combinations(c, 2)):
                best.update(dict.fromkeys(c, k))
    got = {x[0]: x[1] for x in R.largest_cliques(edges_of(spark, pairs), nodes_of(spark, names)).collect()}
    assert got == best


def keys_frame(spark, rows):
    return spark.createDataFrame(rows, "TransactionID long, card string, addr string, email string, device string, ip string")


def test_projection_hub_cap(spark):
    rows = [(i, f"c{i}", "hub", "e" if i < 2 else f"e{i}", f"d{i}", "ip") for i in range(5)]
    k = keys_frame(spark, rows)
    under = B.card_projection(k, hub_cap=6).collect()
    assert len(under) == 10
    assert {(r[0], r[1]): r[2] for r in under}[("c0", "c1")] == 2
    at_cap = B.card_projection(k, hub_cap=5).collect()
    assert [(r[0], r[1], r[2]) for r in at_cap] == [("c0", "c1", 1)]


def test_component_size_counts_rows_and_entities(spark):
    rows = [(1, "c1", "a1", "e1", "d1", "i1"), (2, "c1", "a1", "e1", "d1", "i1"), (3, "c2", "a2", "e2", "d2", "i2")]
    got = {r["id"]: r["component_size"] for r in component_of_cards(keys_frame(spark, rows)).collect()}
    assert got == {"c1": 7, "c2": 6}


def tx_frame(spark, rows):
    return spark.createDataFrame(
        rows, "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, addr1 double, addr2 double, "
              "P_emaildomain string, DeviceType string, DeviceInfo string, isFraud int")


def test_shared_edges_below_and_above_the_pair_cap(spark):
    rows = [(i, i, 1.0, i, 5.0 if i < 8 else 6.0, 1.0, "x.com", "mobile", f"d{i}", 0) for i in range(10)]
    df = tx_frame(spark, rows)
    m = B.fit_graph(df)
    e = B.shared_card_edges(m.keyed(df), m.nodes, cap=10).filter("etype = 'shared_address'").collect()
    pairs = {(r["src"], r["dst"]) for r in e}
    assert {(8, 9), (9, 8)} <= pairs
    rest = [(a, b) for a, b in ((r["src"], r["dst"]) for r in e) if max(a, b) < 8]
    assert 0 < len(rest) <= 20 and all(a != b for a, b in rest)
    assert all((b, a) in pairs for a, b in pairs)


def test_shared_edges_without_hubs_are_the_exact_ones(spark):
    rows = [(i, i, 1.0, i, 5.0 if i < 8 else 6.0, 1.0, "x.com", "mobile", f"d{i}", 0) for i in range(10)]
    df = tx_frame(spark, rows)
    m = B.fit_graph(df)
    e = B.shared_card_edges(m.keyed(df), m.nodes, cap=10, hubs=False).collect()
    assert sorted((r["etype"], r["src"], r["dst"]) for r in e) == [("shared_address", 8, 9), ("shared_address", 9, 8)]


def test_shared_edges_without_a_cap_are_all_pairs_in_blocks(spark, monkeypatch):
    rows = [(i, i, 1.0, i, 5.0 if i < 30 else 6.0, 1.0, "x.com", "mobile", f"d{i % 20}", 0) for i in range(40)]
    df = tx_frame(spark, rows)
    m = B.fit_graph(df)
    monkeypatch.setattr(B, "PAIR_BLOCK", 7)
    e = B.shared_card_edges(m.keyed(df), m.nodes, cap=None).collect()
    want = [("shared_address", a, b) for a in range(40) for b in range(40) if a != b and (a < 30) == (b < 30)]
    want += [("shared_device", a, b) for a in range(40) for b in range(40) if a != b and a % 20 == b % 20]
    assert sorted((r["etype"], r["src"], r["dst"]) for r in e) == sorted(want)


def test_shared_card_edges_query_leaves_no_pair_out(spark, sf):
    """Against all pairs in SQL: before, a key of more than 200 pairs gave 200 draws."""
    import duckdb
    from riskgraph.queries import graph as Q

    con = duckdb.connect()
    for t in ("events", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(f"""WITH {Q.HET_SQL}, k AS (SELECT 'shared_address' AS etype, k_address AS key, k_card FROM het
        UNION SELECT 'shared_device', k_device, k_card FROM het),
        sm AS (SELECT etype, k.key, idx FROM k JOIN nodes n ON n.ntype = 'card' AND n.key = k_card)
        SELECT a.etype, a.idx, b.idx FROM sm a JOIN sm b ON a.etype = b.etype AND a.key = b.key AND a.idx <> b.idx""").fetchall()
    got = [tuple(r) for r in Q.shared_card_edges(spark, sf).select("etype", "src", "dst").collect()]
    assert sorted(got) == sorted(want) and len(got) > 0


def test_peer_limit_keeps_the_smallest_peers(spark):
    rows = [(i, i, 1.0, i, 5.0, 1.0, "x.com", "mobile", f"d{i}", 0) for i in range(30)]
    got = {}
    for r in B.peer_cards(tx_frame(spark, rows), limit=4).collect():
        got.setdefault(r["card"], []).append(r["peer"])
    assert len(got) == 30
    for c, peers in got.items():
        assert sorted(peers) == [x for x in range(6) if x != c][:4]


def test_neighbourhood_takes_the_smallest_hop(spark):
    e = edges_of(spark, [(1, 2), (1, 3), (2, 4), (3, 5), (2, 3)])
    got = {(r["node"], r["hop"]) for r in B.neighbourhood(nodes_of(spark, [1]), e).collect()}
    assert got == {("2", 1), ("3", 1), ("4", 2), ("5", 2)}


def test_sampling_fanout(spark):
    e = edges_of(spark, [(0, i) for i in range(1, 40)])
    s = B.sample_neighbours(nodes_of(spark, [0]), e, fanouts=(15, 10))
    one = s.filter("hop = 1")
    assert one.count() == 15 and one.select("dst").distinct().count() == 15
    again = B.sample_neighbours(nodes_of(spark, [0]), e, fanouts=(15, 10)).filter("hop = 1")
    assert one.exceptAll(again).count() == 0


def test_knn_in_blocks(spark):
    rng = np.random.default_rng(1)
    bank, q = rng.normal(size=(90, 8)), rng.normal(size=(40, 8))
    q[0] = 0
    bd = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(bank)], "id long, v array<double>")
    qd = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "id long, v array<double>")
    got = {}
    for r in K.similar_cases(qd, bd, k=3, dim=8, block=16).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["case_id"], r["cosine"])
    bn = bank / np.linalg.norm(bank, axis=1, keepdims=True)
    for i, v in enumerate(q):
        s = bn @ (v / (np.linalg.norm(v) or 1.0))
        want = sorted(range(90), key=lambda j: (-round(s[j], 12), j))[:3]
        assert [got[i][k][0] for k in (1, 2, 3)] == want


def test_embedding_lookup(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "card long")
    emb = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "c long, v array<float>")
    got = {r["card"]: (list(r["embedding"]), r["is_cold"]) for r in K.lookup_embeddings(
        df, emb, key="card", emb_key="c", vec="v", dim=2).collect()}
    assert got == {1: ([1.0, 2.0], False), 2: ([0.0, 0.0], True), 3: ([0.0, 0.0], True)}


def test_graph_features_have_28_columns_and_fall_back_to_zero(spark):
    rows = [(i, i, 1.0, i % 3, 5.0, 1.0, "x.com", "mobile", f"d{i % 4}", i % 2) for i in range(12)]
    df = tx_frame(spark, rows)
    m = fit_graph_features(df, F.col("TransactionDT") < 6)
    out = m.transform(df)
    assert len(out.columns) == 29 and out.count() == 12
    new = m.transform(tx_frame(spark, [(99, 1, 1.0, 77, 9.0, 9.0, "y.org", "z", "z", 0)])).first()
    assert new["feat_gr_card_degree"] == 0 and new["feat_gr_tx_degree"] == 6


def test_copies_of_a_vector_stay_few_as_the_tables_grow():
    assert K.block_counts(2000, 2000, 4096) == (1, 1) and K.block_counts(12_000, 12_000, 4096) == (3, 3)
    assert K.block_counts(0, 0, 4096) == (1, 1)
    for n in (60_000, 120_000, 500_000):
        assert K.block_counts(n, n, 4096) == (8, 8)


def test_nearest_cases_do_not_depend_on_the_blocks(spark):
    draw = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(draw.normal(size=(300, 8)))], "id long, v array<double>")
    got = [sorted(map(tuple, K.similar_cases(rows, rows, k=3, dim=8, block=b, skip_self=True).collect())) for b in (4096, 10)]
    assert got[0] == got[1] and len(got[0]) == 900
