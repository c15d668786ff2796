"""Paths and rings over classes of cards with one closed neighbourhood."""

import itertools

import pytest

from riskgraph.operators.graph import paths as P
from riskgraph.operators.graph import rings as R
from riskgraph.operators.graph.twins import twin_classes


def bfs(adj, s):
    dist, sigma, order = {s: 0}, {s: 1}, [s]
    for v in order:
        for w in adj[v]:
            if w not in dist:
                dist[w], sigma[w] = dist[v] + 1, 0
                order.append(w)
            if dist[w] == dist[v] + 1:
                sigma[w] += sigma[v]
    return dist, sigma, order


def test_twins_are_searched_once_and_counted_all(spark, monkeypatch):
    """Six devices in a row, ten cards on each two neighbouring ones, one loner: 51 cards, 5 classes."""
    device = {f"c{i:02d}": {i // 10, i // 10 + 1} for i in range(50)} | {"x": {99}}
    adj = {a: [b for b in device if b != a and device[a] & device[b]] for a in device}
    n = len(adj)
    want_c, want_b, want_t = {}, dict.fromkeys(adj, 0.0), {}
    for s in adj:
        dist, sigma, order = bfs(adj, s)
        total = sum(dist.values())
        want_c[s] = (len(dist) - 1) / total * (len(dist) - 1) / (n - 1) if total else 0.0
        want_t[s] = sum(b in adj[a] for a, b in itertools.combinations(adj[s], 2))
        delta = dict.fromkeys(dist, 0.0)
        for w in reversed(order):
            for v in adj[w]:
                if dist.get(v) == dist[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                want_b[w] += delta[w]
    want_b = {v: x / ((n - 1) * (n - 2)) for v, x in want_b.items()}
    e = spark.createDataFrame([(a, b) for a in adj for b in adj[a] if a < b], "src string, dst string")
    nd = spark.createDataFrame([(a,) for a in adj], "id string")
    written, cut = {}, P.cut

    def count(df, tag="cut"):
        out = cut(df, tag)
        written[tag] = max(written.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(P, "cut", count)
    assert {x[0]: x[1] for x in P.betweenness(e, nd, k=None).collect()} == pytest.approx(want_b)
    assert {x[0]: x[1] for x in P.closeness(e, nd).collect()} == pytest.approx(want_c)
    # A row per (source, card) would be 50 and more in a level, and 50 in the reached sets.
    assert written["level"] <= 5 and written["reach"] <= 5
    assert {x[0]: x[1] for x in R.triangles(e, nd).collect()} == want_t
    members, links = twin_classes(e)
    assert members.select("v").distinct().count() == 5 and links.count() == 8


def test_graph_features_leave_no_hub_out(spark):
    """One address of 520 cards, one card apart, one that ties the two: before, a key of 500 cards was dropped."""
    from riskgraph.operators.graph.features import fit_graph_features

    rows = [(i, i, 1.0, i, 5.0 if i < 520 else 6.0, 1.0, f"m{i % 2 if i < 520 else i}.com", "mobile", f"d{i}" if i < 521 else "d0", 0)
            for i in range(522)]
    df = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, addr1 double,"
                               " addr2 double, P_emaildomain string, DeviceType string, DeviceInfo string, isFraud int")
    key = [{("a", r[4]), ("e", r[6]), ("d", r[8])} for r in rows]
    adj = {i: [j for j in range(522) if i != j and key[i] & key[j]] for i in range(522)}
    near = {i: set(x) for i, x in adj.items()}
    got = {r["key"]: r for r in fit_graph_features(df, betweenness_k=None).cards.collect()}
    want_b = dict.fromkeys(adj, 0.0)
    for s in adj:
        dist, sigma, order = bfs(adj, s)
        total, delta = sum(dist.values()), dict.fromkeys(dist, 0.0)
        assert got[str(s)]["closeness"] == pytest.approx((len(dist) - 1) / total * (len(dist) - 1) / 521 if total else 0.0), s
        for w in reversed(order):
            for v in adj[w]:
                if dist.get(v) == dist[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                want_b[w] += delta[w]
    assert {int(k): r["betweenness"] for k, r in got.items()} == pytest.approx({v: x / (521 * 520) for v, x in want_b.items()})
    for s in (0, 1, 519, 520, 521):
        assert got[str(s)]["ring_size"] == 1 + sum(len(near[s] & near[b]) for b in near[s]) // 2, s


def test_cards_with_the_same_entities_are_one_node(spark):
    from riskgraph.operators.graph import build as B

    rows = [(i, f"c{i}", f"a{i // 4}", "e" if i < 6 else f"e{i // 4}", f"d{i // 4}", "ip") for i in range(12)]
    keys = spark.createDataFrame(rows, "TransactionID long, card string, addr string, email string, device string, ip string")
    alike = B.alike_cards(keys)
    reps = {r.id: r.rep for r in alike.collect()}
    assert len(set(reps.values())) == 4 and reps["c5"] == "c4" and reps["c7"] == "c6"
    full = B.card_projection(keys, hub_cap=None).selectExpr("card_a AS src", "card_b AS dst")
    few = B.card_projection(keys.join(alike.selectExpr("rep AS card").distinct(), "card", "left_semi"), hub_cap=None)
    nodes = keys.selectExpr("card AS id").distinct()
    twins = twin_classes(few.selectExpr("card_a AS src", "card_b AS dst"), alike)
    assert few.count() < full.count()
    for whole, small in ((P.betweenness(full, nodes), P.betweenness(few, nodes, twins=twins)),
                         (P.closeness(full, nodes), P.closeness(few, nodes, twins=twins)),
                         (R.triangles(full, nodes), R.triangles(few, nodes, twins=twins))):
        assert {r[0]: r[1] for r in small.collect()} == pytest.approx({r[0]: r[1] for r in whole.collect()})
