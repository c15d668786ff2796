import itertools
import random

import pytest

from riskgraph.operators.graph.cores import core_members, core_numbers


def plain(pairs, names):
    adj = {v: set() for v in names}
    for a, b in pairs:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    core, k = {}, 0
    while adj:
        low = [v for v in adj if len(adj[v]) <= k]
        if not low:
            k += 1
            continue
        for v in low:
            core[v] = k
            for w in adj.pop(v):
                adj.get(w, set()).discard(v)
    return core


def frames(spark, pairs, names):
    return spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(v,) for v in names], "id long")


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    draw = random.Random(seed)
    pairs = [(int(draw.expovariate(0.06)), draw.randrange(70)) for _ in range(260)]
    pairs += [*itertools.combinations(range(60, 68), 2), (3, 3), pairs[0]]
    names = range(200)
    got = {r.id: r.core for r in core_numbers(*frames(spark, pairs, names)).collect()}
    assert got == plain(pairs, names)


def test_chain_clique_star_and_nothing(spark):
    pairs = [(i, i + 1) for i in range(12)] + [*itertools.combinations(range(20, 25), 2)] + [(30, 31 + i) for i in range(40)]
    got = {r.id: (r.core, r.ring_member) for r in core_members(*frames(spark, pairs, range(80)), k=3).collect()}
    assert got == {v: (c, int(c >= 3)) for v, c in plain(pairs, range(80)).items()}
    none = spark.createDataFrame([], "src long, dst long")
    assert [tuple(r) for r in core_numbers(none, spark.range(1)).collect()] == [(0, 0)]
