import random

import pytest

from riskgraph.operators.graph.hubs import dense_numbers, hub_index, neighbour_counts


def plain(rows, starts, hops):
    keys, members = {}, {}
    for k, c in rows:
        if k is not None and c is not None:
            keys.setdefault(c, set()).add(k)
            members.setdefault(k, set()).add(c)
    out = {}
    for s in starts:
        if s is not None:
            seen, front = {s}, {s}
            for _ in range(hops):
                front = {c for f in front for k in keys.get(f, ()) for c in members[k]} - seen
                seen |= front
            out[s] = len(seen) - 1
    return out


def run(spark, rows, starts, hops, heavy):
    index = hub_index(spark.createDataFrame(rows, "key string, member long"), heavy=heavy, hops=hops)
    s = spark.createDataFrame([(x,) for x in starts], "member long")
    got = neighbour_counts(s, index, hops=hops).collect()
    assert len(got) == len({r.member for r in got})
    return {r.member: r.n_unique_neighbors for r in got}


@pytest.mark.parametrize("hops", [1, 2])
@pytest.mark.parametrize("heavy", [2, 4, 1000])
def test_random_graphs(spark, hops, heavy):
    draw = random.Random(heavy + hops)
    rows = [(f"k{min(int(draw.expovariate(0.08)), 60)}", draw.randrange(150)) for _ in range(220)]
    rows += [(None, 3), ("k1", None), ("alone", 149), *rows[:9]]
    starts = [*range(0, 160, 3), None, 5, 5, 149]
    assert run(spark, rows, starts, hops, heavy) == plain(rows, starts, hops)


def test_large_hub_beside_chains(spark):
    """A key of 10,000 cards, cards that meet it only by way of others, and cards far from it."""
    rows = [("hub", c) for c in range(10_000)] + [(f"pair{c}", c + d) for c in range(9_990, 10_060) for d in (0, 1)]
    rows += [("hub2", c) for c in range(9_000, 40_000, 3)]
    starts = [0, 9_000, 9_999, 10_000, 10_001, 10_002, 10_050, 39_999, 50_000]
    for hops in (1, 2):
        assert run(spark, rows, starts, hops, 256) == plain(rows, starts, hops)


def test_empty(spark):
    assert run(spark, [], [1, 2], 2, 4) == {1: 0, 2: 0}
    assert run(spark, [("a", 1), ("a", 2)], [], 2, 4) == {}
    with pytest.raises(ValueError):
        run(spark, [("a", 1)], [1], 3, 4)


def test_numbers_are_dense(spark):
    ids = spark.createDataFrame([(x,) for x in (5, 3, 900, 5, -7)], "member long")
    assert {r.member: r.num for r in dense_numbers(ids).collect()} == {-7: 0, 3: 1, 5: 2, 900: 3}


def test_no_pairs_of_hub_members(spark):
    """Rows joined through a hub grow with its members, not with their square."""
    n = 3000
    index = hub_index(spark.createDataFrame([("hub", c) for c in range(n)], "key string, member long"))
    assert index.light.count() == 0 and index.hubs.count() == 2
    got = neighbour_counts(spark.range(n).withColumnRenamed("id", "member"), index)
    assert {r.n_unique_neighbors for r in got.collect()} == {n - 1}
