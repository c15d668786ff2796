import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgraph.llm import vector_codes as vc
from riskgraph.llm.common import read

SCHEMA = "vec_id long, embedding array<float>, label int"
TOP = (1 << 63) - 1


def plain(rows, parts=16, entries=64, rounds=2):
    """The contract in loops: ``[(vec_id, code, error, label_error)]`` in the order of the kept rows, and the digest."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (width * parts - len(v)), label) for i, v, label in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    book = [[cut[k][p] for k in first] for p in range(parts)]

    def far(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest(p, v):
        return min(range(len(book[p])), key=lambda e: (far(v, book[p][e]), e))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for v in cut:
                held.setdefault(nearest(p, v[p]), []).append(v[p])
            for e, vs in held.items():
                book[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    codes = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
    errors = [sum(far(v[p], book[p][c[p]]) for p in range(parts)) for v, c in zip(cut, codes, strict=True)]
    total = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        total[label] = total.get(label, 0) + min(e, TOP)
    digest = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c in code), min(e, TOP), min(total[label], TOP), digest)
            for (i, _, label), code, e in zip(kept, codes, errors, strict=True)]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def run(spark, given, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).select("*", *[F.lit(1).alias(c) for c in ("code", "error", "_parts", "codes", "entry", "part", "looked")])
    given(vc, embeddings=df)
    return ordered(vc.op11_vector_codes(spark, "").collect())


def test_whole_table_equals_loops(spark, sf):
    rows = [tuple(r) for r in read(spark, sf, "embeddings").select("vec_id", "embedding", "label").collect()]
    assert ordered(vc.op11_vector_codes(spark, sf).collect()) == ordered(plain(rows))


def test_odd_rows(spark, given):
    draw = random.Random(1)
    nan, inf = float("nan"), float("inf")
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(draw.gauss(0, 1)) for _ in range(32)], draw.choice([1, 2, None])) for i in range(80)]
    rows += [rows[3], rows[3], (5, rows[7][1], 1), (None, rows[9][1], None), (None, [0.5] * 32, 3)]
    rows += [(200, None, 1), (201, [1.0, None] + [0.0] * 30, 1), (202, [nan] + [0.0] * 31, 1), (203, [-inf] + [0.0] * 31, 2)]
    rows += [(204, [0.25] * 20, 4), (205, [], 4), (206, [1e6] * 32, 5), (-3, [-0.001] * 32, 6)]
    assert run(spark, given, rows) == ordered(plain(rows))


def test_large_values_are_exact(spark, given):
    draw = random.Random(2)
    rows = [(i, [float(np.float32(draw.gauss(0, 10.0 ** draw.choice([0, 5, 8])))) for _ in range(16)], 1) for i in range(90)]
    assert run(spark, given, rows) == ordered(plain(rows))


@pytest.mark.parametrize("n", [1, 2, 5, 70])
def test_ties_and_few_rows(spark, given, n):
    draw = random.Random(n)
    rows = [(draw.randrange(50), [draw.choice([0.0, 1.0, 2.0]) for _ in range(16)], draw.choice([None, 1])) for _ in range(n)]
    assert run(spark, given, rows) == ordered(plain(rows))


def test_empty_tables(spark, given):
    assert run(spark, given, []) == []
    assert run(spark, given, [(1, None, 2)]) == []
    assert run(spark, given, [(1, [], 2)]) == ordered(plain([(1, [], 2)]))


@pytest.mark.parametrize("b", [1, 2, 8, 31])
def test_bounds_never_lose_the_nearest(b):
    """Many rounds of moving entries: followed codes are those of measuring everything, lower index first."""
    draw = np.random.default_rng(b)
    x = draw.integers(-40, 40, (600, 3))
    c = draw.integers(-40, 40, (24, 3))
    codes, upper, near, lower, outer = vc.measure(x, c, b)
    spared = 0
    for step in range(12):
        new = c + draw.integers(-3, 4, c.shape) * (draw.random((len(c), 1)) < 0.4)
        moved = vc._moves(c, new)
        c = new
        codes, upper, near, lower, outer, looked = vc.follow(x, c, moved, codes, upper, near, lower, outer)
        squares = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (codes == squares.argmin(1)).all()
        away = np.sqrt(squares.astype(float))
        assert (upper >= away[np.arange(len(x)), codes]).all()
        real = np.isfinite(lower)
        assert (lower[real] <= np.take_along_axis(away, near, 1)[real] + 1e-9).all()
        rest = away.copy()
        np.put_along_axis(rest, np.where(real, near, codes[:, None]), np.inf, 1)
        rest[np.arange(len(x)), codes] = np.inf
        assert (outer <= rest.min(1) + 1e-9).all()
        spared += (looked == 0).sum()
        b = (b, 3, 7, 2)[step % 4]
        near, lower, outer = vc.keep(near, lower, outer, b)
    assert spared > 1000


def test_kept_entries_adapt(spark):
    seen = lambda counts: spark.createDataFrame([(d,) for d, n in counts.items() for _ in range(n)], "looked int")
    assert vc._next_near(seen({0: 90, 3: 8, 64: 2}), 8, 64) == 3
    assert vc._next_near(seen({0: 99, 64: 1}), 8, 64) == vc.LEAST
    assert vc._next_near(seen({1: 80, 64: 20}), 8, 64) == 16
