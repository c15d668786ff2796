import random

import pytest
from pyspark.sql import functions as F

from riskgraph.operators.graph import ivf
from riskgraph.operators.graph.knn import similar_cases


@pytest.fixture(scope="module")
def bank(spark):
    draw = random.Random(2)
    centers = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + draw.gauss(0, 0.5) for x in draw.choice(centers)]) for i in range(900)]
    return spark.createDataFrame([*rows, (900, None), (901, [0.0] * 8), (902, rows[5][1])], "id long, v array<double>").cache()


def exact_cases(bank, k):
    full = bank.withColumn("v", F.coalesce("v", F.array_repeat(F.lit(0.0), 8)))
    return similar_cases(full, full, k=k, dim=8, skip_self=True)


def rows(df):
    return sorted((r.query_id, r["rank"], r.case_id, round(r.cosine, 9)) for r in df.collect())


@pytest.mark.parametrize("block", [40, 4096])
def test_all_cells_probed_equals_the_exact_operator(bank, block):
    index = ivf.fit_ivf(bank, dim=8, cells=9, probes=9)
    got = ivf.search(bank, index, k=4, skip_self=True, block=block)
    assert rows(got) == rows(exact_cases(bank, 4))


def test_tuned_recall_and_copies(bank):
    index = ivf.tune(ivf.fit_ivf(bank, dim=8, cells=30, probes=1), bank, target=0.95, skip_self=True, on=10_000)
    assert 1 <= index.probes < 30
    exact = exact_cases(bank, 3)
    found = ivf.search(bank, index, k=3, skip_self=True)
    assert ivf.recall(found, exact) >= 0.95
    fewer = ivf.search(bank, ivf.replace(index, probes=1), k=3, skip_self=True)
    assert ivf.recall(fewer, exact) < ivf.recall(found, exact)
    # Every case lies in one cell, every query in as many as are probed.
    assert index.bank.count() == bank.count()
    assert index.bank.groupBy("id").count().filter(F.col("count") != 1).count() == 0


def test_few_and_no_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 1.0])], "id long, v array<double>")
    index = ivf.fit_ivf(one, dim=2)
    assert [tuple(r)[:3] for r in ivf.search(one.filter("id = 1"), index).collect()] == [(1, 1, 1.0)]
    none = one.limit(0)
    assert ivf.search(one, ivf.fit_ivf(none, dim=2)).collect() == []
    assert ivf.search(none, index).collect() == []
    assert ivf.tune(index, none).probes == 1


def test_all_cells_of_a_batch_come_in_bounded_pieces():
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(3)
    x, centers = draw.normal(size=(500, 4)), draw.normal(size=(300, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(x.tolist())], names=["id", "v"])
    parts = list(ivf._nearest_cells(batch, centers, 300))
    assert sum(p.num_rows for p in parts) == 500 * 300 and max(p.num_rows for p in parts) <= ivf.PIECE_ROWS
    near = pa.Table.from_batches(parts)
    want = np.argsort((centers * centers).sum(axis=1) / 2 - np.round(x @ centers.T, 12), axis=1, kind="stable")
    assert np.array_equal(near["cell"].to_numpy().reshape(500, 300), want)
    assert near["v"][300 * 7 + 5].as_py() == x[7].tolist()


def test_a_query_is_copied_for_packs_and_not_for_cells():
    """With all of 300 cells probed a query goes to 3 packs; before, it went to 300 cells."""
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(4)
    x, centers = draw.normal(size=(50, 4)), draw.normal(size=(300, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(x.tolist())], names=["id", "v"])
    packs = ivf._packs({c: 10 for c in range(300)}, 1000)
    assert [len(p) for p in packs] == [100, 100, 100]
    assert sum(p.num_rows for p in ivf._probed(batch, centers, 300, packs)) == 50 * 3
    want = np.argsort((centers * centers).sum(axis=1) / 2 - np.round(x @ centers.T, 12), axis=1, kind="stable")[:, :7]
    got = {i: set() for i in range(50)}
    for part in ivf._probed(batch, centers, 7, packs):
        for r in part.to_pylist():
            bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=100)
            got[r["id"]] |= {packs[r["pack"]][j] for j in np.nonzero(bits)[0]}
    assert got == {i: set(w) for i, w in enumerate(want.tolist())}
    # A cell of more cases than a pack is cut, and takes up no room beside others.
    assert ivf._packs({0: 5, 1: 25, 2: 5, 3: 5, 4: 1}, 10) == [[0], [1], [1], [1], [2, 3], [4]]


@pytest.mark.parametrize("skip", [False, True])
def test_single_precision_rules_out_no_best_case(monkeypatch, skip):
    """Near ties below single precision, copies, zero vectors and a row without numbers, against a full sort."""
    import numpy as np
    from riskgraph.operators.graph import knn

    monkeypatch.setattr(knn, "CASES", 128)
    monkeypatch.setattr(knn, "PRODUCTS", 4096)
    monkeypatch.setattr(knn, "MEASURED", 100)
    draw = np.random.default_rng(6)
    mat = draw.normal(size=(700, 16))
    mat[100:400] = mat[100] + draw.normal(size=(300, 16)) * 1e-9  # cosines that differ in the 9th digit and beyond
    mat[400:500] = mat[400]
    mat[500:505] = 0
    mat[505:560, 3:] = 0
    mat /= np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-300)
    x = np.concatenate([mat[::3], mat[400:420]])
    mat[600] = np.nan
    codes = np.arange(700) // 2 if skip else None
    own = np.concatenate([np.arange(0, 700, 3) // 2, np.full(20, -1)]) if skip else None
    n = knn.Nearest(x, 4, own)
    n.offer(mat[:300], np.arange(300), codes=None if codes is None else codes[:300])
    n.offer(mat[300:], np.arange(300, 700), codes=None if codes is None else codes[300:])
    rows, cols, sims = n.best()
    full = np.round(np.einsum("id,jd->ij", x, mat), 12)
    full[:, 600] = -np.inf
    if skip:
        full[own[:, None] == codes[None, :]] = -np.inf
    assert len(rows) == 4 * len(x)
    for i in range(len(x)):
        at = rows == i
        want = np.sort(full[i])[::-1][:4]
        assert np.allclose(sims[at], want, atol=2e-12, rtol=0)
        assert np.allclose(full[i][cols[at]], want, atol=2e-12, rtol=0)
        assert all(a < b for (a, s), (b, t) in zip(zip(cols[at], sims[at]), zip(cols[at][1:], sims[at][1:])) if s == t)
