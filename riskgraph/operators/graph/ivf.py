"""Nearest cases by an inverted file: k-means cells, the nearest cells of a query probed, exact re-rank.

The exact operator (:mod:`riskgraph.operators.graph.knn`) compares every query with every case; this one
compares it with the cases of the cells nearest to it.  What is compared is ranked exactly, so a match
found has its true cosine, and with all cells probed both operators agree.

* Cells are learned from at most ``sample`` cases chosen by hash, their number is the root of the number
  of cases, at most :data:`MOST_CELLS`; the centres are the only thing that is broadcast.
* Every case lies in one cell.  Cells are packed, a cell of more cases than a pack is cut, and a query goes once to a
  pack in which it probes a cell, with one bit per cell there: copies of a query follow the packs, not the cells
  probed.  Queries are cut into blocks too, so a group is bounded however many cases fall into one cell.
* :func:`tune` measures, on a stated number of queries, in which cell of a query's order its true
  neighbours lie, and takes as many probes as the wanted recall needs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.operators.graph.knn import best_matches, block_counts, similar_cases, unit_vectors
from riskgraph.plans.lineage import cut

MOST_CELLS = 4096
SAMPLE = 100_000
#: Queries that :func:`tune` compares with all cases.
TUNED_ON = 500
#: Rows that a task hands on at once, and distances to centres that it holds at once.
PIECE_ROWS = 1 << 15
PIECE_PRODUCTS = 1 << 20


@dataclass(frozen=True)
class IvfIndex:
    """``bank``: id, v (unit length), cell.  ``centers``: one row per cell.  ``probes``: cells per query."""

    bank: DataFrame
    centers: np.ndarray
    probes: int
    dim: int


def _units(df: DataFrame, ident: str, vec: str, dim: int) -> DataFrame:
    empty = F.array().cast(df.schema[vec].dataType)
    return unit_vectors(df.select(ident, F.coalesce(F.col(vec), empty).alias(vec)), ident, vec, dim)


def _nearest_cells(batch: pa.RecordBatch, centers: np.ndarray, probes: int):
    """Vectors of a batch with their nearest cells, in pieces of at most ``PIECE_ROWS`` rows (or one
    vector's): with all cells probed a whole batch would be as many vectors as it has rows times cells."""
    half = (centers * centers).sum(axis=1) / 2  # the centres are no unit vectors
    probes = min(probes, len(centers))
    step = max(1, min(PIECE_ROWS // probes, PIECE_PRODUCTS // len(centers)))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        n = part.num_rows
        x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        order = np.argsort(half - np.round(x @ centers.T, 12), axis=1, kind="stable")[:, :probes]
        rows = pa.array(np.repeat(np.arange(n), probes))
        yield pa.RecordBatch.from_arrays([
            part.column("id").take(rows), part.column("v").take(rows),
            pa.array(order.reshape(-1).astype(np.int32)),
            pa.array(np.tile(np.arange(probes, dtype=np.int32), n)),
        ], names=["id", "v", "cell", "nearness"])


def _in_cells(vectors: DataFrame, centers: np.ndarray, probes: int) -> DataFrame:
    """``id, v, cell, nearness`` with one row for each of the ``probes`` nearest cells; ties to the lower cell."""
    shared = vectors.sparkSession.sparkContext.broadcast(centers)
    ident = vectors.schema["id"].dataType.simpleString()

    def assign(batches):
        for batch in batches:
            yield from _nearest_cells(batch, shared.value, probes)

    return vectors.select("id", "v").mapInArrow(assign, f"id {ident}, v array<double>, cell int, nearness int")


def fit_ivf(bank: DataFrame, *, case_id: str = "id", case_vec: str = "v", dim: int = 64, cells: int | None = None,
            probes: int = 8, sample: int = SAMPLE, seed: int = 42) -> IvfIndex:
    """Index of the cases; null vectors count as zero vectors, and null ids are left out."""
    b = cut(_units(bank.filter(F.col(case_id).isNotNull()), case_id, case_vec, dim), "bank")
    n = b.count()
    k = cells or min(MOST_CELLS, max(1, round(sqrt(n))))
    share = int(min(1.0, sample / max(n, 1)) * (1 << 30))
    some = b.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).select(array_to_vector("v").alias("features"))
    centers = np.zeros((1, dim))
    if k > 1 and n > 1:
        centers = np.stack(KMeans(k=k, seed=seed, maxIter=10).fit(some).clusterCenters())
    placed = cut(_in_cells(b, centers, 1).drop("nearness"), "cells")
    return IvfIndex(placed, centers, min(probes, len(centers)), dim)


def _packs(sizes: dict[int, int], block: int) -> list[list[int]]:
    """Cells of every pack: as many as hold ``block`` cases together; a larger cell has packs of its own."""
    packs, room = [], 0
    for cell in sorted(sizes):
        n = sizes[cell]
        if n > block:
            packs.extend([[cell]] * ceil(n / block))
            room = 0
        elif n <= room:
            packs[-1].append(cell)
            room -= n
        else:
            packs.append([cell])
            room = block - n
    return packs


def _probed(batch: pa.RecordBatch, centers: np.ndarray, probes: int, packs: list[list[int]]):
    """``id, v, pack, bits``: a vector once for each pack with one of its ``probes`` nearest cells, and which they are."""
    half = (centers * centers).sum(axis=1) / 2
    probes = min(probes, len(centers))
    step = max(1, min(PIECE_ROWS, PIECE_PRODUCTS // len(centers)))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        n = part.num_rows
        asked = np.ones((n, len(centers)), bool)
        if probes < len(centers):
            x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            order = np.argsort(half - np.round(x @ centers.T, 12), axis=1, kind="stable")[:, :probes]
            asked[:] = False
            np.put_along_axis(asked, order, True, axis=1)
        for p, cells in enumerate(packs):
            mine = asked[:, cells]
            rows = np.nonzero(mine.any(axis=1))[0]
            take = pa.array(rows)
            bits = [x.tobytes() for x in np.packbits(mine[rows], axis=1)]
            yield pa.RecordBatch.from_arrays([
                part.column("id").take(take), part.column("v").take(take), pa.array(np.full(len(rows), p, np.int32)),
                pa.array(bits, pa.binary())], names=["id", "v", "pack", "bits"])


def search(queries: DataFrame, index: IvfIndex, *, k: int = 3, query_id: str = "id", query_vec: str = "v",
           block: int = 4096, skip_self: bool = False) -> DataFrame:
    """``query_id, case_id, cosine, rank``: the best ``k`` cases of the probed cells; equal cosines in case order."""
    q = _units(queries, query_id, query_vec, index.dim)
    # At most one row per cell, so as small as the centres.
    sizes = {r.cell: r.n for r in index.bank.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    cases = sum(sizes.values())
    nq, nb = block_counts(q.count(), cases, block)
    packs = _packs(sizes, ceil(cases / nb))
    first, cut_in = {}, {}
    for p, cells in enumerate(packs):
        for c in cells:
            first.setdefault(c, p)
            cut_in[c] = cut_in.get(c, 0) + 1
    spark = index.bank.sparkSession
    where = F.broadcast(spark.createDataFrame([(c, first[c], cut_in[c]) for c in sizes], "cell int, _first int, _cut int"))
    shared = spark.sparkContext.broadcast((index.centers, packs))
    probes = index.probes
    qid, cid = q.schema["id"].dataType.simpleString(), index.bank.schema["id"].dataType.simpleString()

    def ask(batches):
        for batch in batches:
            yield from _probed(batch, shared.value[0], probes, shared.value[1])

    qd = q.mapInArrow(ask, f"id {qid}, v array<double>, pack int, bits binary").withColumn(
        "qb", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int"))
    bd = index.bank.join(where, "cell").select(
        "id", "v", "cell", (F.col("_first") + F.pmod(F.xxhash64(F.lit(5), "id"), F.col("_cut"))).cast("int").alias("pack"),
        F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))

    def best(qs: pa.Table, bs: pa.Table) -> pa.Table:
        def offer(nearest, mat, codes, cases):
            cells = shared.value[1][bs["pack"][0].as_py()]
            bits = np.frombuffer(b"".join(qs["bits"].to_pylist()), np.uint8).reshape(qs.num_rows, -1)
            asked = np.unpackbits(bits, axis=1, count=len(cells)).astype(bool)
            cell = cases["cell"].to_numpy()
            if asked.all():
                nearest.offer(mat, np.arange(len(mat)), codes=codes)
                return
            for j, c in enumerate(cells):
                at = np.nonzero(cell == c)[0]
                nearest.offer(mat[at], at, np.nonzero(asked[:, j])[0], None if codes is None else codes[at])

        return best_matches(qs, bs, k, skip_self, offer)

    keys = ("pack", "qb")
    near = qd.groupBy(*keys).cogroup(bd.groupBy(*keys)).applyInArrow(best, f"query_id {qid}, case_id {cid}, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "case_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact matches that were found."""
    true = exact.select("query_id", "case_id")
    both = true.join(found.select("query_id", "case_id"), ["query_id", "case_id"], "left_semi").count()
    return both / max(1, true.count())


def tune(index: IvfIndex, queries: DataFrame, *, target: float = 0.9, k: int = 3, query_id: str = "id", query_vec: str = "v",
         skip_self: bool = False, on: int = TUNED_ON) -> IvfIndex:
    """The index with the fewest probes that find ``target`` of the true ``k`` nearest of ``on`` queries.

    Those queries are chosen by hash and compared with all cases once.
    """
    q = queries.filter(F.col(query_id).isNotNull())
    share = int(min(1.0, on / max(q.count(), 1)) * (1 << 30))
    q = cut(_units(q.filter(F.pmod(F.xxhash64(F.lit(7), query_id), F.lit(1 << 30)) < share), query_id, query_vec, index.dim), "tuned")
    true = similar_cases(q, index.bank, k=k, dim=index.dim, skip_self=skip_self).select("query_id", "case_id")
    order = _in_cells(q, index.centers, len(index.centers)).select(
        F.col("id").alias("query_id"), "cell", "nearness")
    at = true.join(index.bank.select(F.col("id").alias("case_id"), "cell"), "case_id").join(order, ["query_id", "cell"])
    seen = {r.nearness: r.n for r in at.groupBy("nearness").agg(F.count(F.lit(1)).alias("n")).collect()}
    need, got = ceil(target * sum(seen.values())), 0
    for nearness in sorted(seen):
        got += seen[nearness]
        if got >= need:
            return replace(index, probes=nearness + 1)
    return index
