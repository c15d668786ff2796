"""Nearest cases by cosine similarity.

Bank and queries are cut into blocks; every pair of blocks is one group with a bounded number of
vectors, in which only the best ``k`` per query are left.  Neither side is broadcast and no
(query, case) pairs leave a task.  :class:`Nearest` finds them: a product in single precision rules out
what cannot be among the best by the bound of its error, and what is left is measured in double precision.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.functions import scalar as S


#: Pairs of blocks that the work is cut into, about, as long as blocks stay within ``MOST_BLOCK``.
GROUPS = 64
MOST_BLOCK = 1 << 16
#: Cosines that a task holds at once, and the cases among them.
PRODUCTS = 1 << 20
CASES = 1 << 13
#: Products of which the largest is looked at first, and candidates measured at once.
SPAN = 64
MEASURED = 1 << 15


def block_counts(queries: int, cases: int, block: int) -> tuple[int, int]:
    """Blocks of both sides.  Every vector travels once per block of the other side, so blocks grow from
    ``block`` to ``MOST_BLOCK`` vectors with the tables, and the copies of a vector stay a few."""
    size = max(block, min(MOST_BLOCK, ceil(sqrt(queries * cases / GROUPS))))
    return max(1, ceil(queries / size)), max(1, ceil(cases / size))


def unit_vectors(df: DataFrame, ident: str, vec: str, dim: int) -> DataFrame:
    """``id, v``: padded or truncated to ``dim`` and scaled to unit length."""
    return df.select(F.col(ident).alias("id"), S.unit(S.fit_length(F.col(vec), dim)).alias("v"))


def matrix(table: pa.Table) -> np.ndarray:
    return table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows, added dimension by dimension: the same in whatever pieces they are asked for."""
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    out = np.zeros(x.shape[1])
    for a, b in zip(x, y, strict=True):
        out += a * b
    return np.round(out, 12)


class Nearest:
    """The best ``k`` cases of each row of ``x``, of cases that are offered in pieces; all are unit or zero vectors.

    ``floor`` is a number that the ``k``-th best cosine of a row is known to reach.  A single-precision product is
    off by at most ``slack``, so a case below the floor by more than that cannot be among the best.  Cases
    of the row's own code (``own`` against ``codes``) are left out.
    """

    def __init__(self, x: np.ndarray, k: int, own: np.ndarray | None = None):
        self.x, self.k, self.own = x, k, own
        self.x32 = x.astype(np.float32)
        self.slack = (x.shape[1] + 8) * 2.0 ** -24
        self.floor = np.full(len(x), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def offer(self, mat: np.ndarray, at: np.ndarray, rows: np.ndarray | None = None, codes: np.ndarray | None = None) -> None:
        """Offers the cases ``mat``, in the order of ``at``, to ``rows`` (or all)."""
        rows = np.arange(len(self.x)) if rows is None else rows
        fine = np.isfinite(mat).all(axis=1)  # others have no cosine
        if not fine.all():
            mat, at, codes = mat[fine], at[fine], None if codes is None else codes[fine]
        hidden = 0 if codes is None or not len(codes) else int(np.unique(codes, return_counts=True)[1].max())
        m32, step = mat.astype(np.float32), max(1, PRODUCTS // max(1, min(len(mat), CASES)))
        held = np.empty(max(1, min(len(rows), step) * min(len(mat), CASES)), np.float32)  # written anew by each product
        for i in range(0, len(rows), step):
            r = rows[i:i + step]
            x32 = self.x32[r]
            for j in range(0, len(mat), CASES):
                part = m32[j:j + CASES].T
                near = np.matmul(x32, part, out=held[:len(r) * part.shape[1]].reshape(len(r), -1))
                self._piece(r, near, mat[j:j + CASES], at[j:j + CASES],
                            None if codes is None else codes[j:j + CASES], self.k + hidden)

    def _piece(self, r, near, mat, at, codes, want) -> None:
        n = near.shape[1]
        span = max(1, min(SPAN, n // (4 * want)))
        heads = -(-n // span)
        top = near[:, :heads].copy()
        for a in range(heads, n, heads):
            part = near[:, a:a + heads]
            np.maximum(top[:, :part.shape[1]], part, out=top[:, :part.shape[1]])
        floor = self.floor[r]
        if heads >= want:
            floor = np.maximum(floor, np.partition(top, heads - want, axis=1)[:, heads - want] - self.slack)
            self.floor[r] = floor
        least = (floor - self.slack).astype(np.float32) - np.float32(1e-6)
        q, h = np.nonzero(top >= least[:, None])
        if len(q) * span > near.size // 16 and near.size > MEASURED:  # many equal: a zero vector, say
            return self._dense(r, mat, at, codes)
        cols = h[:, None] + heads * np.arange(span)
        here = cols < n
        cols = np.minimum(cols, n - 1)
        g, s = np.nonzero((near[q[:, None], cols] >= least[q][:, None]) & here)
        q, c = q[g], cols[g, s]
        if codes is not None:
            other = self.own[r[q]] != codes[c]
            q, c = q[other], c[other]
        for a in range(0, len(q), MEASURED):
            qa, ca = r[q[a:a + MEASURED]], c[a:a + MEASURED]
            self._keep(qa, at[ca], cosines(self.x[qa], mat[ca]))

    def _dense(self, r, mat, at, codes) -> None:
        sims = np.round(self.x[r] @ mat.T, 12)
        if codes is not None:
            sims[self.own[r][:, None] == codes[None, :]] = -np.inf
        order = np.argsort(-sims, axis=1, kind="stable")[:, :self.k]
        keep = np.isfinite(np.take_along_axis(sims, order, axis=1))
        q = np.repeat(r, keep.sum(axis=1))
        self._keep(q, at[order[keep]], cosines(self.x[q], mat[order[keep]]))

    def _keep(self, rows, cols, sims) -> None:
        self.found.append((rows, cols, sims))
        self.held += len(rows)
        if self.held > max(PRODUCTS, 4 * self.k * len(self.x)):
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, cases and cosines of the best so far, in order; equal cosines in the order of the cases."""
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        rows, cols, sims = (np.concatenate(x) for x in zip(*self.found, strict=True))
        fine = np.isfinite(sims)
        rows, cols, sims = rows[fine], cols[fine], sims[fine]
        order = np.lexsort((cols, -sims, rows))
        rows, cols, sims = rows[order], cols[order], sims[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        full = place == self.k - 1
        self.floor[rows[full]] = np.maximum(self.floor[rows[full]], sims[full] - 1e-9)
        self.found, self.held = [(rows[keep], cols[keep], sims[keep])], int(keep.sum())
        return self.found[0]


def id_codes(asked: pa.ChunkedArray, ids: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the ids of queries and of cases, equal where the ids are; a null is equal to none."""
    known = pc.unique(pc.drop_null(ids))
    own = pc.fill_null(pc.index_in(asked.cast(ids.type), known), -1).to_numpy()
    return own, pc.fill_null(pc.index_in(ids, known), -2).to_numpy()


def best_matches(qs: pa.Table, bs: pa.Table, k: int, skip_self: bool, offer=None) -> pa.Table:
    """``query_id, case_id, cosine`` of the best ``k`` of one group.  ``offer(nearest, mat, codes, sorted cases)``
    says which cases are offered to which queries; all to all without it."""
    schema = {"query_id": qs.schema.field("id").type, "case_id": bs.schema.field("id").type, "cosine": pa.float64()}
    if not qs.num_rows or not bs.num_rows:
        return pa.table({n: pa.array([], t) for n, t in schema.items()})
    bs = bs.sort_by("id")
    own, codes = id_codes(qs["id"], bs["id"]) if skip_self else (None, None)
    nearest, mat = Nearest(matrix(qs), k, own), matrix(bs)
    if offer is None:
        nearest.offer(mat, np.arange(len(mat)), codes=codes)
    else:
        offer(nearest, mat, codes, bs)
    rows, cols, sims = nearest.best()
    return pa.table({"query_id": qs["id"].take(pa.array(rows)), "case_id": bs["id"].take(pa.array(cols)), "cosine": sims},
                    schema=pa.schema(list(schema.items())))


def similar_cases(queries: DataFrame, bank: DataFrame, *, k: int = 3, query_id: str = "id", query_vec: str = "v",
                  case_id: str = "id", case_vec: str = "v", dim: int = 64, block: int = 4096,
                  skip_self: bool = False) -> DataFrame:
    """``query_id, case_id, cosine, rank``: exact top ``k``; equal cosines in case order.

    A zero query vector has cosine 0 to every case.
    """
    q = unit_vectors(queries, query_id, query_vec, dim)
    b = unit_vectors(bank, case_id, case_vec, dim)
    nq, nb = block_counts(q.count(), b.count(), block)
    q = q.select(F.pmod(F.xxhash64("id"), F.lit(nq)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("bb"),
                 F.lit(0).alias("side"), "id", "v")
    b = b.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("qb"),
                 F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int").alias("bb"), F.lit(1).alias("side"), "id", "v")
    qid, cid = q.schema["id"].dataType.simpleString(), b.schema["id"].dataType.simpleString()

    near = q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInArrow(
        lambda qs, bs: best_matches(qs, bs, k, skip_self), f"query_id {qid}, case_id {cid}, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "case_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def with_similarity(matches: DataFrame) -> DataFrame:
    """Cosine mapped to 0..1."""
    return matches.withColumn("similarity", S.similarity(F.col("cosine")))


def lookup_embeddings(df: DataFrame, embeddings: DataFrame, *, key: str, emb_key: str, vec: str, dim: int) -> DataFrame:
    """Embedding per row by key; zeros when the key is unknown or the length is wrong."""
    e = embeddings.select(F.col(emb_key).alias("_ek"), F.col(vec).alias("_v"))
    zero = F.array_repeat(F.lit(0).cast("float"), dim)
    return df.join(e, df[key] == F.col("_ek"), "left").withColumn(
        "embedding", F.when(F.size("_v") == dim, F.col("_v")).otherwise(zero)).withColumn(
        "is_cold", F.coalesce(F.size("_v") != dim, F.lit(True))).drop("_ek", "_v")
