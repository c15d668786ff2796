"""Product codes of vectors: k-means of every part with adaptive bounds on the nearest entries.

A vector's components become integers and are cut into equal consecutive parts; each part position
has a codebook, improved by a few k-means rounds, and a vector is written as one entry per part.

1. The first assignment measures every part against all entries.  For each part the state keeps its
   entry, an upper bound on the distance to it, the ``b`` closest other entries with lower bounds in
   ascending order, and one outer bound for all the rest (:func:`measure`).
2. After a round the entries have moved.  The moves widen the bounds: the upper one by the own
   entry's move, each lower one by its entry's, the outer one by the largest.  A part whose upper
   bound stays below all others keeps its entry unseen.  Of an uncertain part the own distance is
   measured, then only the near entries whose bound does not exceed it; if the outer bound does not
   either, all entries are measured again (:func:`follow`).  Whatever is measured is
   compared as whole numbers, so ties go to the lower index exactly; bounds are floats rounded
   outwards and decide only what needs no look.
3. ``b`` adapts: each round counts how many near entries its rows had to look at, and the next state
   keeps as many as serve ``SERVED`` of the rows.
4. A round's state is a table below the shared folder.  A task adds its parts up per (part, entry)
   before the shuffle, so what is shuffled and what comes to the driver are at most
   parts x entries x (width + 1) numbers per task and in all, whatever the number of vectors.

Edge cases: rows whose vector is null, or has a null or non-finite component, are dropped.  Vectors
shorter than the longest, or of a length that the parts do not divide, are filled up with zeros.  The
first entries are those of the smallest ids, null ids last and equal ids by vector; with fewer rows there
are fewer entries.  Repeated rows are coded alike, row for row.  Integers stop at the limits of 64
bits; distances are exact beyond 64 bits, and only a returned error stops at the largest long.  An empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import read, same
from riskgraph.plans.lineage import cut, release

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Near entries kept at first, the least and the most that are kept, and the rows they shall serve.
NEAR, LEAST, MOST, SERVED = 8, 2, 32, 0.95
#: Relative slack of bounds; float32 rounds by less.
SLACK = 1e-6

STATE = "codes array<smallint>, upper array<float>, near array<smallint>, lower array<float>, outer array<float>, looked int"


# --- one part position, in numpy -----------------------------------------------------------------


def _low(v):
    return (np.maximum(v, 0) * (1 - SLACK)).astype(np.float32)


def _high(v):
    return (v * (1 + SLACK)).astype(np.float32)


def _root(squares) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Sums of squared differences over the last axis, exactly; shapes broadcast."""
    out = np.zeros(np.broadcast_shapes(x.shape[:-1], c.shape[:-1]), x.dtype)
    for t in range(x.shape[-1]):
        d = x[..., t] - c[..., t]
        out = out + d * d
    return out


def measure(x: np.ndarray, c: np.ndarray, b: int):
    """Against all entries: ``codes, upper, near, lower, outer``, near and lower of width ``b``."""
    n, k = len(x), len(c)
    squares = _squares(x[:, None, :], c[None, :, :])
    codes = np.argmin(squares, axis=1)
    rows = np.arange(n)
    away = _root(squares)
    upper = _high(away[rows, codes])
    away[rows, codes] = np.inf
    order = np.argsort(away, axis=1, kind="stable")
    near = np.zeros((n, b), np.int64)
    lower = np.full((n, b), np.inf, np.float32)
    have = min(b, k - 1)
    near[:, :have] = order[:, :have]
    lower[:, :have] = _low(np.take_along_axis(away, order[:, :have], axis=1))
    outer = _low(away[rows, order[:, b]]) if k - 1 > b else np.full(n, np.inf, np.float32)
    return codes, upper, near, lower, outer


def follow(x, c, moved, codes, upper, near, lower, outer):
    """The same for entries that have moved by at most ``moved``; also how many near entries each row
    had to look at, the number of entries standing for all."""
    b, k = near.shape[1], len(c)
    upper = _high(upper.astype(np.float64) + moved[codes])
    lower = _low(lower.astype(np.float64) - moved[near])
    outer = _low(outer.astype(np.float64) - moved.max())
    order = np.argsort(lower, axis=1, kind="stable")
    near, lower = np.take_along_axis(near, order, axis=1), np.take_along_axis(lower, order, axis=1)
    codes, looked = codes.copy(), np.zeros(len(x), np.int64)

    least = np.minimum(lower[:, 0], outer) if b else outer
    rows = np.flatnonzero(upper >= least)
    if not len(rows):
        return codes, upper, near, lower, outer, looked
    own = _squares(x[rows], c[codes[rows]])
    upper[rows] = _high(_root(own))
    depth = (lower[rows] <= upper[rows, None]).sum(axis=1)
    whole = upper[rows] >= outer[rows]
    looked[rows] = np.where(whole, k, depth)

    few = (depth > 0) & ~whole
    at, own, depth = rows[few], own[few], depth[few]
    if len(at):
        squares = _squares(x[at][:, None, :], c[near[at]])
        seen = np.arange(b) < depth[:, None]
        lower[at] = np.where(seen, _low(_root(squares)), lower[at])
        # The nearest of those seen and the own entry; of equals the lower index.
        best = np.minimum(own, np.where(seen, squares, own[:, None]).min(axis=1))
        index = np.where(seen & (squares == best[:, None]), near[at], k).min(axis=1)
        index = np.where(own == best, np.minimum(index, codes[at]), index)
        changed = np.flatnonzero(index != codes[at])
        slot = np.argmax(near[at[changed]] == index[changed, None], axis=1)
        # The entry left behind takes the place of the one that is now its own.
        near[at[changed], slot] = codes[at[changed]]
        lower[at[changed], slot] = _low(_root(own[changed]))
        codes[at] = index
        upper[at] = _high(_root(best))
    at = rows[whole]
    if len(at):
        codes[at], upper[at], near[at], lower[at], outer[at] = measure(x[at], c, b)
    return codes, upper, near, lower, outer, looked


def keep(near, lower, outer, b: int):
    """The state with ``b`` near entries; the bounds of those left out go into the outer one."""
    have = near.shape[1]
    order = np.argsort(lower, axis=1, kind="stable")
    near, lower = np.take_along_axis(near, order, axis=1), np.take_along_axis(lower, order, axis=1)
    if b < have:
        return near[:, :b], lower[:, :b], np.minimum(outer, lower[:, b])
    fill = ((0, 0), (0, b - have))
    return np.pad(near, fill), np.pad(lower, fill, constant_values=np.inf), outer


# --- batches -------------------------------------------------------------------------------------


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = len(values), values.size // max(len(values), 1)
    flat = pa.array(np.ascontiguousarray(values).reshape(-1), kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width, pa.int32()), flat)


def _exact(x: np.ndarray, book: np.ndarray):
    """Both as 64-bit integers if no distance can leave 64 bits, else as Python's."""
    size = max([abs(int(f(v))) for v in (x, book) if v.size for f in (np.min, np.max)], default=0)
    if 4 * size * size * max(x.shape[-1] * x.shape[-2], 1) < 1 << 62:
        return x.astype(np.int64), book.astype(np.int64)
    return x.astype(object), book.astype(object)


def _code(docs: DataFrame, parts: int, book: np.ndarray, moved: np.ndarray | None, b: int, last: bool) -> DataFrame:
    """Assigns all parts to the entries of ``book`` (part, entry, component)."""
    kinds = [(f.name, f.dataType.simpleString()) for f in docs.schema if f.name in ("_id", "_label", "_parts")]
    ddl = ", ".join(f"`{n}` {k}" for n, k in kinds)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            whole = _matrix(batch.column("_parts"), n).reshape(n, parts, -1)
            x, c = _exact(whole, book)
            own = [batch.column(name) for name, _ in kinds]
            if moved is not None:
                codes, near = (_matrix(batch.column(k), n).astype(np.int64).reshape(n, parts, -1) for k in ("codes", "near"))
                upper, lower, outer = (_matrix(batch.column(k), n).reshape(n, parts, -1) for k in ("upper", "lower", "outer"))
            out, looked = [], np.zeros(n, np.int64)
            for p in range(parts):
                if moved is None:
                    state = measure(x[:, p], c[p], b)
                else:
                    *state, seen = follow(x[:, p], c[p], moved[p], codes[:, p, 0], upper[:, p, 0], near[:, p], lower[:, p], outer[:, p, 0])
                    state[2:] = keep(*state[2:], b)
                    looked = np.maximum(looked, seen)
                out.append(state)
            codes_now = np.stack([s[0] for s in out], axis=1)
            if last:
                squares = _squares(x, c[np.arange(parts), codes_now]).sum(axis=1)
                error = [min(int(e), (1 << 63) - 1) for e in squares]
                text = ["".join(f"{int(v):02x}" for v in row) for row in codes_now]
                yield pa.RecordBatch.from_arrays([*own[:-1], pa.array(text, pa.string()), pa.array(error, pa.int64())],
                                                 names=[*[n for n, _ in kinds[:-1]], "code", "error"])
                continue
            kind = (pa.int16(), pa.float32(), pa.int16(), pa.float32(), pa.float32())
            new = [_lists(np.stack([s[k] for s in out], axis=1), kind[k]) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*own, *new, pa.array(looked, pa.int32())], names=[
                *[n for n, _ in kinds], "codes", "upper", "near", "lower", "outer", "looked"])

    if last:
        ddl = ", ".join(f"`{n}` {k}" for n, k in kinds[:-1]) + ", code string, error long"
        return docs.mapInArrow(run, ddl)
    return docs.mapInArrow(run, f"{ddl}, {STATE}")


def _moved(state: DataFrame, parts: int, book: np.ndarray) -> np.ndarray:
    """Every entry replaced by the floor of its parts' mean; unused entries stay."""
    entries, width = book.shape[1:]

    def add(batches):
        totals, n_of = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column("_parts"), n).reshape(n, parts, -1)
            big = bool(x.size) and max(abs(int(x.min())), abs(int(x.max()))) > (1 << 62) // n
            codes = _matrix(batch.column("codes"), n)
            for p in range(parts):
                sums = np.zeros((entries, width), object if big else np.int64)
                np.add.at(sums, codes[:, p], x[:, p].astype(object) if big else x[:, p])
                totals[p] += sums.astype(object)
                n_of[p] += np.bincount(codes[:, p], minlength=entries)
        rows = [(p, e, -1, int(n_of[p, e])) for p, e in zip(*np.nonzero(n_of), strict=True)]
        rows += [(p, e, t, int(totals[p, e, t])) for p, e, _, _ in rows for t in range(width)]
        if rows:
            p, e, t, v = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(t, pa.int32()),
                pa.array([_decimal(i) for i in v], pa.decimal128(38, 0))], names=["part", "entry", "at", "total"])

    sums = state.select("_parts", "codes").mapInArrow(add, "part int, entry int, at int, total decimal(38,0)")
    got = {(r.part, r.entry, r.at): int(r.total) for r in sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total")).collect()}
    new = book.copy()
    for (p, e, t), total in got.items():
        if t >= 0:
            new[p, e, t] = total // got[p, e, -1]
    return new


def _decimal(v: int):
    from decimal import Decimal

    return Decimal(v)


def _moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry went, rounded up."""
    x, c = _exact(old, new)
    return _root(_squares(x, c)) * (1 + SLACK)


def _next_near(state: DataFrame, b: int, entries: int) -> int:
    """As many near entries as serve ``SERVED`` of the rows, from the count of each depth."""
    seen = {r.looked: r.n for r in state.groupBy("looked").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, running = sum(seen.values()), 0
    for depth in sorted(seen):
        running += seen[depth]
        if running >= SERVED * total:
            return min(max(depth, LEAST), MOST) if depth < entries else min(2 * b, MOST)
    return b


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """``_id, _label, code, error`` of every kept vector, and the codebooks (part, entry, component)."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    kept = vectors.select(F.col("vec_id").alias("_id"), F.col("label").alias("_label"), e).filter(e.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    kept = kept.withColumn("_parts", F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long"))).drop("embedding")
    kept = cut(kept, "vectors")
    longest = kept.agg(F.max(F.size("_parts"))).first()[0] or 0
    width = -(-longest // parts)
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(width * parts) - F.size("_parts"))
    full = kept.withColumn("_parts", F.concat("_parts", zeros))
    first = full.orderBy(F.col("_id").asc_nulls_last(), "_parts").limit(entries).select("_parts").collect()
    book = np.array([r[0] for r in first], object).reshape(len(first), parts, width).transpose(1, 0, 2)
    if not first:
        return _code(full, parts, book, None, NEAR, True), book

    b, state, moved = NEAR, full, None
    for k in range(rounds):
        before, state = state, cut(_code(state, parts, book, moved, b, False), "codes")
        if k:
            b = _next_near(state, b, len(first))
        new = _moved(state, parts, book)
        moved, book = _moves(book, new), new
        release(before)
    return _code(state, parts, book, moved, b, True), book


def books_text(book: np.ndarray) -> str:
    return ",".join(str(int(v)) for v in book.reshape(-1))


def op11_vector_codes(spark, sf_dir) -> DataFrame:
    coded, book = compress(read(spark, sf_dir, "embeddings"))
    coded = cut(coded, "coded")
    totals = coded.groupBy(F.col("_label").alias("_of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
    total = F.least(F.col("_sum"), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    digest = hashlib.sha256(books_text(book).encode()).hexdigest()
    return coded.join(totals, same(coded, totals, {"_label": "_of"})).select(
        F.col("_id").alias("vec_id"), "code", "error", total.alias("label_error"), F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The contract in SQL: the same rounds as joins of parts with entries."""
    steps = [f"""
kept AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS (SELECT r, unnest(range(len(embedding))) AS i, unnest(embedding) AS x, len(embedding) // {PARTS} AS w FROM kept),
parts AS (SELECT r, i // w AS p, list(CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) ORDER BY i) AS v FROM cells GROUP BY r, i // w),
book0 AS (SELECT p, r - 1 AS e, v FROM parts WHERE r <= {ENTRIES})"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""
far{k} AS (SELECT r, a.p, e, a.v, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM parts a JOIN book{k} b ON a.p = b.p),
near{k} AS (SELECT r, p, any_value(v) AS v, min(d) AS d, arg_min(e, (d, e)) AS e FROM far{k} GROUP BY r, p)""")
        if k < ROUNDS:
            steps.append(f"""
sum{k} AS (SELECT p, e, i, sum(x) AS s, count(*) AS n FROM (SELECT p, e, unnest(range(len(v))) AS i, unnest(v) AS x FROM near{k}) GROUP BY p, e, i),
mean{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM sum{k} GROUP BY p, e),
book{k + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e)""")
    steps.append(f"""
coded AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (r), digest""")
    return "WITH" + ",".join(steps[:-1]) + "," + steps[-1]


SQL = _sql()
