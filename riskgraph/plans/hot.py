"""Splitting hot groups.

A window or a sorted scan puts a whole group into one task.  When one card, one tie of equal
times or simply "all rows" is such a group, it is cut here into pieces along the order column,
at equi-depth edges, so that every piece has a bounded share of the rows.  The operators run
their scan per piece and add what earlier pieces of the same group contribute (a table of one
row per piece).

Why the split table may be broadcast: a group is hot only if it has more than ``share`` of all
rows, and gets as many pieces as it has such shares (and one more), so all hot groups together have
fewer than ``2 / share`` pieces, whatever the size of the input.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.plans.lineage import cut

PIECE = "_piece"
SHARE = 1.0 / 4096
MIN_ROWS = 2_000_000
_STEP = 32


@dataclass(frozen=True)
class HotGroups:
    """``table``: one row per hot group with the sorted ``_edges`` of its pieces."""

    keys: tuple[str, ...]
    order: str
    table: DataFrame


def find_hot(
    df: DataFrame,
    keys,
    order: str,
    *,
    min_rows: int = MIN_ROWS,
    share: float = SHARE,
) -> HotGroups | None:
    """Hot groups of ``df`` by ``keys`` with their edges on ``order``; ``None`` if there are none.

    One counting pass with map-side combine decides; the edges are read from a quantile sketch
    (they only balance the work, no result depends on them being exact).
    """
    keys = tuple(keys)
    counts = df.groupBy(*[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    total, top = counts.agg(F.sum("_n"), F.max("_n")).first()
    if not total:
        return None
    limit = max(min_rows, int(total * share))
    if top <= limit:
        return None
    hot = counts.filter(F.col("_n") > limit).select(*keys, "_n")
    pieces = ceil(top / limit) + 1
    fractions = [i / pieces for i in range(1, pieces)]
    if keys:
        few = F.broadcast(hot.drop("_n"))
        hot_rows = df.join(few, [df[k].eqNullSafe(few[k]) for k in keys], "left_semi")
    else:
        hot_rows = df
    edges = hot_rows.groupBy(*[F.col(k) for k in keys]).agg(
        F.percentile_approx(order, fractions, 10000).alias("_edges"), F.count(F.lit(1)).alias("_n")
    )
    # The sketch has the edges of the largest group; others keep every step-th of them.
    step = F.greatest(F.floor(F.lit(pieces) / F.ceil(F.col("_n") / limit + 1)), F.lit(1)).cast("int")
    thin = F.filter("_edges", lambda e, i: (i + 1) % step == 0)
    edges = edges.withColumn("_edges", F.array_sort(F.array_distinct(F.when(F.size(thin) > 0, thin).otherwise(F.col("_edges"))))).drop("_n")
    return HotGroups(keys, order, cut(edges, "hot"))


def piece_of(edges: Column, value: Column) -> Column:
    """Number of edges <= value, by two short scans instead of one over all edges."""
    outer = F.filter(edges, lambda e, i: ((i + 1) % _STEP == 0) & (e <= value))
    full = F.size(outer) * _STEP
    inner = F.size(F.filter(F.slice(edges, full + 1, F.lit(_STEP)), lambda e: e <= value))
    return F.when(edges.isNull() | value.isNull(), F.lit(0)).otherwise(full + inner).cast("int")


def with_edges(df: DataFrame, hot: HotGroups | None, how: str = "left") -> DataFrame:
    """Add ``_edges``: null for rows of ordinary groups, or ``how="inner"`` to keep hot rows only."""
    if hot is None:
        return df
    if not hot.keys:
        # One group, all rows hot: its edges (at most ``1 / share`` + 1) become a literal.
        edges = hot.table.first()["_edges"]
        return df.withColumn("_edges", F.array(*[F.lit(e) for e in edges]))
    t = F.broadcast(hot.table.select(*[F.col(k).alias(f"_h_{k}") for k in hot.keys], "_edges"))
    cond = F.lit(True)
    for k in hot.keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    return df.join(t, cond, how).drop(*[f"_h_{k}" for k in hot.keys])


def with_piece(df: DataFrame, hot: HotGroups | None, how: str = "left") -> DataFrame:
    """Add the ``_piece`` of every row; 0 for ordinary groups."""
    if hot is None:
        return df.withColumn(PIECE, F.lit(0))
    out = with_edges(df, hot, how)
    return out.withColumn(PIECE, piece_of(F.col("_edges"), F.col(hot.order))).drop("_edges")


def group_window(keys):
    """Window over a per-piece table; bounded, so the empty key may be one partition."""
    return Window.partitionBy(*(list(keys) or [F.lit(0)]))


def attach(df: DataFrame, pieces: DataFrame, keys) -> DataFrame:
    """Left join of a per-piece table (columns named apart from ``df``) on keys and piece."""
    names = [*keys, PIECE]
    p = pieces.select(
        *[F.col(k).alias(f"_p_{k}") for k in names],
        *[c for c in pieces.columns if c not in names],
    )
    cond = F.lit(True)
    for k in names:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_p_{k}"))
    return df.join(F.broadcast(p), cond, "left").drop(*[f"_p_{k}" for k in names])
