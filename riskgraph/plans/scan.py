"""Running sums inside groups, and global row numbers, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.plans.hot import MIN_ROWS, PIECE, attach, find_hot, group_window, with_piece


def running_sums(
    df: DataFrame,
    keys,
    order: str,
    values: dict[str, Column],
    *,
    tie: str | None = None,
    min_rows: int = MIN_ROWS,
    totals: bool = False,
) -> DataFrame:
    """Add inclusive running sums ``values`` per group in the order of ``(order, tie)``.

    ``keys`` may be empty (a global scan).  Groups above ``min_rows`` are split along ``order``;
    rows that share one ``order`` value stay together, so ``order`` should be near-unique there.
    With ``totals`` the group sums are added as ``<name>_total``.
    """
    keys = list(keys)
    df = df.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    hot = find_hot(df, keys, order, min_rows=min_rows)
    out = with_piece(df, hot)
    part = Window.partitionBy(*keys, PIECE)
    w = part.orderBy(*([order] if tie is None else [order, tie]))
    w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.select("*", *[F.sum(f"_v_{n}").over(w).alias(n) for n in values])
    if totals:
        out = out.select("*", *[F.sum(f"_v_{n}").over(part).alias(f"{n}_total") for n in values])
    out = out.drop(*[f"_v_{n}" for n in values])
    if hot is not None:
        base = with_piece(df, hot, "inner")
        sums = base.groupBy(*keys, PIECE).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
        group = group_window(keys)
        before = group.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
        carry = sums.select(
            *keys, PIECE,
            *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in values],
            *[F.sum(f"_s_{n}").over(group).alias(f"_t_{n}") for n in values],
        )
        out = attach(out, carry, keys)
        fixed = {n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in values}
        if totals:
            fixed |= {
                f"{n}_total": F.coalesce(F.col(f"_t_{n}"), F.col(f"{n}_total")) for n in values
            }
        out = out.withColumns(fixed).drop(*[f"_{p}_{n}" for p in "ct" for n in values])
    return out.drop(PIECE)


def row_index(df: DataFrame, order: str, tie: str, name: str = "row_idx",
              *, min_rows: int = MIN_ROWS) -> DataFrame:
    """0-based global position of every row by ``(order, tie)``.

    Counts per distinct ``order`` value are summed up first, then rows are ranked inside their
    tie.  Both scans split hot groups, so neither "all rows" nor one heavy tie is a single task.
    """
    per = df.groupBy(order).agg(F.count(F.lit(1)).alias("_n"))
    before = running_sums(per, [], order, {"_upto": F.col("_n")}, min_rows=min_rows)
    before = before.select(
        F.col(order).alias("_o"), (F.col("_upto") - F.col("_n")).alias("_before")
    )
    ranked = running_sums(df, [order], tie, {"_rank": F.lit(1)}, min_rows=min_rows)
    return (
        ranked.join(before, ranked[order].eqNullSafe(before["_o"]), "left")
        .withColumn(name, F.col("_before") + F.col("_rank") - 1)
        .drop("_o", "_before", "_rank")
    )
