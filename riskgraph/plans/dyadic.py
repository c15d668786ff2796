"""Aggregates over ranges of time at many probes, by a tree of pre-aggregated blocks per key.

Level ``k`` of the tree cuts time into blocks of ``2 ** (bits * k)`` seconds, and a node holds count,
sum, extremes and labels of one key's rows in one block.  Any range is a union of at most
``2 * (2 ** bits - 1)`` nodes of each level.  Building the tree is one hash aggregate and reading it
one equi-join, on (key, level, block) and on (key, level, block above): a key is spread over as many
hash values as it has such blocks, so one that holds nearly all rows needs no splitting, and no step
sorts or scans a key.  A probe asks once for all nodes it needs below one block, so the requests are
about ten a probe and what the join gives are nodes that exist.

Many probes may ask below one block (the large blocks of a hot key).  Blocks that get more than ``SHARE``
of all requests - fewer than ``1 / SHARE`` whatever the input - are broadcast with their at most
``2 ** bits`` nodes, the others joined.  That
join is asked to merge: Spark sizes requests by the probes they are exploded from, about a hundredth,
and would send them all through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.plans.hot import MIN_ROWS, SHARE
from riskgraph.plans.lineage import cut

BITS = 4
NODE = ("_key", "_level", "_block")
RUN = ("_key", "_level", "_parent")


def levels_for(span: int, bits: int = BITS) -> int:
    """Levels above the seconds; the blocks of the last one are at most ``span`` long."""
    k = 0
    while 1 << (bits * (k + 1)) <= span:
        k += 1
    return k


def _blocks(start: Column, stop: Column, level: int) -> Column:
    """Nodes ``start <= block < stop`` of a level."""
    some = F.when(start < stop, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(some, lambda b: F.struct(F.lit(level).alias("_level"), b.alias("_block")))


def cover(lo: Column, hi: Column, top: int, bits: int = BITS) -> Column:
    """Array of the nodes whose blocks are, without overlap, the seconds ``lo`` to ``hi``, both ends in."""
    parts, end = [], hi + 1
    for k in range(top + 1):
        # First block that starts in the range, and the first after those that end in it.
        left, right = -F.shiftright(-lo, bits * k), F.shiftright(end, bits * k)
        if k == top:
            parts.append(_blocks(left, right, k))
            break
        up, down = -F.shiftright(-lo, bits * (k + 1)), F.shiftright(end, bits * (k + 1))
        middle = F.least(F.shiftleft(up, bits), right)
        parts += [_blocks(left, middle, k), _blocks(F.greatest(F.shiftleft(down, bits), middle), right, k)]
    return F.flatten(F.array(*parts))


def tree(history: DataFrame, *, key: str, time: str, amount: str, label: str, top: int, bits: int = BITS) -> DataFrame:
    """``_key, _level, _block, _z``: one row per node that has rows."""
    h = history.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).alias("_key"), F.col(time).cast("long").alias("_t"), F.col(amount).cast("double").alias("_a"),
        F.coalesce(F.col(label).cast("long"), F.lit(0)).alias("_y"))
    up = F.array(*[F.struct(F.lit(k).alias("_level"), F.shiftright("_t", bits * k).alias("_block")) for k in range(top + 1)])
    rows = h.select("_key", "_t", "_a", "_y", F.explode(up).alias("_e")).select(
        "_key", F.col("_e._level").alias("_level"), F.col("_e._block").alias("_block"), "_t", "_a", "_y")
    return rows.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_a").alias("s"), F.max("_a").alias("x"), F.min("_a").alias("i"),
        F.sum("_y").alias("y"), F.min("_t").alias("t")).select(*NODE, F.struct("n", "s", "x", "i", "y", "t").alias("_z"))


def reaches(lo: Column, hi: Column, top: int, bits: int = BITS) -> Column:
    """The nodes of :func:`cover` as runs: array of ``_level, _parent, _from, _to``, the blocks
    ``_from <= block < _to`` of a level that lie in one block of the level above.

    Below the top there are at most two runs a level, so a range is about ten runs, not some seventy nodes.
    """
    def run(level, start, stop, parent):
        return F.struct(F.lit(level).alias("_level"), parent.alias("_parent"), start.alias("_from"), stop.alias("_to"))

    parts, end = [], hi + 1
    for k in range(top + 1):
        left, right = -F.shiftright(-lo, bits * k), F.shiftright(end, bits * k)
        if k == top:
            above = F.when(left < right, F.sequence(F.shiftright(left, bits), F.shiftright(right - 1, bits))).otherwise(
                F.array().cast("array<bigint>"))
            parts.append(F.transform(above, lambda p: run(top, left, right, p)))
            break
        up, down = -F.shiftright(-lo, bits * (k + 1)), F.shiftright(end, bits * (k + 1))
        middle = F.least(F.shiftleft(up, bits), right)
        ends = ((left, middle), (F.greatest(F.shiftleft(down, bits), middle), right))
        parts.append(F.array(*[run(k, x, z, F.shiftright(x, bits)) for x, z in ends]))
    return F.filter(F.flatten(F.array(*parts)), lambda r: r["_from"] < r["_to"])


def _lookup(asked: DataFrame, nodes: DataFrame, min_rows: int, share: float) -> DataFrame:
    """``_pid, _z`` of every existing node of the runs asked for."""
    counts = asked.groupBy(*RUN).agg(F.count(F.lit(1)).alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(min_rows, int((total or 0) * share))
    inside = (F.col("_block") >= F.col("_from")) & (F.col("_block") < F.col("_to"))
    if not total or most <= limit:
        return asked.hint("merge").join(nodes, list(RUN)).filter(inside).select("_pid", "_z")
    hot = counts.filter(F.col("_n") > limit).drop("_n").join(nodes, list(RUN), "left").withColumn("_hot", F.lit(True))
    marked = asked.join(F.broadcast(cut(hot, "hot_nodes")), list(RUN), "left")
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot", "_block", "_z")
    return marked.filter(F.col("_hot") & inside).select("_pid", "_z").unionByName(
        rest.hint("merge").join(nodes, list(RUN)).filter(inside).select("_pid", "_z"))


def range_summary(probes: DataFrame, history: DataFrame, *, probe_id: str, key: str, lo: Column, hi: Column, time: str,
                  amount: str, label: str, span: int, bits: int = BITS, min_rows: int = MIN_ROWS,
                  share: float = SHARE) -> DataFrame:
    """``probe_id, n, total, max_amount, min_amount, n_fraud, first_time`` of ``lo <= time <= hi``.

    ``lo`` and ``hi`` are whole seconds over ``probes``; ``span`` is their usual distance and only sets the
    height of the tree.  Probes with a null key are left out; a range without rows, or one that ends
    before it starts, has count 0 and null amounts; null amounts count as rows and add nothing.
    """
    top = levels_for(span, bits)
    p = probes.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(probe_id).alias("_pid"), lo.cast("long").alias("_lo"), hi.cast("long").alias("_hi"))
    asked = p.filter(F.col("_lo") <= F.col("_hi")).select(
        "_key", "_pid", F.explode(reaches(F.col("_lo"), F.col("_hi"), top, bits)).alias("_e")).select("_pid", "_key", "_e.*")
    nodes = tree(history, key=key, time=time, amount=amount, label=label, top=top, bits=bits).withColumn(
        "_parent", F.shiftright("_block", bits))
    found = _lookup(asked, nodes, min_rows, share)
    return found.unionByName(p.select("_pid"), allowMissingColumns=True).groupBy(F.col("_pid").alias(probe_id)).agg(
        F.coalesce(F.sum("_z.n"), F.lit(0)).alias("n"), F.sum("_z.s").alias("total"), F.max("_z.x").alias("max_amount"),
        F.min("_z.i").alias("min_amount"), F.coalesce(F.sum("_z.y"), F.lit(0)).alias("n_fraud"),
        F.min("_z.t").alias("first_time"))
