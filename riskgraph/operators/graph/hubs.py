"""Unique neighbours through shared keys, hubs included: a heavy-light bipartite join.

Members (cards) and keys (addresses, devices, mail domains) form a bipartite graph; two members are
neighbours when they share a key.  Light keys, below ``heavy`` members, are joined as rows.  A heavy
key would give the square of its members, so it is kept as one bitmap of member numbers, and what a
member reaches through hubs is an OR of bitmaps: one bit a neighbour, never a pair.

* Member numbers are dense, and a bitmap row covers :data:`BLOCK` of them, so a row has 4 KB whatever
  the hub, and a large hub is many rows.
* What is one hop behind a hub is worked out once per hub, from the distinct keys its members have.
* Members that meet the same hubs form a class; the union of bitmaps is made once per class.  Members
  reached through light keys are looked up in the bitmap of the class and counted where it lacks them.

Counts are exact; nothing is capped or drawn.  ``heavy`` only decides which form a key takes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.plans.lineage import cut

#: Numbers that one bitmap row covers.
BLOCK = 4096 * 8
#: Members from which a key is kept as bitmaps.
HEAVY = 256


def dense_numbers(members: DataFrame) -> DataFrame:
    """``member, num``: different members numbered from 0 in their order.

    Members are dealt to ranges and numbered inside; one row per range tells how many lie before it.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select("member").distinct().repartitionByRange(max(2, n), "member")
    dealt = cut(dealt.select("member", F.spark_partition_id().alias("_p")), "members")
    inside = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("member")) - 1)
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    return inside.join(before, "_p").select("member", (F.col("_b") + F.col("_r")).cast("long").alias("num"))


def _block(num: str = "num") -> Column:
    return F.floor(F.col(num) / BLOCK).cast("long").alias("block")


def _bits(num: str = "num") -> Column:
    return F.bitmap_construct_agg((F.col(num) % BLOCK).cast("long")).alias("bits")


def _has_bit(bits: str, num: str) -> Column:
    """Whether a bitmap row has the bit of a number of its block."""
    return F.expr(f"(cast(conv(hex(substring({bits}, cast({num} % {BLOCK} div 8 as int) + 1, 1)), 16, 10) as int) >> cast({num} % 8 as int)) & 1") == 1


@dataclass
class HubIndex:
    """``numbers``: member, num.  ``light`` and ``heavy``: key, num.  ``hubs``: hop, key, block, bits - the
    members of a heavy key (hop 0), and all members that share a key with one of those (hop 1)."""

    numbers: DataFrame
    light: DataFrame
    heavy: DataFrame
    hubs: DataFrame


def hub_index(memberships: DataFrame, *, heavy: int = HEAVY, hops: int = 2) -> HubIndex:
    """Index of ``key, member`` rows for :func:`neighbour_counts` over up to ``hops`` (1 or 2) hops.

    Rows with a null key or member join nobody; repeated rows count once.
    """
    m = memberships.select("key", "member").filter(F.col("key").isNotNull() & F.col("member").isNotNull()).distinct()
    numbers = cut(dense_numbers(m), "numbers")
    size = m.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2)
    m = m.join(size, "key").join(numbers, "member")  # a key of one member joins nobody
    m = cut(m.select("key", "num", (F.col("_n") >= heavy).alias("_heavy")), "memberships")
    light, big = m.filter(~F.col("_heavy")).drop("_heavy"), m.filter("_heavy").drop("_heavy")
    hubs = cut(big.groupBy("key", _block()).agg(_bits()).select(F.lit(0).alias("hop"), "key", "block", "bits"), "hubs")
    if hops > 1:
        near = big.select(F.col("key").alias("_hub"), "num").join(m, "num").select("_hub", "key", "_heavy").distinct()
        through_light = near.filter(~F.col("_heavy")).join(light, "key").groupBy("_hub", _block()).agg(_bits())
        through_heavy = near.filter("_heavy").join(hubs.drop("hop"), "key").select("_hub", "block", "bits")
        behind = through_light.unionByName(through_heavy).groupBy(F.col("_hub").alias("key"), "block").agg(
            F.bitmap_or_agg("bits").alias("bits"))
        hubs = hubs.unionByName(cut(behind.select(F.lit(1).alias("hop"), "key", "block", "bits"), "behind"))
    return HubIndex(numbers, light, big, hubs)


def neighbour_counts(starts: DataFrame, index: HubIndex, *, hops: int = 2) -> DataFrame:
    """``member, n_unique_neighbors``: different members within ``hops`` (1 or 2) of each start.

    The start itself does not count; repeated starts count once, null ones are left out, and members
    that share no key have 0.
    """
    if hops not in (1, 2):
        raise ValueError("one or two hops")
    begin = cut(starts.select("member").filter(F.col("member").isNotNull()).distinct().join(index.numbers, "member", "left"), "starts")
    own = begin.filter(F.col("num").isNotNull()).select(F.col("num").alias("start"), "num")
    through_hub = own.join(index.heavy, "num").select("start", F.lit(hops - 1).alias("hop"), "key")
    reached = _through_light(own, index)
    if hops == 2:
        reached = cut(reached, "firsthop")
        onwards = reached.join(index.heavy, "num").select("start", F.lit(0).alias("hop"), "key")
        through_hub = through_hub.unionByName(onwards).distinct()
        reached = _through_light(reached, index)

    # The hubs that a start meets name its class; they are attributes of a few members, not members.
    named = through_hub.groupBy("start").agg(F.array_sort(F.collect_set(F.struct("hop", "key"))).alias("_hubs"))
    named = cut(named.select("start", "_hubs", F.sha2(F.to_json(F.struct("_hubs")), 256).alias("cls")), "classes")
    parts = named.groupBy("cls").agg(F.any_value("_hubs").alias("_hubs")).select("cls", F.explode("_hubs").alias("h")).select("cls", "h.*")
    union = cut(parts.join(index.hubs, ["hop", "key"]).groupBy("cls", "block").agg(F.bitmap_or_agg("bits").alias("bits")), "unions")
    of_hubs = named.join(union.groupBy("cls").agg(F.sum(F.bitmap_count("bits")).alias("_hub")), "cls").select("start", "_hub")

    rows = reached.join(named.select("start", "cls"), "start", "left").withColumn("block", _block())
    rows = rows.join(union, ["cls", "block"], "left").filter(F.col("bits").isNull() | ~_has_bit("bits", "num"))
    others = rows.groupBy("start").agg(F.count(F.lit(1)).alias("_light"))
    total = F.coalesce("_hub", F.lit(0)) + F.coalesce("_light", F.lit(0)) - 1
    out = begin.join(of_hubs, begin["num"] == of_hubs["start"], "left").drop("start")
    out = out.join(others, out["num"] == others["start"], "left")
    return out.select("member", F.greatest(total, F.lit(0)).cast("long").alias("n_unique_neighbors"))


def _through_light(members: DataFrame, index: HubIndex) -> DataFrame:
    """``start, num``: members behind the light keys of each start's members."""
    keys = members.join(index.light, "num").select("start", "key").distinct()
    return keys.join(index.light, "key").select("start", "num").distinct()
