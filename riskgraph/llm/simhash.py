"""SimHash near-duplicates with a distributed binary-trie self-join.

* Fingerprints: 64 majority bits over the XXH64 of a text's word shingles, one map.
* The distinct fingerprints form a binary trie, cut into cells: a cell is a trie node with at most
  ``cell`` fingerprints, found by counting prefixes level by level, so crowded parts of the trie
  are cut deeper and no cell grows with the input.
* Pairs of cells are traversed together if their prefixes differ in at most ``most`` bits; pairs
  are found by an equi-join on prefixes with flipped bits, never by comparing all cells.
* A task descends both tries of a cell pair bit by bit, all live node pairs at once, adding up
  differing bits and pruning node pairs above the budget.  It returns a spanning forest of the
  links it found, so a crowd of near copies gives as many edges as members, not as many as pairs.
* Components of the forest's edges: large-star and small-star rounds until nothing changes.

Exact copies share a fingerprint and never multiply anything but the last join, a plain equi-join.

Edge cases: null, empty and blank texts have fingerprint zero, linked like any other; fewer words
than a shingle are one shingle; null ids belong to their component but never name it, unless it
has no other (then the component id is null); repeated rows each get their result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import per_row, read, same, texts, utf8
from riskgraph.plans.lineage import cut, release

WIDTH = 3
MOST = 2
SEED = 42
CELL = 4096
_LEVELS = 4
_CHUNK = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    sums = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        w = words[at : at + _CHUNK + width - 1]
        shingles = map(b" ".join, zip(*(w[k:] for k in range(width)))) if len(w) >= width else [b" ".join(w)]  # noqa: B905
        raw = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8).reshape(-1, 8)
        for k in range(8):
            sums[8 * k : 8 * k + 8] += np.bincount(raw[:, k], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(sums * 2 > n).tobytes(), "big", signed=True)


def _fingerprints(width):
    def rows(batch):
        for d, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            yield d, fingerprint(text, width)

    return rows


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    return per_row(texts(docs), "doc_id long, fp long", _fingerprints, width)


# --- the join of two cells ---------------------------------------------------------------------


def trie_links(a: np.ndarray, b: np.ndarray | None, depth: int, errors: int, most: int = MOST):
    """Index pairs of sorted distinct ``a`` and ``b`` (None: ``a`` itself) within ``most`` bits.

    The first ``depth`` bits are the same in all of ``a`` and in all of ``b``, and differ in
    ``errors`` bits between them.  Node pairs are ranges of both arrays; each step splits all of
    them by the next bit.
    """
    own = b is None
    b = a if own else b
    live = tuple(np.array([v], np.int64) for v in (0, len(a), 0, len(b), errors))
    found = []
    for bit in range(63 - depth, -2, -1):
        alo, ahi, blo, bhi, err = live
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():  # both paths are down to one fingerprint: the rest of the way is one popcount
            i, j = alo[single], blo[single]
            near = np.bitwise_count(a[i] ^ b[j]) <= most
            if own:
                near &= i < j
            found.append((i[near], j[near]))
            alo, ahi, blo, bhi, err = (x[~single] for x in (alo, ahi, blo, bhi, err))
        if bit < 0 or not len(alo):
            break
        ones_a, ones_b = (
            np.concatenate(([0], np.cumsum((x >> np.uint64(bit)) & np.uint64(1), dtype=np.int64))) for x in (a, b))
        amid, bmid = ahi - (ones_a[ahi] - ones_a[alo]), bhi - (ones_b[bhi] - ones_b[blo])
        parts = []
        for a0, a1, b0, b1, more in (
            (alo, amid, blo, bmid, 0), (amid, ahi, bmid, bhi, 0), (alo, amid, bmid, bhi, 1), (amid, ahi, blo, bmid, 1)):
            keep = (a1 > a0) & (b1 > b0) & (err + more <= most)
            if own:  # of a pair of nodes and its mirror image only the first is followed
                keep &= a0 <= b0
            parts.append(tuple(x[keep] for x in (a0, a1, b0, b1, err + more)))
        live = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of ``n`` nodes under links ``(i, j)``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _join_cells(batches, most):
    for batch in batches:
        src, dst = [], []
        for a, b, depth, errors in zip(*(batch.column(c) for c in ("a", "b", "depth", "errors")), strict=True):
            left = np.sort(a.values.to_numpy().view(np.uint64))
            right = np.sort(b.values.to_numpy().view(np.uint64)) if b.is_valid else None
            i, j = trie_links(left, right, depth.as_py(), errors.as_py(), most)
            if not len(i):
                continue
            nodes = left if right is None else np.concatenate((left, right))
            root = forest(len(nodes), i, j if right is None else j + len(left))
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            src.append(nodes[moved].view(np.int64))
            dst.append(nodes[root[moved]].view(np.int64))
        if src:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])


# --- cells and their pairs ---------------------------------------------------------------------


def _prefix(fp, depth: int):
    return F.shiftrightunsigned(fp, 64 - depth) if depth else F.lit(0).cast("long")


def cells(distinct: DataFrame, cell: int = CELL) -> tuple[DataFrame, list[int]]:
    """``depth, prefix, members`` of every trie cell, and the depths in use."""
    n = distinct.count()
    depth = max(0, (max(n, 1) - 1).bit_length() - (cell - 1).bit_length())
    rest, done, depths = distinct.select("fp"), [], []
    while True:
        keyed = rest.withColumn("prefix", _prefix(F.col("fp"), depth))
        crowded = keyed.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell).select("prefix")
        crowded = cut(crowded, "cells")
        some = depth < 64 and not crowded.isEmpty()
        small = keyed.join(crowded, "prefix", "left_anti") if some else keyed
        done.append(small.groupBy("prefix").agg(F.collect_list("fp").alias("members")).select(
            F.lit(depth).alias("depth"), "prefix", "members"))
        depths.append(depth)
        if not some:
            break
        rest = cut(keyed.join(crowded, "prefix", "left_semi").select("fp"), "cells")
        depth = min(64, depth + _LEVELS)
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return cut(out, "cells"), depths


def _masks(depth: int, most: int) -> list[int]:
    out = {0}
    for _ in range(most):
        out |= {m | 1 << b for m in out for b in range(depth)}
    return sorted(m - (1 << 64) if m >> 63 else m for m in out)


def cell_pairs(cells: DataFrame, depths: list[int], most: int = MOST) -> DataFrame:
    """Pairs of cells whose prefixes differ in at most ``most`` bits, with their fingerprints."""
    deep = cells.select(F.col("depth").alias("d1"), F.col("prefix").alias("p1"))
    pairs = None
    for d in depths:
        own = deep.filter(F.col("d1") >= d).withColumn(
            "up", F.when(F.lit(d) > 0, F.expr(f"shiftrightunsigned(p1, d1 - {d})")).otherwise(F.lit(0)).cast("long"))
        near = own.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in _masks(d, most)]))).select(
            "d1", "p1", F.lit(d).alias("d2"), F.col("up").bitwiseXOR(F.col("mask")).alias("p2"),
            F.bit_count("mask").alias("errors"))
        near = near.filter((F.col("d1") > d) | (F.col("p1") <= F.col("p2")))
        pairs = near if pairs is None else pairs.unionAll(near)
    one = cells.select(F.col("depth").alias("d1"), F.col("prefix").alias("p1"), F.col("members").alias("a"))
    two = cells.select(F.col("depth").alias("d2"), F.col("prefix").alias("p2"), F.col("members").alias("b"))
    there = pairs.join(two.select("d2", "p2"), ["d2", "p2"], "left_semi")
    joined = there.join(one, ["d1", "p1"]).join(two, ["d2", "p2"])
    itself = (F.col("d1") == F.col("d2")) & (F.col("p1") == F.col("p2"))
    return joined.select("a", F.when(~itself, F.col("b")).alias("b"), F.col("d2").alias("depth"), "errors")


def links(distinct: DataFrame, most: int = MOST, cell: int = CELL) -> DataFrame:
    """Edges ``src, dst`` that connect all ``fp`` of ``distinct`` within ``most`` bits."""
    found, depths = cells(distinct, cell)
    return cell_pairs(found, depths, most).mapInArrow(lambda b: _join_cells(b, most), "src long, dst long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that is not its own root, by stars until nothing changes."""
    cur = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "stars")
    before = None
    while True:
        # Large star: larger neighbours of a node move to its smallest neighbour (or itself).
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours and the node itself move to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        new = cut(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        state = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        release(cur)
        cur = new
        if state == before or not state[0]:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, width: int = WIDTH, most: int = MOST, cell: int = CELL) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``."""
    prints = cut(fingerprints(docs, width), "fingerprints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    edges = cut(links(distinct, most, cell), "links")
    roots = components(edges)
    known = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    names = known.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    by_print = cut(known.join(names, known["root"] == names["r"]).select(F.col("fp").alias("f"), "component_id"), "components")
    return prints.join(by_print, prints["fp"] == by_print["f"]).select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH, most: int = MOST, cell: int = CELL) -> DataFrame:
    """Rows of ``docs``, all columns: the document that names each component, once.

    A component of null ids keeps one row of id null.  Rows that share the kept id are counted as
    one document: of different rows the one with the smallest text hash stays.
    """
    found = cut(near_duplicates(docs, width, most, cell), "near")
    ids = cut(found.groupBy(F.col("component_id").alias("_d")).agg(F.lit(1).alias("_one")).drop("_one"), "kept")
    repeated = found.groupBy(F.col("doc_id").alias("_d")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_d")
    repeated = cut(repeated, "repeated")
    # The kept ids grow with the input, so they are never broadcast: the plan is the same at every size.
    kept = docs.join(ids.hint("merge"), same(docs, ids, {"doc_id": "_d"}), "left_semi")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, same(kept, repeated, {"doc_id": "_d"}), "left_anti")
    again = kept.join(repeated, same(kept, repeated, {"doc_id": "_d"}), "left_semi").withColumn("_h", F.xxhash64("text"))
    first = again.groupBy(F.col("doc_id").alias("_d")).agg(F.min("_h").alias("_m"))
    again = again.join(first, same(again, first, {"doc_id": "_d", "_h": "_m"}), "left_semi").drop("_h")
    return once.unionByName(again.dropDuplicates(["doc_id"]))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return keep_one(docs)
