"""Benchmark decontamination: windows of normalised benchmark words looked up in every document.

The windows of the benchmark are a hash set that is broadcast to the tasks in blocks of bounded
size (``block_windows``); a task scans the word windows of its documents, compares the words of
every hit, and returns the hit word ranges.  A benchmark of more windows than one block is done
block by block, and the ranges found for a document are united afterwards, so nothing depends on
the number of blocks.

Edge cases: a null text has no words, so it is never hit; an item without words has no window; an
item shorter than ``n`` words is one window of its own length; repeated items each count; a null
``item_id`` is an item whose id reads as the empty string.  Repeated rows each get their result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import per_row, read, same, texts, utf8

N = 13
SHARE = 0.05
BLOCK_WINDOWS = 200_000

#: Letters A-Z become small, ASCII other than letters and digits becomes a space, the rest stays.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

HITS = "doc_id long, n_words long, ranges array<int>, items array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WindowSet:
    """Windows of one block of benchmark items, by number of words."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[bytes, set[str]]] = {}
        number = self.vocabulary
        for item, text in items:
            ids = np.array([number.setdefault(w, len(number) + 1) for w in words(text)], np.int64)
            if len(ids):
                m = min(n, len(ids))
                for i in range(len(ids) - m + 1):
                    found.setdefault(m, {}).setdefault(ids[i : i + m].tobytes(), set()).add(item)
        self.items = {m: {k: tuple(sorted(v)) for k, v in d.items()} for m, d in found.items()}
        self.hashes = {
            m: np.unique(_mix(np.frombuffer(b"".join(d), np.int64).reshape(-1, m).T)) for m, d in found.items()}

    def look_up(self, tokens: list[bytes]) -> tuple[list[int], set[str]]:
        """Hit word ranges (start, end, start, end, ...; merged and in order) and the items hit."""
        n, items = len(tokens), set()
        ids = np.fromiter(map(self.vocabulary.get, tokens, repeat(0)), np.int64, n)
        known = np.concatenate(([0], np.cumsum(ids != 0)))
        hit = []
        for m, wanted in self.hashes.items():
            if n < m or known[-1] < m:
                continue
            at = np.flatnonzero(known[m:] - known[:-m] == m)
            if not len(at):
                continue
            h = _mix([ids[at + k] for k in range(m)])
            near = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            for i in at[wanted[near] == h].tolist():
                got = self.items[m].get(ids[i : i + m].tobytes())
                if got:
                    items.update(got)
                    hit.append((i, i + m))
        return merge(hit), items


def _mix(columns) -> np.ndarray:
    """Polynomial hash of words ``columns[0], columns[1], ...`` modulo 2**64."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)
    return h


def merge(ranges) -> list[int]:
    out: list[int] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _scan(shared):
    def rows(batch):
        found = shared.value
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            tokens = words(text)
            ranges, items = found.look_up(tokens)
            yield doc_id, len(tokens), ranges, sorted(items)

    return rows


def _blocks(benchmark: DataFrame, n: int, block_windows: int) -> list:
    """Broadcast window sets, each of about ``block_windows`` windows at most."""
    spark = benchmark.sparkSession
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # A text of k characters has at most k / 2 + 1 words, hence windows.
    size = items.select(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = int(size // block_windows) + 1
    found = []
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        block = WindowSet([(r[0], r[1].encode()) for r in part.toLocalIterator()], n)
        found.append(spark.sparkContext.broadcast(block))
    return found


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = N, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: ``doc_id, n_words, ranges, items`` with the hit word ranges."""
    found = _blocks(benchmark, n, block_windows)
    if len(found) == 1:
        return per_row(texts(docs), HITS, _scan, found[0])
    return _united(docs, found).drop("k")


def _united(docs: DataFrame, found: list) -> DataFrame:
    """Hits of several blocks, united by document; rows with the same id and text have the same hits."""
    key = F.xxhash64("text")
    base = per_row(texts(docs, key.alias("k")), "doc_id long, n_words long, k long", _count)
    parts = [per_row(texts(docs, key.alias("k")), HITS + ", k long", _scan_key, f) for f in found]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionAll(p)
    hits = hits.filter(F.size("items") > 0).groupBy(F.col("doc_id").alias("_d"), F.col("k").alias("_k")).agg(
        F.flatten(F.collect_set("ranges")).alias("r"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("i"))
    joined = base.join(hits, same(base, hits, {"doc_id": "_d", "k": "_k"}), "left").select(
        "doc_id", "n_words", "r", "i", "k")
    return per_row(joined, HITS + ", k long", _merged)


def _count():
    def rows(batch):
        for d, t, k in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            yield d, len(words(t)), k

    return rows


def _scan_key(shared):
    scan = _scan(shared)

    def rows(batch):
        for row, k in zip(scan(batch), batch.column(2).to_pylist(), strict=True):
            yield (*row, k)

    return rows


def _merged():
    def rows(batch):
        for d, n, r, i, k in zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True):
            r = r or []
            yield d, n, merge(zip(r[::2], r[1::2], strict=True)), sorted(i or []), k

    return rows


def judge(hits: DataFrame, share: float = SHARE) -> DataFrame:
    """Counts of :func:`find_hits` and ``contaminated``: hit words are at least ``share`` of all."""
    n_hit = F.aggregate(
        F.transform("ranges", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)),
        F.lit(0).cast("long"), lambda a, x: a + x)
    out = hits.withColumn("n_hit", n_hit)
    return out.withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * round(1 / share) >= F.col("n_words")))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, n: int = N, share: float = SHARE, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated; no shuffle for one block."""
    found = _blocks(benchmark, n, block_windows)
    if len(found) > 1:
        bad = judge(_united(docs, found), share).filter("contaminated").select(
            F.col("doc_id").alias("_d"), F.col("k").alias("_k")).distinct()
        keyed = docs.withColumn("_key", F.xxhash64("text"))
        return keyed.join(bad, same(keyed, bad, {"doc_id": "_d", "_key": "_k"}), "left_anti").select(*docs.columns)
    shared, at, least = found[0], docs.columns.index("text"), round(1 / share)

    def clean(batches):
        for batch in batches:
            keep = []
            for text in utf8(batch.column(at)):
                tokens = words(text)
                r, _ = shared.value.look_up(tokens)
                hit = sum(r[1::2]) - sum(r[::2])
                keep.append(not (hit and least * hit >= len(tokens)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """``doc_id, text`` with the hit words cut out of every document (a benchmark of one block)."""
    items = [(str(r[0]), (r[1] or "").encode()) for r in benchmark.select("item_id", "text").toLocalIterator()]
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet(items, n))
    return per_row(texts(docs), "doc_id long, text string", _cut_out, shared)


def _cut_out(shared):
    import re

    word = re.compile(rb"[0-9a-z\x80-\xff]+")

    def rows(batch):
        for d, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            ranges, _ = shared.value.look_up(words(t))
            if ranges:
                at = [m.span() for m in word.finditer(t.translate(_FOLD))]
                keep, last = [], 0
                for a, b in zip(ranges[::2], ranges[1::2], strict=True):
                    keep.append(t[last : at[a][0]])
                    last = at[b - 1][1]
                t = b"".join([*keep, t[last:]])
            yield d, t.decode()

    return rows


def op5_decontaminate(spark, sf_dir) -> DataFrame:
    hits = judge(find_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(item_id::varchar, '') AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, m, array_to_string(w[p:p + m - 1], ' ') AS x FROM (
  SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM (
    SELECT item, w, least(len(w), {N}) AS m FROM i WHERE len(w) > 0))),
dw AS (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS x FROM (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
h AS (SELECT doc_id, item, p, m FROM dw JOIN iw USING (m, x)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are not contaminated."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))
