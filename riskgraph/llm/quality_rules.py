"""Quality rules: word rules of one text, and the frequency of its lines across documents.

A line is normalised (A-Z small, digits to 0, white space to single spaces) and hashed.  Per host
(``source``) the documents that carry a line are counted; a line above ``max_documents`` is
boilerplate and counts as removed, except in the first document that has it: the one with the smallest
id (null last), of an id's several texts one by their hash, whatever the partitions of the input.  A document is depleted, and rejected, when less than ``min_share`` of its words or fewer than ``min_left``
words would remain.

Copies of one text are not different documents, so what is counted are distinct hashes of the whole
text; near copies count each.  A count is distinct before it is counted, both with partial
aggregation, so a hot host or line is only a sum; the few lines above the limit meet the document
lines on a salted key.

Edge cases: null and empty texts have no words and fail the word rules; a null host is the host of
the empty name; rows repeated with id, text and host are judged alike and count as one document, also
where that one keeps the line; texts of any length are measured whole; a line as often as the limit
(a tie) is not above it; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import WHITE, per_row, read, same, texts, utf8
from riskgraph.plans.lineage import cut

MAX_DOCUMENTS = 100
MIN_WORDS = 10
MAX_REPEATED = 0.2
MIN_SHARE = 0.3
#: A document of which fewer words are left is depleted even if that is a large share.
MIN_LEFT = 5
WINDOW = 5
SALTS = 16

FACTS = ("doc_id long, host string, key long, row long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
         " n_repeat_words long, digest long, lines array<struct<h: long, n: int>>")

_SYMBOLS = b"#*$%&|<>"
_NOT_STARTS = WHITE + bytes(range(0x80, 0xC0))
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_MIX = 0x9E3779B97F4A7C15


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(_MIX) + ids[k : k + n]
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(h, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    edge[starts] += 1
    edge[starts + width] -= 1
    return int((np.cumsum(edge) > 0).sum())


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.lower().translate(_DIGITS).split())


def _hash(value: bytes) -> int:
    return xxhash.xxh64_intdigest(value, 42) - (1 << 63)


def measure(text: bytes) -> tuple:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, digest, lines`` of one text."""
    words = text.split()
    seen, again = set(), 0
    lines: dict[bytes, int] = {}
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
            n = len(line.split())
        else:
            n = len(line.split())
            if not n:
                continue
            seen.add(line)
        normal = normal_line(line)
        lines[normal] = lines.get(normal, 0) + n
    hashed = [{"h": _hash(k), "n": v} for k, v in lines.items()]
    return (
        len(words), len(text.translate(None, _NOT_STARTS)), len(text) - len(text.translate(None, _SYMBOLS)),
        again, repeated_words(words), _hash(text), hashed)


def _facts():
    def rows(batch):
        ids, hosts, keys, rows_ = (batch.column(j).to_pylist() for j in (0, 2, 3, 4))
        for d, host, key, row, text in zip(ids, hosts, keys, rows_, utf8(batch.column(1)), strict=True):
            yield (d, host or "", key, row, *measure(text))

    return rows


def row_hash():
    return F.xxhash64("doc_id", "text")


def line_facts(docs: DataFrame, host: str = "source") -> DataFrame:
    """Counts, text hash and line hashes of every document, written once (see :func:`judge`)."""
    keyed = texts(docs, F.col(host).cast("string").alias("host"), F.monotonically_increasing_id().alias("key"),
                  row_hash().alias("row"))
    # The written table fixes the row keys; they are only compared with themselves.
    return cut(per_row(keyed, FACTS, _facts), "line_facts")


def _place():
    """Order of documents as one number, so that its minimum combines before the shuffle: id, then hash."""
    number = F.coalesce("doc_id", F.lit((1 << 63) - 1)).cast("decimal(20,0)") * F.lit(1 << 40).cast("decimal(13,0)")
    return number + F.pmod("row", F.lit(1 << 40)).cast("decimal(13,0)")


def frequent_lines(facts: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """``host, h, documents, first``: lines in more than ``max_documents`` different texts of a host.

    ``first`` is the :func:`_place` of the document that keeps the line.
    """
    lines = facts.select("host", "digest", _place().alias("place"), F.explode("lines.h").alias("h"))
    by_text = lines.groupBy("host", "h", "digest").agg(F.min("place").alias("place"))
    return by_text.groupBy("host", "h").agg(
        F.count(F.lit(1)).alias("documents"), F.min("place").alias("first")
    ).filter(F.col("documents") > max_documents)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > round(100 * MAX_REPEATED) * F.col("n_words"))


def judge(facts: DataFrame, max_documents: int = MAX_DOCUMENTS, min_share: float = MIN_SHARE,
          min_left: int = MIN_LEFT) -> DataFrame:
    """Facts with ``removed_words``, ``base_failed`` and ``kept``."""
    frequent = frequent_lines(facts, max_documents).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lines = facts.select("host", "key", _place().alias("place"), F.explode("lines").alias("l")).select(
        "host", "key", "place", F.col("l.h").alias("h"), F.col("l.n").alias("n"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"))
    removed = lines.join(frequent, ["host", "h", "salt"]).filter(F.col("place") != F.col("first")).groupBy(
        F.col("key").alias("_key")).agg(
            F.sum("n").alias("removed_words"), F.collect_list("h").alias("removed_lines"))
    out = facts.join(removed, facts["key"] == removed["_key"], "left").drop("_key").withColumn(
        "removed_words", F.coalesce("removed_words", F.lit(0)))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < min_left) | (left < min_share * F.col("n_words")))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~depleted)


def op8_quality_rules(spark, sf_dir) -> DataFrame:
    judged = judge(line_facts(read(spark, sf_dir, "documents")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_passing(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs``, all columns, that pass; of rows alike in id and text all stay if one host passes them."""
    judged = judge(line_facts(docs), **limits)
    failed = judged.groupBy(F.col("doc_id").alias("_d"), F.col("row").alias("_r")).agg(
        F.max("kept").alias("_any")).filter(~F.col("_any")).drop("_any")
    keyed = docs.withColumn("_row", row_hash())
    return keyed.join(failed, same(keyed, failed, {"doc_id": "_d", "_row": "_r"}), "left_anti").select(*docs.columns)


def _without():
    def rows(batch):
        for d, text, gone in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            if gone:
                gone = set(gone)
                text = b"\n".join(x for x in text.split(b"\n") if not x.split() or _hash(normal_line(x)) not in gone)
            yield d, text.decode()

    return rows


def remove_lines(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """``doc_id, text`` of every row without the lines that :func:`judge` counts as removed; null texts are empty.

    Rows repeated with id and text are one document: what any of their hosts keeps, all keep.
    """
    removed = judge(line_facts(docs), max_documents).groupBy(F.col("doc_id").alias("_d"), F.col("row").alias("_r")).agg(
        F.collect_set(F.coalesce("removed_lines", F.array().cast("array<long>"))).alias("_sets"))
    gone = removed.select("_d", "_r", F.aggregate("_sets", F.col("_sets")[0], F.array_intersect).alias("_gone")).filter(
        F.size("_gone") > 0)
    keyed = texts(docs, row_hash().alias("_row"))
    joined = keyed.join(gone, same(keyed, gone, {"doc_id": "_d", "_row": "_r"}), "left").select("doc_id", "text", "_gone")
    return per_row(joined, "doc_id long, text string", _without)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass."""
    return keep_passing(docs)
