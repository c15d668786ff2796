"""Phrases that stand out: collocations mined from a weighted de Bruijn graph of words, per language.

Texts are split into pieces at punctuation and line ends, pieces into words.  Every count is exact.

1. A first map counts hashed words and word pairs in a table of buckets, one byte each, a second one the
   triples that these leave possible.  A bucket below the least count proves that nothing in it is
   frequent, so pieces can be cut there: an occurrence of a frequent phrase has only frequent words,
   pairs and triples.  The tables grow with the input up to ``2**MOST_BITS`` buckets; what is broadcast
   is one bit a bucket, so at most 16 MB each.  Beyond that the cut is merely less sharp, and the
   counts stay the same.
2. A third map cuts the pieces, and adds up per task: the edges of the graph, phrases of ``longest``
   words that lead from the node of their first words to the node of their last words; and the ends,
   the last ``longest - 1`` words of each cut piece, or the whole of a shorter one; and single words.
3. The sums over all tasks are the weighted graph (:func:`graph`).  Edges below the least count are no
   phrases; their weight becomes an end at the node they leave.
4. Unary paths are compacted: where one edge alone enters a node, one alone leaves it, with the
   same weight and no end there, both belong to one path.  Places on paths are found by pointer
   doubling, and a path of up to ``STRETCH`` edges becomes one row (:func:`compact`).
5. Shorter counts come from the flow: what passes a node is what leaves it along edges plus what
   ends there, and a phrase of j words occurs as often as the phrases of j + 1 words it begins,
   plus the pieces it ends (:func:`flow`).
6. Frequent phrases are cut at every place, looked up, scored in whole decimal numbers, dropped
   where a longer one is as frequent, and ranked per language with a limit that acts before the
   shuffle (:func:`ranked`).

All sums are combined in tasks before the shuffle, so a hot passage is one row a task.  What is frequent
is in nearly every task, so each map runs in a few long tasks a core (:func:`long_tasks`): tables and
rows sent follow the cores and the different phrases, not the number of splits of the input.

Edge cases: null and empty texts have no words; a null language is ``und``, with rows of that name;
repeated rows count each; ties rank by count, then by the phrase's bytes; a language without frequent
phrases has no rows, an empty table none; texts are read whole, in groups of ``TOKENS`` words; other
columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.llm.common import read, utf8
from riskgraph.plans.lineage import cut, release

LEAST = 100
LONGEST = 5
TOP = 2000
#: A longer phrase with this percentage of a phrase's count hides it.
COVER = 100

FEWEST_BITS, MOST_BITS, BYTES_PER_BUCKET = 16, 27, 64
CHUNK = 1 << 14
#: Words, and different words, that a task holds before it adds them up.
TOKENS, VOCABULARY = 3_000_000, 400_000
#: Different phrases that a task adds up before it sends them on.
HELD = 600_000
STRETCH = 4096
ROWS = 50_000
#: Tasks of each map over the texts, per core of the cluster.
WAVES = 2

_BREAK = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")


# --- words of a task -----------------------------------------------------------------------------


def words_of(text: bytes) -> list[bytes]:
    """Words in order; ``\\n`` is the end of a piece, and empty words mean nothing."""
    return text.lower().translate(_BREAK).replace(b"\n", b" \n ").split(b" ")


class Numbers(dict):
    """Words to numbers as they come: 0 the empty word, 1 the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _blocks(batches):
    """``(lang, words, numbers)``: the texts of a task in groups of bounded size, per language."""
    held: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
    tokens = words = 0

    def flush():
        for lang, (known, parts) in held.items():
            a = np.concatenate(parts)
            yield lang, list(known), a[a != 0]

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            if lang not in held:
                held[lang] = Numbers(), []
            known, parts = held[lang]
            before, split = len(known), words_of(text)
            split.append(b"\n")
            parts.append(np.fromiter(map(known.__getitem__, split), np.int32, len(split)))
            tokens += len(split)
            words += len(known) - before
            if tokens > TOKENS or words > VOCABULARY:
                yield from flush()
                held.clear()
                tokens = words = 0
    yield from flush()


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * np.uint64(0x9E3779B97F4A7C15) + right
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.uint32)


def long_tasks(docs: DataFrame) -> DataFrame:
    """The same rows in at most ``WAVES`` partitions per core; a task's memory does not depend on its rows."""
    return docs.coalesce(WAVES * docs.sparkSession.sparkContext.defaultParallelism)


# --- buckets -------------------------------------------------------------------------------------


def _is_frequent(table: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (table[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8) & 1).astype(bool)


def _pairs(h, a, table, bits) -> tuple[np.ndarray, np.ndarray]:
    """``fine`` words, and ``link[i]``: places i and i + 1 are a pair that can be frequent."""
    fine = _is_frequent(table, _bucket(h, bits))
    fine[:2] = False
    link = np.zeros(len(a), bool)
    both = np.flatnonzero(fine[a[:-1]] & fine[a[1:]])
    link[both] = _is_frequent(table, _bucket(_mix(h[a[both]], h[a[both + 1]]), bits))
    return fine, link


def _triples(h, a, link) -> tuple[np.ndarray, np.ndarray]:
    """Places that begin two links, and the hashes of their three words."""
    at = np.flatnonzero(link[:-1] & link[1:])
    return at, _mix(_mix(h[a[at]], h[a[at + 1]]), h[a[at + 2]])


def frequent_buckets(docs: DataFrame, bits: int, least: int, pairs: np.ndarray | None = None) -> np.ndarray:
    """One bit per bucket: whether what falls into it reaches ``least``.

    At first words and pairs; with the table of those, the triples that they leave possible.
    """
    kind = np.uint8 if least < 256 else np.uint32
    shared = docs.sparkSession.sparkContext.broadcast(pairs)

    def count(batches):
        known, table = shared.value, np.zeros(1 << bits, kind)

        def add(buckets, counts):
            table[buckets] = np.minimum(table[buckets] + counts.astype(np.int64), least).astype(kind)

        for lang, words, a in _blocks(batches):
            h = _hashes(lang, words)
            if known is None:
                own, of = np.unique(_bucket(h[2:], bits), return_inverse=True)
                add(own, np.bincount(of, np.bincount(a, minlength=len(words))[2:], len(own)))
                both = np.flatnonzero((a[:-1] > 1) & (a[1:] > 1))
                hashes = _mix(h[a[both]], h[a[both + 1]])
            else:
                hashes = _triples(h, a, _pairs(h, a, known, bits)[1])[1]
            add(*np.unique(_bucket(hashes, bits), return_counts=True))
        step = min(CHUNK, len(table))
        for k in range(len(table) // step):
            part = table[k * step : (k + 1) * step]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["chunk", "counts"])

    def merge(batches):
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(raw.as_py()), kind)
                old = tables.get(k)
                tables[k] = part if old is None else np.minimum(old.astype(np.int64) + part, least).astype(kind)
        for k, part in tables.items():
            bit = np.packbits(part >= least).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bit], pa.binary())], names=["chunk", "bits"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.mapInArrow(count, "chunk int, counts binary").repartition(n, "chunk")
    out = np.zeros((1 << bits) // 8, np.uint8)
    step = min(CHUNK, 1 << bits) // 8
    for row in dealt.mapInArrow(merge, "chunk int, bits binary").toArrow().to_pylist():
        out[row["chunk"] * step : (row["chunk"] + 1) * step] = np.frombuffer(row["bits"], np.uint8)
    return out


# --- the graph -----------------------------------------------------------------------------------


def _distinct(a: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different runs of ``size`` numbers at ``starts`` (one place of each), and their counts."""
    code = a[starts].astype(np.int64)
    first = counts = None
    for j in range(1, size):
        _, first, code, counts = np.unique(
            code << 32 | a[starts + j], return_index=True, return_inverse=True, return_counts=True)
    return starts[first], counts


def graph(docs: DataFrame, pairs: np.ndarray, triples: np.ndarray, bits: int, longest: int = LONGEST) -> DataFrame:
    """``lang, size, gram, n``: edges (``size`` words = ``longest``), ends (2 to ``longest - 1``),
    single words (1), and all words of the language (0, without a gram)."""
    shared = docs.sparkSession.sparkContext.broadcast((pairs, triples))

    def gather(batches):
        pairs, triples = shared.value
        sums = Sums()
        for lang, words, a in _blocks(batches):
            h = _hashes(lang, words)
            fine, link = _pairs(h, a, pairs, bits)
            at, hashes = _triples(h, a, link)
            on = np.zeros(len(a), bool)  # on[i]: the pair at i goes on to the pair at i + 1
            on[at[_is_frequent(triples, _bucket(hashes, bits))]] = True
            counts = np.bincount(a, minlength=len(words))
            yield from sums.add(lang, 0, [b""], [int(counts[2:].sum())])
            own = np.flatnonzero(fine & (counts > 0))
            yield from sums.add(lang, 1, [words[i] for i in own.tolist()], counts[own].tolist())
            for size, starts in _runs(link, on, longest):
                if len(starts):
                    places, n = _distinct(a, starts, size)
                    for k in range(0, len(places), ROWS):
                        grams = a[places[k : k + ROWS, None] + np.arange(size)].tolist()
                        yield from sums.add(lang, size, [b" ".join([words[i] for i in g]) for g in grams], n[k : k + ROWS].tolist())
        yield from sums.flush()

    rows = docs.mapInArrow(gather, "lang string, size int, gram string, n long")
    return rows.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def _runs(link: np.ndarray, on: np.ndarray, longest: int):
    """``(size, starts)`` of the edges, and of the last words of every cut piece of two words or more.

    A cut piece is a run of pairs that go on; where a pair does not, the next piece begins with its
    second word, so every pair lies in one piece.
    """
    edge = link.copy()
    for j in range(longest - 2):
        edge &= np.append(on[j:], np.zeros(min(j, len(on)), bool))
    yield longest, np.flatnonzero(edge)
    if longest == 2:  # the nodes are single words
        return
    last = np.flatnonzero(link & ~on)  # where the last pair begins
    back = np.zeros(len(last), np.int64)  # words before it, as far as they matter
    for j in range(1, longest - 2):
        before = last - j
        back += (back == j - 1) & (before >= 0) & on[np.maximum(before, 0)]
    for more in range(longest - 2):
        yield 2 + more, last[back == more] - more


class Sums:
    """Counts of a task over all its blocks, sent on when there are ``HELD`` of them."""

    def __init__(self):
        self.of: dict[tuple[str, int], dict[bytes, int]] = {}
        self.held = 0

    def add(self, lang: str, size: int, grams: list[bytes], counts: list[int]):
        known = self.of.setdefault((lang, size), {})
        before = len(known)
        for g, n in zip(grams, counts, strict=True):
            known[g] = known.get(g, 0) + n
        self.held += len(known) - before
        if self.held > HELD:
            yield from self.flush()

    def flush(self):
        for (lang, size), known in self.of.items():
            grams, counts = list(known), list(known.values())
            for k in range(0, len(grams), ROWS):
                some = grams[k : k + ROWS]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(some), pa.string()), pa.array([size] * len(some), pa.int32()),
                    pa.array(some, pa.binary()).cast(pa.string()), pa.array(counts[k : k + ROWS], pa.int64()),
                ], names=["lang", "size", "gram", "n"])
        self.of, self.held = {}, 0


def _first(gram: str | Column, k: int | Column) -> Column:
    return F.call_function("substring_index", F.col(gram) if isinstance(gram, str) else gram, F.lit(" "), F.lit(k) if isinstance(k, int) else k)


def _last(gram: str, k: int) -> Column:
    return _first(gram, -k)


def stops(grams: DataFrame, least: int, longest: int) -> DataFrame:
    """``lang, size, gram, n``: where the flow ends, for each size of node below ``longest``."""
    ends = grams.filter((F.col("size") >= 2) & (F.col("size") < longest))
    inside = ends.select("lang", "n", "gram", F.explode(F.sequence(F.lit(2), F.col("size"))).alias("size")).select(
        "lang", "size", _first("gram", -F.col("size")).alias("gram"), "n")
    rare = grams.filter((F.col("size") == longest) & (F.col("n") < least)).select(
        "lang", F.lit(longest - 1).alias("size"), _first("gram", longest - 1).alias("gram"), "n")
    return inside.unionByName(rare)


def compact(edges: DataFrame, ends: DataFrame, longest: int) -> DataFrame:
    """``lang, path, edges, n``: unary paths of the frequent edges ``lang, gram, n``, as words.

    ``ends`` (lang, gram) are the nodes where some flow ends.  A cycle cannot be unary all along:
    what is on it came from a piece, and the piece ends somewhere.
    """
    edges = cut(edges.select("lang", "gram", "n", F.monotonically_increasing_id().alias("id")), "edges")
    leaving = edges.groupBy("lang", _first("gram", longest - 1).alias("node")).agg(
        F.count(F.lit(1)).alias("_outs"), F.first("id").alias("id"), F.first("n").alias("_out"))
    entering = edges.groupBy("lang", _last("gram", longest - 1).alias("node")).agg(
        F.count(F.lit(1)).alias("_ins"), F.first("id").alias("before"), F.first("n").alias("_in"))
    unary = leaving.join(entering, ["lang", "node"]).filter("_outs = 1 and _ins = 1 and _out = _in")
    unary = unary.join(ends.select("lang", F.col("gram").alias("node")), ["lang", "node"], "left_anti")
    # ``to``: an edge further ahead on the path, ``far`` edges before this one; itself at the start.
    places = edges.join(unary.select("id", "before"), "id", "left").select(
        "id", F.coalesce("before", "id").alias("to"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("far"))
    places = cut(places, "places")
    reach = places.agg(F.sum("far")).first()[0]
    while True:
        ahead = places.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"))
        before, places = places, cut(places.join(ahead, "to").select(
            "id", F.col("_to").alias("to"), (F.col("far") + F.col("_far")).alias("far")), "places")
        release(before)
        reach, last = places.agg(F.sum("far")).first()[0], reach
        if reach == last:
            break
    joined = edges.join(places, "id").groupBy("lang", "n", "to", F.floor(F.col("far") / STRETCH).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("far", "gram"))).alias("steps"))
    rest = F.transform(F.expr("slice(steps, 2, size(steps))"), lambda s: _first(s["gram"], -1))
    return joined.select("lang", F.concat_ws(" ", F.col("steps")[0]["gram"], rest).alias("path"), F.size("steps").alias("edges"), "n")


def flow(paths: DataFrame, ends: DataFrame, longest: int) -> dict[int, DataFrame]:
    """``lang, gram, n`` for every size from ``longest - 1`` down to 2: the counts of all phrases left."""
    words = F.split("path", " ")
    now = paths.select("lang", "n", "edges", words.alias("words")).select("lang", "n", F.explode(F.transform(
        F.sequence(F.lit(1), F.col("edges")), lambda k: F.concat_ws(" ", F.slice("words", k, longest - 1)))).alias("gram"))
    out = {}
    for size in range(longest - 1, 1, -1):
        here = ends.filter(F.col("size") == size).select("lang", "gram", "n")
        begun = now.select("lang", _first("gram", size).alias("gram"), "n")
        now = out[size] = begun.unionByName(here).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return out


# --- scores --------------------------------------------------------------------------------------


def counted(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``lang, size, gram, n`` of every word and phrase that occurs ``least`` times, and ``lang, n``.

    ``bits`` are those of the bucket table; without them they follow the bytes of all texts.
    """
    docs = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text"))
    if bits is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1
        bits = min(max(int(np.ceil(np.log2(max(size / BYTES_PER_BUCKET, 1)))), FEWEST_BITS), MOST_BITS)
    docs = long_tasks(docs)
    pairs = frequent_buckets(docs, bits, least)
    triples = frequent_buckets(docs, bits, least, pairs)
    grams = cut(graph(docs, pairs, triples, bits, longest), "grams")
    ends = stops(grams, least, longest)
    whole = grams.filter((F.col("size") == longest) & (F.col("n") >= least))
    phrases = [grams.filter((F.col("size") == 1) & (F.col("n") >= least)), whole]
    if longest > 2:
        paths = cut(compact(whole, ends.filter(F.col("size") == longest - 1), longest), "paths")
        for size, f in flow(paths, ends, longest).items():
            phrases.append(f.filter(F.col("n") >= least).withColumn("size", F.lit(size)))
    out = phrases[0]
    for p in phrases[1:]:
        out = out.unionByName(p)
    totals = grams.filter(F.col("size") == 0).select("lang", F.col("n").alias("total"))
    return cut(out, "phrases"), cut(totals, "totals")


def ranked(phrases: DataFrame, totals: DataFrame, top: int = TOP, cover: int = COVER) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases."""
    size = F.col("size")
    many = phrases.filter(size >= 2)
    inside = phrases.filter(size >= 3).select("lang", "n", "size", F.split("gram", " ").alias("w")).select(
        "lang", "n", "w", "size", F.explode(F.sequence(F.lit(2), size - 1)).alias("part")).select(
        "lang", "n", "w", "part", F.explode(F.sequence(F.lit(1), size - F.col("part") + 1)).alias("at"))
    hidden = inside.groupBy("lang", F.concat_ws(" ", F.slice("w", F.col("at"), F.col("part"))).alias("gram")).agg(F.max("n").alias("_n"))
    kept = many.join(hidden, ["lang", "gram"], "left").filter(F.col("_n").isNull() | (F.col("_n") * 100 < F.col("n") * cover))
    cuts = kept.select("lang", "gram", F.col("n").alias("a"), "size", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "gram", "a", "k", _first("gram", F.col("k")).alias("_l"), _first("gram", F.col("k") - size).alias("_r"))
    left = phrases.select("lang", F.col("gram").alias("_l"), F.col("n").alias("l"))
    right = phrases.select("lang", F.col("gram").alias("_r"), F.col("n").alias("r"))
    # Numbers of up to 19 digits: a * n and l * r fit 38 digits, and so does a thousand times a share of them.
    score = F.expr("cast(cast(1000 * cast(a as decimal(16,0)) as decimal(19,0)) * cast(total as decimal(19,0)) as decimal(38,0))"
                   " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.join(left, ["lang", "_l"]).join(right, ["lang", "_r"]).join(totals, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "gram", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", F.col("gram").alias("phrase"), "a", "b.l", "b.r", "n", "b.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", place).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir) -> DataFrame:
    return ranked(*counted(read(spark, sf_dir, "documents")))


SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
  {" UNION ALL ".join(f"SELECT lang, {k} AS size, array_to_string(w[i:i+{k - 1}], ' ') AS gram FROM places WHERE i + {k - 1} <= len(w)" for k in range(1, LONGEST + 1))}),
f AS (SELECT lang, size, gram, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
cand AS (SELECT lang, size, gram, string_split(gram, ' ') AS w, n AS a FROM f WHERE size >= 2),
inside AS (SELECT lang, w, a, size, unnest(range(2, size)) AS part FROM cand WHERE size >= 3),
inner_grams AS (SELECT lang, w, a, part, unnest(range(1, size - part + 2)) AS i FROM inside),
hidden AS (SELECT lang, array_to_string(w[i:i+part-1], ' ') AS gram, max(a) AS n FROM inner_grams GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN hidden h ON c.lang = h.lang AND c.gram = h.gram
  WHERE h.n IS NULL OR 100 * h.n < {COVER} * c.a),
cuts AS (SELECT lang, gram, w, size, a, unnest(range(1, size)) AS k FROM kept),
scored AS (
  SELECT c.lang, c.gram, c.a, c.k, l.n AS l, r.n AS r, t.n,
    CAST((1000::HUGEINT * c.a * t.n) // (l.n::HUGEINT * r.n) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.gram = array_to_string(c.w[1:c.k], ' ')
    JOIN f r ON r.lang = c.lang AND r.gram = array_to_string(c.w[c.k+1:c.size], ' ') JOIN totals t ON t.lang = c.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) AS o FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank FROM best WHERE o = 1)
SELECT lang, rank, gram AS phrase, a, l, r, n, score FROM placed WHERE rank <= {TOP}
"""
