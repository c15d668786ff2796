"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

1. A map tokenises whole texts and cuts only documents longer than a sequence.  Chunks between
   white space are encoded once per worker and kept in a bounded table (``MEMO_BYTES``), as the
   tokenizer never looks across white space.
2. The pieces (numbers only) are sorted by length over all partitions and written, with their
   place inside (partition, length).  A count per (partition, length) - at most partitions +
   4096 rows, whatever the input - is the length histogram and the rank of every piece.
3. The configuration linear program over the histogram: patterns of lengths that fit a sequence,
   every length covered as often as it occurs, as few patterns as possible.  Multiplicative
   weights hold a price per length; a knapsack dynamic program finds the patterns of the best
   price, each is taken in a fraction, and the prices of covered lengths fall (:func:`relax`, which
   also gives the best dual value as a bound).  The fractions are rounded, the rest is put by best
   fit, on counts, into the tightest gaps (:func:`solve`).
4. A piece's rank among its length gives its sequence and offset by one search in the slot table,
   whose size depends on the number of patterns (``ROUNDS`` x 4096 at most), not on the input.

Edge cases: a null or empty text is the end token alone; repeated rows are packed each; an empty
table gives no rows; null ids stay null.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import per_row, read, texts, utf8
from riskgraph.plans.lineage import cut

CAPACITY = 4096
END = 1
MEMO_BYTES = 160_000_000
ROUNDS = 12
RATE = 0.35
SCALE = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Lower-case letters of ASCII and Latin-1, then at most one mark: such a chunk is a word and a mark
#: to the tokenizer, and its normaliser leaves it as it is.
_PLAIN = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,]?)")
#: Capitals of Latin-1 to small letters, as the normaliser does.
_SMALL = {c: c + 32 for c in range(0xC0, 0xDF) if c != 0xD7}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet for Latin-1 letters: visible bytes stand for themselves, the others
    are numbered from 256 in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class ChunkIds:
    """Little-endian ids of texts; what is known of chunks is forgotten beyond ``MEMO_BYTES`` bytes,
    so a worker holds no more than that and the chunks of one text, however long chunks are.

    Chunks of plain letters go straight to the tokenizer's model, all others through its whole
    pipeline; both give the same ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.size = 0
        self.marks = {m: self._ids(self.tokenizer.encode(m, add_special_tokens=False).ids) for m in ".,"} | {"": b""}

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def learn(self, chunks) -> None:
        known, rest = self.known, []
        for c in chunks:
            text = c.decode()
            if not c.isascii():
                text = text.translate(_SMALL)
            plain = _PLAIN.fullmatch(text)
            if plain is None:
                rest.append(c)
                continue
            word, mark = plain.groups()
            if not word.isascii():
                word = word.translate(self.letters)
            core = c[:-1] if mark else c
            ids = known.get(core)
            if ids is None:
                ids = known[core] = self._ids([t.id for t in self.word(word)])
            if mark:
                known[c] = ids + self.marks[mark]
        if rest:
            got = self.tokenizer.encode_batch_fast([c.decode() for c in rest], add_special_tokens=False)
            known.update(zip(rest, (self._ids(e.ids) for e in got), strict=True))

    def encode(self, text: bytes) -> bytes:
        chunks = text.split()
        new = set(chunks).difference(self.known)
        if new:
            if self.size > MEMO_BYTES:
                self.known.clear()
                self.size, new = 0, set(chunks)
            self.learn(new)
            self.size += sum(260 + len(c) + len(self.known[c]) for c in new)
        return b"".join(map(self.known.__getitem__, chunks))


_TOKENIZERS: dict[str, ChunkIds] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(path, capacity, end):
    ids = _TOKENIZERS.get(path) or _TOKENIZERS.setdefault(path, ChunkIds(path))
    last, width = np.array([end], "<u4").tobytes(), 4 * capacity

    def rows(batch):
        for d, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            raw = ids.encode(text.lower()) + last
            for k, at in enumerate(range(0, len(raw), width)):
                part = raw[at : at + width]
                yield d, k, at // 4, len(part) // 4, zlib.crc32(part)

    return rows


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece."""
    return per_row(texts(docs), PIECES, _pieces, path or tokenizer_path(), capacity, end)


# --- configurations ----------------------------------------------------------------------------


def price(weights: np.ndarray, capacity: int):
    """Knapsack: for each capacity the best total weight, and the length that is put in last (0: none)."""
    lengths = np.flatnonzero(weights > 0)
    w = weights[lengths]
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int32)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = upto[c]
        if k:
            value = best[c - lengths[:k]] + w[:k]
            j = int(value.argmax())
            if value[j] > best[c]:
                best[c], choice[c] = value[j], lengths[j]
    return best, choice


def _fill(choice: np.ndarray, room: int) -> dict[int, int]:
    out: dict[int, int] = {}
    while room > 0:
        length = int(choice[room])
        if length:
            out[length] = out.get(length, 0) + 1
            room -= length
        else:
            room -= 1
    return out


def relax(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, rate: float = RATE):
    """Configuration linear program: ``([(x, {length: copies})], bound)``.

    The patterns, each taken ``x / SCALE`` times, cover every length exactly; ``bound`` is the best dual
    value met, which no packing, whole or fractional, can go below.  ``counts[l]`` is the number of
    pieces of length ``l``.  Weights of lengths are prices: every pattern of near maximal weight takes
    ``rate`` of what its lengths still miss, and their weights shrink by the share that was covered.
    What is left after ``rounds`` is covered by best fit, in the same fractions.
    """
    need = counts.astype(np.int64) * SCALE
    total = np.maximum(need, 1)
    weights = np.where(need > 0, np.arange(len(need)) / capacity, 0.0)
    bound = float(counts @ weights)  # lengths as shares of the capacity are dual feasible
    patterns: list[tuple[int, dict[int, int]]] = []
    for _ in range(rounds):
        prices = np.where(need > 0, weights, 0.0)
        best, choice = price(prices, capacity)
        if best[capacity] <= 0:
            break
        bound = max(bound, float(counts @ prices) / best[capacity])
        for top in np.flatnonzero(need)[::-1].tolist():
            if not need[top] or weights[top] + best[capacity - top] < (1 - rate / 4) * best[capacity]:
                continue
            pattern = _fill(choice, capacity - top)
            pattern[top] = pattern.get(top, 0) + 1
            most = min(int(need[length]) // n for length, n in pattern.items())
            free = capacity - sum(length * n for length, n in pattern.items())
            if most < 1 or free * 128 > capacity:
                continue
            times = max(1, int(rate * most))
            patterns.append((times, pattern))
            for length, n in pattern.items():
                need[length] -= times * n
                weights[length] *= np.exp(-rate * times * n / total[length])
    found: dict[tuple, int] = {}
    for times, pattern in _best_fit(patterns, need, capacity):
        key = tuple(sorted(pattern.items()))
        found[key] = found.get(key, 0) + times
    return [(x, dict(key)) for key, x in found.items()], bound


def solve(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, rate: float = RATE):
    """Patterns with their multiplicity: ``[(times, {length: copies})]``; every piece is in one.

    The fractional cover of :func:`relax` is rounded down.  What is open is packed twice, by the
    patterns with the largest fractions that fit whole and best fit for the rest, or by every
    pattern once more without what is too much; the shorter result counts.  The second makes it at
    most the value of the linear program plus the number of its patterns.
    """
    fractional, _ = relax(counts, capacity, rounds, rate)
    whole = [(x // SCALE, pattern) for x, pattern in fractional if x >= SCALE]
    parts = sorted(((x % SCALE, sorted(pattern.items())) for x, pattern in fractional if x % SCALE), reverse=True)
    parts = [dict(items) for _, items in parts]
    open_ = counts.astype(np.int64).copy()
    for times, pattern in whole:
        for length, n in pattern.items():
            open_[length] -= times * n
    need, fitting = open_.copy(), []
    for pattern in parts:
        if all(need[length] >= n for length, n in pattern.items()):
            fitting.append((1, pattern))
            for length, n in pattern.items():
                need[length] -= n
    fitted = _best_fit(whole + fitting, need, capacity)
    need, trimmed = open_.copy(), []
    for pattern in parts:
        less = {length: min(n, int(need[length])) for length, n in pattern.items() if need[length]}
        if less:
            trimmed.append((1, less))
            for length, n in less.items():
                need[length] -= n
    covered = _best_fit(whole + trimmed, need, capacity)
    return min(fitted, covered, key=lambda p: sum(times for times, _ in p))


def _best_fit(patterns, need: np.ndarray, capacity: int):
    """Puts what is left, longest first, into the tightest open gaps; works on counts."""
    done, gaps, order = [], {}, []

    def put(gap: int, times: int, pattern: dict[int, int]) -> None:
        if gap == 0:
            done.append((times, pattern))
            return
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(order, gap)
        gaps[gap].append((times, pattern))

    for times, pattern in patterns:
        put(capacity - sum(length * n for length, n in pattern.items()), times, pattern)
    for length in np.flatnonzero(need)[::-1].tolist():
        left = int(need[length])
        while left:
            k = bisect.bisect_left(order, length)
            if k == len(order):
                each = capacity // length
                times, copies = (left // each, each) if left >= each else (1, left)
                put(capacity - copies * length, times, {length: copies})
                left -= times * copies
                continue
            gap = order[k]
            times, pattern = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(k)
            copies = min(gap // length, left)
            take = min(times, left // copies)
            if take < times:
                put(gap, times - take, pattern)
            put(gap - copies * length, take, {**pattern, length: pattern.get(length, 0) + copies})
            left -= take * copies
    for gap in order:
        done += gaps[gap]
    return done


class Slots:
    """Where the r-th piece of a length goes."""

    def __init__(self, patterns, counts: np.ndarray):
        self.first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        rows, sequence = [], 0
        for times, pattern in patterns:
            offset = 0
            for length in sorted(pattern, reverse=True):
                rows.append((length, times * pattern[length], pattern[length], sequence, offset))
                offset += length * pattern[length]
            sequence += times
        self.sequences = sequence
        length, n, self.copies, self.sequence, self.offset = (
            np.array(c, np.int64) for c in (zip(*sorted(rows), strict=True) if rows else ((),) * 5))
        self.at = np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n
        assert not len(n) or np.array_equal(np.bincount(length, n, len(counts)).astype(np.int64), counts)

    def place(self, length: np.ndarray, rank: np.ndarray):
        g = self.first[length] + rank
        k = np.searchsorted(self.at, g, side="right") - 1
        r = g - self.at[k]
        return self.sequence[k] + r // self.copies[k], self.offset[k] + r % self.copies[k] * length


def _more(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def pack(pieces: DataFrame, capacity: int = CAPACITY, partitions: int | None = None) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; other columns are kept."""
    spark = pieces.sparkSession
    pieces = cut(pieces, "tokenised")  # dealing by range reads its input twice
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in ("length", "doc_id", "piece", "ids_crc32")]
    dealt = pieces.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema]

    def number(batches):
        part, last, rank = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            length = batch.column("length").to_numpy()
            if not len(length):
                continue
            # Where each run of equal lengths starts; the first run may go on from the last batch.
            starts = np.flatnonzero(np.concatenate(([True], length[1:] != length[:-1])))
            begin = np.repeat(starts, np.diff(np.append(starts, len(length))))
            run = np.arange(len(length)) - begin
            if length[0] == last:
                run[begin == 0] += rank
            last, rank = length[-1], int(run[-1]) + 1
            yield _more(batch, _part=pa.array(np.full(len(length), part, np.int32)), _rank=pa.array(run))

    table = cut(dealt.mapInArrow(number, ", ".join([*fields, "_part int", "_rank long"])), "pieces")
    runs = table.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pandas().sort_values(["length", "_part"])
    counts = np.bincount(runs["length"], runs["n"], capacity + 1).astype(np.int64)
    before = {(length, part): int(b) for length, part, b in zip(
        runs["length"], runs["_part"], runs.groupby("length")["n"].cumsum() - runs["n"], strict=True)}
    slots = Slots(solve(counts, capacity), counts)
    shared = spark.sparkContext.broadcast((before, slots))

    def place(batches):
        before, slots = shared.value
        for batch in batches:
            length, part, rank = (batch.column(c).to_numpy() for c in ("length", "_part", "_rank"))
            base = np.array([before[k] for k in zip(length.tolist(), part.tolist(), strict=True)], np.int64)
            sequence, offset = slots.place(length, rank + base)
            kept = batch.select([c for c in batch.schema.names if c not in ("_part", "_rank")])
            yield _more(kept, sequence_id=pa.array(sequence), offset=pa.array(offset))

    return table.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def op4_packing(spark, sf_dir) -> DataFrame:
    return pack(pieces(read(spark, sf_dir, "documents")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left."""
    return pack(pieces(docs))
