"""Language-model scoring by logistic context mixing over the running text.

A text is its words, each ended by a space, and a lone space as its end token.  Each bit of these
running bytes is predicted by ``ORDERS`` hashed contexts: the 1 to 5 bytes before, across word
borders, and the whole word so far.  A context's prediction are the zeros and ones that followed
it in all training texts, every token counted; the bits of a word after its own beginnings
multiply to ``c / N``, so that the last context is the word counts.  Predictions are mixed in the
logistic domain by weights that a gate (longest context seen, place in the word, bit) selects,
learned online over all training positions with the position's own count taken out, and refined by
an adaptive probability map.  The bits of a byte sum to one, so do all texts.

A text's score mixes experts: the mixed bits alone and their mean with the discounted word counts,
each with some trusts in the words the text itself has used so far.  Each is weighed by how well it
has done up to there (the Bayesian mixture, which is the mean of the experts' products).

The plan keeps all corpus statistics in distributed tables:

1. A map over the training texts counts positions that look alike to the model (same bytes before,
   word so far and next byte) per task; they are dealt by hash, added up and written once.
2. These give the bit counts of the contexts (tables of fixed size) and, in an online pass, mixing
   weights and map; the averages over tasks are kept.
3. A map splits texts into blocks of bounded size and numbers the distinct words of a block.
4. The blocks' words are dealt by word, which gives the corpus counts, and go back to the blocks,
   where texts look them up and are spelled: each alike position once, while a task remembers it.

A word in every block has one row per block, so no word is hot, and a text never leaves its block.

Edge cases: null, empty and blank texts are the end token alone; without training texts N and V
are 0, all words are unknown, the base's V + 1 is 1, and every bit has probability 1/2; repeated
rows each count and each get their score; a null id counts as the remainder 0, that is, held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from riskgraph.llm.common import fold, fold_of, read, texts, utf8
from riskgraph.plans.lineage import new_path

FOLDS = 10
BLOCK_TOKENS = 2_000_000
ALPHA = 0.1
DISCOUNT = 0.75
#: Table sizes (bits of the index) of the contexts of 1 to 5 bytes and of the word so far.
TABLE_BITS = (16, 20, 21, 22, 23, 24)
ORDERS = len(TABLE_BITS)
WORD = ORDERS - 1
GATES = 5 * ORDERS * 4
BUCKETS = 33
RATE = 0.02
#: How much each expert trusts the text's own words.
OWN = (0.0, 0.1, 0.5, 0.9)
#: Bytes of text taken at once, positions mixed at once, and alike positions a task keeps.
PIECE = 1 << 20
BATCH = 4096
KEPT = 3_000_000
#: Parts that alike positions are dealt by, and slots of one row of bit counts.
SHARDS = 512
_CHUNK = 1 << 16
#: Counts are kept in one byte: whole up to 64, then in steps of 1/12.
_LEVELS = np.concatenate((np.arange(65), 64 * (13 / 12) ** np.arange(1, 192))).astype(np.float32)
#: By the levels of zeros (high byte) and ones: stretched prediction, and whether more than one was seen.
_STRETCH = (np.log(_LEVELS + np.float32(0.2))[None, :] - np.log(_LEVELS + np.float32(0.2))[:, None]).ravel()
_SEEN = (_LEVELS[None, :] + _LEVELS[:, None] > 1).ravel()
#: Scores of positions that a task remembers (bits of the index).
MEMORY_BITS = 22

_BASE = np.concatenate(([0], np.cumsum([1 << b for b in TABLE_BITS])))
SLOTS = int(_BASE[-1])


def _written(df: DataFrame, tag: str) -> DataFrame:
    """Like a cut of the lineage, in the smaller encoding."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- blocks ------------------------------------------------------------------------------------

BLOCKS = ("block long, doc_id long, held_out boolean, n int, ids binary, first int, words array<string>,"
          " counts array<int>")
_DICTIONARY_ROW = 20_000


def _plane(ids: list[int]) -> bytes:
    """Numbers byte plane by byte plane; the high planes of small numbers compress to nothing."""
    return np.array(ids, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplane(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _blocks(block_tokens):
    state = {"n": 0}

    def fresh():
        state.update(block=(TaskContext.get().partitionId() << 24) | state["n"], number={b"": 0}, seen=[], tokens=0)
        state["n"] += 1

    def dictionary():
        words = list(state["number"])
        ids = np.concatenate([np.zeros(0, np.int64), *state["seen"]]).astype(np.int64)
        counts = np.bincount(ids, minlength=len(words)).astype(np.int32)
        for at in range(0, len(words), _DICTIONARY_ROW):
            part = [w.decode() for w in words[at : at + _DICTIONARY_ROW]]
            yield state["block"], None, None, len(part), None, at, part, counts[at : at + _DICTIONARY_ROW]

    def rows(batch):
        if "block" not in state:
            fresh()
        for d, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            number = state["number"]
            ids = [number.setdefault(w, len(number)) for w in text.lower().split()]
            ids.append(0)
            held = fold_of(d, FOLDS) == 0
            if not held:
                state["seen"].append(np.array(ids, np.uint32))
            yield state["block"], d, held, len(ids), _plane(ids), None, None, None
            state["tokens"] += len(ids)
            if state["tokens"] >= block_tokens:
                yield from dictionary()
                fresh()

    rows.last = lambda: dictionary() if state.get("tokens") else ()
    return rows


def blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Numbered texts and the dictionaries of their blocks, written once."""
    arrow = to_arrow_schema(_parse_datatype_string(BLOCKS))

    def run(batches):
        f, out, size = _blocks(block_tokens), [], 0

        def send():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

        def source():
            for batch in batches:
                yield from f(batch)
            yield from f.last()

        for row in source():
            out.append(row)
            size += row[3]
            if size > 200_000 or len(out) >= 2000:
                yield send()
                out, size = [], 0
        if out:
            yield send()

    return _written(texts(docs).mapInArrow(run, BLOCKS), "lm_blocks")


def counted_words(blocks: DataFrame) -> DataFrame:
    """``word, c, lead, block, idx`` sorted by word in each partition.

    ``c``: the word's training tokens; ``lead``: first row of its word.
    """
    pairs = blocks.filter(F.col("words").isNotNull()).select(
        "block", "first", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w")).select(
            F.col("w.words").alias("word"), F.col("w.counts").alias("n"), "block", (F.col("first") + F.col("pos")).alias("idx"))
    one = Window.partitionBy("word")
    return _written(pairs.select(
        "word", F.sum("n").over(one).alias("c"),
        (F.row_number().over(one.orderBy("block")) == 1).alias("lead"), "block", "idx"), "lm_words")


# --- running text ------------------------------------------------------------------------------

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_U8 = np.uint64(8)
#: All bits but those of the shard.
_REST = np.uint64((1 << 55) - 1)
_SINGLE = np.uint64(1 << 52)
_MASKS = [np.uint64((1 << 8 * k) - 1) for k in range(6)]
_PLACE = np.array([0, 1, 2, 2, 3, 3, 4, 4])


class Spelled:
    """Byte positions of some texts: value, what is before it, place in the word.

    ``before`` has two rows: the five bytes before (none from another text) and a hash of the word
    so far.  A text is given without its last space.
    """

    def __init__(self, words: list[bytes]):
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self._fill(np.frombuffer(b"".join(w + b" " for w in words), np.uint8), lengths)

    @classmethod
    def of(cls, raw: np.ndarray, lengths: np.ndarray) -> Spelled:
        """Texts of the given lengths, one after the other, each with its last space."""
        out = cls.__new__(cls)
        out._fill(raw, lengths)
        return out

    def _fill(self, raw, lengths):
        self.n, self.lengths, self.byte = len(lengths), lengths, raw
        size = len(raw)
        at = np.arange(size)
        wide = raw.astype(np.uint64)
        self.before = np.zeros((2, size), np.uint64)
        tail = self.before[0]
        for k in range(1, 6):
            tail[k:] |= wide[: max(0, size - k)] << np.uint64(8 * (k - 1))
        first = np.cumsum(lengths) - lengths
        for k in range(5):
            tail[first[lengths > k] + k] &= _MASKS[k]
        start = np.zeros(size, np.int64)
        np.maximum.accumulate(np.where(raw[:-1] == 32, at[1:], 0), out=start[1:])
        place = at - start
        power = np.cumprod(np.full(int(place.max(initial=0)) + 1, _ODD[0], np.uint64))
        term = (wide + np.uint64(1)) * power[place]
        sums = np.cumsum(term, dtype=np.uint64) - term
        self.before[1] = sums - sums[start]
        self.place = np.minimum(place, 7)

    @property
    def word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.lengths)

    def code(self) -> np.ndarray:
        """Place, the bytes before and the byte in one number."""
        return self.place.astype(np.uint64) << np.uint64(48) | self.before[0] << _U8 | self.byte


def _key(code: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """64-bit hash of all that the model sees at a position; inside a word the first bits are the word's."""
    k = prefix * _ODD[1] + code * _ODD[0]
    k ^= k >> np.uint64(29)
    k *= _ODD[2]
    k ^= k >> np.uint64(32)
    k *= _ODD[1]
    own = _word_hash(prefix)
    return np.where(code >> np.uint64(48), own ^ (own ^ k) & _REST, k)


def _alike(key: np.ndarray) -> np.ndarray:
    """Per position, one position with the same key, the same for all of them."""
    bits = np.uint64(64 - max(8, len(key).bit_length() + 1))
    table = np.empty(1 << (64 - int(bits)), np.int64)
    out = np.empty(len(key), np.int64)
    left, turn = np.arange(len(key)), 0
    while len(left):
        k = key[left] if turn else key
        slot = (k * (_ODD[turn % 4] + np.uint64(2 * turn)) >> bits).view(np.int64)
        table[slot] = left
        found = table[slot]
        hit = key[found] == k
        out[left[hit]] = found[hit]
        left = left[~hit]
        turn += 1
    return out


def _word_hash(prefix: np.ndarray) -> np.ndarray:
    h = prefix * _ODD[0]
    h ^= h >> np.uint64(29)
    return h * _ODD[1]


def _hash(before: np.ndarray, order: int) -> np.ndarray:
    return _word_hash(before[1] if order == WORD else before[0] & _MASKS[order + 1])


def _nibble(h: np.ndarray, order: int, high) -> np.ndarray:
    """First of the 16 slots of half a byte in its context; ``high``: 16 + its first half, or 1."""
    x = h + high * _ODD[2]
    x ^= x >> np.uint64(32)
    x *= _ODD[0]
    if order == WORD:  # a word's slots lie in its shard's part of the table
        x = h ^ (h ^ x >> np.uint64(9)) & _REST
    return ((x >> np.uint64(68 - TABLE_BITS[order])) << np.uint64(4)).view(np.int64) + _BASE[order]


def _slots(contexts: list[np.ndarray], node: np.ndarray, bases: dict | None = None, orders=range(ORDERS)) -> list[np.ndarray]:
    """Table index per order of a bit's node (1: first bit) in its context."""
    bases = {} if bases is None else bases
    deep = int(node.max(initial=1)).bit_length() - 5  # all nodes are of one bit
    if deep < 0:
        half, high, local = 0, np.uint64(1), node.astype(np.int64)
    else:
        half, high = 1, (node >> np.uint32(deep)).astype(np.uint64)
        local = (node & np.uint32((1 << deep) - 1) | np.uint32(1 << deep)).astype(np.int64)
    if half not in bases:
        bases[half] = [_nibble(h, k, high) for k, h in zip(orders, contexts, strict=True)]
    return [b + local for b in bases[half]]


def _bits(byte: np.ndarray):
    byte = byte.astype(np.uint32)
    for j in range(8):
        yield (np.uint32(1) << np.uint32(j)) | byte >> np.uint32(8 - j), (byte >> np.uint32(7 - j) & np.uint32(1)).astype(bool), j


# --- alike positions of the training texts -----------------------------------------------------

ALIKE = "shard int, code binary, prefix binary, n binary"


def _added(code, prefix, n):
    """Positions sorted by key, alike ones added up."""
    key = _key(code, prefix)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    lead = order[first]
    return key[first], code[lead], prefix[lead], np.add.reduceat(n[order], first) if len(first) else n


def _shards(key, code, prefix, n):
    shard = (key >> np.uint64(55)).astype(np.int32)  # one of SHARDS
    found, first = np.unique(shard, return_index=True)
    ends = [*first[1:].tolist(), len(key)]
    for at in range(0, len(found), 64):
        cuts = list(zip(first[at : at + 64].tolist(), ends[at : at + 64], strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(found[at : at + 64]), *(pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (code, prefix, n))],
            names=["shard", "code", "prefix", "n"])


def _positions(batches):
    """Alike positions of a task; what is kept at once is bounded."""
    parts, kept, runs, size = [], 0, [], 0

    def taken():
        s = Spelled(runs)
        code, prefix = s.code(), s.before[1]
        n = np.bincount(_alike(_key(code, prefix)), minlength=len(code))
        first = np.flatnonzero(n)
        return code[first], prefix[first], n[first]

    def joined():
        return _added(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    for batch in batches:
        for text in utf8(batch.column(1)):
            run = b" ".join([*text.lower().split(), b""])
            runs.append(run)
            size += len(run) + 1
            if size < PIECE:
                continue
            parts.append(taken())
            kept, runs, size = kept + len(parts[-1][0]), [], 0
            if kept > KEPT:
                table = joined()
                parts, kept = [table[1:]], len(table[0])
                if kept > KEPT // 2:
                    yield from _shards(*table)
                    parts, kept = [], 0
    if runs:
        parts.append(taken())
    if parts:
        yield from _shards(*joined())


def _unpacked(table):
    """Arrays of all rows: code, prefix, n."""
    return [np.frombuffer(b"".join(table.column(c).to_pylist()), t)
            for c, t in (("code", np.uint64), ("prefix", np.uint64), ("n", np.int64))]


def _merged(key, rows):
    _, code, prefix, n = _added(*_unpacked(rows))
    # All positions after one beginning of a word are here; what follows a beginning seen once tells nothing.
    order = np.argsort(prefix)
    first = np.flatnonzero(np.concatenate(([True], prefix[order][1:] != prefix[order][:-1])))
    total = np.empty(len(n), np.int64)
    total[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(n))))
    code = np.where((total == 1) & (code >> np.uint64(48) > 0), code | _SINGLE, code)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (code, prefix, n))],
                    names=["shard", "code", "prefix", "n"])


def alike(train: DataFrame) -> DataFrame:
    """Positions of all training texts that the model tells apart, with their counts."""
    found = texts(train).mapInArrow(_positions, ALIKE)
    return _written(found.groupBy("shard").applyInArrow(_merged, ALIKE), "lm_alike")


def _in_parts(code, prefix, n, size):
    for at in range(0, len(code), size):
        c = code[at : at + size]
        yield (np.stack((c >> _U8 & _MASKS[5], prefix[at : at + size])), (c & np.uint64(255)).astype(np.uint8),
               (c >> np.uint64(48) & np.uint64(7)).astype(np.int64), n[at : at + size].astype(float), c < _SINGLE)


COUNTS = "chunk int, slot binary, zeros binary, ones binary"


def _sides(slot, counts):
    """The counts of some slots, in as few bytes as they need."""
    part = counts[slot]
    return [slot.astype(np.uint16), *(part[:, b].astype("u2" if part.max() < 1 << 16 else "u8") for b in (0, 1))]


def _bit_counts(batches):
    """Counts of zeros and ones per slot, one order after the other: at most ``SLOTS`` of them from a task."""
    rows = [_unpacked(batch) for batch in batches]
    for order, bits in enumerate(TABLE_BITS) if rows else ():
        counts = np.zeros(2 << bits, np.float32 if bits > 20 else float)
        for columns in rows:
            for before, byte, _, n, known in _in_parts(*columns, 1 << 16):
                if order == WORD:
                    before, byte, n = before[:, known], byte[known], n[known]
                h, base = _hash(before, order), {}
                for node, bit, _ in _bits(byte):
                    slot = _slots([h], node, base, (order,))[0] - _BASE[order]
                    np.add.at(counts, slot * 2 + bit, n.astype(counts.dtype))
        counts = counts.reshape(-1, 2)
        for at in range(0, len(counts), _CHUNK):
            part = counts[at : at + _CHUNK]
            slot = np.flatnonzero(part.any(axis=1))
            if len(slot):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(int(_BASE[order]) + at) // _CHUNK], pa.int32()),
                     *(pa.array([x.tobytes()], pa.binary()) for x in _sides(slot, part))], names=["chunk", "slot", "zeros", "ones"])


def _summed(key, rows):
    """The sums over tasks, each as the number of its level."""
    counts = np.zeros((2, _CHUNK))
    for slot, *sides in zip(*(rows.column(c) for c in ("slot", "zeros", "ones")), strict=True):
        at = np.frombuffer(slot.as_py(), np.uint16)
        for side, x in zip(counts, sides, strict=True):
            x = x.as_py()
            side[at] += np.frombuffer(x, f"u{len(x) // len(at)}")
    at = np.flatnonzero(counts.any(axis=0))
    levels = np.minimum(np.searchsorted(_LEVELS, counts[:, at] * (25 / 24), side="right") - 1, 255).astype(np.uint8)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (
        at.astype(np.uint16), *levels))], names=["chunk", "slot", "zeros", "ones"])


# --- mixing ------------------------------------------------------------------------------------


class Mixer:
    """Bit predictors of all orders, gated mixing weights and the final map."""

    def __init__(self, shared, weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.shared = shared  # the broadcast bit counts, packed or not
        if weights is None:
            weights = np.tile(np.array([0.0, 0.1, 0.2, 0.2, 0.3, 0.3], np.float32), (GATES, 1))
        self.weights = weights
        self.refine = refine
        self.memory = self.paired = None

    def pairs(self) -> np.ndarray:
        """Levels of zeros and ones of each slot in one number."""
        if self.paired is None:
            value = self.shared.value
            self.paired = np.frombuffer(pa.Codec("zstd").decompress(value, 2 * SLOTS), np.uint16) if isinstance(value, bytes) else value[0].astype(np.uint16) << np.uint16(8) | value[1].astype(np.uint16)
        return self.paired

    def inputs(self, slots, bit=None):
        """Stretched predictions (order, position) and the gate's longest context.

        With ``bit`` the position's own count is taken out, as it is not known before it is read.
        """
        pairs = self.pairs()
        x = np.empty((ORDERS, len(slots[0])), np.float32)
        longest = np.zeros(len(slots[0]), np.int64)
        for k, slot in enumerate(slots):
            pair = pairs.take(slot)
            if bit is None:
                np.take(_STRETCH, pair, out=x[k], mode="clip")
                np.copyto(longest, k, where=_SEEN[pair])
                continue
            n0 = np.maximum(_LEVELS[pair >> 8] - ~bit, 0)
            n1 = np.maximum(_LEVELS[pair & 255] - bit, 0)
            x[k] = np.log((n1 + np.float32(0.2)) / (n0 + np.float32(0.2)))
            np.copyto(longest, k, where=n0 + n1 > 1)
        return x, longest

    def mix(self, x, gate):
        w = np.ascontiguousarray(self.weights.T)
        z = w[0].take(gate) * x[0]
        for k in range(1, ORDERS):
            z += w[k].take(gate) * x[k]
        return np.clip(z, -12, 12, out=z)

    def final(self, z, gate):
        """Mean of the mixed probability and what the map says of it in this gate."""
        p = 1 / (1 + np.exp(-z)).astype(float)
        if self.refine is not None:
            at = (z + np.float32(12)) * np.float32((BUCKETS - 1) / 24)
            low = np.minimum(at.astype(np.int64), BUCKETS - 2)
            at -= low
            low += gate * BUCKETS
            told = self.refine.ravel()
            under = told.take(low)
            low += 1
            p += under + (told.take(low) - under) * at
            p /= 2
        return np.clip(p, 1e-6, 1 - 1e-6, out=p)

    def gate(self, longest, place, j):
        return (longest * 5 + _PLACE[place]) * 4 + j // 2

    def spell(self, before, byte, place) -> np.ndarray:
        """Natural logarithm of the probability of each byte."""
        contexts, bases = [_hash(before, k) for k in range(ORDERS)], {}
        out = np.ones(len(byte))
        for node, bit, j in _bits(byte):
            x, longest = self.inputs(_slots(contexts, node, bases))
            gate = self.gate(longest, place, j)
            p = self.final(self.mix(x, gate), gate)
            out *= np.where(bit, p, 1 - p)
        return np.log(out).astype(np.float32)

    def logs(self, s: Spelled) -> np.ndarray:
        """The same for all positions of ``s``: alike ones are spelled once and remembered."""
        if self.memory is None:
            self.memory = np.zeros(1 << MEMORY_BITS, np.uint64), np.zeros(1 << MEMORY_BITS, np.float32)
        keys, values = self.memory
        key = _key(s.code(), s.before[1])
        slot = (key >> np.uint64(64 - MEMORY_BITS)).view(np.int64)
        out = values[slot]
        new = np.flatnonzero(keys[slot] != key)
        same = _alike(key[new])
        lead = np.flatnonzero(same == np.arange(len(new)))
        at, found = new[lead], np.empty(len(new), np.float32)
        for i in range(0, len(at), 4 * BATCH):
            part = at[i : i + 4 * BATCH]
            found[lead[i : i + 4 * BATCH]] = self.spell(s.before[:, part], s.byte[part], s.place[part])
        out[new] = found[same]
        keys[slot[at]], values[slot[at]] = key[at], found[lead]
        return out


def _learn(shared):
    """Online pass of one task: weights by gradient steps, and what the map should have said."""

    def run(batches):
        mixer = Mixer(shared)
        weights = mixer.weights
        seen, ones = np.zeros(GATES * BUCKETS), np.zeros(GATES * BUCKETS)
        size, total = np.zeros((GATES, ORDERS)), 0.0
        for before, byte, place, count, _ in (part for batch in batches for part in _in_parts(*_unpacked(batch), BATCH)):
            total += count.sum()
            contexts, bases = [_hash(before, k) for k in range(ORDERS)], {}
            for node, bit, j in _bits(byte):
                x, longest = mixer.inputs(_slots(contexts, node, bases), bit)
                gate = mixer.gate(longest, place, j)
                z = mixer.mix(x, gate)
                near = gate * BUCKETS + np.rint((z + 12) * ((BUCKETS - 1) / 24)).astype(np.int64)
                seen += np.bincount(near, count, len(seen))
                ones += np.bincount(near, count * bit, len(ones))
                error = (bit - 1 / (1 + np.exp(-z))) * count
                n = np.maximum(np.bincount(gate, count, GATES), 1)
                for k in range(ORDERS):
                    slope = np.bincount(gate, error * x[k], GATES) / n
                    size[:, k] += slope * slope
                    weights[:, k] += RATE * slope / np.sqrt(size[:, k] + 1e-9)
        if total:
            rows = [("w", i, float(v) * total, float(total)) for i, v in enumerate(weights.ravel())]
            rows += [("m", int(i), float(ones[i]), float(seen[i])) for i in np.flatnonzero(seen)]
            kind, i, a, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array(i, pa.int32()), pa.array(a), pa.array(n)], names=["kind", "i", "a", "n"])

    return run


def bit_counts(positions: DataFrame) -> np.ndarray:
    """Levels of zeros and ones after every hashed context, paired: ``SLOTS`` numbers."""
    pairs = np.zeros(SLOTS, np.uint16)
    found = positions.mapInArrow(_bit_counts, COUNTS).groupBy("chunk").applyInArrow(_summed, COUNTS)
    for chunk, slot, *sides in zip(*found.toArrow().columns, strict=True):
        at = chunk.as_py() * _CHUNK + np.frombuffer(slot.as_py(), np.uint16).astype(np.int64)
        zeros, ones = (np.frombuffer(x.as_py(), np.uint8).astype(np.uint16) for x in sides)
        pairs[at] = zeros << np.uint16(8) | ones
    return pairs


def fit(train: DataFrame) -> Mixer:
    """The model of the running bytes of all training texts (columns ``doc_id``, ``text``)."""
    positions = alike(train)
    # Most slots of a small corpus are empty; every executor keeps the broadcast on its disk.
    shared = train.sparkSession.sparkContext.broadcast(pa.Codec("zstd").compress(bit_counts(positions).tobytes(), asbytes=True))
    learned = positions.mapInArrow(lambda b: _learn(shared)(b), "kind string, i int, a double, n double").groupBy("kind", "i").agg(
        F.sum("a").alias("a"), F.sum("n").alias("n")).toArrow().to_pandas()
    mixer = Mixer(shared)
    w, m = learned[learned["kind"] == "w"], learned[learned["kind"] == "m"]
    mixer.weights = mixer.weights.copy()
    mixer.weights.ravel()[w["i"]] = (w["a"] / w["n"]).astype(np.float32)
    centre = 1 / (1 + np.exp(-np.linspace(-12, 12, BUCKETS)))
    ones, seen = 8 * np.tile(centre, GATES), np.full(GATES * BUCKETS, 8.0)
    ones[m["i"]] += m["a"]
    seen[m["i"]] += m["n"]
    mixer.refine = (ones / seen).reshape(GATES, BUCKETS)
    return mixer


# --- scores ------------------------------------------------------------------------------------

SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
          " base_score double, score double")


def text_scores(logs: np.ndarray, ids: np.ndarray, tokens: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """log10 probability of texts: the mean of the experts' products.

    ``logs``: natural logarithm of each token's probability by the mixed bits; ``ids``: its word;
    ``tokens``: tokens per text; ``counted``: each token's probability by the word counts alone.
    """
    start = np.cumsum(tokens) - tokens
    text = np.repeat(np.arange(len(tokens)), tokens)
    place = np.arange(len(ids)) - start[text]
    same = text * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(same, kind="stable")
    s = same[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(s)), bool), s[1:] != s[:-1])))
    before = np.empty(len(ids))
    before[order] = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    own = before / np.maximum(place, 1)
    new = own == 0  # words not used before, the first of a text among them
    sums = []
    for model in (logs, np.logaddexp(logs, counted) - np.log(2)):
        p = np.exp(model)
        for trust in OWN:
            # Nothing is known of a text's own words at its first; a long word's p may be too small for a number.
            mixed = np.where(new, model + np.log1p(-trust) * (place > 0), np.log((1 - trust) * p + trust * own + 1e-300)) if trust else model
            sums.append(np.add.reduceat(mixed, start))
    sums = np.array(sums)
    top = sums.max(axis=0)
    return (top + np.log(np.exp(sums - top).mean(axis=0))) / np.log(10)


def _score_block(shared):
    arrow = to_arrow_schema(_parse_datatype_string(SCORES))

    def run(key, texts, words):
        mixer, train, kinds = shared.value
        idx = words.column("idx").to_numpy()
        c = np.zeros(len(idx))
        c[idx] = words.column("c").to_numpy()
        names = [b""] * len(idx)
        for i, w in zip(idx.tolist(), words.column("word").cast(pa.binary()).to_pylist(), strict=True):
            names[i] = w
        raw = np.frombuffer(b"".join(w + b" " for w in names), np.uint8)
        long = np.fromiter(map(len, names), np.int64, len(names)) + 1
        at = np.cumsum(long) - long
        base = np.log10((c + ALPHA) / (train + ALPHA * (kinds + 1)))
        columns = [[], [], [], []]

        def taken(part):
            ids, tokens = np.concatenate(part).astype(np.int64), np.array([len(x) for x in part])
            start, size = np.cumsum(tokens) - tokens, long[ids]
            word = np.cumsum(size) - size
            flat = raw[np.repeat(at[ids] - word, size) + np.arange(size.sum())]
            logs = np.add.reduceat(mixer.logs(Spelled.of(flat, np.add.reduceat(size, start))).astype(float), word)
            counted = np.log(np.maximum(c[ids] - DISCOUNT, 0) / train + DISCOUNT * kinds / train * np.exp(logs) + 1e-300) if train else logs
            for out, x in zip(columns, (tokens, np.add.reduceat((c[ids] > 0).astype(np.int64), start),
                                        np.add.reduceat(base[ids], start), text_scores(logs, ids, tokens, counted)), strict=True):
                out.append(x)

        part, size = [], 0
        for x in texts.column("ids"):
            ids = _unplane(x.as_py())
            part.append(ids)
            size += int(long[ids].sum())
            if size >= PIECE:
                taken(part)
                part, size = [], 0
        if part:
            taken(part)
        n, known, low, high = (np.concatenate([np.zeros(0), *x]) for x in columns)
        return pa.table([texts.column("doc_id"), texts.column("held_out"), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)),
                         pa.array(np.full(len(n), train, np.int64)), pa.array(low), pa.array(high)], schema=arrow)

    return run


def score(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    mixer = fit(docs.filter(fold("doc_id", FOLDS) != 0))
    table = blocks(docs, block_tokens)
    words = counted_words(table)
    n, v = words.filter("lead").agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    shared = docs.sparkSession.sparkContext.broadcast((mixer, int(n or 0), int(v or 0)))
    numbered = table.filter(F.col("words").isNull()).select("block", "doc_id", "held_out", "ids")
    told = words.select("word", "c", "block", "idx")
    return numbered.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score_block(shared), SCORES)


def op9_lm_scoring(spark, sf_dir) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
