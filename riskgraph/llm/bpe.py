"""BPE encoding and decoding of whole texts by batched numpy merge rounds.

1. A map splits each text at ASCII white space into chunks.  Chunks that the worker has not met are
   normalised and split into words: ASCII ones by a pattern here, others by the normaliser and
   pre-tokeniser of the vocabulary file, special tokens before that, as raw text.
2. New words of a whole group of texts are merged together.  Their symbols lie in one flat array.  A
   round looks all neighbouring pairs up by binary search in the sorted pair keys, takes each
   word's lowest rank, merges that pair wherever it stands in the word, and closes the gaps; words
   without a pair leave the array (:meth:`Merges.short`).
3. A word beyond ``LONG`` symbols is merged in rounds over ranks instead: positions wait under the
   rank of their pair, a round takes all positions of the lowest rank, and only the new neighbours
   are looked up again, so a run of a million letters needs no pass over all of it per merge.
4. What is known of chunks and words is kept within ``CACHE`` bytes per worker and then forgotten.

Taking all places of the lowest rank at once gives what one merge at a time gives as long as no
pair with a merged symbol ranks before the merge that makes it.  The table is checked for that when
it is loaded (``ordered``); if it does not hold, a round merges only the leftmost place.

Texts are taken in groups of about ``GROUP`` bytes and results are sent in batches of that size, so
memory follows the longest text, not the number of rows.  There is no shuffle.

Edge cases: a null or empty text has no ids and decodes to the empty text; null ids of documents
stay null; repeated rows and ties are encoded alike, row for row; an empty table gives no rows; other
columns are not read, whatever their names; ids outside the vocabulary are left out of a decoded
text, as the tokenizers library does; null ids decode to the empty text.
"""

from __future__ import annotations

import heapq
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import read, texts, utf8

LONG = 128
CACHE = 112 << 20
GROUP = 4 << 20
#: What a cached entry takes besides its bytes.
ENTRY = 200

_NONE = np.iinfo(np.int64).max
#: The pre-tokeniser's pattern on lower-case ASCII without white space.
_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_signs() -> list[str]:
    """The byte-level alphabet: visible bytes of Latin-1 stand for themselves, the others are
    numbered from 256 in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def tokens_of(path: str) -> list[bytes | None]:
    """The token of every id, special ones too."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    named = [*((i, t) for t, i in spec["model"]["vocab"].items()), *((t["id"], t["content"]) for t in spec["added_tokens"])]
    out: list[bytes | None] = [None] * (1 + max(i for i, _ in named))
    for i, token in named:
        out[i] = token.encode()
    return out


class Merges:
    """The merge table of a vocabulary file as sorted pair keys, and the rounds over it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        end = model.get("end_of_word_suffix") or ""
        signs = byte_signs()
        self.byte = np.array([vocab[s] for s in signs], np.int64)
        self.last = np.array([vocab[s + end] for s in signs], np.int64)
        self.size = 1 + max([*vocab.values(), *special.values()])

        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([a * self.size + b for a, b in rank], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank = np.array(list(rank.values()), np.int64)[order]
        first = np.full(self.size, _NONE)
        left, right = np.divmod(self.keys, self.size)
        np.minimum.at(first, left, self.rank)
        np.minimum.at(first, right, self.rank)
        self.ordered = bool((first[self.into[self.rank]] > self.rank).all())

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``_NONE`` for pairs that never merge."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def symbols(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = self.byte[flat]
        out[ends - 1] = self.last[flat[ends - 1]]
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Little-endian ids of each word (none empty)."""
        out: list[bytes] = [b""] * len(words)
        short, held = [], 0
        for i, w in enumerate(words):
            if len(w) > LONG:
                sym = self.symbols(np.frombuffer(w, np.uint8), np.array([len(w)]))
                out[i] = self.long(sym).astype("<u4").tobytes()
                continue
            short.append(i)
            held += len(w)
            if held > GROUP // 4:
                self._short_into(out, words, short)
                short, held = [], 0
        if short:
            self._short_into(out, words, short)
        return out

    def _short_into(self, out: list[bytes], words: list[bytes], which: list[int]) -> None:
        ids, ends = self.short([words[i] for i in which])
        raw, start = ids.astype("<u4").tobytes(), 0
        for i, stop in zip(which, (ends * 4).tolist(), strict=True):
            out[i] = raw[start:stop]
            start = stop

    def short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words in one flat array, and where each word ends in it."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.symbols(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size))
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        while len(sym):
            rank = np.full(len(sym), _NONE)
            same = np.flatnonzero(word[1:] == word[:-1])
            rank[same] = self.lookup(sym[same], sym[same + 1])
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            length = np.diff(np.append(starts, len(sym)))
            best = np.repeat(np.minimum.reduceat(rank, starts), length)
            active = best < _NONE
            if not active.all():
                done_sym.append(sym[~active])
                done_word.append(word[~active])
                sym, word, rank, best = sym[active], word[active], rank[active], best[active]
            at = np.flatnonzero(rank == best)
            if not len(at):
                break
            if self.ordered:
                at = _apart(at, np.concatenate(([False], at[1:] == at[:-1] + 1)))
            else:
                at = at[np.concatenate(([True], word[at[1:]] != word[at[:-1]]))]
            sym[at] = self.into[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.cumsum(np.bincount(word, minlength=len(words)))

    def long(self, sym: np.ndarray) -> np.ndarray:
        """Ids of one word by rounds over ranks; positions form a linked list."""
        sym, n = sym.copy(), len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n)
        rank, alive = np.full(n + 1, _NONE), np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(at: np.ndarray) -> None:
            r = rank[at]
            at, r = at[r < _NONE], r[r < _NONE]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else r
            for value, part in zip(r[cuts].tolist(), np.split(at, cuts[1:]), strict=False):
                if value not in waiting:
                    waiting[value] = []
                    heapq.heappush(queue, value)
                waiting[value].append(part)

        rank[: n - 1] = self.lookup(sym[:-1], sym[1:])
        wait(np.arange(n - 1))
        while queue:
            value = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(value)))
            at = at[rank[at] == value]
            if not len(at):
                continue
            if self.ordered:
                at = _apart(at, np.concatenate(([False], after[at[:-1]] == at[1:])))
            else:
                at, rest = at[:1], at[1:]
            gone = after[at]
            follow = after[gone]
            sym[at] = self.into[value]
            rank[gone], alive[gone] = _NONE, False
            after[at] = follow
            before[follow] = at
            changed = np.concatenate((at, before[at]))
            changed = np.unique(changed[changed >= 0])
            follow = after[changed]
            inner = follow < n
            rank[changed] = _NONE
            rank[changed[inner]] = self.lookup(sym[changed[inner]], sym[follow[inner]])
            wait(changed)
            if not self.ordered:
                wait(rest)
        return sym[alive]


def _apart(at: np.ndarray, touches: np.ndarray) -> np.ndarray:
    """Of neighbouring places that overlap, every other one, from the left."""
    if not touches.any():
        return at
    place = np.arange(len(at))
    start = np.maximum.accumulate(np.where(touches, 0, place))
    return at[(place - start) % 2 == 0]


class Encoder:
    """Ids of texts; chunks and words already met are looked up."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        tokenizer = Tokenizer.from_file(path)
        self.normal = tokenizer.normalizer.normalize_str if tokenizer.normalizer else lambda s: s
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in tokenizer.get_added_tokens_decoder().items()}
        longest = sorted((re.escape(t.encode()) for t in self.special), key=len, reverse=True)
        self.specials = re.compile(b"(" + b"|".join(longest) + b")") if longest else None
        self.value = {ord(s): b for b, s in enumerate(byte_signs())}
        self.forget()

    def forget(self) -> None:
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[bytes | str, bytes] = dict(self.special)
        self.held = 0

    def parts(self, chunk: bytes) -> list[bytes | str]:
        """Words of a chunk; special tokens are told from words by being str."""
        if self.specials and b"<" in chunk and self.specials.search(chunk):
            between = self.specials.split(chunk)
            return [p for k, part in enumerate(between) for p in ((part.decode(),) if k % 2 else self.parts(part))]
        if chunk.isascii():
            return _ASCII.findall(chunk.lower())
        return [word.translate(self.value).encode("latin-1") for word, _ in self.split(self.normal(chunk.decode()))]

    def learn(self, chunks: set[bytes]) -> None:
        """Adds the ids of new chunks; words they share are merged once."""
        cut = {chunk: self.parts(chunk) for chunk in chunks}
        words = list(set().union(*cut.values()).difference(self.words))
        ids = self.merges.merge(words)
        self.words.update(zip(words, ids, strict=True))
        known = self.words.__getitem__
        got = {c: known(p[0]) if len(p) == 1 else b"".join(map(known, p)) for c, p in cut.items()}
        self.chunks.update(got)
        for a, b in ((words, ids), (got.keys(), got.values())):
            self.held += sum(map(len, a)) + sum(map(len, b)) + ENTRY * len(a)

    def encode(self, group: list[bytes]) -> list[bytes]:
        """Little-endian ids of each text of a group."""
        if self.held > CACHE:
            self.forget()
        split = [t.split() for t in group]
        new = set().union(*split).difference(self.chunks)
        if new:
            self.learn(new)
        known = self.chunks.__getitem__
        return [b"".join(map(known, s)) for s in split]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _grouped(batch: pa.RecordBatch, column: str):
    """Slices ``(first row, bytes of the rows)`` of about ``GROUP`` bytes."""
    first, held, group = 0, 0, []
    for value in utf8(batch.column(column)):
        group.append(value)
        held += len(value)
        if held > GROUP:
            yield first, group
            first, held, group = first + len(group), 0, []
    if group:
        yield first, group


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids``: the ids as little-endian unsigned 32-bit integers."""
    path = path or default_path()
    docs = texts(docs)

    def run(batches):
        own = encoder(path)
        for batch in batches:
            for first, group in _grouped(batch, "text"):
                ids = own.encode(group)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, len(group)),
                    pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()),
                ], names=["doc_id", "n_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of :func:`encode` with ``decoded``: their tokens, as the file has no decoder joined by spaces."""
    path = path or default_path()
    encoded = encoded.select("doc_id", "n_tokens", "ids")

    def run(batches):
        tokens = tokens_of(path)
        for batch in batches:
            for first, group in _grouped(batch, "ids"):
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, len(group)) for c in batch.columns), pa.array([_joined(g, tokens) for g in group], pa.binary()).cast(pa.string())],
                    names=[*batch.schema.names, "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def _joined(ids: bytes, tokens: list[bytes | None]) -> bytes:
    got = np.frombuffer(ids, "<u4").tolist()
    try:
        return b" ".join(map(tokens.__getitem__, got))
    except (IndexError, TypeError):  # ids that the vocabulary lacks
        return b" ".join(t for t in (tokens[i] for i in got if i < len(tokens)) if t is not None)


def op13_bpe(spark, sf_dir) -> DataFrame:
    both = decode(encode(read(spark, sf_dir, "documents")))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
