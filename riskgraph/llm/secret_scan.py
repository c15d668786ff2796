"""Secret scans with a trigram inverted index.

1. Every rule's regular expression is turned into a Boolean query of trigrams that each match must
   contain (:func:`query_of`).  Rules in which no trigram is mandatory have the query ``True``.
2. A task cuts its rows into shards of bounded size and builds, per shard, the inverted index of
   the trigrams that any query asks for: one vector pass over the bytes of the shard yields
   sorted postings (trigram -> rows).
3. The query of a rule is answered by intersecting and uniting postings; only candidate rows are
   verified with the regular expression.  Rules without mandatory trigrams verify every row.

The index lives as long as its shard: there is no shuffle, no broadcast and no state between rows,
so a lost executor costs the repetition of its tasks only.

Edge cases: a null text is empty and has no spans; texts of any length are scanned whole; repeated
rows each get their result; extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import per_row, read, texts, utf8

SHARD_BYTES = 4 << 20
#: More literal strings than this are not spelled out; the query then asks for less.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``pattern``; a match counts if the group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed values of the contract.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Further well-known token formats.  Each takes time in proportion to the text: ``jwt`` starts only where
#: a run of its letters does, and a scheme has at most 32 characters (of a longer run the last ones).
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google_api", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"(?i:authorization:\x20*bearer\x20+)[A-Za-z0-9._~+/-]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{0,31}://[^\s/:@]{1,256}:[^\s/:@]{1,256}@", 0, 8),
)
RULES = BASE + MORE


# --- Boolean trigram queries -------------------------------------------------------------------
# A query is True (no condition), a trigram (bytes), ("and", parts) or ("or", parts).


def _join(kind: str, parts):
    """Conjunction or disjunction with True simplified away."""
    flat = []
    for p in parts:
        if p is True:
            if kind == "or":
                return True
            continue
        flat += p[1] if isinstance(p, tuple) and p[0] == kind else [p]
    flat = list(dict.fromkeys(flat))
    return True if not flat else flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _trigrams(strings):
    """Query for "contains one of ``strings``"."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


@dataclass
class _Part:
    """What is known of the texts a part of a pattern matches.

    ``exact``: all texts, if few; otherwise ``heads`` and ``tails`` hold possible first and last
    bytes (the empty one: anything) and ``query`` a condition that every text meets.
    """

    exact: frozenset[bytes] | None
    heads: frozenset[bytes]
    tails: frozenset[bytes]
    query: object


_ANY = _Part(None, frozenset([b""]), frozenset([b""]), True)


def _strings(strings) -> _Part:
    s = frozenset(strings)
    return _Part(s, s, s, True)


def _loose(p: _Part) -> _Part:
    if p.exact is None:
        return p
    return _Part(None, p.exact, p.exact, _join("and", [p.query, _trigrams(p.exact)]))


def _short(strings, head: bool):
    cut = frozenset(s[:3] if head else s[-3:] for s in strings)
    return cut if len(cut) <= MAX_STRINGS else frozenset([b""])


def _then(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MAX_STRINGS:
        return _strings(x + y for x in a.exact for y in b.exact)
    query = [_loose(a).query, _loose(b).query]
    if len(a.tails) * len(b.heads) <= MAX_STRINGS:
        query.append(_trigrams(x[-2:] + y[:2] for x in a.tails for y in b.heads))
    heads = a.heads if a.exact is None else [x + y for x in a.exact for y in b.heads]
    tails = b.tails if b.exact is None else [x + y for x in a.tails for y in b.exact]
    return _Part(None, _short(heads, True), _short(tails, False), _join("and", query))


def _either(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts):
        union = frozenset().union(*(p.exact for p in parts))
        if len(union) <= MAX_STRINGS:
            return _strings(union)
    parts = [_loose(p) for p in parts]
    return _Part(
        None, _short(frozenset().union(*(p.heads for p in parts)), True),
        _short(frozenset().union(*(p.tails for p in parts)), False), _join("or", [p.query for p in parts]))


def _char(code: int) -> bytes:
    return chr(code).encode().lower()


def _class(items) -> _Part:
    chars: set[bytes] = set()
    for op, value in items:
        if op is C.LITERAL:
            chars.add(_char(value))
        elif op is C.RANGE and value[1] - value[0] < MAX_STRINGS:
            chars |= {_char(c) for c in range(value[0], value[1] + 1)}
        else:
            return _ANY
    return _strings(chars) if len(chars) <= 8 else _ANY


def _analyse(tree) -> _Part:
    whole = _strings([b""])
    for op, value in tree:
        if op is C.LITERAL:
            part = _strings([_char(value)])
        elif op is C.IN:
            part = _class(value)
        elif op is C.SUBPATTERN:
            part = _analyse(value[3])
        elif op is C.BRANCH:
            part = _either([_analyse(t) for t in value[1]])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = value
            inner = _analyse(body)
            if low == 0 and high == 1:
                part = _either([_strings([b""]), inner])
            elif low == 0:
                part = _ANY
            elif low == high == 1:
                part = inner
            else:
                loose = _loose(inner)
                part = _Part(None, loose.heads, loose.tails, loose.query)
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            part = _strings([b""])
        else:
            part = _ANY
        whole = _then(whole, part)
    return whole


def query_of(pattern: str):
    """Boolean trigram query over lower-case (A-Z) text that each match of ``pattern`` meets."""
    return _loose(_analyse(parser.parse(pattern))).query


def trigrams_of(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(trigrams_of(q) for q in query[1]))


# --- index and search --------------------------------------------------------------------------


class ShardIndex:
    """Postings of the wanted trigrams over the texts of one shard."""

    def __init__(self, shard: list[bytes], wanted: dict[bytes, int], table: np.ndarray):
        ends = np.cumsum([len(t) + 1 for t in shard])
        raw = np.frombuffer(b"\n".join(shard).lower() + b"\n", np.uint8)
        code = raw[:-2].astype(np.int32) << 16
        code |= raw[1:-1].astype(np.int32) << 8
        code |= raw[2:]
        number = table[code]
        at = np.flatnonzero(number)
        row = np.searchsorted(ends, at, side="right")
        pairs = np.unique(number[at].astype(np.int64) * len(shard) + row)
        numbers, rows = pairs // len(shard), pairs % len(shard)
        cuts = np.searchsorted(numbers, np.arange(len(wanted) + 2))
        self.rows = np.arange(len(shard))
        self.postings = {t: rows[cuts[k] : cuts[k + 1]] for t, k in wanted.items()}

    def search(self, query) -> np.ndarray:
        """Sorted rows that meet a query."""
        if query is True:
            return self.rows
        if isinstance(query, bytes):
            return self.postings[query]
        found = sorted((self.search(q) for q in query[1]), key=len)
        out = found[0]
        for other in found[1:]:
            if query[0] == "or":
                out = np.union1d(out, other)
            elif len(out):
                out = np.intersect1d(out, other, assume_unique=True)
        return out


class Scanner:
    def __init__(self, rules):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), query_of(r.pattern)) for r in rules]
        wanted = sorted(set().union(*(trigrams_of(q) for _, _, q in self.rules)))
        self.wanted = {t: k + 1 for k, t in enumerate(wanted)}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, k in self.wanted.items():
            self.table[int.from_bytes(t, "big")] = k

    def scan(self, shard: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Per text the spans (start, rule number, end) in code points, sorted."""
        out: list[list] = [[] for _ in shard]
        if sum(map(len, shard)) < 1:
            return out
        index = ShardIndex(shard, self.wanted, self.table)
        full = [k for k, r in enumerate(self.rules) if r[2] is True]
        candidates: dict[int, list[int]] = {}
        for k, (_, _, query) in enumerate(self.rules):
            if query is not True:
                for row in index.search(query).tolist():
                    candidates.setdefault(row, []).append(k)
        for row, raw in enumerate(shard):
            todo = full + candidates.get(row, [])
            if raw and todo:
                text = raw.decode()
                for k in todo:
                    rule, regex, _ = self.rules[k]
                    for m in regex.finditer(text):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            out[row].append((m.start(), k, m.end()))
                out[row].sort()
        return out


def shards(sizes, most: int = SHARD_BYTES):
    """(from, to) of consecutive rows with about ``most`` bytes; a longer text is a shard alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def _scan(rules, shard_bytes):
    scanner = Scanner(rules)

    def rows(batch):
        ids = batch.column(0).to_pylist()
        raw = list(utf8(batch.column(1)))
        for a, b in shards([len(t) for t in raw], shard_bytes):
            for d, spans in zip(ids[a:b], scanner.scan(raw[a:b]), strict=True):
                yield d, [{"kind": rules[k].kind, "start": s, "end": e, "rule": k} for s, k, e in spans]

    return rows


def scan(docs: DataFrame, rules=RULES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: ``doc_id, found`` with kind, start, end (code points) of each secret."""
    return per_row(
        texts(docs), "doc_id long, found array<struct<kind: string, start: int, end: int, rule: int>>", _scan,
        tuple(rules), shard_bytes)


def redact(docs: DataFrame, rules=RULES, mask: str = "[SECRET]") -> DataFrame:
    """``doc_id, text`` with every span replaced by ``mask``; overlapping spans become one."""

    def setup(rules, mask):
        scanner = Scanner(rules)

        def rows(batch):
            ids, raw = batch.column(0).to_pylist(), list(utf8(batch.column(1)))
            for a, b in shards([len(t) for t in raw]):
                for d, t, spans in zip(ids[a:b], raw[a:b], scanner.scan(raw[a:b]), strict=True):
                    text, keep, last = t.decode(), [], 0
                    for s, _, e in spans:
                        if s >= last:
                            keep += [text[last:s], mask]
                        last = max(last, e)
                    yield d, "".join([*keep, text[last:]])

        return rows

    return per_row(texts(docs), "doc_id long, text string", setup, tuple(rules), mask)


def op1_secret_scan(spark, sf_dir) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["rule"] < len(BASE))

    def spans(xs):
        return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(spans(base), 256).alias("base_sha256"), spans("found").alias("spans"))
