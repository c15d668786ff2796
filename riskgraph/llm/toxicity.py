"""Toxicity by a learned lexicon, found also misspelled, weighed by its context.

* Lexicon: whole words and word beginnings that stand in labelled toxic documents far more often
  than in others (likelihood ratio above ``EVIDENCE``), with their log odds as weight.  Evidence alone
  decides; no count of terms is set, and the bounded sample bounds their number.
* Matching: the lexicon is a trie; Levenshtein automata of all its terms run on it at once.  States
  are sets of (trie node, edits), made and remembered when a text first needs them, so a word
  costs one table step per letter and most words die after a few.  Whole terms of 5 letters allow
  one edit, of 9 letters two; beginnings are met exactly.
* Context: around each hit a window of words is read.  Inside quotation marks, or after words that
  report speech, a hit counts ``QUOTED`` of its weight; further hits or an address to a person
  close by add to it.
* Score: a logistic model over the sums of one text, fitted on the labelled sample.

At most ``TRAIN_ROWS`` labelled rows are learned from, none of the held-out fold.

Edge cases: null and empty texts score as texts without hits; without labelled rows of both kinds
the lexicon is empty and every score is the share of toxic labels (0 if there are none); repeated
rows each get their score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import fold, per_row, read, texts, utf8
from riskgraph.llm.learn import FOLDS, chance, labelled_sample, logistic

TRAIN_ROWS = 12_000
EVIDENCE = 25.0
MIN_DOCS = 4
BEGINNINGS = (4, 5, 6)
NEAR = 8
QUOTED = 0.25
STATES = 50_000

_WORD = re.compile(r"\w+")
_QUOTES = "\"“”„«»‹›"
_REPORT = frozenset("said says say called calls wrote writes quote quoted quotes word term reads sagte nannte dit écrit dijo".split())
_ADDRESS = frozenset("you your youre du dich dein tu te tes toi vous votre usted tú".split())
N_FEATURES = 7


class Lexicon:
    """Trie of ``{term: weight}``; a term that ends in ``*`` is a beginning."""

    def __init__(self, weights: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[float, int] | None] = [None]
        self.begins: list[float | None] = [None]
        self.depth = [0]
        for term, weight in weights.items():
            node = 0
            for c in term.removesuffix("*"):
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                    self.begins.append(None)
                    self.depth.append(self.depth[node] + 1)
                node = self.next[node][c]
            if term.endswith("*"):
                self.begins[node] = weight
            else:
                n = len(term)
                self.ends[node] = (weight, 2 if n >= 9 else 1 if n >= 5 else 0)
        # The most edits any term below a node allows: paths beyond it are not followed.
        self.allow = [e[1] if e else -1 for e in self.ends]
        self.exact = [b is not None or e is not None for b, e in zip(self.begins, self.ends, strict=True)]
        for node in range(len(self.next) - 1, -1, -1):
            for child in self.next[node].values():
                self.allow[node] = max(self.allow[node], self.allow[child])
                self.exact[node] = self.exact[node] or self.exact[child]
        self._forget()

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.results: list[tuple[float, int] | None] = []
        self._state({(0, 0)}, None)

    def _state(self, nodes, begun) -> int:
        """Number of the state of these (node, edits), after skipped letters of terms; 0 is the start."""
        todo, best = list(nodes), {}
        while todo:
            node, edits = todo.pop()
            if best.get(node, 9) <= edits or not (edits <= self.allow[node] or edits == 0 and self.exact[node]):
                continue
            best[node] = edits
            if edits == 0 and self.begins[node] is not None and (begun is None or self.begins[node] > begun):
                begun = self.begins[node]
            todo += [(child, edits + 1) for child in self.next[node].values()]
        key = frozenset([*best.items(), ("begun", begun)])
        number = self.states.get(key)
        if number is None:
            number = self.states[key] = len(self.members)
            self.members.append(key)
            self.steps.append({})
            found = [(0, begun)] if begun is not None else []
            found += [(e, self.ends[n][0]) for n, e in best.items() if self.ends[n] and e <= self.ends[n][1]]
            low = min((e for e, _ in found), default=0)
            self.results.append((max(w for e, w in found if e == low), low) if found else None)
        return number

    def _step(self, state: int, c: str) -> int:
        """State after reading ``c``: -1 if nothing can match any more."""
        nodes, begun = [], None
        for node, edits in self.members[state]:
            if node == "begun":
                begun = edits
                continue
            nodes.append((node, edits + 1))  # an extra letter in the text
            for letter, child in self.next[node].items():
                nodes.append((child, edits + (letter != c)))
        number = self._state(nodes, begun)
        if len(self.members[number]) == 1 and begun is None:
            number = -1
        self.steps[state][c] = number
        return number

    def match(self, word: str) -> tuple[float, int] | None:
        """Weight and edits of the nearest term, the heaviest of equals; None if there is none."""
        if len(self.members) > STATES:
            self._forget()
        state = 0
        for c in word:
            after = self.steps[state].get(c)
            state = self._step(state, c) if after is None else after
            if state < 0:
                return None
        return self.results[state]


def hits(text: str, lexicon: Lexicon, memo: dict) -> np.ndarray:
    """Features of one text: sums over its hits by kind of context."""
    words = _WORD.findall(text.lower())
    out = np.zeros(N_FEATURES)
    found = []
    for i, w in enumerate(words):
        got = memo.get(w, 0)
        if got == 0:
            if len(memo) > 200_000:
                memo.clear()
            got = memo[w] = lexicon.match(w)
        if got:
            found.append((i, *got))
    if not found:
        return out
    quoted = _quoted(text) if any(q in text for q in _QUOTES) else ()
    at = [i for i, _, _ in found]
    for k, (i, weight, edits) in enumerate(found):
        near = words[max(0, i - NEAR) : i + NEAR + 1]
        said = (quoted and i in quoted) or not _REPORT.isdisjoint(words[max(0, i - NEAR) : i])
        part = weight * (QUOTED if said else 1.0) / (1 + edits)
        close = (k > 0 and i - at[k - 1] <= NEAR) or (k + 1 < len(at) and at[k + 1] - i <= NEAR)
        out[0 if edits == 0 else 1] += part
        out[2] += said
        out[3] += close and not said
        out[4] += not said and not _ADDRESS.isdisjoint(near)
        out[5] = max(out[5], part)
    out[6] = 100 * out[0] / len(words)
    return np.log1p(np.maximum(out, 0))


def _quoted(text: str) -> set[int]:
    """Numbers of the words between quotation marks of one line."""
    out, n = set(), 0
    for line in text.lower().split("\n"):
        parts = re.split(f"[{_QUOTES}]", line)
        for k, part in enumerate(parts):
            m = len(_WORD.findall(part))
            if k % 2 == 1 and k < len(parts) - 1:
                out.update(range(n, n + m))
            n += m
    return out


def _terms():
    def rows(batch):
        for text, y in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = set(_WORD.findall(text.decode().lower()))
            seen = Counter()
            for w in words:
                if w.isdigit():
                    continue
                seen[w] = 1
                for n in BEGINNINGS:
                    if len(w) > n:
                        seen[w[:n] + "*"] = 1
            yield list(seen), y

    return rows


def learn_lexicon(sample: DataFrame, evidence: float = EVIDENCE) -> dict[str, float]:
    """Terms of toxic documents with their log odds, by document counts over the sample."""
    toxic, n = (v or 0 for v in sample.agg(F.sum("y"), F.count(F.lit(1))).first())
    if not toxic or toxic == n:
        return {}
    counts = per_row(sample.select("doc_id", "text", "y"), "terms array<string>, y int", _terms).select(
        F.explode("terms").alias("term"), "y").groupBy("term").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
    rate = toxic / n
    p = F.col("a") / F.col("n")
    # G statistic of the term's toxic share against the share of all documents.
    g = 2 * (F.col("a") * F.log(p / rate) + F.when(p < 1, (F.col("n") - F.col("a")) * F.log((1 - p) / (1 - rate))).otherwise(0.0))
    kept = counts.filter((F.col("a") >= MIN_DOCS) & (p > 3 * rate) & (p > 0.4)).withColumn("g", g).filter(
        F.col("g") >= evidence).orderBy("term").collect()
    return {r["term"]: math.log((r["a"] + 0.5) / (r["n"] - r["a"] + 0.5)) + math.log((1 - rate) / rate) for r in kept}


def _features(weights):
    lexicon, memo = Lexicon(weights), {}

    def rows(batch):
        for d, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            yield d, hits(text.decode(), lexicon, memo).tolist()

    return rows


def _scores(shared):
    weights, model = shared.value
    features = _features(weights)

    def rows(batch):
        for d, x in features(batch):
            yield d, float(chance(np.array(x), model))

    return rows


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS):
    """Lexicon and logistic weights."""
    sample = labelled_sample(docs, labels, "toxic", train_rows)
    weights = learn_lexicon(sample)
    rows = per_row(sample.select("doc_id", "text", "y"), "y int, x array<double>", _labelled, weights).toArrow().to_pandas()
    if not len(rows) or rows["y"].nunique() < 2:
        rate = float(rows["y"].mean()) if len(rows) else 0.0
        return {}, np.array([0.0] * N_FEATURES + [30.0 if rate >= 1 else -30.0])
    return weights, logistic(np.array(rows["x"].tolist()), rows["y"].to_numpy(float), ridge=0.1)


def _labelled(weights):
    features = _features(weights)

    def rows(batch):
        for (_, x), y in zip(features(batch), batch.column(2).to_pylist(), strict=True):
            yield y, x

    return rows


def score(docs: DataFrame, model) -> DataFrame:
    """``doc_id, score``; the model (a bounded lexicon and a few numbers) goes to every task."""
    return per_row(texts(docs), "doc_id long, score double", _scores, docs.sparkSession.sparkContext.broadcast(model))


def op6_toxicity(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
