import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskgraph.llm import phrases as ph
from riskgraph.llm.common import read


def plain(docs, least=100, longest=5, top=2000, cover=100):
    """The contract in loops: rows of ``[(lang, text)]``."""
    counts, total = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for size in range(1, longest + 1):
                f.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        many = {g: n for g, n in f.items() if n >= least and len(g) > 1}
        hidden = {g[i : i + k] for g, n in many.items() for k in range(2, len(g)) for i in range(len(g) - k + 1)
                  if 100 * n >= cover * f[g[i : i + k]]}
        rows = []
        for g, a in many.items():
            if g not in hidden:
                cuts = [(1000 * a * total[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, total[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def run(docs, **args):
    top = {k: args.pop(k) for k in ("top", "cover") if k in args}
    return sorted(tuple(r) for r in ph.ranked(*ph.counted(docs, **args), **top).collect())


def frame(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string")
    return df.select("*", *[F.lit(1).alias(c) for c in ("gram", "n", "size", "total", "rank", "_l", "doc_id")])


def test_whole_table_equals_loops(spark, sf):
    docs = read(spark, sf, "documents")
    got = sorted(tuple(r) for r in ph.op12_phrases(spark, sf).collect())
    assert got == plain([tuple(r) for r in docs.select("lang", "text").collect()])
    assert len(got) > 30


def made(seed, n, vocabulary, length):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["The", "É", "été", "x\x1cy", "😀"]
    whole = " ".join(draw.choices(words, k=30))
    out = []
    for _ in range(n):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", "  ", ". ", "\n", " , ", "\x0b", " ;"]) for _ in range(draw.randint(0, length)))
        out.append((draw.choice(["en", "en", "de", None, "und"]), text + (whole if draw.random() < 0.5 else "")))
    return out


@pytest.mark.parametrize("longest", [2, 3, 4, 5, 6])
@pytest.mark.parametrize("seed,vocabulary", [(1, 4), (2, 60)])
def test_made_texts(spark, seed, vocabulary, longest):
    rows = made(seed, 80, vocabulary, 60) + [("en", None), (None, ""), ("en", "a a a a a a a a a a a a"), ("en", " \t. ,"), ("fr", None)] * 3
    rows += [("en", "p q r s t u v p q r s t u v p q r s t u v p q r s")] * 7
    assert run(frame(spark, rows), least=5, longest=longest) == plain(rows, 5, longest)


@pytest.mark.parametrize("bits", [4, 8, 20])
def test_counts_do_not_depend_on_the_buckets(spark, bits):
    rows = made(3, 60, 300, 80)
    assert run(frame(spark, rows), least=4, bits=bits) == plain(rows, 4)


def test_blocks_partitions_and_stretches_do_not_show(spark, monkeypatch):
    monkeypatch.setattr(ph, "TOKENS", 50)
    monkeypatch.setattr(ph, "STRETCH", 7)
    monkeypatch.setattr(ph, "HELD", 40)
    rows = made(4, 60, 5, 90)
    for n in (1, 5):
        assert run(frame(spark, rows).repartition(n), least=6, top=9, cover=80) == plain(rows, 6, 5, 9, 80)


def test_rows_sent_follow_the_cores_and_not_the_splits(spark, monkeypatch):
    rows, parts, real = made(5, 90, 20, 60), [], ph.graph

    def graph(docs, *args):
        parts.append(docs.rdd.getNumPartitions())
        return real(docs, *args)

    monkeypatch.setattr(ph, "graph", graph)
    assert run(frame(spark, rows).repartition(60), least=5) == plain(rows, 5)
    assert parts == [ph.WAVES * spark.sparkContext.defaultParallelism]


def test_large_counts_have_exact_scores(spark):
    phrases = spark.createDataFrame([("en", 1, "a", 10**15), ("en", 1, "b", 10**15 + 1), ("en", 2, "a b", 10**15 - 7)], "lang string, size int, gram string, n long")
    totals = spark.createDataFrame([("en", 9 * 10**15)], "lang string, total long")
    (row,) = ph.ranked(phrases, totals).collect()
    assert row.score == 1000 * (10**15 - 7) * 9 * 10**15 // (10**15 * (10**15 + 1))


def test_a_passage_becomes_one_path(spark):
    words = [f"w{i}" for i in range(40)]
    edges = [("en", " ".join(words[i : i + 5]), 9) for i in range(36)] + [("de", " ".join(words[:5]), 9)]
    none = spark.createDataFrame([], "lang string, gram string")
    got = ph.compact(spark.createDataFrame(edges, "lang string, gram string, n long"), none, 5).collect()
    assert sorted((r.lang, r.path, r.edges) for r in got) == [("de", " ".join(words[:5]), 1), ("en", " ".join(words), 36)]


def test_long_text_and_empty_table(spark, odd, empty, given):
    given(ph, documents=odd)
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert sorted(tuple(r) for r in ph.op12_phrases(spark, "").collect()) == plain(rows)
    assert run(odd, least=10) == plain(rows, 10)
    given(ph, documents=empty)
    assert ph.op12_phrases(spark, "").collect() == []
