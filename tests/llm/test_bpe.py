import hashlib
import random

import numpy as np
import pytest

from riskgraph.llm import bpe
from riskgraph.llm.common import read

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.default_path())


def raw(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_whole_table_equals_the_library(spark, sf, library):
    got = {r.doc_id: tuple(r)[1:] for r in bpe.op13_bpe(spark, sf).collect()}
    docs = read(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        assert got[d.doc_id] == expected(library, d.text)


def test_odd_rows(spark, odd, empty, given, library):
    given(bpe, documents=odd)
    rows = bpe.op13_bpe(spark, "").collect()
    texts = odd.select("doc_id", "text").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, *tuple(r)[1:]) for r in rows) == sorted(
        (t.doc_id is None, t.doc_id or 0, *expected(library, t.text)) for t in texts)
    given(bpe, documents=empty)
    assert bpe.op13_bpe(spark, "").collect() == []


PARTS = ["ab", "a", "the ing er", "éÉÀß", "H̱ẖİK", "ΣΑΣ σ", "ﬁǅ中文 日本", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|",
         "'s 't'll'D'RE", "\x1c\x85\xa0 　", "0123４٣²½", "!!??..", "́̀", "\U0001f600", "é", "aaaaaaa", "\x00\x01", "­​", "_"]


def test_random_texts(own, library):
    draw = random.Random(3)
    for _ in range(1500):
        text = "".join(draw.choice(PARTS) if draw.random() < 0.5 else draw.choice("".join(PARTS)) for _ in range(draw.choice([3, 10, 60])))
        assert own.encode([text.encode()])[0] == raw(library, text), repr(text)


@pytest.mark.parametrize("ordered", [True, False])
def test_both_kinds_of_rounds_agree(own, ordered, monkeypatch):
    draw = random.Random(5)
    words = [bytes(draw.choices(b"abcdefaae", k=draw.randint(1, 127))) for _ in range(300)] + [b"a" * n for n in range(1, 60)]
    want = own.merges.merge(words)
    monkeypatch.setattr(own.merges, "ordered", ordered)
    assert own.merges.merge(words) == want
    for w, ids in zip(words, want, strict=True):
        sym = own.merges.symbols(np.frombuffer(w, np.uint8), np.array([len(w)]))
        assert own.merges.long(sym).astype("<u4").tobytes() == ids


def test_long_words(own, library):
    draw = random.Random(7)
    for text in ("".join(draw.choices("etaoinshrdlu", k=100_000)), "a" * 300_001, "?!" * 50_000):
        assert own.encode([text.encode()])[0] == raw(library, text)


def test_cache_is_bounded_and_ids_stay_right(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 20_000)
    own = bpe.Encoder(bpe.default_path())
    for k in range(50):
        text = " ".join(f"word{k}x{i} <|endoftext|>" for i in range(40))
        assert own.encode([text.encode()])[0] == raw(library, text)
        assert own.held < 20_000 + 40 * 2 * 3 * 300


def test_decode_leaves_out_unknown_ids(spark):
    ids = np.array([3306, 49407, 10_000_000, 272], "<u4").tobytes()
    df = spark.createDataFrame([(1, 4, bytearray(ids)), (None, 0, None)], "doc_id long, n_tokens long, ids binary")
    assert [r.decoded for r in bpe.decode(df).collect()] == ["hello</w> <|endoftext|> 1</w>", ""]
