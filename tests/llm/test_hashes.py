"""Texts that simple hashes take for one another: complementary Thue-Morse words."""

import numpy as np
import public_tokenizers
import pytest

from rasterloom.llm import decontaminate, jaccard, quality, tokens
from rasterloom.llm import text as T

from .test_decontaminate import brute as leaks
from .test_decontaminate import got as leaks_of
from .test_quality import brute as counts
from .test_tokens import plain


def pair(bits):
    one = "a"
    for _ in range(bits):
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("bits", [10, 11, 12])
def test_families(bits):
    one, two = (np.frombuffer(x.encode(), np.uint8) for x in pair(bits))
    for family in (0, 1):
        assert len({int(T.hashes(x, np.array([0]), np.array([len(x)]), False, family)[0]) for x in (one, two, one)}) == 2


def test_equal():
    x = np.frombuffer(b"abcdefgh" * 40 + b"abcdefgx", np.uint8)
    at, to, n = np.array([0, 0, 8, 3, 0, 0]), np.array([8, 1, 8, 11, 8, 8]), np.array([300, 9, 0, 17, 320, 319])
    assert T.equal(x, at, x, to, n).tolist() == [x[a : a + m].tobytes() == x[b : b + m].tobytes() for a, b, m in zip(at, to, n)]


def test_operators(spark):
    rows = [(k, t) for k, t in enumerate([t for bits in (10, 11, 12) for t in pair(bits)] + [f"{x}\n{y}\n{x}" for x, y in (pair(10), pair(12))])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(7, pair(10)[0]), (8, pair(12)[1])]
    assert leaks_of(decontaminate.report(docs, spark.createDataFrame(items, "item_id long, text string"))) == leaks(rows, items)
    c = quality.counts(docs.select("text").toArrow().column("text"))
    assert list(zip(*(c[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))) == [counts(t) for _, t in rows]
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, n = tokens.Encoder(path)(docs.select("text").toArrow().column("text"))
    assert [g.tolist() for g in np.split(ids, np.cumsum(n)[:-1])] == plain([t for _, t in rows])
    assert {r.doc_id: r.class_id for r in jaccard.links(docs.where("doc_id < 6")).collect()} == {k: k for k in range(6)}


def test_hashes_that_collide(monkeypatch):
    """Where all hashes are alike, bytes decide."""
    monkeypatch.setattr(T, "hashes", lambda buf, starts, ends, fold, family=0: np.ones(len(starts), T.U64))
    texts = ["a b c a b c\nx\ny\nx", "p q r s t u", "a\nb"]
    import pyarrow as pa

    c = quality.counts(pa.array(texts))
    assert [tuple(c[k][i] for k in ("n_dup_lines", "n_repeat_words")) for i in range(3)] == [counts(t)[3:] for t in texts]
    ids, n = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))(pa.array(texts))
    assert [g.tolist() for g in np.split(ids, np.cumsum(n)[:-1])] == plain(texts)
