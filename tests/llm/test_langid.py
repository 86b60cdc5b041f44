import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rasterloom.llm import langid as L
from rasterloom.llm import queries

SF = "/root/testdata/sf0.01"

SYLLABLES = {"de": "ung keit schl ein über", "en": "ing tion the wh ness", "nl": "ij aan oor eer uw", "fr": "eau oux ègu ent ç", "es": "ción ñ ll que ado", "zz": "xq vzk qwr kkj xxv", "ru": "ова ский про ени ать"}


def spoken(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [(i, spoken(rng, lang, rng.choice([1, 5, 40])), lang) for i, lang in enumerate(sorted(SYLLABLES) * 60)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op12_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_seven_languages_of_four_families(spark, corpus):
    fitted = L.model(table(spark, corpus))
    assert fitted["tree"] == {"germanic": ["de", "en", "nl"], "other": ["zz"], "romance": ["es", "fr"], "slavic": ["ru"]}
    assert len(fitted["machines"]) == 6 + 3 + 1
    rng = random.Random(2)
    new = [(i, spoken(rng, lang, 6), lang) for i, lang in enumerate(sorted(SYLLABLES) * 20)]
    got = {r.doc_id: r.lang_pred for r in L.predicted(table(spark, new), fitted).collect()}
    assert sum(got[i] == lang for i, _, lang in new) >= 0.97 * len(new)
    # by hand: family by votes, then language by votes
    for i, text, _ in new[:20]:
        at, ids, f = L.frequencies([text])

        def votes(kin, names):
            out = dict.fromkeys(names, 0.0)
            for a in names:
                for b in names:
                    if (kin, a, b) in fitted["machines"]:
                        w, slope = fitted["machines"][kin, a, b]
                        p = 1 / (1 + np.exp(-slope * float((w[ids] * f).sum())))
                        out[a] += p
                        out[b] += 1 - p
            return max(names, key=lambda n: out[n])

        kin = votes("", list(fitted["tree"]))
        assert got[i] == votes(kin, fitted["tree"][kin])


def test_features_are_those_of_the_text_alone():
    texts = ["Ab  cd", "", "é9!é", "x", "  ", "ab cd"]
    together = L.frequencies(texts)
    for i, t in enumerate(texts):
        alone = L.frequencies([t])
        own = slice(together[0][i], together[0][i + 1])
        assert np.array_equal(together[1][own], alone[1]) and np.allclose(together[2][own], alone[2])
        ids, of, n = L.grams(pa.array([t]))
        words = " " + "".join(w + " " for w in "".join(c if c.isalpha() else " " for c in t.lower()).split())
        b = words.encode()
        assert len(ids) == sum(max(0, len(b) - k + 1) for k in (2, 3, 4)) + len(b.replace(b" ", b"")) and n == 1
    assert together[0][-1] == len(together[1])
    assert np.array_equal(L.frequencies(["Ab  cd"])[1], L.frequencies(["ab cd"])[1])


def test_machine_reaches_the_minimum():
    rng = np.random.default_rng(3)
    n = 60
    y = np.where(np.arange(n) % 2, 1, -1)
    at, ids = np.arange(n + 1) * 3, rng.integers(0, 12, 3 * n)
    ids = np.concatenate([rng.choice(12, 3, replace=False) for _ in range(n)])
    x = rng.random(3 * n)
    x /= np.repeat(np.sqrt((x * x).reshape(n, 3).sum(axis=1)), 3)
    dense = np.zeros((n, 12))
    dense[np.repeat(np.arange(n), 3), ids] = x
    cost = np.full(n, 0.7)
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (dense @ w))).sum()
    w = L.separated(at, ids, x, y, cost, passes=2000)[:12]
    v = np.zeros(12)
    best = loss(v)
    for k in range(1, 20_000):  # subgradient descent
        v = v - (v - (cost * y * (y * (dense @ v) < 1)) @ dense) / k
        best = min(best, loss(v))
    assert loss(w) <= best + 0.02 * abs(best)


def test_edges(spark, corpus):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 -- !", "fr"), (4, "the thing", None), (None, "ción que", "es"), (5, "the thing", "en"), (5, "the thing", "en"), (6, "١٢", "en")]
    out = L.report(table(spark, rows + [(i + 100, t, lang) for i, t, lang in corpus])).collect()
    assert len(out) == len(rows) + len(corpus)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert by[1] == by[2] == by[3] == by[6] == [("und", 0.0)]
    assert by[4][0][0] == "en" and by[None][0][0] == "es" and by[5][0] == by[5][1] and len(by[5]) == 2
    one = [(i, "the thing", "en") for i in range(10)]
    assert {(r.lang_pred, r.score) for r in L.report(table(spark, one)).collect()} == {("en", 1.0)}
    assert {r.lang_pred for r in L.report(table(spark, [(1, "the", None)])).collect()} == {"und"}
    assert L.report(table(spark, one).limit(0)).count() == 0


def test_held_out_labels_and_other_columns_change_nothing(spark, corpus):
    plain = sorted(L.report(table(spark, corpus)).collect())
    other = [(i, t, "fr" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, i, "x", 0.5) for i, t, lang in corpus]
    named = spark.createDataFrame(other, "doc_id long, text string, lang string, lang_pred long, row string, Score double")
    assert sorted(L.report(named).collect()) == plain


def test_long_texts_are_predicted_whole(spark, corpus):
    fitted = L.model(table(spark, corpus))
    rng = random.Random(4)
    text = spoken(rng, "de", 3_000) + " " + spoken(rng, "fr", 60_000)
    assert L.predicted(table(spark, [(1, text, None)]), fitted).first().lang_pred == "fr"
    rows = L.sample(table(spark, [(1, text, "fr"), (2, text, "fr")])).collect()
    assert len(rows) == 1 and len(rows[0].text) <= L.SAMPLE_CHARS + 16
