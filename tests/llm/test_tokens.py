import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from rasterloom.llm import tokens as K

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "", None, " ", "a", " a", "a ", "\n", "a\nb", "a\n\nb", "a  b", "it's I'll don't 's", "é è x  y z　w", "tab\tx \x0b y", "<|endoftext|> x <|endoftext|>y a <|endoftext|> b <|",
    "漢字 かな 😀 😀x ", "\u0085 a \u0085b", "x" * 3000, "word " * 5000, "a\r\nb c\x1c d \x1fe", "ß ß\nß é\né", "​ a ​ b", " \n a \n", "1 23 4.5 $ %\n$ x_y", "ÀÀ À x× y", "\x7f a\x7f b",
]


def plain(texts):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def test_encoder_is_the_tokenizer():
    enc = K.Encoder(PATH)
    for _ in range(2):
        ids, per = enc(pa.array(HARD, pa.string()))
        got = [x.tolist() for x in np.split(ids, np.cumsum(per)[:-1])]
        assert got == plain(HARD)


def test_pieces_that_come_again_are_encoded_once(monkeypatch):
    monkeypatch.setattr(K, "KEPT_PIECES", 60)
    enc, met = K.Encoder(PATH), []
    plainly = enc._encode
    monkeypatch.setattr(enc, "_encode", lambda buf, a, b: met.extend(buf[x:y].tobytes() for x, y in zip(a, b)) or plainly(buf, a, b))
    for k in range(20):
        texts = ["often met words", " ".join(f"rare{k}x{j}" for j in range(25))]
        ids, per = enc(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(per)[:-1])] == plain(texts)
    assert met.count(b" words") == 1 and len(enc.keys) <= 100


def test_texts_are_coded_once(spark, monkeypatch, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    class Counted(K.Code):
        def encode(self, ids, per):
            calls.add(len(per))
            return super().encode(ids, per)

    monkeypatch.setattr(K, "Code", Counted)
    K.write(spark.range(500).selectExpr("id AS doc_id", "'word ' || id AS text").repartition(3), f"{tmp_path}/out", PATH)
    assert calls.value == 500


@pytest.mark.parametrize("limit", [4, 5, 20])
def test_code(limit):
    rng = np.random.default_rng(limit)
    counts = np.array([0, 1000, 500, 100, 3, 1, 1, 0, 1, 9, 2, 40])
    n = K.code_lengths(counts, limit)
    assert n.max() <= limit and ((n > 0) == (counts > 0)).all() and sum(2.0 ** -n[n > 0]) <= 1
    if limit == 20:
        import heapq

        h, cost = counts[counts > 0].tolist(), 0
        heapq.heapify(h)
        while len(h) > 1:
            s = heapq.heappop(h) + heapq.heappop(h)
            cost += s
            heapq.heappush(h, s)
        assert (counts * n).sum() == cost
    code = K.Code(n)
    per = np.array([1, 2000, 5, 1, 3000])
    ids = rng.choice(np.flatnonzero(counts), per.sum())
    data, first, at = code.encode(ids, per)
    assert (code.decode(data, at[:: 1] * 0 + at, np.ones(len(at), np.int64)) == ids).all()


def check(docs_df, rows):
    got = sorted(((r.doc_id is not None, r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in K.report(docs_df, PATH).collect()), key=repr)
    keyed = [((d is not None, d or 0, zlib.crc32(np.array(i, "<u2").tobytes())), d, i) for (d, _), i in zip(rows, plain([t for _, t in rows]))]
    want, start = [], 0
    for _, d, i in sorted(keyed, key=lambda x: x[0]):
        want.append((d is not None, d, start, len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
        start += len(i)
    assert got == sorted(want, key=repr)


def test_rows(spark):
    rows = [*enumerate(HARD), (None, "null id"), (5, "twice"), (5, "twice"), (5, "other"), (-7, "negative")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df.repartition(3), rows)
    assert K.report(df.limit(0), PATH).count() == 0


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(df, [(r.doc_id, r.text) for r in df.collect()])


def test_folder_is_read_without_anything_else(spark, tmp_path):
    rows = [*enumerate(HARD), (None, "null id")]
    K.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), f"{tmp_path}/out", PATH)
    back = K.read(spark.newSession(), f"{tmp_path}/out").collect()
    want = dict(zip([d for d, _ in rows], plain([t for _, t in rows])))
    assert {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in back} == want
    ends = sorted((r.start, r.start + r.n_tokens) for r in back)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert spark.read.parquet(f"{tmp_path}/out/about").first()["tokenizer"] == "byte_bpe_50k.json"
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["about", "blocks", "code", "parts"]


def test_workers_that_code_or_decode_keep_no_tokenizer(monkeypatch):
    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(K, "TaskContext", Context)
    K.encoder(PATH)
    assert not list(K._blocks([], K.Code(np.zeros(1, np.int64)), np.uint16)) and K.encoder.cache_info().currsize == 0
