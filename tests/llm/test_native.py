import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import chat, licenses, queries

from .oracle import same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op1_decontaminate", "op6_license_scan", "op7_chat_format"])
def test_sql(spark, name):
    same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def test_chat_edges(spark):
    hard = ["", None, "<|end|>", "<|turn|>x", "\\", "\\<|", "<\\|", "<|>", "|>", "|\\>", "<|user|>\n", "\\\\<||>", "</s>[INST] é 😀"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "a|>b<|end|>", None) for t in hard)]
    rows += [(None, None, "assistant", "b"), (None, 0, "user", "a"), (2, 0, "user", "x"), (2, 0, "user", "x"), (3, 1, "assistant", "z" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).repartition(4)
    got = {r.conv_id: r for r in chat.report(df).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((((t is not None, t or 0), r or "", x or "") for c, t, r, x in rows if c == conv))
        text = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == 4 and chat.report(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert chat.formatted(one).first().formatted == "<|user|>a<|end|><|assistant|>b<|turn|>c<|end|>"


def brute(text, weight, whole):
    def vec(ws):
        return {w: k * weight[w] for w, k in Counter(ws).items() if w in weight}

    best = None
    for u in [*text.split("\n"), *([text] if whole else [])]:
        ws = licenses.words_of(u)
        v = vec(ws)
        if not v or sum(w in weight for w in ws) < licenses.SHARE * len(ws):
            continue
        for name, t in licenses.TEMPLATES:
            tv = vec(licenses.words_of(t))
            c = sum(x * v.get(w, 0) for w, x in tv.items()) / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in tv.values()))
            if round(c, 6) >= licenses.COSINE and (best is None or (round(c, 6), name) > best):
                best = (round(c, 6), name)
    return best


def test_license_edges(spark):
    texts = ["released under the MIT license", "x\nAll Rights Reserved\ny", None, "", "Licensed under CC BY-NC 4.0. and many more words of another kind here", "the of and under", "Permission is hereby granted free of charge to any\nperson obtaining a copy of this software and associated documentation files"]
    paths = ["a/LICENSE", "a/b/COPYING.txt", "a/b/c/x.txt", "a/d/x", None, "e/x", "a/b/c/d/LICENSE"]
    rows = list(zip(paths, texts, range(9)))
    rows += [("a/b/c/x.txt", None, 2), ("x.txt", "plain", 8)]
    df = spark.createDataFrame(rows, "path string, text string, license int").withColumnRenamed("license", "n")
    weight = licenses.idf(df)
    got = licenses.scan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for p, t, n in rows if n == r.n and p == r.path)
        want = brute(text, weight, bool(r.path and r.path.split("/")[-1].startswith(("LICENSE", "COPYING")))) if text else None
        assert (r.cosine, r.own_license) == (want or (None, None)), r
    by = {r.path: (r.license, r.basis, r.licence_dir) for r in got}
    assert by["a/b/c/x.txt"] == ("All-Rights-Reserved", "directory", "a/b") and by["a/d/x"] == ("MIT", "directory", "a")
    assert by["e/x"][1] == by["x.txt"][1] == "none" and by["a/b/c/d/LICENSE"][0] == "MIT"
    assert licenses.scan(df.limit(0)).count() == 0
