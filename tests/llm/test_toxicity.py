import math
import re
import zlib
from collections import defaultdict

import numpy as np

from quern.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def test_contract_and_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in queries.queries()["op4_toxicity"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count()
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    y = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(y[d], r["predicted"]) for d, r in got.items() if r["held_out"] and d in y]
    assert sum(a == b for a, b in held) / len(held) > 0.9  # 299 rows to learn from


def test_learns_words_and_inflections():
    rows = [(toxicity.features(f"word{i} other{i * 7} " + (f"grrumble{i} x" if i % 3 == 0 else "fine")), int(i % 3 == 0)) for i in range(600)]
    m = toxicity.fit(rows)
    w = m.dense()

    def score(t):
        return 1 / (1 + np.exp(-(w[toxicity.features(t)].sum() + m.bias)))

    assert score("some grrumbling here") > 0.3 > score("some fine text here")
    assert len(m.index) < 1000 and 0 < score("") < 1


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (3, None, 0), (None, 1, 0), (6, 1, 9), (99, 1, 1)], "doc_id long, toxic int, text int")
    rows = toxicity.classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert toxicity.classify(odd_docs.limit(0), labels).count() == 0
    for nothing in (labels.limit(0), labels.filter("toxic = 1"), labels.filter("doc_id = 99")):
        got = toxicity.classify(odd_docs, nothing).collect()
        assert all(abs(r["score"] - toxicity.PRIOR) < 1e-9 and r["predicted"] == 0 for r in got) and len(got) == odd_docs.count()
        kept = toxicity.without_toxic(odd_docs, nothing)
        assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_blocks_cover_the_whole_text(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500))
    want = toxicity.features(text)
    monkeypatch.setattr(toxicity, "BLOCK", 11)
    assert np.array_equal(toxicity.features(text), want)


def plain_features(text):
    words = [zlib.crc32(w.encode()) for w in re.findall(r"\w+", (text or "").lower())]
    a, b, c, d, e = (int(x) for x in toxicity._ODD)
    found = [w * a for w in words] + [x * b + y * c for x, y in zip(words, words[1:])] + [x * d + y * e for x, y in zip(words, words[2:])]
    found = {(x * a % 2**64) >> 44 for x in found}
    for w in re.findall(r"\w+", (text or "").lower()):
        for k in toxicity.STEMS:
            if len(w.encode()) > k:
                found.add((zlib.crc32(w.encode()[:k], k) * (b if k % 2 else a) % 2**64) >> 44)
    return sorted(found)


def plain_ftrl(rows):
    """Follow the regularised leader, coordinate by coordinate, with floats in dictionaries."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0 if i == "bias" else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for x, y in rows:
            w = {i: weight(i) for i in [*x, "bias"]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in w:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if weight(i)}


def test_against_a_plain_version(spark):
    """Features, sample, weights and scores of a small table, each made again plainly."""
    text = lambda i: " ".join(f"{'grr' if i % 3 == 0 else 'nice'}{chr(97 + i * k % 7)}{'ing' * (k % 2)}" for k in range(9))
    rows = [(i, text(i)) for i in range(120)] + [(7, "one id of two documents"), (None, "no id"), (121, None), (122, "Ünï 1x ß")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 123)], "doc_id long, toxic int")
    assert all(toxicity.features(t).tolist() == plain_features(t) for _, t in rows)
    once = {d: t for d, t in rows if d not in (None, 7)}
    fold = lambda d: zlib.crc32(str(d).encode()) % 4 != 2
    order = sorted((d for d in once if fold(d)), key=lambda d: zlib.crc32(str(d).encode()))
    want = plain_ftrl([(plain_features(once[d]), int(d % 3 == 0)) for d in order])
    model = toxicity.learn(docs, labels)
    assert set(model.index.tolist()) == set(want) - {"bias"} and len(want) > 5
    assert all(abs(w - want[i]) < 1e-5 for i, w in zip(model.index.tolist(), model.weight.tolist())) and abs(model.bias - want["bias"]) < 1e-9
    for r in toxicity.classify(docs, labels).collect():
        t = next(t for d, t in rows if d == r["doc_id"] and (d != 7 or t == text(7) or r["score"] is None))
        if r["doc_id"] not in (7,):
            z = want["bias"] + sum(want.get(i, 0) for i in plain_features(t))
            assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-5


def test_sample_is_bounded(spark):
    """By rows and by bytes, whatever repeats; long texts are in it like others."""
    rows = [(i, "some words here " * (5000 if i == 8 else 1)) for i in range(40)] * 2 + [(i, f"word{i}") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] * 3, "doc_id long, toxic int")
    pick = lambda **k: [r[0] for r in toxicity.chosen(docs, labels, "toxic", "text", "doc_id", 2, 4, **k).collect()]
    every = pick(rows=1000, most=1 << 28)
    assert sorted(every) == [i for i in range(100, 160) if zlib.crc32(str(i).encode()) % 4 != 2]  # others repeat
    assert pick(rows=7, most=1 << 28) == every[:7]
    assert 0 < len(pick(rows=1000, most=4 * 7 * 9)) <= 9
    one = docs.filter("doc_id < 40").dropDuplicates(["doc_id"])
    assert 8 in [r[0] for r in toxicity.chosen(one, labels, "toxic", "text", "doc_id", 2, 4, 1000, 1 << 28).collect()]
