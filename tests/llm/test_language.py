import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quern.llm import language, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_contract_and_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in queries.queries()["op8_language"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    right = []
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (d["text"] is None or not any(c.isalpha() for c in d["text"]))
        if r["held_out"] and d["lang"]:
            right.append(r["lang_pred"] == d["lang"])
    assert len(right) > 150 and np.mean(right) > 0.93


def test_odd_rows(spark, odd_docs):
    rows = language.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 4)} == {"und"}
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert language.identify(odd_docs.limit(0)).count() == 0
    unlearned = language.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlearned} == {"und"}


def toy():
    rng = np.random.default_rng(2)
    return [(bytes(rng.choice(np.frombuffer(a, np.uint8), n)), y) for n in (5, 64, 40) for a, y in [(b"abcde ", "x"), (b"defgh ", "y"), (b"hijab ", "z")] for _ in range(20)]


def test_gradients(monkeypatch):
    """Backpropagation against differences of the loss."""
    rng = np.random.default_rng(0)
    net = language.fit(toy(), steps=1)
    x = rng.integers(97, 105, (6, 3)).astype(np.uint8)
    mask = np.array([[1, 1, 1]] * 4 + [[1, 0, 1]] * 2, np.float32)
    pull = rng.normal(size=(6, language.STATES, 3)).astype(np.float32)

    def loss(d):
        return sum(float((h.astype(float) * p).sum()) for h, p in zip(d.run(x, mask), pull))

    trace = []
    list(net.ahead.run(x, mask, trace))
    dw, du = net.ahead.back(x, mask, trace, list(pull))
    for a, g in ((net.ahead.w, dw), (net.ahead.u, du)):
        for at in [np.unravel_index(i, a.shape) for i in np.argsort(-np.abs(g).ravel())[:40:5]]:
            kept, e = a[at], np.float32(1e-2)
            a[at] = kept + e
            up = loss(net.ahead)
            a[at] = kept - e
            down = loss(net.ahead)
            a[at] = kept
            assert abs((up - down) / (2 * e) - g[at]) < 0.03 * max(1, abs(g[at]))


def test_pooling_is_the_mean_over_all_positions(monkeypatch):
    net = language.fit(toy(), steps=30)
    texts = [b"", b"a", b"abcd" * 40, b"fgh de" * 11]
    got = net.pool(texts)
    for t, p in zip(texts[1:], got[1:]):
        each = []
        for i in range(0, len(t), language.WINDOW):
            x = np.frombuffer(t[i : i + language.WINDOW], np.uint8)[:, None]
            h, b = list(net.ahead.run(x, None)), list(net.behind.run(x[::-1], None))[::-1]
            each += [net.label(u, v)[:, 0] for u, v in zip(h, b)]
        assert len(each) == len(t) and np.allclose(np.mean(each, axis=0), p, atol=1e-5)
    monkeypatch.setattr(language, "WIDTH", 2)
    assert np.allclose(net.pool(texts), got, atol=1e-6)
    assert [net.languages[i] for i in net.pool([b"abcab", b"defgd"]).argmax(axis=1)] == ["x", "y"]


def plain_sample(rows, each, windows):
    """Documents of least hash in each language and windows of them, by the library's XXH64 on whole rows."""
    best = defaultdict(dict)
    for d, lang, text, u, at in rows:
        if None not in (d, lang, text) and text and zlib.crc32(str(d).encode()) % 5 != 0:
            b = text.encode()
            ws = {b[x : x + language.WINDOW] for x in at} if len(b) > language.WINDOW else {b}
            best[lang][d, text] = (u, sorted(ws))
    return sorted({(w, lang) for lang, found in best.items() for _, ws in sorted(found.values())[:each] for w in ws})


def test_sample_and_labels_against_a_plain_version(spark):
    """The sample by hash, whatever repeats, and whole texts labelled position by position."""
    words = {"x": "abcde fabde", "y": "qrstu vqrsv", "z": "ghijk lmghk"}
    rows = [(i, lang, " ".join((words[lang] + " ")[k % 9 :] for k in range(i % 23))) for i, lang in enumerate(["x", "y", "y", "z"] * 60)]
    rows += [(3, "z", "ghi jkl ghi")] * 500 + [(None, "x", "abc"), (900, None, "abc"), (901, "x", None), (902, "x", " 12 "), (903, "y", "qrs " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    d = docs.withColumn("b", F.col("text").cast("binary")).withColumn("u", F.shiftrightunsigned(F.xxhash64("doc_id", "b"), 11).cast("double") / 2.0**53)
    n = F.greatest(F.octet_length("b") - language.WINDOW + 1, F.lit(1))
    d = d.withColumn("at", F.array(*[F.pmod(F.xxhash64("doc_id", "b", F.lit(i)), n) for i in range(4)]))
    found = [tuple(r) for r in d.select("doc_id", "lang", "text", "u", "at").collect()]
    for each in (7, 30, 500):
        want = plain_sample(found, each, 4)
        inner = d.select(F.col("doc_id").alias("id"), "lang", "b").dropna().filter((toxicity.bucket(F.col("id"), 5) != 0) & (F.octet_length("b") > 0))
        assert language.sample(inner, each) == want and len(want) > 7
    net = language.learn(docs)
    again = language.fit(plain_sample(found, 500, 4))
    assert all(np.array_equal(a, b) for a, b in zip(net.weights(), again.weights()))
    got = sorted(str(tuple(r)) for r in language.identify(docs).select("doc_id", "lang_pred").collect())
    want = []
    for d_, _, t in rows:
        p = np.zeros(3)
        b = (t or "").encode()
        for i in range(0, min(len(b), 20_000), language.WINDOW):
            x = np.frombuffer(b[i : i + language.WINDOW], np.uint8)[:, None]
            h, k = list(net.ahead.run(x, None)), list(net.behind.run(x[::-1], None))[::-1]
            p += sum(net.label(u, v)[:, 0] for u, v in zip(h, k))
        want.append(str((d_, net.languages[p.argmax()] if any(c.isalpha() for c in t or "") else "und")))
    assert got == sorted(want)


def test_no_group_of_a_language_meets_in_one_task(spark):
    """One language of nearly all rows: what is dealt by language is a bounded sample."""
    docs = spark.range(40_000).selectExpr("id", "if(id % 100 = 0, 'x', 'y') AS lang", "cast(concat('text ', id) AS binary) AS b")
    few = language.drawn(docs, {k: s for k, (_, s) in language.shares(docs, 50, 8000).items()}, 4)
    assert 100 <= few.count() < 400
    assert "Window" not in few._jdf.queryExecution().executedPlan().toString()
