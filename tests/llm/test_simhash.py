import random

import pyspark.sql.functions as F
import xxhash

from quern.llm import queries, simhash
from quern.llm.common import Q, components

SF = "/root/testdata/sf0.001"


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps):
    """Component names of [(id, fp)] by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return [names.get(find(i)) for i in range(len(fps))]


def check(df, docs):
    rows = [(r["doc_id"], plain(r["text"])) for r in docs.collect()]
    want = sorted((str(d), f"{f:016x}", str(c)) for (d, f), c in zip(rows, brute(rows)))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in df.collect()) == want


def test_whole_table(spark):
    check(queries.queries()["op1_simhash"](spark, SF), spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_rows(spark, odd_docs):
    check(simhash.near_duplicates(odd_docs), odd_docs)
    kept = simhash.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    names = simhash.near_duplicates(odd_docs).select("component_id").distinct().count()
    assert kept.count() == names
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0 and simhash.deduplicate(odd_docs.limit(0)).count() == 0


def test_blocks_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(f"a{i * i % 101}\tB" for i in range(3000)).encode()
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == want
    assert want % 2**64 == plain(text.decode())


def test_every_link_is_found(spark):
    """Random fingerprints and copies of them with 0 to 5 bits flipped."""
    r = random.Random(5)
    fps = set()
    for _ in range(150):
        x = r.getrandbits(64)
        fps |= {x, *(x ^ sum(1 << b for b in r.sample(range(64), k)) for k in range(1, 6))}
    fps = sorted(f - 2**64 if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], f"{Q}fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(df), "a", "b").collect()}
    ids = {f: i for i, f in enumerate(fps)}
    want = brute([(ids[f], f % 2**64) for f in fps])
    assert [ids[got.get(f, f)] for f in fps] == want


def test_components_of_a_path_and_a_hub(spark):
    e = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(e, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(51)} | {1000 + i: 1000 for i in range(200)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").filter(F.lit(True)).count() == 0
