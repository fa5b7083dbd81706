import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from quern.llm import shingles
from quern.llm.common import Q


def five_word_fingerprint(shingles):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_copies(rows):
    """The least id of each component of [(id, text)]: sets of five-word shingles alike to 0.8, or fingerprints of all
    shingles, repeats included, within three bits; by comparing all pairs."""
    sets, fps = [], []
    for _, t in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        each = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
        sets.append(frozenset(each))
        fps.append(five_word_fingerprint(each))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (fps[i] ^ fps[j]).bit_count() <= 3 or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return set(least.values())


def corpus():
    """Texts of their own, copies with words replaced, short and equal ones, and a group of 40 near copies."""
    r = random.Random(11)
    word = lambda: f"w{r.randrange(4000)}"
    texts = []
    for k in range(60):
        own = [word() for _ in range(r.choice((30, 120, 300)))]
        texts.append(own)
        for changes in (len(own) // 100, len(own) // 50, len(own) // 25):
            copy = list(own)
            for at in r.sample(range(len(own)), changes):
                copy[at] = word()
            texts.append(copy)
    base = [word() for _ in range(200)]
    for _ in range(40):
        copy = list(base)
        for at in r.sample(range(200), 2):
            copy[at] = word()
        texts.append(copy)
    return [" ".join(t) for t in texts] + ["a b c", "a b c", "a b d", "", " ", "A B  C"]


def crowd():
    """300 texts that share most of a page and aren't near copies of each other, of which 30 have one near copy each."""
    r = random.Random(5)
    page = [f"p{k}" for k in range(400)]
    texts = []
    for k in range(300):
        own = page[:250] + [f"o{k}x{r.randrange(10**6)}" for _ in range(80 + k % 30)] + page[250:]
        texts.append(own)
        if k % 10 == 0:
            texts.append([*own[:260], "changed", *own[261:]])
    r.shuffle(texts)
    return [" ".join(t) for t in texts]


def crowded_keys(n=800):
    """n texts whose sets are alike to 0.77 by a common page, so that all min-wise keys are crowded, and a near copy of each
    tenth, alike to 0.81. A word of its own, repeated, gives each text a fingerprint far from all others."""
    r = random.Random(3)
    page = [f"p{k}" for k in range(300)]
    texts = []
    for k in range(n):
        own = [f"o{k}x{i}" for i in range(35)]
        texts.append([*page, *own, *[f"r{k}"] * 400])
        if k % 10 == 0:
            texts.append([*page, *own[:11], *(f"c{k}x{i}" for i in range(24)), *[f"s{k}"] * 400])
    r.shuffle(texts)
    return [" ".join(t) for t in texts]


def stage(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    kept = corpus_pipeline.drop_copies(spark, spark.read.parquet(str(tmp_path / "d")), "")
    return {r["doc_id"] for r in kept.collect()}


def test_stage_finds_all_pairs_at_crowded_keys(spark, tmp_path):
    rows = list(enumerate(crowded_keys()))
    assert stage(spark, tmp_path, rows) == near_copies(rows)


@pytest.mark.parametrize("make", [corpus, crowd])
def test_prefixes_find_all_pairs_by_themselves(spark, tmp_path, monkeypatch, make):
    """The min-wise keys only save work."""
    monkeypatch.setattr(shingles, "similar", lambda docs, banded, text: banded.limit(0).selectExpr(f"{Q}fp AS a", f"{Q}fp AS b"))
    rows = list(enumerate(make()))
    assert stage(spark, tmp_path, rows) == near_copies(rows)


def test_prefixes_of_similar_sets_meet():
    """At exactly the similarity, and at places that the filters pass; whatever is known of the order."""
    r = np.random.default_rng(2)
    for both in range(1, 200):
        each = r.permutation(np.arange(1, 400, dtype=np.uint64))
        most = both // 4  # so many others leave the similarity at 0.8 or above
        for more in {0, most // 2, most}:
            x, y = np.sort(each[: both + more]), np.sort(np.concatenate([each[:both], each[both + more : both + most]]))
            x, y = sorted((x, y), key=len)
            values = np.sort(r.choice(each, 100, replace=False))
            a, b = (shingles.prefix(s, values, (values % 7 + 3).astype(np.int64)) for s in (x, y))
            places = [(p, b.tolist().index(v)) for p, v in enumerate(a.tolist()) if v in b]
            assert any(9 * (len(x) - p) >= 8 * len(x) and 9 * min(len(x) - p, len(y) - q) >= 4 * (len(x) + len(y)) for p, q in places)


@pytest.mark.parametrize("make", [corpus, crowd])
def test_stage_finds_all_pairs_of_similarity(spark, tmp_path, make):
    rows = list(enumerate(make()))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    kept = corpus_pipeline.drop_copies(spark, spark.read.parquet(str(tmp_path / "d")), "")
    assert {r["doc_id"] for r in kept.collect()} == near_copies(rows)


def test_shingles_are_a_set():
    assert len(shingles.shingles(b"a b c d e a b c d e")) == 5
    assert shingles.bands(shingles.shingles(b" ")) == [] and len(shingles.bands(shingles.shingles(b"one"))) == shingles.BANDS
