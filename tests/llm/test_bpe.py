import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import bpe, queries

SF = "/root/testdata/sf0.001"
FILE = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def raw():
    return open(FILE, "rb").read()


@pytest.fixture(scope="module")
def library(raw):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())


@pytest.mark.parametrize("odd", [False, True])
def test_tables(spark, library, odd_docs, odd):
    docs = odd_docs if odd else spark.read.parquet(f"{SF}/documents.parquet")
    got = bpe.digests(docs, FILE, P.PATTERN) if odd else queries.queries()["op7_bpe"](spark, SF)
    want = [(r["doc_id"], *digests(library, r["text"])) for r in docs.collect()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_encoded_rows(spark, library, odd_docs):
    got = bpe.encoded(odd_docs.withColumnRenamed("k", "token_ids"), FILE, P.PATTERN)
    rows = got.collect()
    assert got.columns == [*odd_docs.columns[:-1], "token_ids"] and len(rows) == odd_docs.count()
    assert sorted(str(r["text"]) for r in rows) == sorted(str(r["text"]) for r in odd_docs.collect())
    for r in rows:
        assert r["token_ids"] == (None if r["text"] is None else library.encode_ordinary(r["text"]))
    assert bpe.encoded(odd_docs.limit(0), FILE, P.PATTERN).count() == 0 == bpe.digests(odd_docs.limit(0), FILE, P.PATTERN).count()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(raw, library, text):
    c = bpe.codec(raw, P.PATTERN)
    assert [int(i) for b in c.blocks(text) for i in b.split()] == library.encode_ordinary(text)


def test_blocks_do_not_change_ids(raw, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 5)
    text = "It's  a \n\n test of   blocks, don't\tsplit 123 things.    end "
    assert [int(i) for b in bpe.codec(raw, P.PATTERN).blocks(text) for i in b.split()] == library.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=20), st.integers(0, 40), st.integers(0, 40))
def test_appends_and_edits_are_exact(raw, data, more, a, b):
    v = bpe.codec(raw, P.PATTERN).vocabulary
    a, b = sorted((min(a, len(data)), min(b, len(data))))
    assert bpe.Prefixes(v, data).append(more).ids() == bpe.Prefixes(v, data + more).ids()
    assert bpe.Prefixes(v, data).edit(a, b, more).ids() == bpe.Prefixes(v, data[:a] + more + data[b:]).ids()


def test_long_edit_takes_over_the_tail(raw, library):
    v = bpe.codec(raw, P.PATTERN).vocabulary
    data = b"abcdefghij" * 200
    p = bpe.Prefixes(v, data).edit(5, 9, b"xyz")
    assert p.last == bpe.Prefixes(v, data[:5] + b"xyz" + data[9:]).last
