import hashlib
from collections import defaultdict
from string import ascii_lowercase, ascii_uppercase

import pytest

from quern.llm import exact_dedup, queries
from tests.oracle import same

SF = "/root/testdata/sf0.001"
LOW = str.maketrans(ascii_uppercase, ascii_lowercase)


def plain(docs):
    groups, rows = defaultdict(list), docs.collect()
    for r in rows:
        groups[(r["text"] or "").translate(LOW)].append(r["doc_id"])
    keep = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    return [(r["doc_id"], keep[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for r in rows for t in [(r["text"] or "").translate(LOW)]], len(groups)


def check(got, docs):
    rows = got.collect()
    want, groups = plain(docs)
    assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in rows) == sorted(map(str, want))
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == groups and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_matches_sql(spark):
    same(queries.queries()["op2_exact_dedup"](spark, SF), queries.oracle_sql()["op2_exact_dedup"], SF)


@pytest.mark.parametrize("block, share, few", [(4096, 1000, 32), (7, 3, 2), (64, 5, 1)])
def test_odd_rows(spark, odd_docs, block, share, few):
    check(exact_dedup.exact_duplicates(odd_docs, block=block, share=share, few=few), odd_docs)


def test_blocks_that_almost_agree(spark):
    texts = ["", "a", "aa", "aaaa" * 4, "aaaa" * 4 + "a", "aaaa" * 5, "AAAA" * 5, "aaaabbbb" * 2, "bbbbaaaa" * 2, "É" * 9, "é" * 9] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for few in (1, 3, 1000):
        check(exact_dedup.exact_duplicates(docs, block=4, few=few), docs)


def test_hot_texts_are_named_in_parts(spark):
    """Half of all rows have one text, in parts; each part has few places, and all have one name in the end."""
    docs = spark.createDataFrame([(i, "the same words here" if i % 2 else f"own {i // 4}") for i in range(400)], "doc_id long, text string")
    check(exact_dedup.exact_duplicates(docs, few=9), docs)
    check(exact_dedup.exact_duplicates(docs, block=5, few=9), docs)
    hot = exact_dedup._hot(exact_dedup._places(docs, "text", "doc_id", 4096), 1000, 9)
    assert [r["parts"] for r in hot] == [23]


def test_input_that_is_no_scan(spark):
    docs = spark.range(60).selectExpr("id AS doc_id", "concat('t', id % 7) AS text").repartition(5)
    check(exact_dedup.exact_duplicates(docs), docs)
    assert exact_dedup.deduplicate(docs.orderBy("text")).count() == 7


def test_empty_and_deduplicate(spark, odd_docs):
    assert exact_dedup.exact_duplicates(odd_docs.limit(0)).count() == 0
    kept = exact_dedup.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == plain(odd_docs)[1]


def test_no_python_in_the_plan(spark, odd_docs):
    plan = exact_dedup.exact_duplicates(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
