import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import mixing, queries
from tests.oracle import same

SF = "/root/testdata/sf0.001"


def test_matches_sql(spark):
    same(queries.queries()["op5_mixing"](spark, SF), queries.oracle_sql()["op5_mixing"], SF)


def test_targets_are_met(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise("rest").alias("source"))
    weights = {"hot": 0.2, None: 0.3, "unseen": 5.0}
    out = Counter(r["source"] for r in mixing.mix(docs, weights, 50_000).select("source").collect())
    assert set(out) == {"hot", None} and abs(out["hot"] - 20_000) < 700 and abs(out[None] - 30_000) < 900
    assert mixing.mix(docs, {"unseen": 1.0}).count() == 0


def test_poisson_inverse(spark):
    cdf = mixing.distributions(spark.createDataFrame([("a", 2.5), ("b", 400.0), ("c", 0.0)], "source string, rate double"))
    got = {r["source"]: r["cdf"] for r in cdf.collect()}
    assert set(got) == {"a", "b"} and abs(got["a"][2] - 0.543813115883325) < 1e-12
    assert all(abs(c[-1] - 1) < 1e-9 and c == sorted(c) for c in got.values())


def test_odd_rows(spark, odd_docs):
    out = mixing.mix(odd_docs, total=400)
    assert out.columns == odd_docs.columns
    copies = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert copies[1, "alpha beta gamma delta epsilon"] % 2 == 0  # repeated rows alike
    assert {k for k in copies} <= {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    assert mixing.mix(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [0, 20_000])
def test_either_join_gives_the_same_rows_in_shuffled_order(spark, limit, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((r["doc_id"], r["copy"]) for r in queries.queries()["op5_mixing"](spark, SF).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    got = [(r["doc_id"], r["copy"]) for r in mixing.mix(docs, copy="copy").collect()]
    assert sorted(got) == want and got != want


def test_large_rates(spark):
    """A source of one row at a rate of 100,000: a short table, the exact quantile."""
    rate = 1e5
    r = mixing.distributions(spark.createDataFrame([("a", rate)], "source string, rate double")).first()
    assert len(r["cdf"]) < 8_000 and abs(r["cdf"][-1] - 1) < 1e-8
    want, c = {}, 0.0
    for k in range(int(rate) - 4_000, int(rate) + 4_000):
        c += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        want[k] = c
    assert all(abs(x - want[r["least"] + i]) < 1e-8 for i, x in enumerate(r["cdf"]) if r["least"] + i in want)
    docs = spark.createDataFrame([(1, "t", "a"), *((i, "t", "b") for i in range(2, 40))], "doc_id long, text string, source string")
    n = Counter(x["doc_id"] for x in mixing.mix(docs, {"a": 1.0, "b": 1.0}, 200_000).select("doc_id").collect())
    u = int(hashlib.md5(b"mix|1").hexdigest()[:13], 16) / 2**52
    assert n[1] == min(k for k in want if want[k] > u) and abs(sum(n.values()) - 200_000) < 2_000


def test_log_factorial(spark):
    got = spark.range(0, 2_000_000, 777).select("id", mixing.log_factorial(F.col("id")).alias("f")).collect()
    got += spark.range(40).select("id", mixing.log_factorial(F.col("id")).alias("f")).collect()
    assert all(abs(r["f"] - math.lgamma(r["id"] + 1)) <= 1e-12 * max(1, r["f"]) for r in got)
