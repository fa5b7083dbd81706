"""Queries on tables whose keys or sizes are beyond those of the bundled ones."""

import pytest
from pyspark.sql import functions as F

from quern import errors
from quern import operators as ops
from quern import queries as catalogue
from quern.plans.profile import profile_steps
from quern.sequence import Lazy, Sequence
from quern.sources import from_list, from_records, from_table, to_list
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """orders and events, 3 times, with shifted keys: those of the last copy need 17 bits."""
    d = str(tmp_path_factory.mktemp("repeated"))
    for table, place, key in (("orders", "o_orderkey", "o_custkey"), ("events", "event_id", "user_id")):
        df = spark.read.parquet(f"{SF}/{table}.parquet")
        n, copy = df.count(), F.col("__c")
        df = df.crossJoin(spark.range(3).withColumnRenamed("id", "__c"))
        df.withColumns({place: F.col(place) + copy * n, key: F.col(key) + copy * 40_000}).drop("__c").write.parquet(f"{d}/{table}.parquet")
    return d


def in_duckdb_too(spark, d, name):
    same(catalogue.QUERIES[name](spark, d), catalogue.SQL[name].replace("FROM orders", f"FROM read_parquet('{d}/orders.parquet/*.parquet')").replace("FROM events", f"FROM read_parquet('{d}/events.parquet/*.parquet')"), d)


@pytest.mark.parametrize("single", [True, False])
@pytest.mark.parametrize("name", ["sort_kv_keybits", "sort_u32_keybits"])
def test_keys_of_17_bits(spark, repeated, monkeypatch, name, single):
    if not single:
        monkeypatch.setattr("quern.order.SINGLE_BYTES", 1000)
    in_duckdb_too(spark, repeated, name)


@pytest.mark.parametrize("v, bits", [([], 0), ([0, 0], 0), ([1, 0], 1), ([65535], 16), ([65536, 3], 17), ([2**32 - 1], 32)])
def test_key_width(spark, v, bits):
    q = from_list(spark, v)
    assert ops.key_width(q).count.first()[0] == bits
    assert to_list(ops.sort(q, key_bits=ops.key_width(q))) == sorted(v)


def test_a_lazy_width_is_a_checked_contract(spark):
    q = from_records(spark, [(70000, 1), (3, 2)])
    for bits in (16, 33, -1):
        with pytest.raises(Exception, match="bits"):
            ops.sort(q, key_bits=Lazy(spark.createDataFrame([(bits,)], "n long"))).df.collect()
    with pytest.raises(errors.InvalidKeyBits):
        ops.sort(q, key_bits=33)
    got = ops.dense(ops.sort(q, key_bits=Lazy(spark.createDataFrame([(17,)], "n long"))), "rank", "range")
    assert sorted(tuple(r) for r in got.select("rank", "key", "value").collect()) == [(0, 3, 2), (1, 70000, 1)]


@pytest.mark.parametrize("bytes_", [1000, 30_000, 16 << 20])
def test_profile_has_the_same_spans_at_any_size(spark, repeated, monkeypatch, bytes_):
    """Beyond one window the sort and the runs have phases of their own, which aren't among the query's."""
    monkeypatch.setattr("quern.order.SINGLE_BYTES", bytes_)
    in_duckdb_too(spark, repeated, "profile_pipeline")


def test_spans_of_phases_beyond_one_window_stay_in_the_profile(spark):
    q = from_list(spark, list(range(100)))
    got = profile_steps(q, [("sort", ops.sort)], bucket=8, strategy="buckets")
    assert [s.label for s in got.spans] == ["sort.range", "sort.within"] and [s.label for s in got.of_any_size()] == ["sort.within"]


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_window_only_while_rows_fit_a_task(spark, repeated, monkeypatch):
    """Asked for or not: beyond, scans and runs go through buckets and places through ranges, to the same end."""
    q = catalogue.events(spark, repeated)
    made = {
        "hashpartitioning(__b": lambda: catalogue.QUERIES["scan_single_window"](spark, repeated),
        "hashpartitioning(__k": lambda: ops.run_length_encode(q, "window"),
        "rangepartitioning(": lambda: ops.dense(ops.sort(q), "rank", "window"),
    }
    small = {dealt: make() for dealt, make in made.items()}
    assert all("SinglePartition" in executed(df) and dealt not in executed(df) for dealt, df in small.items())
    want = [sorted(map(tuple, df.collect())) for df in small.values()]
    monkeypatch.setattr("quern.order.SINGLE_BYTES", 1000)
    assert all(dealt in executed(make()) for dealt, make in made.items())
    assert [sorted(map(tuple, make().collect())) for make in made.values()] == want
    in_duckdb_too(spark, repeated, "scan_single_window")


def test_a_known_capacity_bounds_a_window_too(spark, monkeypatch):
    q = from_list(spark, list(range(9)))
    assert "hashpartitioning(__b" not in executed(ops.scan(q, strategy="window").df)
    monkeypatch.setattr("quern.order.SINGLE_WINDOW", 8)
    got = ops.scan(q, strategy="window")
    assert "hashpartitioning(__b" in executed(got.df) and to_list(got) == [0, 1, 3, 6, 10, 15, 21, 28, 36]


@pytest.mark.parametrize("rows", [[(0, 5), (None, 3), (1, 5)], [(4, None), (7, 1), (9, None), (11, None)], [(None, None)]])
def test_nulls_in_a_window_of_known_capacity(spark, rows):
    q = from_table(spark.createDataFrame(rows, "p long, v long"), value="v", order_by="p", capacity=len(rows))
    for s in (q, ops.sort(q)):
        assert "rangepartitioning" not in executed(ops.dense(s, "i", "window"))
        a, b = ([tuple(r) for r in ops.dense(s, "i", x).orderBy("i").collect()] for x in ("window", "range"))
        assert a == b and len(a) == len(rows)
    for f in (lambda x: ops.scan(q, strategy=x, bucket=2).df, lambda x: ops.run_length_encode(q, x, 2)):
        assert "hashpartitioning(__" not in executed(f("window"))
        a, b = (sorted(map(str, f(x).collect())) for x in ("window", "buckets"))
        assert a == b


def test_cached_rows_in_a_window_of_known_capacity(spark):
    kv = [(None if i % 50 == 0 else 7 if i % 3 else i % 40, i) for i in range(2000)]
    rows = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(kv)], "pos long, key long, value long").persist()
    try:
        q = ops.sort(Sequence(rows, ("key", "value"), capacity=len(kv)))
        assert "hashpartitioning" not in executed(ops.dense(q, "rank", "window"))
        a, b = ([tuple(r) for r in ops.dense(q, "rank", how).orderBy("rank").collect()] for how in ("window", "range"))
        assert a == b and len(a) == len(kv)
    finally:
        rows.unpersist()
