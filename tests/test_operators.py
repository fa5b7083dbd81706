"""Host oracles at boundary sizes, literal vectors, plan shapes and errors."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern import Pipeline, errors
from quern import operators as ops
from quern.functions.predicates import Between, Equal, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, NotEqual
from quern.plans import profile
from quern.plans.profile import profile_steps
from quern.sequence import Sequence
from quern.sources import from_columns, from_list, from_parquet, from_records, from_table, to_list, to_parquet
from quern.streaming import compact_stream, histogram_stream, reduce_stream

MAX = 2**32 - 1
SIZES = [0, 1, 2, 31, 32, 33, 64, 65, 257]
BUCKET = 32


def values(n, seed=1):
    r = random.Random(seed * 1000 + n)
    return [r.choice([0, 1, 7, MAX, r.randrange(2**32)]) for _ in range(n)]


def scanned(v, inclusive):
    out, total = [], 0
    for x in v:
        out.append((total + x) % 2**32 if inclusive else total)
        total = (total + x) % 2**32
    return out


def runs(v):
    out = []
    for x in v:
        if out and out[-1][0] == x:
            out[-1][1] += 1
        else:
            out.append([x, 1])
    return [(i, a, b) for i, (a, b) in enumerate(out)]


@pytest.mark.parametrize("n", SIZES)
@pytest.mark.parametrize("strategy", ["window", "buckets"])
def test_scan_and_runs(spark, n, strategy):
    v = values(n)
    q = from_list(spark, v)
    for inclusive in (True, False):
        assert to_list(ops.scan(q, inclusive, strategy, BUCKET)) == scanned(v, inclusive)
    w = [x % 3 for x in v]
    got = ops.run_length_encode(from_list(spark, w), strategy, BUCKET).orderBy("run").collect()
    assert [tuple(r) for r in got] == runs(w)


@pytest.mark.parametrize("n", SIZES)
def test_reductions(spark, n):
    v = values(n)
    q = from_list(spark, v)
    assert ops.reduce(q).first()[0] == sum(v) % 2**32
    assert ops.reduce(q, "min").first()[0] == min(v, default=MAX)
    assert ops.reduce(q, "max").first()[0] == max(v, default=0)
    kv = list(zip(v, range(n)))
    assert tuple(ops.argmin_by_key(from_records(spark, kv)).first()) == min(kv, default=(MAX, MAX))


@pytest.mark.parametrize("n", SIZES)
def test_masks_and_compaction(spark, n):
    v = values(n)
    q = from_list(spark, v)
    for p, f in [(Equal(7), lambda x: x == 7), (NotEqual(7), lambda x: x != 7), (LessThan(7), lambda x: x < 7), (LessThanOrEqual(7), lambda x: x <= 7), (GreaterThan(7), lambda x: x > 7), (GreaterThanOrEqual(7), lambda x: x >= 7), (Between(1, 7), lambda x: 1 <= x <= 7), (Between(9, 3), lambda x: False), (~Equal(7) & GreaterThan(0), lambda x: x != 7 and x > 0)]:
        assert to_list(Pipeline(q).where(p).seq) == [x for x in v if f(x)]
    flags = [int(x % 2) for x in v]
    assert to_list(ops.compact_with(q, flags)) == [x for x in v if x % 2]


@pytest.mark.parametrize("n", SIZES)
@pytest.mark.parametrize("strategy", ["window", "buckets"])
def test_stable_sort(spark, n, strategy):
    kv = [(x % 5, i) for i, x in enumerate(values(n))]
    q = ops.sort(from_columns(spark, [k for k, _ in kv], [x for _, x in kv]))
    want = sorted(kv, key=lambda r: r[0])
    assert to_list(q) == want
    got = ops.dense(q, "rank", {"window": "window", "buckets": "range"}[strategy]).orderBy("rank").collect()
    assert [(r["rank"], r["key"], r["value"]) for r in got] == [(i, *r) for i, r in enumerate(want)]


@pytest.mark.parametrize("n", [0, 1, 4, 9, MAX])
def test_counted(spark, n):
    kv = [(7, 70), (2, 20), (2, 21), (1, 10), (0, 0)]
    q = from_records(spark, kv).counted(spark.createDataFrame([(n,)], "n long"))
    part = kv[:n]
    assert to_list(ops.sort(q)) == sorted(part, key=lambda r: r[0])
    assert tuple(ops.argmin_by_key(q).first()) == min(part, default=(MAX, MAX))
    assert q.count().first()[0] == len(part)


def test_literal_vectors(spark):
    q = from_list(spark, [4, 17, 9, 22, 11, 3])
    p = Pipeline(q)
    assert [r["mask"] for r in p.mask(GreaterThanOrEqual(10)).seq.df.orderBy("pos").collect()] == [0, 1, 0, 1, 1, 0]
    assert to_list(p.where(GreaterThanOrEqual(10)).seq) == [17, 22, 11]
    assert p.reduce().first()[0] == 66 and to_list(p.sort().seq) == [3, 4, 9, 11, 17, 22]
    assert to_list(ops.scan(from_list(spark, [3, 1, 4, 1]), False)) == [0, 3, 4, 8]
    assert to_list(ops.scan(from_list(spark, [MAX, 1, MAX, 2]))) == [MAX, 0, MAX, 1]
    assert ops.reduce(from_list(spark, [MAX, 2, MAX, 7])).first()[0] == 7
    assert [r["count"] for r in ops.histogram(from_list(spark, [0, 3, 1, 3, 7, 3, 9]), 8).orderBy("bin").collect()] == [1, 1, 0, 3, 0, 0, 0, 1]
    assert to_list(ops.sort(from_records(spark, list(zip([MAX, 0, MAX, 0, 1], range(5)))))) == [(0, 1), (0, 3), (1, 4), (MAX, 0), (MAX, 2)]
    got = Pipeline(from_list(spark, [5, 1, 5, 2, 2, 1, 9, 5])).sort().run_length_encode().orderBy("run").collect()
    assert [tuple(r) for r in got] == [(0, 1, 2), (1, 2, 2), (2, 5, 3), (3, 9, 1)]
    assert to_list(q.slice(2, 4)) == [9, 22]


def test_errors(spark):
    q = from_list(spark, [4])
    with pytest.raises(errors.InvalidKeyBits):
        ops.sort(from_list(spark, []), key_bits=33)
    with pytest.raises(errors.InvalidHistogramBinCount):
        ops.histogram(q, 257)
    with pytest.raises(errors.InvalidHistogramBinCount):
        ops.histogram(q, 0)
    with pytest.raises(errors.CompactionLengthMismatch):
        ops.compact_with(from_list(spark, [1, 2]), [1])
    with pytest.raises(errors.InvalidCompactionFlag):
        ops.compact_with(from_list(spark, [1, 2]), [1, 2])
    with pytest.raises(errors.RangeOutOfBounds):
        q.slice(0, 2)
    with pytest.raises(errors.ValueOutOfDomain):
        from_list(spark, [2**32])
    with pytest.raises(errors.UnorderedSequence):
        ops.scan(from_table(q.df, value="value"))
    for bad in (ops.sort(q, key_bits=2).df, ops.compact_with(q, from_list(spark, [1, 1])).df, from_table(spark.createDataFrame([(None,)], "v long"), value="v", validate=True).df):
        with pytest.raises(Exception, match="bits|lengths|outside"):
            bad.collect()


def test_plan_shapes(spark, monkeypatch):
    """Predicates reach the scan, a sort under a reduction is not run, sorted runs take no window over rows."""
    q = from_parquet(spark, "/root/testdata/sf0.001/events.parquet", value="user_id", order_by="event_id", dense=True)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    filtered = plan(Pipeline(q).where(Between(10, 40)).seq.df)
    assert "GreaterThanOrEqual(user_id,10)" in filtered and "ts" not in filtered.partition("ReadSchema")[2]
    assert "Sort [" not in plan(Pipeline(q).sort().reduce())
    assert "SinglePartition" not in plan(ops.run_length_encode(ops.sort(q), "buckets").drop("run"))
    assert "SinglePartition" in plan(ops.scan(q).df)
    monkeypatch.setattr("quern.order.SINGLE_BYTES", 1000)
    assert "hashpartitioning(__b" in plan(ops.scan(q).df)


def test_profile(spark):
    assert profile([]).spans == []
    got = profile([("two", from_list(spark, [1, 2]).df)])
    assert [(s.label, s.rows) for s in got.spans] == [("two", 2)] and got.elapsed > 0


def test_streaming(spark, tmp_path):
    to_parquet(from_list(spark, [4, 17, 9, 22, 11, 3]), str(tmp_path / "in"))
    q = from_table(spark.readStream.schema("pos long, value long").parquet(str(tmp_path / "in")), value="value")
    for name, df, mode, want in [("kept", compact_stream(q, GreaterThan(10)), "append", [(11,), (17,), (22,)]), ("total", reduce_stream(q), "complete", [(66,)]), ("bins", histogram_stream(q, 5), "complete", [(3, 1), (4, 1)])]:
        run = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        run.processAllAvailable()
        run.stop()
        assert sorted(tuple(r) for r in spark.table(name).collect()) == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, MAX), max_size=40))
def test_window_and_buckets_agree(spark, v):
    q = from_list(spark, v)
    assert to_list(ops.scan(q, True, "window")) == to_list(ops.scan(q, True, "buckets", 8)) == scanned(v, True)


CHAINS = {
    "where": lambda p, v, k: (p.where(GreaterThan(k)), [x for x in v if x > k]),
    "sort": lambda p, v, k: (p.sort(), sorted(v)),
    "scan": lambda p, v, k: (p.scan(), scanned(v, True)),
    "exclusive": lambda p, v, k: (p.scan(False), scanned(v, False)),
    "slice": lambda p, v, k: (p.slice(min(k, len(v)) // 2, min(k, len(v))), v[min(k, len(v)) // 2 : min(k, len(v))]),
    "counted": lambda p, v, k: (p.counted(p.seq.rows.sparkSession.createDataFrame([(k,)], "n long")), v[:k]),
    "with": lambda p, v, k: (Pipeline(ops.compact_with(p.seq, [int(i % 3 == k % 3) for i in range(len(v))])), [x for i, x in enumerate(v) if i % 3 == k % 3]),
}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.data_too_large])
@given(st.lists(st.integers(0, 9), max_size=12), st.lists(st.tuples(st.sampled_from(sorted(CHAINS)), st.integers(0, 9)), min_size=2, max_size=4), st.booleans())
def test_chains(spark, v, steps, by_range):
    """Random chains against lists, each also with new places given by range."""
    p = Pipeline(from_list(spark, v))
    for name, k in steps:
        p, v = CHAINS[name](p, v, k)
        if by_range:
            p = Pipeline(p.seq.reindexed("range"))
    assert to_list(p.seq) == v
    assert p.count().first()[0] == len(v) and p.reduce().first()[0] == sum(v) % 2**32
    got = ops.run_length_encode(p.seq).orderBy("run").collect()
    assert [tuple(r) for r in got] == runs(v)


def test_composition(spark):
    v = [5, 1, 3, 9, 2]
    p = Pipeline(from_list(spark, v))
    assert to_list(p.sort().scan().seq) == [1, 3, 6, 11, 20]
    assert to_list(p.sort().slice(0, 2).seq) == [1, 2]
    two = spark.createDataFrame([(2,)], "n long")
    assert to_list(p.sort().counted(two).seq) == [1, 2]
    assert to_list(p.where(GreaterThan(2)).counted(two).seq) == [5, 3]
    assert to_list(p.where(GreaterThan(2)).slice(1, 3).seq) == [3, 9]
    assert to_list(ops.compact_with(p.sort().seq, [1, 0, 0, 0, 1])) == [1, 9]
    assert to_list(ops.compact_with(p.seq, ops.sort(from_list(spark, [1, 0, 0, 1, 0])))) == [9, 2]
    assert [r["value"] for r in p.sort().seq.df.collect()] == [1, 2, 3, 5, 9]
    kv = from_records(spark, [(1, 8), (0, 8), (1, 7), (0, 7), (0, 8)])
    assert to_list(ops.sort(ops.sort(kv, "value"), "key")) == [(0, 7), (0, 8), (0, 8), (1, 7), (1, 8)]
    for f in (ops.run_length_encode, ops.scan):
        with pytest.raises(errors.PrimitiveError):
            f(kv)


def test_bounds_of_unknown_lengths(spark):
    q = from_table(spark.createDataFrame([(0, 7), (1, 8)], "p long, v long"), value="v", order_by="p", dense=True)
    assert to_list(q.slice(0, 2)) == [7, 8] and q.slice(1, 2).count().first()[0] == 1
    assert to_list(q.slice(2, 2)) == []
    for bad in (q.slice(0, 100).df, q.slice(0, 100).count(), Pipeline(q).where(Equal(7)).slice(0, 2).seq.df):
        with pytest.raises(Exception, match=r"0\.\.\d+ of"):
            bad.collect()
    assert q.counted(spark.createDataFrame([(9,)], "n long")).count().first()[0] == 2


@pytest.mark.parametrize("rows", [[(0, 5), (None, 3), (1, 5)], [(4, None), (7, 1), (9, None), (11, None)], [(None, None)]])
def test_nulls_are_alike_in_windows_and_ranges(spark, rows):
    q = from_table(spark.createDataFrame(rows, "p long, v long"), value="v", order_by="p")
    assert not q.dense
    for s in (q, ops.sort(q)):
        a, b = ([tuple(r) for r in ops.dense(s, "i", x).orderBy("i").collect()] for x in ("window", "range"))
        assert a == b and len(a) == len(rows)
    for f in (lambda x: ops.scan(q, strategy=x, bucket=2).df, lambda x: ops.run_length_encode(q, x, 2)):
        a, b = (sorted(map(str, f(x).collect())) for x in ("window", "buckets"))
        assert a == b
    with pytest.raises(Exception, match="null"):
        from_table(spark.createDataFrame(rows, "p long, v long"), value="v", order_by="p", validate=True).df.collect()


def test_one_shuffle_of_rows_gives_all_ranks(spark):
    """The range exchange is run once, whatever columns are asked for, and a hot key isn't a task of its own."""
    kv = [(7 if i % 3 else i % 50, i) for i in range(3000)]
    q = ops.sort(from_records(spark, kv))
    for columns in (["rank", "key", "value"], ["rank"]):
        got = ops.dense(q, "rank", "range").select(*columns)
        rows = got.orderBy("rank").collect()
        assert [r["rank"] for r in rows] == list(range(len(kv)))
        if len(columns) > 1:
            assert [tuple(r)[1:] for r in rows] == sorted(kv, key=lambda r: r[0])
        written = ops.dense(q, "rank", "range").select(*columns)
        written.collect()
        plan = written._jdf.queryExecution().executedPlan().toString()
        final = plan.partition("== Initial Plan ==")[0]
        assert len(re.findall(r"[+:]- Exchange rangepartitioning", final)) == 1 and "ReusedExchange" in final
    sizes = ops.dense(q, "rank", "range").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < len(kv) / 3


def test_profile_of_a_chain(spark):
    p = Pipeline(from_list(spark, [4, 17, 9, 22, 11, 3])).where(GreaterThanOrEqual(9)).sort()
    got = p.profile("run_length", ops.run_length_encode)
    assert [(s.label, s.rows) for s in got.spans] == [("predicate.mask", 6), ("compact.count", 1), ("compact.scatter", 4), ("sort.within", 4), ("run_length.mark", 4), ("run_length.finalize", 4)]
    assert all(s.duration > 0 and s.tasks > 0 for s in got.spans) and got.stage_time <= got.elapsed
    q = from_list(spark, list(range(100)))
    for step, labels in [(("scan", lambda s: ops.scan(s, strategy="buckets", bucket=8)), ["scan.level.0", "scan.level.1", "scan.add.0"]), (("sort", ops.sort), ["sort.range", "sort.within"]), (("histogram", lambda s: ops.histogram(s, 4)), ["histogram.count"]), (("run_length", lambda s: ops.run_length_encode(s, "buckets", 8)), ["run_length.mark", "run_length.scan.level.0", "run_length.finalize"])]:
        assert [s.label for s in profile_steps(q, [step], bucket=8, strategy="buckets").spans] == labels


@pytest.mark.parametrize("n", [0, 1, 2, 31, 32, 255, 257, 511])
@pytest.mark.parametrize("pattern", [lambda i: 7, lambda i: i, lambda i: i // 7, lambda i: 1 if 3 <= i % 9 <= 6 else 4])
def test_run_patterns(spark, n, pattern):
    v = [pattern(i) for i in range(n)]
    got = ops.run_length_encode(from_list(spark, v), "buckets", BUCKET).orderBy("run").collect()
    assert [tuple(r) for r in got] == runs(v)


def test_ranks_of_cached_rows(spark):
    """Above a cached table exchanges aren't shared: such rows are counted in buckets, to the same end."""
    kv = [(None if i % 50 == 0 else 7 if i % 3 else i % 40, i) for i in range(2000)]
    rows = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(kv)], "pos long, key long, value long").persist()
    try:
        q = Sequence(rows, ("key", "value"))
        for s in (ops.sort(q), ops.sort(ops.compact(q.with_df(rows.withColumn("mask", F.lit(1))))), ops.compact(q.with_df(rows.withColumn("mask", (F.col("pos") % 2).cast("int"))))):
            a, b = ([tuple(r) for r in ops.dense(s, "rank", how).orderBy("rank").collect()] for how in ("window", "range"))
            assert a == b and len(a) in (1000, 2000)
    finally:
        rows.unpersist()
