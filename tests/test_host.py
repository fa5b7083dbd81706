"""Host calls, shared counts and profiles."""

import pytest

from quern import errors, host
from quern import operators as ops
from quern.functions import Between, Equal, GreaterThanOrEqual
from quern.plans import CountPlan, Dispatch, Workspace, count_at, immediate, profile
from quern.sources import from_list, from_parquet, from_records, to_list, to_parquet

MAX = 2**32 - 1


def test_calls(spark):
    v, kv = [4, 17, 9, 22, 11, 3], [(3, 90), (7, 20), (7, 70), (1, 40)]
    assert host.mask(spark, v, GreaterThanOrEqual(10)) == [0, 1, 0, 1, 1, 0]
    assert host.mask_records(spark, kv, "key", Equal(7)) == [0, 1, 1, 0]
    assert host.mask_records(spark, kv, "value", Between(40, 70)) == [0, 0, 1, 1]
    assert host.compact(spark, [40, 10, 30, 20, 50, 60], [0, 1, 1, 0, 1, 0]) == [10, 30, 50]
    assert host.compact_records(spark, kv, [1, 0, 0, 1]) == [(3, 90), (1, 40)]
    assert host.scan(spark, [1] * 8) == list(range(1, 9)) and host.scan_exclusive(spark, [1] * 8) == list(range(8))
    assert host.reduce(spark, v) == 66 and host.reduce(spark, [], "min") == MAX and host.reduce(spark, [], "max") == 0
    assert host.histogram(spark, [0, 1, 1], 4) == [1, 2, 0, 0] and host.histogram(spark, [], 2) == [0, 0]
    assert host.run_length_encode(spark, [4, 4, 4, 1, 1, 7, 4, 4]) == ([4, 1, 7, 4], [3, 2, 1, 2])
    assert host.sort(spark, [MAX, 0, MAX, 1, 0, 42, 42]) == [0, 0, 1, 42, 42, MAX, MAX]
    assert host.sort_records(spark, kv, 3) == [(1, 40), (3, 90), (7, 20), (7, 70)]
    assert host.argmin(spark, [(7, 3), (7, 1)]) == (7, 1) and host.argmin(spark, []) == (MAX, MAX)
    with pytest.raises(errors.KeyExceedsBitRange):
        host.sort(spark, [4], 2)
    with pytest.raises(errors.InvalidKeyBits):
        host.sort(spark, [], 33)
    assert host.sort(spark, [0, 0], 0) == [0, 0]


@pytest.mark.parametrize("dispatch", list(Dispatch))
@pytest.mark.parametrize("n", [0, 3, 104])
def test_one_count_for_several_consumers(spark, dispatch, n):
    kv = [(5, 50), (1, 10), (3, 30), (1, 11)]
    meta = spark.createDataFrame([(9, n)], "other int, found int")
    held = CountPlan(count_at(meta, "found"), 4, dispatch).persisted()
    with held as plan:
        check_plan(spark, plan, kv, n, meta)
    assert not held.count.count.is_cached


def check_plan(spark, plan, kv, n, meta):
    q = plan.of(from_records(spark, kv))
    assert to_list(ops.sort(q)) == sorted(kv[:n], key=lambda r: r[0])
    assert tuple(ops.argmin_by_key(q).first()) == min(kv[:n], default=(MAX, MAX))
    assert plan.clamped().count.first()[0] == min(n, 4) and meta.first()["found"] == n
    r = plan.of(from_list(spark, [7, 7, 2, 9]))
    assert ops.reduce(r).first()[0] == sum([7, 7, 2, 9][:n])
    assert sum(x["length"] for x in ops.run_length_encode(r).collect()) == min(n, 4)


def test_files_and_modes(spark, tmp_path):
    path = str(tmp_path / "seq")
    to_parquet(ops.sort(from_list(spark, [3, 1, 2])), path)
    back = from_parquet(spark, path, value="value", order_by="pos", validate=True)
    assert to_list(back) == [1, 2, 3]
    with pytest.raises(errors.BufferTooSmall):
        to_parquet(from_list(spark, [1, 2]), path, capacity=1)
    kept = immediate(back.df)
    assert kept.is_cached and kept.count() == 3
    p = profile([("a", back.df), ("b", back.df.limit(1))])
    assert [(s.label, s.rows) for s in p.spans] == [("a", 3), ("b", 1)] and 0 < p.stage_time <= p.elapsed
    assert Workspace(30_000_000).also("sort", "scan").shuffle_partitions() == 6 and Workspace(9).shuffle_partitions() == 1
