"""Host lists in, host lists out: each call checks its input, runs one plan and collects the result."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quern import operators as ops
from quern.errors import InvalidKeyBits, KeyExceedsBitRange
from quern.functions.predicates import Predicate
from quern.sources import from_list, from_records, to_list

Records = list[tuple[int, int]]


def _narrow(keys, bits: int) -> None:
    if not 0 <= bits <= 32:
        raise InvalidKeyBits(f"{bits} bits")
    wide = next((k for k in keys if k >> bits), None)
    if wide is not None:
        raise KeyExceedsBitRange(f"{wide} needs more than {bits} bits")


def mask(spark: SparkSession, values: list[int], predicate: Predicate) -> list[int]:
    return [r["mask"] for r in ops.mask(from_list(spark, values), predicate).rows.orderBy("pos").select("mask").collect()]


def mask_records(spark: SparkSession, records: Records, field: str, predicate: Predicate) -> list[int]:
    return [r["mask"] for r in ops.mask(from_records(spark, records), predicate, field).rows.orderBy("pos").select("mask").collect()]


def compact(spark: SparkSession, values: list[int], flags: list[int]) -> list[int]:
    return to_list(ops.compact_with(from_list(spark, values), flags))


def compact_records(spark: SparkSession, records: Records, flags: list[int]) -> Records:
    return to_list(ops.compact_with(from_records(spark, records), flags))


def scan(spark: SparkSession, values: list[int]) -> list[int]:
    return to_list(ops.scan(from_list(spark, values)))


def scan_exclusive(spark: SparkSession, values: list[int]) -> list[int]:
    return to_list(ops.scan(from_list(spark, values), inclusive=False))


def reduce(spark: SparkSession, values: list[int], op: str = "sum") -> int:
    return ops.reduce(from_list(spark, values), op).first()["value"]


def histogram(spark: SparkSession, values: list[int], bins: int) -> list[int]:
    return [r["count"] for r in ops.histogram(from_list(spark, values), bins).orderBy("bin").collect()]


def run_length_encode(spark: SparkSession, values: list[int]) -> tuple[list[int], list[int]]:
    rows = ops.run_length_encode(from_list(spark, values)).orderBy("run").collect()
    return [r["value"] for r in rows], [r["length"] for r in rows]


def sort(spark: SparkSession, values: list[int], key_bits: int = 32) -> list[int]:
    _narrow(values, key_bits)
    return to_list(ops.sort(from_list(spark, values)))


def sort_records(spark: SparkSession, records: Records, key_bits: int = 32) -> Records:
    _narrow([k for k, _ in records], key_bits)
    return to_list(ops.sort(from_records(spark, records)))


def argmin(spark: SparkSession, records: Records) -> tuple[int, int]:
    return tuple(ops.argmin_by_key(from_records(spark, records)).first())
