"""Where sequences come from and go to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.domain import U32_MAX, checked
from quern.errors import BufferTooSmall, ValueOutOfDomain
from quern.sequence import Fixed, Sequence


def _u32(x) -> int:
    if not isinstance(x, int) or isinstance(x, bool) or not 0 <= x <= U32_MAX:
        raise ValueOutOfDomain(repr(x))
    return x


def from_list(spark: SparkSession, values: list[int]) -> Sequence:
    """A u32 sequence of host values, checked here; its length is known."""
    rows = [(i, _u32(v)) for i, v in enumerate(values)]
    return Sequence(spark.createDataFrame(rows, "pos long, value long"), ("value",), Fixed(len(rows)), len(rows))


def from_records(spark: SparkSession, records: list[tuple[int, int]]) -> Sequence:
    """A record sequence of host (key, value) pairs."""
    rows = [(i, _u32(k), _u32(v)) for i, (k, v) in enumerate(records)]
    return Sequence(spark.createDataFrame(rows, "pos long, key long, value long"), ("key", "value"), Fixed(len(rows)), len(rows))


def from_columns(spark: SparkSession, keys: list[int], values: list[int]) -> Sequence:
    """Two parallel host columns; in Spark both layouts are one DataFrame."""
    return from_records(spark, list(zip(keys, values, strict=True)))


def from_table(
    df: DataFrame,
    value: str,
    key: str | None = None,
    order_by: str | None = None,
    capacity: int | None = None,
    validate: bool = False,
    dense: bool = False,
) -> Sequence:
    """A sequence over a table's columns.

    order_by: a unique ordinal; rows where it is null come first. Without it only order-free operators (mask, reduce,
    histogram, argmin) are allowed. dense: it counts the rows from 0 without gaps, which spares what depends on
    places the shuffle that numbers them.
    validate: raise at run time where an ordinal is null, or a value null or outside the domain. Off, values are
    trusted, so that predicates still reach the Parquet scan.
    """
    name = {"key": key, "value": value}
    cols = {k: F.col(c).cast("long") for k, c in name.items() if c is not None}
    pos = {"pos": F.col(order_by).cast("long")} if order_by else {}
    if validate:
        cols = {k: checked(c, k) for k, c in cols.items()}
        pos = {k: F.coalesce(c, F.raise_error(F.lit("null ordinal")).cast("long")) for k, c in pos.items()}
    rows = df.select(*(c.alias(k) for k, c in (pos | cols).items()))
    return Sequence(rows, ("key", "value") if key else ("value",), None, capacity, None, bool(order_by), dense)


def from_parquet(spark: SparkSession, path: str, **roles) -> Sequence:
    return from_table(spark.read.parquet(path), **roles)


def in_order(seq: Sequence) -> DataFrame:
    """The rows sorted as the sequence orders them."""
    seq.needs_order("in_order")
    return seq.rows.orderBy(*seq.order)


def to_list(seq: Sequence) -> list:
    """Host values, for sequences that fit the driver."""
    rows = in_order(seq).select(*seq.fields).collect()
    return [tuple(r) if seq.is_records else r[0] for r in rows]


def to_parquet(seq: Sequence, path: str, mode: str = "errorifexists", capacity: int | None = None) -> None:
    """Write in order, with ordinals dense from 0: range-partitioned files, sorted within, so that readers keep
    min/max pruning. Rows that get new ordinals are in that order already."""
    n = seq.known_capacity()
    if capacity is not None and n is not None and capacity < n:
        raise BufferTooSmall(f"{capacity} for {n}")
    placed = seq.reindexed()
    rows = placed.rows if placed is not seq else in_order(seq)
    rows.write.mode(mode).parquet(path)
