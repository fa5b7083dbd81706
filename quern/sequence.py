"""Sequences: a DataFrame whose order is an explicit ordinal column.

``pos`` orders the rows. A u32 sequence has (pos, value), a record sequence (pos, key, value).
Compaction leaves gaps in ``pos`` and a sort leaves it as it was; what depends on places gives new ordinals first.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.domain import U32_MAX
from quern.errors import ElementCountTooLarge, PrimitiveError, RangeOutOfBounds, UnorderedSequence
from quern.order import indexed, one_window


@dataclass(frozen=True)
class Fixed:
    """A length known on the driver."""

    n: int

    def __post_init__(self):
        if not 0 <= self.n <= U32_MAX:
            raise ElementCountTooLarge(f"{self.n} elements")


@dataclass(frozen=True)
class Lazy:
    """A length that only the cluster knows: a DataFrame of one row and one LONG column ``n``."""

    count: DataFrame


@dataclass(frozen=True)
class Sequence:
    #: In no particular order: what operators work on.
    rows: DataFrame
    fields: tuple[str, ...] = ("value",)
    extent: Fixed | Lazy | None = None
    capacity: int | None = None
    #: Field by which ``sort`` left the rows ordered; the order is that of (field, pos).
    sorted_by: str | None = None
    ordered: bool = True
    #: Whether pos counts the rows from 0, without gaps.
    dense: bool = True

    @property
    def is_records(self) -> bool:
        return self.fields == ("key", "value")

    @property
    def order(self) -> list[str]:
        return [self.sorted_by, "pos"] if self.sorted_by else ["pos"]

    @property
    def df(self) -> DataFrame:
        """The rows; after a sort, in order. Catalyst drops that sort under aggregates."""
        return self.rows.orderBy(*self.order) if self.sorted_by else self.rows

    def known_capacity(self) -> int | None:
        return self.extent.n if isinstance(self.extent, Fixed) else self.capacity

    def needs_order(self, what: str) -> None:
        if not self.ordered:
            raise UnorderedSequence(f"{what} needs an ordinal; build the sequence with order_by")

    def needs_values(self, what: str) -> None:
        if self.is_records:
            raise PrimitiveError(f"{what} takes a u32 sequence, not records")

    def with_df(self, rows: DataFrame, **changes) -> "Sequence":
        return replace(self, rows=rows, **changes)

    def reindexed(self, strategy: str = "auto") -> "Sequence":
        """The same elements with pos dense from 0 in the sequence's order; itself if that is so already.

        strategy: "window" (one task, if the rows fit one), "range" (one range shuffle), or "auto" by the known capacity or plan size.
        """
        self.needs_order("reindexed")
        if self.dense and not self.sorted_by:
            return self
        single = one_window(self.rows, self.known_capacity(), strategy)
        rows = indexed(self.rows, self.order, "__dst", single).drop("pos").withColumnRenamed("__dst", "pos")
        return self.with_df(rows.select("pos", *[c for c in self.rows.columns if c != "pos"]), sorted_by=None, dense=True)

    def slice(self, lo: int, hi: int) -> "Sequence":
        """Elements lo..hi-1, re-based to 0. hi beyond the length raises: at once if the length is known, else when
        rows or the count are read."""
        self.needs_order("slice")
        n = self.known_capacity()
        if lo < 0 or hi < lo or (n is not None and hi > n):
            raise RangeOutOfBounds(f"{lo}..{hi} of {n}")
        q = self.reindexed()
        inside = (F.col("pos") >= lo) & (F.col("pos") < hi)
        if isinstance(self.extent, Fixed):
            rows = q.rows.filter(inside).withColumn("pos", F.col("pos") - lo)
            return q.with_df(rows, extent=Fixed(hi - lo), capacity=hi - lo)
        short = F.raise_error(F.concat(F.lit(f"{lo}..{hi} of "), F.col("n").cast("string"))).cast("long")
        length = self.count().select(F.when(F.col("n") >= hi, F.lit(hi - lo).cast("long")).otherwise(short).alias("n"))
        # One row, by construction. The condition reads the length, so that it is checked wherever rows are read.
        rows = q.rows.filter(inside).crossJoin(F.broadcast(length.withColumnRenamed("n", "__n")))
        rows = rows.filter(F.col("pos") < F.lit(lo) + F.col("__n")).withColumn("pos", F.col("pos") - lo).drop("__n")
        return q.with_df(rows, extent=Lazy(length), capacity=hi - lo)

    def counted(self, count: DataFrame | Lazy, capacity: int | None = None) -> "Sequence":
        """The first min(count, capacity) elements; count stays on the cluster.

        count: one row, one LONG column (or a Lazy). The one-row side of the cross join is bounded by
        construction (a global aggregate or a limit of one), so it is broadcast.
        """
        self.needs_order("counted")
        n = count.count if isinstance(count, Lazy) else count
        n = n.select(F.col(n.columns[0]).cast("long").alias("__n")).limit(1)
        known = self.known_capacity()
        capacity = known if capacity is None else capacity if known is None else min(capacity, known)
        q = self.reindexed()
        rows = q.rows if capacity is None else q.rows.filter(F.col("pos") < capacity)
        rows = rows.crossJoin(F.broadcast(n)).filter(F.col("pos") < F.col("__n")).drop("__n")
        if isinstance(self.extent, Fixed):
            clamped = n.select(F.least("__n", F.lit(capacity)).alias("n"))
        else:  # only the rows tell how many there are
            clamped = rows.agg(F.count(F.lit(1)).alias("n"))
        return q.with_df(rows, extent=Lazy(clamped), capacity=capacity)

    def count(self) -> DataFrame:
        """One row, one LONG column ``n``: the logical length, evaluated when read."""
        if isinstance(self.extent, Lazy):
            return self.extent.count
        return self.rows.agg(F.count(F.lit(1)).alias("n"))

    def mapped(self, **columns: Column) -> "Sequence":
        """The same places with other fields, each from an expression over the old ones."""
        return self.with_df(self.rows.withColumns(columns))
