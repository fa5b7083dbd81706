"""One lazy count for several consumers, and how their work is dealt out."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sequence import Lazy, Sequence


class Dispatch(Enum):
    """Scheduling only; results are the same."""

    #: Partitions follow the data at run time (adaptive execution coalesces them).
    INDIRECT = "indirect"
    #: Partitions follow the capacity: one for each of CAPACITY_ROWS rows that there may be.
    CAPACITY = "capacity"


CAPACITY_ROWS = 1 << 20


def count_at(metadata: DataFrame, column: str) -> Lazy:
    """A count held in one column of a one-row table of metadata."""
    return Lazy(metadata.select(F.col(column).cast("long").alias("n")))


@dataclass(frozen=True)
class CountPlan:
    """min(count, capacity), clamped once; the source count isn't changed."""

    count: Lazy
    capacity: int
    dispatch: Dispatch = Dispatch.INDIRECT

    def clamped(self) -> Lazy:
        return Lazy(self.count.count.select(F.least(F.col("n"), F.lit(self.capacity)).alias("n")))

    def persisted(self) -> "CountPlan":
        """For consumers in several actions: the one-row count is computed once. Used in a with statement, it is
        given back at the end; release() does that elsewhere."""
        return CountPlan(Lazy(self.count.count.persist()), self.capacity, self.dispatch)

    def release(self) -> None:
        self.count.count.unpersist()

    def __enter__(self) -> "CountPlan":
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def of(self, seq: Sequence) -> Sequence:
        """The counted prefix of a sequence."""
        out = seq.counted(self.count, self.capacity)
        if self.dispatch is Dispatch.CAPACITY:
            out = out.with_df(out.rows.repartition(max(1, -(-self.capacity // CAPACITY_ROWS)), "pos"))
        return out


#: Bytes a row that an operator sends through a shuffle of rows, for records of LONGs; others send none.
SHUFFLED = {"scan": 16, "run_length_encode": 16, "compact_with": 24, "sort": 24}
PARTITION_BYTES = 128 << 20


@dataclass(frozen=True)
class Workspace:
    """What a session should be sized for. Spark allocates by itself; the shuffle width is derived, from the
    operator that shuffles most."""

    capacity: int
    operators: frozenset[str] = frozenset()

    def also(self, *operators: str) -> "Workspace":
        return Workspace(self.capacity, self.operators | set(operators))

    def shuffled_bytes(self) -> int:
        return self.capacity * max((SHUFFLED.get(o, 0) for o in self.operators), default=0)

    def shuffle_partitions(self) -> int:
        return max(1, -(-self.shuffled_bytes() // PARTITION_BYTES))

    def reserve(self, spark: SparkSession) -> None:
        """Set the session's shuffle width to it, and never lower than it is."""
        key = "spark.sql.shuffle.partitions"
        spark.conf.set(key, str(max(self.shuffle_partitions(), int(spark.conf.get(key)))))
