"""Places of a sequence's elements as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.order import indexed, one_window
from quern.sequence import Sequence


def dense(seq: Sequence, out: str = "dst", strategy: str = "auto") -> DataFrame:
    """The rows with their index in the sequence's order, from 0.

    strategy: "window" (one task, if the rows fit one), "range" (one range shuffle of the rows), or "auto". Dense ordinals that no sort
    has left behind are the index as they are.
    """
    seq.needs_order("dense")
    if seq.dense and not seq.sorted_by and strategy == "auto":
        return seq.rows.withColumn(out, F.col("pos"))
    return indexed(seq.rows, seq.order, out, one_window(seq.rows, seq.known_capacity(), strategy))
