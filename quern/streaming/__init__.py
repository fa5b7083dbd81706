"""The operators that need no order, on streaming DataFrames.

Masks and compactions are stateless; reductions and histograms keep one row, or one row a bin, of state.
Scans, run lengths and stable sorts need the whole order and aren't defined on an unbounded input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import operators as ops
from quern.errors import InvalidHistogramBinCount, PrimitiveError
from quern.functions.predicates import Predicate
from quern.operators.histogram import MAX_BINS
from quern.sequence import Sequence


def _streaming(seq: Sequence) -> Sequence:
    if not seq.rows.isStreaming:
        raise PrimitiveError("not a streaming DataFrame")
    return seq


def compact_stream(seq: Sequence, predicate: Predicate, field: str = "value") -> DataFrame:
    return ops.compact(ops.mask(_streaming(seq), predicate, field)).rows


def reduce_stream(seq: Sequence, op: str = "sum") -> DataFrame:
    """For output mode "complete" or "update"."""
    return ops.reduce(_streaming(seq), op)


def histogram_stream(seq: Sequence, bins: int) -> DataFrame:
    """Bins seen so far; a sink that needs zeros adds them."""
    if not 1 <= bins <= MAX_BINS:
        raise InvalidHistogramBinCount(f"{bins} bins")
    df = _streaming(seq).rows.filter(F.col("value") < bins)
    return df.groupBy(F.col("value").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
