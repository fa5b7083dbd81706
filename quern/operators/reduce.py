"""Wrapping sum, minimum and maximum, with identities on empty input. One row, LONG ``value``."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.domain import MAX_IDENTITY, MIN_IDENTITY, wrapping_sum
from quern.errors import PrimitiveError
from quern.sequence import Sequence


def reduce(seq: Sequence, op: str = "sum") -> DataFrame:
    """A global aggregate: one partial row a task, whatever the order. op: "sum", "min" or "max"."""
    c = F.col("value")
    made = {"sum": lambda: wrapping_sum(c), "min": lambda: F.coalesce(F.min(c), F.lit(MIN_IDENTITY)), "max": lambda: F.coalesce(F.max(c), F.lit(MAX_IDENTITY))}
    if op not in made:
        raise PrimitiveError(f"unknown reduction {op}")
    return seq.rows.agg(made[op]().alias("value"))
