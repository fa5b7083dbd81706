"""Lexicographic minimum (key, value); (MAX, MAX) on empty input."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.domain import U32_MAX
from quern.sequence import Sequence


def argmin_by_key(seq: Sequence) -> DataFrame:
    """One row (key, value). min(struct) breaks key ties by value, which min_by would not."""
    least = seq.rows.agg(F.min(F.struct("key", "value")).alias("m"))
    return least.select(F.coalesce("m.key", F.lit(U32_MAX)).alias("key"), F.coalesce("m.value", F.lit(U32_MAX)).alias("value"))
