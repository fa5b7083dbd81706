"""Dense histograms: the value is the bin; values past the last bin are ignored; absent bins count 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import InvalidHistogramBinCount
from quern.sequence import Sequence

MAX_BINS = 256


def histogram(seq: Sequence, bins: int, max_bins: int | None = MAX_BINS) -> DataFrame:
    """(bin, count). max_bins=None lifts the limit. The counts side has one row a bin, joined to range(bins)."""
    if bins < 1 or (max_bins is not None and bins > max_bins):
        raise InvalidHistogramBinCount(f"{bins} bins; 1..{max_bins} allowed")
    counts = seq.rows.filter(F.col("value") < bins).groupBy(F.col("value").alias("bin")).agg(F.count(F.lit(1)).alias("__n"))
    every = seq.rows.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("__n", F.lit(0)).cast("long").alias("count"))
