"""Order-preserving compaction: a filter. The ordinal stays, so the order does; the count stays lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import CompactionLengthMismatch, InvalidCompactionFlag
from quern.sequence import Fixed, Lazy, Sequence


def compact(seq: Sequence, flag: str = "mask", validate: bool = False) -> Sequence:
    """Rows whose flag is 1. validate: any flag but 0 and 1 is a runtime error instead of a dropped row."""
    c = F.col(flag)
    if validate:
        c = F.when(c.isin(0, 1), c).otherwise(F.raise_error(F.lit("mask flag is neither 0 nor 1")).cast("int"))
    cols = [x for x in ("pos", *seq.fields) if x in seq.rows.columns]
    df = seq.rows.filter(c == 1).select(*cols)
    return seq.with_df(df, extent=Lazy(df.agg(F.count(F.lit(1)).alias("n"))), capacity=seq.known_capacity(), dense=False)


def compact_with(seq: Sequence, mask: Sequence | list[int]) -> Sequence:
    """By a separate mask: another u32 sequence, or host flags (checked here). The flag at a place decides on the
    element at the same place, whatever sorts and compactions either has been through."""
    seq.needs_order("compact_with")
    seq = seq.reindexed()
    if isinstance(mask, list):
        n = seq.extent.n if isinstance(seq.extent, Fixed) else len(mask)
        if n != len(mask):
            raise CompactionLengthMismatch(f"{n} elements, {len(mask)} flags")
        bad = next(((i, f) for i, f in enumerate(mask) if f not in (0, 1)), None)
        if bad:
            raise InvalidCompactionFlag(f"flag {bad[1]} at {bad[0]}")
        flags = seq.rows.sparkSession.createDataFrame(list(enumerate(mask)), "pos long, mask int")
    else:
        flags = mask.reindexed().rows.select("pos", F.col("value").cast("int").alias("mask"))
    # A row without its counterpart is a length mismatch, which only execution can see.
    flags = flags.withColumn("__right", F.lit(1))
    both = seq.rows.withColumn("__left", F.lit(1)).join(flags, "pos", "full_outer")
    ok = F.col("__left").isNotNull() & F.col("__right").isNotNull()
    both = both.withColumn("mask", F.when(ok, F.col("mask")).otherwise(F.raise_error(F.lit("mask and input lengths differ")).cast("int")))
    return compact(seq.with_df(both.drop("__left", "__right")), validate=True)


def selected_count(seq: Sequence) -> DataFrame:
    """One row, LONG ``n``."""
    return seq.count()
