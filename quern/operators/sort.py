"""Stable ascending sorts. The rows stay where they are until something reads them in order: ``df``, sinks, ranks
and whatever depends on places. Reductions never pay for a sort."""

from pyspark.sql import functions as F

from quern.errors import InvalidKeyBits
from quern.sequence import Lazy, Sequence


def sort_field(seq: Sequence) -> str:
    """What a sort orders by unless told."""
    return "key" if seq.is_records else "value"


def key_width(seq: Sequence, by: str | None = None) -> Lazy:
    """The least key_bits that hold the field in every row, 32 at most: one aggregate over it, run when it is read."""
    most = F.max(by or sort_field(seq))
    bits = F.when(most > 0, F.least(F.length(F.bin(most)), F.lit(32))).otherwise(0)
    return Lazy(seq.rows.agg(bits.cast("long").alias("n")))


def sort(seq: Sequence, by: str | None = None, key_bits: int | Lazy = 32, validate: bool = True) -> Sequence:
    """Order by (field, place before). key_bits: a checked contract; wider keys raise when the rows are read. A Lazy one is
    known to the cluster only, as that of key_width()."""
    lazy = isinstance(key_bits, Lazy)
    if not lazy and not 0 <= key_bits <= 32:
        raise InvalidKeyBits(f"{key_bits} bits")
    seq.needs_order("sort")
    by = by or sort_field(seq)
    if seq.sorted_by not in (None, by):  # equal keys keep the order that the sort before gave them
        seq = seq.reindexed()
    df = seq.rows
    if validate and (lazy or key_bits < 32):
        c, bits = F.col(by), key_bits.count.scalar() if lazy else F.lit(key_bits)
        if lazy:
            bits = F.when(bits.between(0, 32), bits).otherwise(F.raise_error(F.concat(bits.cast("string"), F.lit(" bits"))).cast("long"))
        fits = c < F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int"))
        wide = F.raise_error(F.concat(F.lit(f"{by} needs more than "), bits.cast("string"), F.lit(" bits"))).cast("long")
        df = df.withColumn(by, F.when(fits, c).otherwise(wide))
    return seq.with_df(df, sorted_by=by)
