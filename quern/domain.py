"""The u32 domain on LONG columns: bounds, identities and wrapping arithmetic.

Spark has no unsigned types and raises on overflow (ANSI), so every wrap is explicit.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the u32 domain.
U32_MOD = 4294967296
U32_MAX = 4294967295
SUM_IDENTITY = 0
MIN_IDENTITY = U32_MAX
MAX_IDENTITY = 0


def wrap(c: Column) -> Column:
    """c modulo 2^32, never negative."""
    return F.pmod(c, F.lit(U32_MOD))


def checked(c: Column, what: str = "value") -> Column:
    """c, or a runtime error where it is null or outside the domain.

    The check is folded into the column that is read: an unread assertion would be pruned.
    """
    return F.when(c.between(0, U32_MAX), c).otherwise(F.raise_error(F.lit(f"{what} is null or outside 0..{U32_MAX}")).cast("long"))


def wrapping_sum(c: Column) -> Column:
    """Sum modulo 2^32 of u32 values. The 16-bit halves can't overflow a LONG below 2^47 rows."""
    high = F.coalesce(F.sum(F.shiftright(c, 16)), F.lit(0))
    low = F.coalesce(F.sum(c.bitwiseAND(F.lit(65535))), F.lit(0))
    return wrap(F.pmod(high, F.lit(65536)) * 65536 + F.pmod(low, F.lit(U32_MOD)))
