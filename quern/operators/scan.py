"""Inclusive and exclusive prefix sums modulo 2^32."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.domain import wrap
from quern.order import BUCKET, one_window, running_sum
from quern.sequence import Sequence

#: How places are given anew for each way of scanning.
REINDEX = {"window": "window", "buckets": "range", "auto": "auto"}


def scan(seq: Sequence, inclusive: bool = True, strategy: str = "auto", bucket: int = BUCKET) -> Sequence:
    """strategy: "window" (one task, if the rows fit one), "buckets" (two-phase), or "auto" by the known capacity.

    The result has dense ordinals, whatever the input had. Running sums are carried as LONGs; below 2^31 elements
    they can't overflow, nor can the totals below 2^31 elements in all.
    """
    seq.needs_order("scan")
    seq.needs_values("scan")
    q = seq.reindexed(REINDEX[strategy])
    if one_window(q.rows, q.known_capacity(), strategy):
        w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        df = q.rows.withColumn("value", wrap(F.coalesce(F.sum("value").over(w), F.lit(0))))
    else:
        df = running_sum(q.rows, "pos", F.col("value"), "__sum", bucket, inclusive).withColumn("value", wrap(F.col("__sum")))
    return q.with_df(df.select("pos", "value"))
