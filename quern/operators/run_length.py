"""Adjacent run-length encoding: (run, value, length), runs from 0 in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.scan import REINDEX
from quern.order import BUCKET, bucket_of, indexed, one_window, running_sum
from quern.sequence import Sequence


def marked(seq: Sequence, strategy: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """(pos, value, __head): 1 where a run begins, that is where the predecessor differs.

    In buckets, the predecessor of a bucket's first row is the last row of the bucket before that isn't empty, taken
    from one summary row a bucket.
    """
    df = seq.rows.select("pos", "value")
    if one_window(df, seq.known_capacity(), strategy):
        before = F.lag("value").over(Window.orderBy("pos"))
        first = F.row_number().over(Window.orderBy("pos")) == 1
        return df.withColumn("__head", (first | ~before.eqNullSafe(F.col("value"))).cast("long"))
    df = df.withColumn("__k", bucket_of("pos", bucket))
    last = df.groupBy("__k").agg(F.max_by(F.struct("value"), F.coalesce("pos", F.lit(0))).alias("__last"))
    prior = last.select("__k", F.lag("__last").over(Window.orderBy("__k")).alias("__prior"))
    local = F.coalesce(F.lag(F.struct("value")).over(Window.partitionBy("__k").orderBy("pos")), F.col("__prior"))
    return df.join(prior, "__k").select("pos", "value", (~local.eqNullSafe(F.struct("value"))).cast("long").alias("__head"))


def run_length_encode(seq: Sequence, strategy: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """A sequence sorted by value needs no window over its rows: runs are its groups, ranked by value. Otherwise
    a row heads a run if its predecessor differs, and runs are numbered by the running count of heads."""
    seq.needs_order("run_length_encode")
    seq.needs_values("run_length_encode")
    if seq.sorted_by == "value":
        groups = seq.rows.groupBy("value").agg(F.count(F.lit(1)).alias("length"))
        single = one_window(groups, seq.known_capacity(), strategy)
        return indexed(groups, ["value"], "run", single).select("run", "value", "length")
    q = seq.reindexed(REINDEX[strategy])
    heads = marked(q, strategy, bucket)
    if one_window(q.rows, q.known_capacity(), strategy):
        w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        runs = heads.withColumn("run", F.sum("__head").over(w) - 1)
    else:
        runs = running_sum(heads, "pos", F.col("__head"), "run", bucket, True).withColumn("run", F.col("run") - 1)
    return runs.groupBy("run").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("length"))
