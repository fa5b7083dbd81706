"""Running sums and indices over an ordinal, without a task that sees every row.

Small inputs take one window: there the extra exchange costs more than it saves. Otherwise a running sum cuts the
ordinal into buckets, and an index comes from one range shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ordinals a bucket spans.
BUCKET = 1 << 17
#: Known capacities up to this take one window; without one, estimated plan sizes up to that many bytes.
SINGLE_WINDOW, SINGLE_BYTES = 1 << 20, 16 << 20
#: Bucket of null ordinals, which come first as they do in a window.
NULLS = -(1 << 62)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size of the optimized plan: from file sizes, without running anything."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def one_window(rows: DataFrame, n: int | None, strategy: str) -> bool:
    """Whether the rows go through one task: not by "range" or "buckets", and by "window" or "auto" while they fit one.
    Rows of an unknown size don't."""
    if strategy not in ("auto", "window"):
        return False
    return n <= SINGLE_WINDOW if n is not None else estimated_bytes(rows) <= SINGLE_BYTES


def bucket_of(pos: str, bucket: int) -> Column:
    return F.coalesce(F.floor(F.col(pos) / bucket).cast("long"), F.lit(NULLS))


def bucket_totals(df: DataFrame, pos: str, amount: Column, bucket: int = BUCKET) -> DataFrame:
    """(__b, __t): the sum of amount in each bucket."""
    return df.groupBy(bucket_of(pos, bucket).alias("__b")).agg(F.sum(amount).alias("__t"))


def bucket_offsets(totals: DataFrame) -> DataFrame:
    """(__b, __o): the sum of all buckets before. One row a bucket goes through a single window."""
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))


def running_sum(df: DataFrame, pos: str, amount: Column, out: str, bucket: int = BUCKET, inclusive: bool = True, by: str | None = None) -> DataFrame:
    """df and the running sum of amount along pos, restarted for each value of by. pos: unique ordinals that are dense, or
    nearly so: a bucket then holds at most ``bucket`` rows, and there are few of them. Rows of a null ordinal come first."""
    if by:
        key = F.struct(by).alias("__g")  # a null is a value like others
        df = df.withColumns({"__g": key, "__b": bucket_of(pos, bucket), "__a": amount})
        totals = df.groupBy("__g", "__b").agg(F.sum("__a").alias("__t"))
        before = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select("__g", "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
        local = Window.partitionBy("__g", "__b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        summed = df.withColumn("__s", F.coalesce(F.sum("__a").over(local), F.lit(0))).join(offsets, ["__g", "__b"])
        return summed.withColumn(out, F.col("__s") + F.col("__o")).drop("__g", "__b", "__a", "__s", "__o")
    local = Window.partitionBy("__b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    offsets = bucket_offsets(bucket_totals(df, pos, amount, bucket))
    summed = df.withColumns({"__b": bucket_of(pos, bucket), "__a": amount}).withColumn("__s", F.coalesce(F.sum("__a").over(local), F.lit(0)))
    return summed.join(offsets, "__b").withColumn(out, F.col("__s") + F.col("__o")).drop("__b", "__a", "__s", "__o")


def asked_whole(df: DataFrame) -> DataFrame:
    """df under a condition that holds for every row. It can't be moved, folded or pruned and names every column, so
    whatever reads this table asks the same of the exchanges under it, and Spark runs those once."""
    return df.filter((F.monotonically_increasing_id() >= 0) | (F.xxhash64(*df.columns) == 0))


def dealt_by_range(df: DataFrame, by: list[str]) -> DataFrame:
    """df in spark.sql.shuffle.partitions ranges of the columns by, with one exchange for all its readers."""
    return asked_whole(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by))


def range_offsets(dealt: DataFrame) -> DataFrame:
    """(__p, __n, __o): rows of each partition and of all before it. A row a partition goes through one window."""
    sizes = dealt.groupBy(F.spark_partition_id().alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("__p", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))


def indexed_in_buckets(df: DataFrame, by: list[str], out: str, bucket: int = BUCKET) -> DataFrame:
    """The same as indexed() by running counts: of rows with smaller keys, and along the last column among equal ones."""
    one = F.lit(1).cast("long")
    if len(by) == 1:
        return running_sum(df, by[0], one, out, bucket, False)
    key, pos = by
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    sizes = running_sum(sizes, key, F.col("__n"), "__below", bucket, False).select(F.struct(key).alias("__k"), "__below")
    ranked = running_sum(df, pos, one, "__within", bucket, False, key).withColumn("__k", F.struct(key))
    return ranked.join(sizes, "__k").withColumn(out, F.col("__below") + F.col("__within")).drop("__k", "__below", "__within")


def _cached(df: DataFrame) -> bool:
    return "InMemoryRelation" in df._jdf.queryExecution().withCachedData().toString()


def indexed(df: DataFrame, by: list[str], out: str, single: bool) -> DataFrame:
    """df and each row's index in the order of the columns by, from 0; nulls come first.

    single: by one window. Rows of a cached table, above which Spark runs equal exchanges twice, are counted in buckets.
    Otherwise rows are shuffled once, by range, and sorted there; a row's index is its place
    in its partition after the sizes of those before. Keys may be hot, by is to be unique as a whole. An index is only
    given out while it is below its partition's counted size, so that ranges that didn't agree would raise.
    """
    if single:
        return df.withColumn(out, (F.row_number().over(Window.orderBy(*by)) - 1).cast("long"))
    if _cached(df):
        return indexed_in_buckets(df, by, out)
    dealt = dealt_by_range(df, by)
    at = dealt.sortWithinPartitions(*by).withColumn("__i", F.monotonically_increasing_id())
    at = at.withColumns({"__p": F.shiftright("__i", 33).cast("int"), "__i": F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))})
    index = F.when(F.col("__i") < F.col("__n"), F.col("__o") + F.col("__i")).otherwise(F.raise_error(F.lit("ranges were dealt differently")).cast("long"))
    return at.join(F.broadcast(range_offsets(dealt)), "__p", "left").withColumn(out, index).drop("__i", "__p", "__n", "__o")
