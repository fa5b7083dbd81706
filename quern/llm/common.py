"""What the operators share: cuts in the lineage, row ids, Arrow helpers and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Prefix of internal columns: extra columns of the caller's can't clash with them.
Q = "__quern_"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else what setCheckpointDir() was given.

    One of this machine's is made up only where neither is set and all runs on this machine, as in tests. Elsewhere
    that is an error: executors would each write to a disk of their own, and tables would be read back empty.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and spark.sparkContext._jsc.getCheckpointDir().isPresent():
        at = spark.sparkContext._jsc.getCheckpointDir().get()
    if not at:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        at = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def dealt_anew(df: DataFrame, *keys: str) -> DataFrame:
    """A small aggregate of one row for each of keys, on which it will be joined, dealt by a hash of them: the join then
    shuffles both of its sides for itself, and Spark can split a hot key's rows, as it can't while an aggregate holds
    them."""
    return df.repartition(F.xxhash64(*keys))


#: Folders that cut() has written and nobody has removed.
_written: set[str] = set()


def _in_hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size of a table, from its files; 0 where it has none, as of rows that the driver made."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def cut(df: DataFrame, narrow_of: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again. Lost executors lose nothing that is in it.

    The driver's JVM owns the table and removes it as it exits; drop() and discard() do so before.
    narrow_of: the table whose rows df has only a few bytes of each. A file a partition would be many tiny ones:
    there are as many as twice the cores, or one for each GiB of the table if that is more. by: a column of about
    unique values to deal them by, where making the rows is the work, which then keeps all its tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    if narrow_of is not None:
        n = min(1 << 20, max(2 * spark.sparkContext.defaultParallelism, estimated_bytes(narrow_of) >> 30))
        df = df.repartition(n, by) if by else df.coalesce(n)
    df.write.parquet(path)
    _written.add(path)
    files, at = _in_hadoop(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    files, at = _in_hadoop(spark, path)
    files.delete(at, True)
    files.cancelDeleteOnExit(at)
    _written.discard(path)


def drop(df: DataFrame) -> None:
    """Remove what cut() wrote, once nothing reads it any more."""
    _remove(df.sparkSession, df._quern_path)


def sweep(spark: SparkSession) -> None:
    """Have the driver's JVM look for plans that are gone. Spark removes the shuffle files of a plan only then, which a
    heap that isn't full puts off for long: for where a step's files would lie beside the next one's."""
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What cut() writes inside is removed at the end, but for the tables that are handed to the function it gives."""
    before, kept = set(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._quern_path)
        return df

    yield keep
    for path in _written - before - kept:
        _remove(spark, path)


#: The setting that row_id() pins, and what it was before in each session that has it pinned.
SPLITS = "spark.sql.files.minPartitionNum"
_pinned: list[SparkSession] = []


def discard(spark: SparkSession) -> None:
    """Remove all that cut() wrote in this process, and give back the setting that row_id() pins: for when the results
    that read those tables have been stored."""
    for path in list(_written):
        _remove(spark, path)
    while _pinned:
        _pinned.pop().conf.unset(SPLITS)


def _is_scan(df: DataFrame) -> bool:
    """Whether df only reads, filters and projects stored rows: then its rows come in the same places each time."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().apply(0)
    return bool(re.match("LogicalRelation|Relation|LocalRelation|LogicalRDD|Scan", node.nodeName()))


def stored(df: DataFrame) -> DataFrame:
    """df if it is a scan, as row_id() needs it, else a table of its rows."""
    return df if _is_scan(df) else cut(df)


def row_id() -> Column:
    """An id of the row by its place in the input files, the same each time they are read. The input must be stored().

    How Spark splits files depends on the number of cores that happen to be there, which lost executors change: so
    that number is pinned in the session until discard().
    """
    spark = SparkSession.getActiveSession()
    if spark.conf.get(SPLITS, None) is None:
        spark.conf.set(SPLITS, str(max(1, spark.sparkContext.defaultParallelism)))
        _pinned.append(spark)
    return F.monotonically_increasing_id()


#: Rows that Python objects are made of at once.
ROWS = 512


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def per_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """f over slices of Arrow batches. Memory is bounded by a batch, which the session limits in rows and bytes
    (spark.sql.execution.arrow.maxBytesPerBatch), and by the objects of a slice."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(f, slices(batches))

    return df.mapInArrow(over, schema)


def components(edges: DataFrame, a: str, b: str, nodes: DataFrame | None = None) -> DataFrame:
    """(node, root) of each node of an undirected graph of LONG ids, root the least id it reaches.

    Alternating large and small stars until nothing changes: about log(n) rounds, each two joins on the
    node that Spark can split where a hub is hot, and minima that are combined before the shuffle. Nothing
    is collected but a count and a checksum. Nodes without edges don't occur in the result. nodes: the table of
    the nodes, by whose size the edges are written.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), nodes)
    seen = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
        both = e.union(e.select("v", "u"))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(dealt_anew(m, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(dealt_anew(m, "u"), "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        e, old = cut(small, e), e
        drop(old)
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
