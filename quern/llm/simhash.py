"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint's bit is 1 if more than half of its shingles' hashes have it set. Two fingerprints x and y at
distance 3 or less have a point m in the middle, at most 1 from one and at most 2 from the other. So each
fingerprint emits the points around it, points are shuffled, and fingerprints that meet are linked:

* All emit their ball of radius 1. Those that meet there are at most 2 apart, so all of a point's
  fingerprints are linked in a chain.
* Distances of 3 are between fingerprints of different parity. The even ones need radius 1 only; the odd
  ones emit radius 2. Of three differing bits two lie in the same half of the 64, so the 992 pairs of bits
  within halves do; the other 1024 points of that ball would only find the same links again.

Every link is found and each is verified by its distance. Distinct fingerprints only are emitted, so a group
of equal documents is one of them however large it is, and a point gathers at most 65 or 1,122 of them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Q, components, cut, dealt_anew, per_batch, row_id, stored

SEED = 42
WORDS = 3
RADIUS = 3
#: Bytes of text whose words are held at once.
BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _blocks(text: bytes):
    """The text in blocks of whole words."""
    at = 0
    while at < len(text):
        m = _SPACE.search(text, at + BLOCK)
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


def digests(text: bytes | None, words: int):
    """Digests of a text's shingles, in lists. Texts of fewer words than a shingle are one; null, empty and blank
    ones have none. Long texts are worked through in blocks."""
    n, held = 0, []
    for block in _blocks(text or b""):
        # bytes.lower() maps A-Z only; bytes.split() splits at \x20 and \x09-\x0d.
        held += block.lower().split()
        if len(held) < words:
            continue
        joined = b" ".join(held)
        size = np.fromiter(map(len, held), np.int64, len(held))
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size)[: len(held) - words + 1].tolist()
        yield [xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]
        n += len(starts)
        held = held[-(words - 1) :] if words > 1 else []
    if not n and held:
        yield [xxhash.xxh64_digest(b" ".join(held), SEED)]


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Of a text's bytes, as a signed 64-bit integer. Null, empty and blank texts have 0."""
    ones, n = np.zeros(64, np.int64), 0
    for some in digests(text, words):
        bits = np.frombuffer(b"".join(some), np.uint8).reshape(-1, 8)
        for i in range(0, len(bits), 1 << 14):
            ones += np.unpackbits(bits[i : i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int32)
        n += len(bits)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(row, id, fp) of every document; row numbers rows by their place in docs."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = pa.array([fingerprint(t) for t in b.column(2).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps], [f"{Q}row", f"{Q}id", f"{Q}fp"])

    cols = [row_id().alias(f"{Q}row"), F.col(id).cast("long").alias(f"{Q}id"), F.col(text).cast("binary").alias(f"{Q}text")]
    return per_batch(docs.select(*cols), f, f"{Q}row long, {Q}id long, {Q}fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Points of the smaller side that a task holds: 32 MB or so.
POINTS = 1 << 20


def links(fps: DataFrame, fp: str = f"{Q}fp") -> DataFrame:
    """(a, b): verified links that join what lies within 3 bits of each other. fps: distinct fingerprints, cut."""
    # The fingerprints are few bytes and their points many: each of these partitions emits its own, and so many
    # partitions meet at points that the table of one side's points, of one row each, fits a task. Points are spread
    # by their own bits, so that no task gets many more.
    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() * 65 // POINTS))
    fps = fps.repartition(n, fp)
    one = F.explode(F.array(*[F.lit(m).cast("long") for m in [0, *(_signed(1 << i) for i in range(64))]]))
    # A pair of bits i and j is the number 64 i + j. Rows hold it instead of the point, which it gives with the
    # fingerprint: rows then differ in two bytes from the one before, and compress to 7.5 bytes each.
    two = F.explode(F.array(*[F.lit(64 * i + j).cast("short") for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)]))

    def emit(df: DataFrame) -> DataFrame:
        return df.select(F.col(fp).alias("x"), one.alias("m")).select("x", F.col("x").bitwiseXOR(F.col("m")).alias("k"))

    even = F.bit_count(fp) % 2 == 0
    chain = emit(fps).selectExpr("x AS a", "k", "lag(x) OVER (PARTITION BY k ORDER BY x) AS b").filter("b IS NOT NULL")
    centres = emit(fps.filter(even)).repartition(n, "k").groupBy("k").agg(F.min("x").alias("b"))
    far = fps.filter(~even).select(F.col(fp).alias("a"), two.alias("ij"))
    point = F.expr("a ^ (shiftleft(1L, cast(ij AS int) >> 6) | shiftleft(1L, cast(ij AS int) & 63))")
    far = far.repartition(n, point).join(centres.hint("shuffle_hash"), point == F.col("k"))
    found = chain.select("a", "b").union(far.select("a", "b"))
    return found.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def grouped(fps: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """fps of with_fingerprints(), cut, with root: the least fingerprint (as a LONG) that its own reaches.
    more: (a, b) of fingerprints that are linked too."""
    distinct = cut(fps.select(f"{Q}fp").distinct(), fps)
    linked = links(distinct)
    roots = components(linked if more is None else linked.union(more), "a", "b", distinct).select(F.col("node").alias(f"{Q}fp"), F.col("root").alias(f"{Q}root"))
    # Fingerprints with links only: others are their own root. A hot fingerprint's rows can be split.
    return fps.join(roots, f"{Q}fp", "left").withColumn(f"{Q}root", F.coalesce(f"{Q}root", f"{Q}fp"))


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    Null texts count as empty; empty and blank ones have fingerprint zero and are linked like any other.
    Null ids keep their row and never name a component, unless all of its ids are null: then it is null.
    Repeated rows each keep theirs. An empty table gives an empty result.
    """
    docs = stored(docs)
    g = grouped(cut(with_fingerprints(docs, text, id), docs, f"{Q}row"))
    names = dealt_anew(g.groupBy(f"{Q}root").agg(F.min(f"{Q}id").alias(f"{Q}component")), f"{Q}root")
    digits = F.lower(F.lpad(F.hex(f"{Q}fp"), 16, "0"))
    return g.join(names, f"{Q}root").select(F.col(f"{Q}id").alias("doc_id"), digits.alias("fingerprint"), F.col(f"{Q}component").alias("component_id"))


def first_of_each(docs: DataFrame, g: DataFrame) -> DataFrame:
    """The row of docs with the least id of each of grouped()'s roots."""
    first = F.min(F.struct(F.col(f"{Q}id").isNull(), f"{Q}id", f"{Q}row"))[f"{Q}row"]
    keep = g.groupBy(f"{Q}root").agg(first.alias(f"{Q}row")).select(f"{Q}row")
    return docs.withColumn(f"{Q}row", row_id()).join(keep, f"{Q}row", "left_semi").drop(f"{Q}row")


def deduplicate(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """docs with one row of each component: that of the least id (null ids last), of equal ids the first row."""
    docs = stored(docs)
    return first_of_each(docs, grouped(cut(with_fingerprints(docs, text, id), docs, f"{Q}row")))
