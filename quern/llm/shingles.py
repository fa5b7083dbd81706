"""Near copies by the Jaccard similarity of their sets of word shingles, all of them.

A fingerprint's radius reaches texts that hardly differ: at a similarity of 0.8 two SimHash fingerprints of 64 bits
are about 10 bits apart, and balls of that radius can't be emitted. So sets are compared, in two steps:

* Most links are found at min-wise keys: BANDS of them, each of DEPTH values. Sets that agree in all values of a band
  meet at its key, where sets are ordered by their keys in the bands after it and each meets the BEFORE sets before it.
  This step only saves work: it joins what is alike in few pairs, however many sets a key has.
* What is left is decided by prefixes, between sets that aren't joined yet. With all shingles in one order, two sets
  of similarity 0.8 have a shingle in common among the first fifth of each, and the shorter one among its first ninth:
  all sets meet there, without a bound on how many. The order is rare shingles first, by counts that miss some. Any
  order finds all links; by this one sets of a common page meet only if they also share what few sets have.

Each pair that met is verified by the sets themselves. Equal sets are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm.common import Q, components, cut, drop, per_batch, row_id, slices, stored, sweep

WORDS = 5
#: The similarity as a fraction: lengths of prefixes are exact.
SHARED, OF = 4, 5
SIMILAR = SHARED / OF
BANDS, DEPTH, BEFORE = 24, 5, 16
#: Hashes that are permuted at once.
BLOCK = 1 << 12
#: Shingles that a task counts at once, how many of them must be equal to be sent on, and the most that are broadcast.
COUNTED, EQUAL, FREQUENT = 1 << 22, 3, 1 << 18
#: Sets that a task remembers, so as not to give them again.
MET = 1 << 18

_RANDOM = np.random.default_rng(simhash.SEED)
_TIMES = _RANDOM.integers(0, 1 << 63, (BANDS * DEPTH, 1), np.uint64) * 2 + 1
_PLUS = _RANDOM.integers(0, 1 << 63, (BANDS * DEPTH, 1), np.uint64)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order: of words as simhash.fingerprint() has them."""
    found = [x for some in simhash.digests(text, words) for x in some]
    return np.unique(np.frombuffer(b"".join(found), ">u8").astype(np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """Keys of a set, one a band, as signed 64-bit integers. The empty set has none."""
    if not len(hashes):
        return []
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[i : i + BLOCK] * _TIMES + _PLUS).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(v.tobytes(), k) - (1 << 63) for k, v in enumerate(least.reshape(BANDS, DEPTH))]


def with_bands(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(row, id, fp, set, n, bands) of every document: its SimHash fingerprint, and its set's hash, size and keys."""
    names = [f"{Q}row", f"{Q}id", f"{Q}fp", "set", "n", "bands"]

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(2).to_pylist()
        sets = [shingles(t) for t in texts]
        columns = [
            pa.array([simhash.fingerprint(t, WORDS) for t in texts], pa.int64()),
            pa.array([xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64()),
            pa.array(map(len, sets), pa.int32()),
            pa.array(map(bands, sets), pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names)

    cols = [row_id().alias(f"{Q}row"), F.col(id).cast("long").alias(f"{Q}id"), F.col(text).cast("binary").alias(f"{Q}text")]
    return per_batch(docs.select(*cols), f, f"{Q}row long, {Q}id long, {Q}fp long, set long, n int, bands array<long>")


def verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, text: str = "text") -> DataFrame:
    """Those of pairs whose sets x and y, of n_x and n_y shingles, are SIMILAR. rows: (set, row), a row of each set."""
    needed = pairs.select(F.col("x").alias("set")).union(pairs.select(F.col("y").alias("set"))).distinct()
    needed = rows.select("set", f"{Q}row").join(needed, "set")

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t).view(np.int64) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["set", "hashes"])

    texts = docs.select(row_id().alias(f"{Q}row"), F.col(text).cast("binary").alias(f"{Q}text"))
    sets = per_batch(texts.join(needed, f"{Q}row").select("set", f"{Q}text"), f, "set long, hashes array<long>")
    for side in "xy":
        pairs = pairs.join(sets.select(F.col("set").alias(side), F.col("hashes").alias(f"of_{side}")), side)
    both = F.size(F.array_intersect("of_x", "of_y"))
    return pairs.withColumn("both", both).filter(F.col("both") / (F.col("n_x") + F.col("n_y") - F.col("both")) >= SIMILAR)


def similar(docs: DataFrame, banded: DataFrame, text: str = "text") -> DataFrame:
    """(a, b): fingerprints of equal sets and of sets that met at a key and are SIMILAR. banded: with_bands(docs), cut.

    Pairs whose fingerprints are within simhash.RADIUS aren't made: simhash.links() joins them.
    """
    same = banded.groupBy("set").agg(F.min(f"{Q}fp").alias("a"), F.max(f"{Q}fp").alias("z"), F.min(f"{Q}row").alias(f"{Q}row"), F.first("n").alias("n"))
    mixed = same.filter("a <> z").select("set", "a")
    equal = banded.select("set", F.col(f"{Q}fp").alias("b")).distinct().join(mixed, "set").select("a", "b").filter("a <> b")

    one = banded.groupBy("set").agg(F.first("bands").alias("bands"))
    keyed = one.select("set", "bands", F.posexplode("bands").alias("k", "key"))
    keyed = keyed.select("key", "set", *(F.expr(f"cast(shiftright(element_at(bands, (k + {i}) % {BANDS} + 1), 32) AS int)").alias(f"o{i}") for i in (1, 2)))
    pairs = keyed.selectExpr("set AS y", f"collect_list(set) OVER (PARTITION BY key ORDER BY o1, o2, set ROWS BETWEEN {BEFORE} PRECEDING AND 1 PRECEDING) AS xs")
    pairs = pairs.filter("size(xs) > 0").select("y", F.explode("xs").alias("x")).distinct()
    for side in "xy":
        pairs = pairs.join(same.select(F.col("set").alias(side), F.col("a").alias(f"fp_{side}"), F.col("n").alias(f"n_{side}")), side)
    far = F.bit_count(F.col("fp_x").bitwiseXOR(F.col("fp_y"))) > simhash.RADIUS
    pairs = cut(pairs.filter(far & (F.least("n_x", "n_y") / F.greatest("n_x", "n_y") >= SIMILAR)), banded)
    sweep(docs.sparkSession)
    return equal.union(verified(docs, same, pairs, text).selectExpr("fp_x AS a", "fp_y AS b"))


def _each_set(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """A hash and the shingles of the sets that batches of texts have, but for repeated ones that the task remembers.
    The empty set has no partner but itself."""
    met: set[int] = set()
    for b in slices(batches):
        for t in b.column(0).to_pylist():
            hashes = shingles(t)
            name = xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)
            if len(hashes) and name not in met:
                if len(met) == MET:
                    met.clear()
                met.add(name)
                yield name, hashes


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ascending, and their counts, from all of texts. Tasks count COUNTED shingles at a time and send
    those on that occur EQUAL times among them: counts may be too small, and decide about work only."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            most = n >= EQUAL
            return pa.RecordBatch.from_arrays([pa.array(values[most].view(np.int64)), pa.array(n[most])], ["shingle", "n"])

        held, size = [], 0
        for _, hashes in _each_set(batches):
            held.append(hashes)
            size += len(hashes)
            if size >= COUNTED:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    found = texts.mapInArrow(over, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    table = found.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    values, n = (table[c].to_numpy() for c in ("shingle", "n"))
    at = np.argsort(values.view(np.uint64))
    return values.view(np.uint64)[at], n[at]


def prefix(hashes: np.ndarray, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, in the order of all: by their counts, those without one first, then by themselves.
    As many as one must be in common with any set that is SIMILAR."""
    n = np.zeros(len(hashes), np.int64)
    if len(values):
        at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
        n = np.where(values[at] == hashes, counts[at], 0)
    return hashes[np.argsort(n, kind="stable")[: len(hashes) + 1 + -SHARED * len(hashes) // OF]]


def with_prefixes(texts: DataFrame) -> DataFrame:
    """(shingle, set, n, p) of each shingle of the prefix of every set of n shingles; p: its place, from 0. Sets may repeat."""
    order = texts.sparkSession.sparkContext.broadcast(frequent(texts))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, hashes in _each_set(batches):
            first = prefix(hashes, *order.value)
            for i in range(0, len(first), BLOCK):
                some = first[i : i + BLOCK].view(np.int64)
                columns = [some, np.full(len(some), name), np.full(len(some), len(hashes), np.int32), np.arange(i, i + len(some), dtype=np.int32)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["shingle", "set", "n", "p"])

    return texts.mapInArrow(over, "shingle long, set long, n int, p int")


def remaining(docs: DataFrame, g: DataFrame, text: str = "text") -> DataFrame:
    """(a, b): roots that are joined by sets which are SIMILAR, all of them. g: (row, set, root) of docs, cut."""
    texts = docs.select(F.col(text).cast("binary").alias(f"{Q}text"))
    # Of two sets, the one of fewer shingles has so many in common with the other that the first one is among these.
    short = F.expr(f"{SHARED + OF}L * (n - p) >= {2 * SHARED}L * n")
    of = "OVER (PARTITION BY shingle)"
    met = with_prefixes(texts).withColumn("short", short).repartition("shingle")
    met = met.selectExpr("*", f"min(set) {of} AS least", f"max(set) {of} AS greatest", f"max(short) {of} AS some")
    met = cut(met.filter("some AND least <> greatest").select("shingle", "set", "n", "p", "short").distinct(), docs, "shingle")
    sweep(docs.sparkSession)

    one = g.groupBy("set").agg(F.first(f"{Q}root").alias("root"), F.min(f"{Q}row").alias(f"{Q}row"))
    of_root = met.join(one.select("set", "root"), "set").groupBy("shingle", "root")
    # Lists by root: what is joined already isn't paired, however much it is.
    x = of_root.agg(F.expr("collect_list(struct(set, n, p)) FILTER (WHERE short)").alias("xs")).filter("size(xs) > 0").withColumnRenamed("root", "a")
    y = of_root.agg(F.expr("collect_list(struct(set, n, p))").alias("ys")).withColumnRenamed("root", "b")
    pairs = x.join(y, "shingle").filter("a <> b").select("a", "b", F.explode("xs").alias("x"), "ys").select("a", "b", "x", F.explode("ys").alias("y"))
    pairs = pairs.filter("x.n < y.n OR x.n = y.n AND x.set < y.set").filter(f"{SHARED + OF}L * least(x.n - x.p, y.n - y.p) >= {SHARED}L * (x.n + y.n)")
    pairs = cut(pairs.selectExpr("a", "b", "x.set AS x", "y.set AS y", "x.n AS n_x", "y.n AS n_y").distinct(), docs)
    drop(met)
    sweep(docs.sparkSession)
    return verified(docs, one, pairs, text).select("a", "b")


def deduplicate(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """docs with one row of each component of SIMILAR texts and of texts with fingerprints, of WORDS words a shingle,
    within simhash.RADIUS: the row of the least id (null ids last), of equal ids the first."""
    docs = stored(docs)
    banded = cut(with_bands(docs, text, id), docs, f"{Q}row")
    g = cut(simhash.grouped(banded.select(f"{Q}row", f"{Q}id", f"{Q}fp", "set"), similar(docs, banded, text)), banded)
    sweep(docs.sparkSession)
    roots = components(remaining(docs, g, text), "a", "b", banded).select(F.col("node").alias(f"{Q}root"), F.col("root").alias(f"{Q}least"))
    g = g.join(roots, f"{Q}root", "left").withColumn(f"{Q}root", F.coalesce(f"{Q}least", f"{Q}root"))
    return simhash.first_of_each(docs, g)
