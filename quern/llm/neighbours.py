"""Approximate nearest neighbours by a hash-prefix forest.

A tree is a sorted array of long bit strings: on which sides of random hyperplanes a vector lies. A query goes
down each tree to the longest prefix that it shares with anything there, which is a place in the array; then
all trees go up together, one bit at a time, and what shares the shorter prefix is a wider range around that
place. The ascent ends at the first prefix length at which the ranges hold enough entries. What is in them is ranked
by its exact distance.

Each tree is built once, over all vectors, and lies in pages: the entries that share a first few bits. A query meets
one page of each tree, counts there how many entries share each longer prefix with it, and the counts of all trees
give the length at which its ascent ends; a query that its pages don't hold enough for goes on in pages of half as many
bits. Then the entries of that length are its candidates, and its vector is sent only to the shards that hold some. So
the work grows with queries times the entries gathered.

How many entries are enough is fitted on a bounded sample of queries and vectors. Where vectors have structure, that is
a few dozen a tree, however many vectors there are. Vectors without any (whose distances concentrate) take a fixed
share of all, by this as by any other method; where it is over 1/FEW of them, sending a row for each candidate costs more
than meeting all shards, so each shard of vectors gets a forest of its own then, in which each query descends and ascends
by itself, to its share of the entries.

No task holds more than a part of a page, or of a shard: crowded pages are dealt to parts, their queries likewise,
until a task makes at most PAIRS. Nothing that grows with the data is broadcast. Equal vectors are one entry: of a
group only the few least ids can be among anyone's nearest, so a hot vector is small too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Q, cut, scratch

TREES, BITS, SEED = 80, 32, 5
#: The sample that the ascent is fitted on: queries, whose nearest are found by comparing all, and vectors; the share of
#: the nearest that it is to gather there; entries a tree that it always gathers.
FIT_QUERIES, FIT_VECTORS, RECALL, LEAST = 128, 4_096, 0.95, 30
#: Entries of a page, vectors of a shard, pairs of a query and an entry that a task makes, bytes of queries in a shard.
PAGE, SHARD, PAIRS, QUERY_BYTES = 32_768, 8_192, 1 << 22, 1 << 26
#: Candidates are sent as rows where they are at most 1/FEW of all vectors; else blocks of about BLOCK queries meet shards.
FEW, BLOCK = 4, 16_384
LEVELS = [f"n{i}" for i in range(BITS + 1)]


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dim, TREES * BITS))


@dataclass(frozen=True)
class Hashing:
    """Bit strings of vectors, around the centre of a sample of each length."""

    centres: dict[int, np.ndarray]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, TREES) as integers, first bit highest."""
        out, planes = np.empty((len(x), TREES), np.uint32), _planes(x.shape[1])
        x = x - self.centres.get(x.shape[1], 0.0)
        for t in range(TREES):
            out[:, t] = np.packbits(x @ planes[:, t * BITS : (t + 1) * BITS] > 0, axis=1).view(">u4")[:, 0]
        return out


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the prefixes that codes share."""
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


def _usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part, components as doubles."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(v, lambda x: x == 0)
    return df.filter(F.col(vector).isNotNull() & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), v.alias("v")).filter(~bad & ~zero & (F.size("v") > 0))


def by_length(v: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length."""
    size, flat, ends = v.value_lengths().to_numpy(), v.flatten().to_numpy(), None
    out = {}
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        if len(at) == len(size):
            out[dim] = at, flat.reshape(-1, dim)
        else:
            ends = np.cumsum(size) if ends is None else ends
            out[dim] = at, flat[(ends[at] - dim)[:, None] + np.arange(dim)]
    return out


def _list(v: list) -> pa.ListArray:
    return pa.array(v, pa.list_(pa.float64()))


def fitted(groups: DataFrame, queries: DataFrame, n: int, k: int, recall: float) -> tuple[Hashing, float]:
    """The hashing, and the entries a tree that gather the share recall of a sample's nearest."""
    some = groups.orderBy(F.xxhash64("rep"), "rep").limit(FIT_VECTORS).select("v").collect()
    vectors = by_length(_list([r["v"] for r in some]))
    hashing = Hashing({dim: x.mean(axis=0) for dim, (_, x) in vectors.items()})
    asked = by_length(_list([r["v"] for r in queries.orderBy(F.xxhash64("query"), "query").limit(FIT_QUERIES).select("v").collect()]))
    if not asked:
        return hashing, float(LEAST)

    def over(batches):
        best: dict = {}
        for b in batches:
            for dim, (_, x) in by_length(b.column(0)).items():
                for i, q in enumerate(asked[dim][1] if dim in asked else ()):
                    d = ((x - q) ** 2).sum(axis=1)
                    near = np.argpartition(d, min(k, len(d) - 1))[: k + 1]
                    best[dim, i] = sorted([*best.get((dim, i), []), *((float(d[j]), x[j].tolist()) for j in near)])[: k + 1]
        rows = [(dim, i, d, v) for (dim, i), found in best.items() for d, v in found]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], ["dim", "i", "d", "v"])

    found = groups.select("v").mapInArrow(over, "dim int, i int, d double, v array<double>")
    place = F.row_number().over(Window.partitionBy("dim", "i").orderBy("d", "v"))
    found = found.withColumn("at", place).filter(F.col("at").between(2, k + 1)).collect()  # the first is the query itself
    shared, held = [], []
    for dim, (_, q) in asked.items():
        mine = hashing.codes(q)
        for r in (r for r in found if r["dim"] == dim):
            shared.append(shared_bits(mine[r["i"]], hashing.codes(np.array([r["v"]]))[0]).max())
        if dim in vectors:
            others = hashing.codes(vectors[dim][1])
            held += [np.bincount(shared_bits(m, others).ravel(), minlength=BITS + 1)[::-1].cumsum()[::-1] for m in mine]
    level = max((i for i in range(BITS + 1) if np.mean(np.array(shared) >= i) >= recall), default=0) if shared else 0
    typical = float(np.median([h[level] for h in held])) / TREES * n / max(1, len(some)) if held else 0.0
    return hashing, max(float(LEAST), typical)


def entries(df: DataFrame, hashing: Hashing, name: str) -> DataFrame:
    """(dim, tree, code, name): a row of each vector in each tree. df: (name, v)."""

    def over(batches):
        for b in batches:
            names = b.column(0).to_numpy()
            for dim, (at, x) in by_length(b.column(1)).items():
                codes = hashing.codes(x)
                columns = [np.full(codes.size, dim, np.int32), np.tile(np.arange(TREES, dtype=np.int16), len(x)), codes.ravel().astype(np.int64), np.repeat(names[at], TREES)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "tree", "code", name])

    return df.select(name, "v").mapInArrow(over, f"dim int, tree short, code long, {name} long")


_KEYS = ["dim", "tree", "page"]


def paged(arrays: DataFrame, asked: DataFrame, bits: int, most: int, pairs: int) -> tuple[DataFrame, DataFrame]:
    """Entries and queries with the page of each, and the parts of crowded pages: no part has more than most entries
    (about), nor more pairs of an entry and a query."""
    page = F.shiftright("code", BITS - bits).alias("page")
    arrays, asked = arrays.select("*", page), asked.select("*", page)
    sizes = arrays.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("e")).join(asked.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("q")), _KEYS)
    crowded = sizes.select(*_KEYS, F.ceil(F.col("e") / most).cast("int").alias("es"), F.ceil(F.col("q") * F.least("e", F.lit(most)) / pairs).cast("int").alias("qs")).filter("es > 1 OR qs > 1")
    crowded = cut(crowded, arrays)
    if crowded.isEmpty():
        return arrays.withColumns({"ep": F.lit(0), "qp": F.lit(0)}), asked.withColumns({"ep": F.lit(0), "qp": F.lit(0)})

    def own(name: str, n: str):
        return F.expr(f"cast(pmod(xxhash64({name}), coalesce({n}, 1)) AS int)")

    def each(n: str):
        return F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))

    left, right = arrays.join(crowded, _KEYS, "left"), asked.join(crowded, _KEYS, "left")
    return left.withColumn("ep", own("rep", "es")).withColumn("qp", each("qs")), right.withColumn("qp", own("query", "qs")).withColumn("ep", each("es"))


def _count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """For each query, entries that share a prefix of each length with it."""
    codes, asked = np.sort(left["code"].to_numpy()), right["code"].to_numpy()
    out = {"query": right["query"].to_numpy()}
    for i, name in enumerate(LEVELS):
        rest = (1 << (BITS - i)) - 1
        out[name] = np.searchsorted(codes, asked | rest, "right") - np.searchsorted(codes, asked & ~rest, "left")
    return pd.DataFrame(out)


def _gather(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a query and an entry that shares a prefix of the query's length."""
    order = np.argsort(left["code"].to_numpy(), kind="stable")
    codes, reps, asked = left["code"].to_numpy()[order], left["rep"].to_numpy()[order], right["code"].to_numpy()
    rest = (np.int64(1) << (BITS - right["level"].to_numpy().astype(np.int64))) - 1
    lo, hi = np.searchsorted(codes, asked & ~rest, "left"), np.searchsorted(codes, asked | rest, "right")
    size = hi - lo
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
    return pd.DataFrame({"query": np.repeat(right["query"].to_numpy(), size), "rep": reps[at]})


def candidates(arrays: DataFrame, asked: DataFrame, n: int, enough: float, page: int, pairs: int) -> tuple[DataFrame, int]:
    """(query, rep) of all queries' candidates, each once, and a bound of their number.

    enough: entries in all trees together at which an ascent ends. Where pages don't hold them the ascent goes on in
    pages of half as many bits, and ends with whole trees.
    """
    bits = max(0, min(int(np.ceil(np.log2(max(1, n / page)))), int(np.log2(max(1.0, n * TREES / (4 * enough))))))
    found, made = None, 0
    while True:
        left, right = paged(arrays, asked, bits, page, pairs)
        keys = [*_KEYS, "ep", "qp"]
        counts = left.select(*keys, "code").groupBy(*keys).cogroup(right.select(*keys, "code", "query").groupBy(*keys))
        counts = counts.applyInPandas(_count, "query long, " + ", ".join(f"{c} long" for c in LEVELS))
        counts = counts.groupBy("query").agg(*(F.sum(c).alias(c) for c in LEVELS))
        level = F.coalesce(*(F.when(F.col(LEVELS[i]) >= enough, F.lit(i)) for i in range(BITS, bits - 1, -1)), F.lit(-1) if bits else F.lit(0))
        held = F.element_at(F.array(*LEVELS), F.greatest(F.col("level"), F.lit(0)) + 1)
        levels = cut(counts.select("query", *LEVELS, level.alias("level")).select("query", "level", held.alias("held")), arrays)
        made += levels.filter("level >= 0").agg(F.sum("held")).first()[0] or 0
        ends = right.join(levels.filter("level >= 0").select("query", "level"), "query")
        pair = left.select(*keys, "code", "rep").groupBy(*keys).cogroup(ends.select(*keys, "code", "query", "level").groupBy(*keys))
        pair = pair.applyInPandas(_gather, "query long, rep long")
        found = pair if found is None else found.union(pair)
        if bits == 0:
            return found.distinct(), made
        # Queries of empty pages have no counts at all.
        asked = cut(asked.join(levels.filter("level >= 0").select("query"), "query", "left_anti"), asked)
        if asked.isEmpty():
            return found.distinct(), made
        bits //= 2


def ranked(groups: DataFrame, queries: DataFrame, pairs: DataFrame, shards: int, blocks: int, k: int) -> DataFrame:
    """(query, vec_id, score) of each query's k nearest in each shard, of its candidates."""
    shard = F.pmod(F.xxhash64("rep"), F.lit(shards)).alias("shard")
    block = F.pmod(F.xxhash64("query", F.lit(1)), F.lit(blocks)).alias("block")
    lists = pairs.groupBy("query", shard).agg(F.collect_list("rep").alias("reps"))
    right = lists.join(queries, "query").select("shard", block, "query", "v", "reps")
    left = groups.select(shard, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "rep", "v", "ids")

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            order = np.argsort(left["rep"].to_numpy())
            reps, ids = left["rep"].to_numpy()[order], left["ids"].to_list()
            row, matrix = np.zeros(len(left), np.int64), {}
            for dim, (at, x) in by_length(_list(left["v"].to_list())).items():
                row[at], matrix[dim] = np.arange(len(at)), x
            for q, v, some in zip(right["query"].tolist(), right["v"], right["reps"]):
                at = order[np.searchsorted(reps, some)]
                d = np.sqrt(((matrix[len(v)][row[at]] - np.asarray(v, float)) ** 2).sum(axis=1))
                if len(d) > k:
                    near = d <= np.partition(d, k - 1)[k - 1]
                    at, d = at[near], d[near]
                best = sorted((s, i) for r, s in zip(at.tolist(), d.tolist()) for i in ids[r])[:k]
                out["query"] += [q] * len(best)
                out["vec_id"] += [i for _, i in best]
                out["score"] += [s for s, _ in best]
        return pd.DataFrame(out)

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(rank, "query long, vec_id long, score double")


def scanned(groups: DataFrame, queries: DataFrame, hashing: Hashing, enough: float, shards: int, blocks: int, k: int) -> DataFrame:
    """(query, vec_id, score) of each query's k nearest in each shard, by a forest of the shard's vectors. enough: entries
    in all of its trees together at which an ascent ends."""

    def each(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = groups.select(F.pmod(F.xxhash64("rep"), F.lit(shards)).alias("shard"), each(blocks).alias("block"), "v", "ids")
    right = queries.select(each(shards).alias("shard"), F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block"), "query", "v")

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "vec_id": [], "score": []}
        mine, asked = (by_length(_list(x["v"].to_list())) for x in (left, right))
        for dim in asked.keys() & mine.keys():
            (at, x), (of, q) = mine[dim], asked[dim]
            ids, names = [left["ids"].iloc[i] for i in at], right["query"].to_numpy()[of]
            codes, goal = hashing.codes(x), hashing.codes(q)
            order = np.argsort(codes, axis=0, kind="stable")
            codes = np.take_along_axis(codes, order, axis=0)
            lo, hi = np.zeros((2, TREES, len(q)), np.int64)
            open_ = np.arange(len(q))
            for length in range(BITS, -1, -1):  # from the longest prefixes up, in all trees at once
                rest = np.uint32((1 << (BITS - length)) - 1)
                for t in range(TREES):
                    c = goal[open_, t]
                    lo[t, open_] = np.searchsorted(codes[:, t], c & ~rest, "left")
                    hi[t, open_] = np.searchsorted(codes[:, t], c | rest, "right")
                open_ = open_[(hi - lo)[:, open_].sum(axis=0) < enough]
                if not len(open_):
                    break
            for i, v in enumerate(q):
                seen = np.zeros(len(x), bool)
                for t in range(TREES):
                    seen[order[lo[t, i] : hi[t, i], t]] = True
                rows = np.flatnonzero(seen)
                d = np.sqrt(((x[rows] - v) ** 2).sum(axis=1))
                if len(d) > k:
                    near = d <= np.partition(d, k - 1)[k - 1]
                    rows, d = rows[near], d[near]
                best = sorted((s, n) for r, s in zip(rows.tolist(), d.tolist()) for n in ids[r])[:k]
                out["query"] += [names[i]] * len(best)
                out["vec_id"] += [n for _, n in best]
                out["score"] += [s for s, _ in best]
        return pd.DataFrame(out)

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(scan, "query long, vec_id long, score double")


def nearest(
    df: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    every: int = 100,
    recall: float = RECALL,
    page: int = PAGE,
    shard: int = SHARD,
    pairs: int = PAIRS,
    block: int = BLOCK,
    routed: bool | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, ranks from 1, score the distance.

    Queries are the rows whose id is divisible by every, candidates all rows but the query's own. Ties go to
    the smaller id. Vectors that are null, empty or zero, or hold a null, NaN or infinite component, and null
    ids, take no part; vectors of another length than the query's aren't its candidates. Rows that repeat an
    id are candidates each, and a query that repeats is answered each time. An empty table gives no rows. recall: the
    share of a sample's nearest that the ascent is fitted to gather; above 1, all vectors are candidates. routed: whether
    candidates are sent as rows, by default where they are few.
    """
    rows = _usable(df, id, vector)
    asked = rows.filter(F.col("id") % every == 0)
    with scratch(df.sparkSession) as keep:
        # Equal vectors: the k + 1 least ids are enough, as one may be the query's own. Spark keeps no more than
        # that of each group in each task before it shuffles them.
        least = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
        groups = cut(least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
        # Rows may share an id and not the vector: vectors are named by their place in a table.
        groups = cut(groups.withColumn("rep", F.monotonically_increasing_id()), df)
        queries = cut(asked.select("v").distinct())
        queries = keep(cut(queries.withColumn("query", F.monotonically_increasing_id()), df))
        n = groups.count()
        hashing, gather = fitted(groups, queries, n, k, recall)
        enough = gather * TREES if recall <= 1 else float("inf")
        shards = max(1, -(-n // shard))
        if routed if routed is not None else 2 * enough * FEW <= n:
            arrays, roots = cut(entries(groups, hashing, "rep")), cut(entries(queries, hashing, "query"))
            found, made = candidates(arrays, roots, n, enough, page, pairs)
            nearby = ranked(groups, queries, found, shards, max(1, int(made * 16 // (shards * QUERY_BYTES))), k + 1)
        else:
            nearby = scanned(groups, queries, hashing, enough / shards, shards, max(1, -(-queries.count() // block)), k + 1)
        best = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
        top = keep(cut(nearby.withColumn("n", best).filter(F.col("n") <= k + 1).select("query", "vec_id", "score", "n"), df))
    answers = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id", "n"))).alias(f"{Q}found"))
    # A row for each query: its vector's answers without one entry of its own id, then numbered.
    own = asked.join(queries, "v").select(F.col("id").alias("query_id"), "query").join(answers, "query")
    at = F.array_position(F.transform(f"{Q}found", lambda x: x["vec_id"]), F.col("query_id")).cast("int")
    at = F.when(at > 0, at).otherwise(F.size(f"{Q}found") + 1)
    others = F.concat(F.slice(f"{Q}found", F.lit(1), at - 1), F.slice(f"{Q}found", at + 1, F.lit(k + 1)))
    listed = own.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("i", "x"))
    return listed.select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
