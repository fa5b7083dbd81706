"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Words count whole and by their first STEMS bytes, so that inflections not seen in training share a feature.

Each coordinate has its own learning rate, and L1 leaves most weights at exactly zero, so the model is a
short list of hashed features and weights. That list is broadcast: it has at most 2^BITS entries.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Q, per_batch, slices

#: Features are hashed to this many bits.
BITS = 20
#: Bytes of a word's beginnings that are features of their own.
STEMS = (4, 5)
#: Bounds of the sample that the model is fitted on: labelled rows, and bytes of their features together.
FIT_ROWS = 8_000
FIT_BYTES = 1 << 28
#: A text has at most 4 bytes of features for each of its own bytes, and for each of the 2^BITS features.
MOST_BYTES = 4 << BITS
EPOCHS = 3
THRESHOLD = 0.3
#: Score of every text where there is nothing to learn from: below the threshold, so that nothing is rejected.
PRIOR = 0.05
#: Of 16 pairs of ALPHA and L1, those of the least log loss on a fold of the training rows (crc32 mod 4 of 3).
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.3
#: Characters of text that are worked on at once.
BLOCK = 1 << 20

_WORD = re.compile(r"\w+")
_GAP = re.compile(r"\s")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _indices(words: np.ndarray) -> np.ndarray:
    """Of the words (as 32-bit hashes), of adjacent pairs and of pairs around a gap of one."""
    a, b, c, d, e = _ODD
    h = [words * a, words[:-1] * b + words[1:] * c, words[:-2] * d + words[2:] * e]
    return (np.concatenate(h) * a >> np.uint64(64 - BITS)).astype(np.int32)


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a whole text, sorted; none for null and empty texts."""
    found, at, held = [], 0, np.zeros(0, np.uint64)
    text = text or ""
    while at < len(text):
        m = _GAP.search(text, at + BLOCK)
        end = m.start() if m else len(text)
        words = "\n".join(_WORD.findall(text[at:end].lower())).encode("utf-8", "surrogatepass").split(b"\n")
        hashed = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) if words != [b""] else held[:0]
        hashed = np.concatenate([held, hashed])
        stems = [np.fromiter({zlib.crc32(w[:k], k) for w in words if len(w) > k}, np.uint64) * _ODD[k % 2] for k in STEMS]
        stems = (np.concatenate(stems) >> np.uint64(64 - BITS)).astype(np.int32)
        found.append(np.unique(np.concatenate([_indices(hashed), stems])))
        held, at = hashed[-2:], end
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


@dataclass(frozen=True)
class Model:
    """Features with a weight other than zero, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.index] = self.weight
        return out


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    """FTRL-proximal, one row at a time in the order given. The last coordinate is the bias, without L1. Rows of one
    label only can't tell it from the other: the model then gives PRIOR for every text."""
    if len({y > 0 for _, y in rows}) < 2:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log(PRIOR / (1 - PRIOR))))
    n = (1 << BITS) + 1
    z, g2 = np.zeros(n), np.zeros(n)
    l1 = np.full(n, L1)
    l1[-1] = 0

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1[i], 0.0, (np.sign(zi) * l1[i] - zi) / ((BETA + np.sqrt(g2[i])) / ALPHA + L2))

    for _ in range(epochs):
        for x, y in rows:
            i = np.append(x, n - 1)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            sigma = (np.sqrt(g2[i] + g * g) - np.sqrt(g2[i])) / ALPHA
            z[i] += g - sigma * w
            g2[i] += g * g
    w = weights(np.arange(n))
    kept = np.flatnonzero(w[:-1]).astype(np.int32)
    return Model(kept, w[kept].astype(np.float32), float(w[-1]))


def bucket(id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo of; null for null ids."""
    return F.crc32(id.cast("string").cast("binary")) % of


def chosen(docs: DataFrame, labels: DataFrame, label: str, text: str, id: str, held_out: int, folds: int, rows: int, most: int) -> DataFrame:
    """(id, y) of the labelled documents to fit on: at most rows, those of the least hashed ids, as long as their
    features stay within most bytes together."""
    q = f"{Q}id"
    known = labels.select(F.col(id).cast("long").alias(q), F.col(label).cast("int").alias("y")).dropna()
    known = known.filter(bucket(F.col(q), folds) != held_out).groupBy(q).agg(F.max("y").alias("y"))
    size = F.least(F.lit(4) * F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), F.lit(MOST_BYTES))
    # Aggregated before it is joined: however often an id repeats, a task sends one row of it.
    texts = docs.select(F.col(id).cast("long").alias(q), size.alias("size")).groupBy(q).agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    first = known.join(texts.filter("n = 1"), q).withColumn("h", F.xxhash64(q)).orderBy("h", q).limit(rows)
    so_far = F.sum("size").over(Window.orderBy("h", q).rowsBetween(Window.unboundedPreceding, 0))  # over at most rows
    return first.withColumn("so_far", so_far).filter(F.col("so_far") <= most).select(q, "y")


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    text: str = "text",
    id: str = "doc_id",
    held_out: int = 2,
    folds: int = 4,
    rows: int = FIT_ROWS,
    most: int = FIT_BYTES,
) -> Model:
    """Fit on up to rows labelled documents, those of the least hashed ids, outside the held-out fold; most bounds the
    bytes of their features, which the driver holds.

    Of ids with several labels the largest counts, and any above 0 is label 1; null ids and labels are left out, and so
    are ids of several documents, as a label doesn't tell which of them it is for. Null texts are learnt from as empty.
    """
    few = F.broadcast(chosen(docs, labels, label, text, id, held_out, folds, rows, most))  # at most ``rows`` narrow rows
    sample = docs.select(F.col(id).cast("long").alias(f"{Q}id"), F.col(text).alias(f"{Q}text")).join(few, f"{Q}id")

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t).tobytes() for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary()), b.column(2)], ["id", "x", "y"])

    got = {r["id"]: (np.frombuffer(r["x"], np.int32), int(r["y"] > 0)) for r in per_batch(sample, f, "id long, x binary, y int").collect()}
    return fit([got[k] for k in sorted(got, key=lambda k: zlib.crc32(str(k).encode()))])


def scores(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """docs with the double column score: every row, whole texts; null and empty texts get the bias alone."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def over(batches):
        m = shared.value
        w, names = m.dense(), None
        for b in slices(batches):
            z = np.array([w[features(t)].sum(dtype=np.float64) + m.bias for t in b.column(at).to_pylist()])
            names = names or [*b.schema.names, score]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names)

    return docs.mapInArrow(over, type(docs.schema)([*docs.schema.fields]).add(score, "double"))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. Null ids are scored and never held out."""
    narrow = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = scores(narrow, learn(docs, labels, text=text, id=id), "text")
    held = F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score threshold or more; columns as they are."""
    score = f"{Q}score"
    return scores(docs, learn(docs, labels, text=text, id=id), text, score).filter(F.col(score) < threshold).drop(score)
