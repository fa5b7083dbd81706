"""Language identification by a bidirectional gated recurrent network over bytes.

Whole texts are read in windows of WINDOW bytes, forwards and backwards; each position is labelled from both
states, and a document's probabilities are the mean of its positions'. The network is trained in numpy by
backpropagation through time on a bounded sample. It has a few thousand weights, whatever the corpus.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Q, per_batch
from quern.llm.toxicity import bucket

WINDOW, STATES = 64, 8
#: Windows that go through the network at once.
WIDTH = 4096
#: Bounds of the sample: documents a language and in all, and windows of each, at hashed places of its whole text.
FIT_EACH, FIT_ALL, FIT_WINDOWS = 500, 8_000, 4
STEPS, BATCH, RATE, SEED = 240, 256, 0.02, 11


@dataclass
class Direction:
    """Gates are stacked: update, reset, candidate. w: (3 STATES, 256), biases included; u: (3 STATES, STATES)."""

    w: np.ndarray
    u: np.ndarray

    def run(self, x: np.ndarray, mask: np.ndarray | None, trace: list | None = None):
        """States (STATES, width) of each row of x, a row a position. Where mask is 0 the state is reset."""
        s = STATES
        # sigmoid(a) = (1 + tanh(a / 2)) / 2
        half = np.concatenate([np.full(2 * s, 0.5), np.ones(s)]).astype(np.float32)[:, None]
        w, u = self.w * half, self.u * half
        h = np.zeros((s, x.shape[1]), np.float32)
        for t in range(len(x)):
            g, r = np.take(w, x[t], axis=1), u @ h
            zr = np.tanh(g[: 2 * s] + r[: 2 * s])
            zr += 1
            zr *= 0.5
            n = np.tanh(g[2 * s :] + zr[s:] * r[2 * s :])
            before, h = h, n + zr[:s] * (h - n)
            if mask is not None:
                h *= mask[t]
            if trace is not None:
                trace.append((before, zr[:s], zr[s:], n, r[2 * s :]))
            yield h

    def back(self, x: np.ndarray, mask: np.ndarray, trace: list, dh: list) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of w and u from those of the states."""
        s, du = STATES, np.zeros_like(self.u)
        inputs, carry = np.empty((3 * s, *x.shape), np.float32), 0.0
        for t in reversed(range(len(x))):
            before, z, r, n, q = trace[t]
            d = (carry + dh[t]) * mask[t]
            dn = d * (1 - z) * (1 - n * n)
            dz, dr = d * (before - n) * z * (1 - z), dn * q * r * (1 - r)
            inputs[:, t] = np.concatenate([dz, dr, dn])
            recur = np.concatenate([dz, dr, dn * r])
            du += recur @ before.T
            carry = d * z + self.u.T @ recur
        flat = x.ravel()
        return np.stack([np.bincount(flat, i.ravel(), 256) for i in inputs]).astype(np.float32), du


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    behind: Direction
    v: np.ndarray
    c: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.behind.w, self.behind.u, self.v, self.c]

    def label(self, h: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Probabilities (languages, width) of a position from both states."""
        a = self.v[:, :STATES] @ h + self.v[:, STATES:] @ b + self.c
        a -= a.max(axis=0)
        np.exp(a, out=a)
        a /= a.sum(axis=0)
        return a

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of each text's positions (texts, languages); an empty text has all alike."""
        n = np.array([len(t) for t in texts], np.int64)
        windows = -(-n // WINDOW)
        owner = np.repeat(np.arange(len(texts)), windows)
        x = np.frombuffer(b"".join([t.ljust(k * WINDOW, b"\0") for t, k in zip(texts, windows.tolist())]), np.uint8).reshape(-1, WINDOW)
        valid = np.full(len(x), WINDOW, np.int64)
        last = np.cumsum(windows)[windows > 0] - 1
        valid[last] = (n - (windows - 1) * WINDOW)[windows > 0]
        out = np.zeros((len(texts), len(self.languages)))
        for i in range(0, len(x), WIDTH):
            part = np.ascontiguousarray(x[i : i + WIDTH].T)
            mask = (np.arange(WINDOW)[:, None] < valid[i : i + WIDTH]).astype(np.float32)
            ahead = list(self.ahead.run(part, None))  # padding comes last, where it changes nothing
            total = np.zeros((len(self.languages), part.shape[1]), np.float32)
            for t, b in zip(range(WINDOW - 1, -1, -1), self.behind.run(part[::-1], mask[::-1])):
                total += self.label(ahead[t], b) * mask[t]
            np.add.at(out, owner[i : i + WIDTH], total.T)
        return np.where(n[:, None] > 0, out / np.maximum(n, 1)[:, None], 1 / max(1, len(self.languages)))


def fit(windows: list[tuple[bytes, str]], steps: int = STEPS, seed: int = SEED) -> Network:
    """Train on (bytes, language) by Adam; batches take languages alike. The windows' order doesn't matter."""
    rng = np.random.default_rng(seed)
    names = sorted({y for _, y in windows})
    s, k = STATES, len(names)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = Network(names, *[Direction(normal(3 * s, 256, scale=0.3), normal(3 * s, s, scale=0.35)) for _ in range(2)], normal(k, 2 * s, scale=0.3), np.zeros((k, 1), np.float32))
    if not windows:
        return net
    windows = sorted(windows)
    x = np.frombuffer(b"".join(w[:WINDOW].ljust(WINDOW, b"\0") for w, _ in windows), np.uint8).reshape(-1, WINDOW)
    n = np.array([min(len(w), WINDOW) for w, _ in windows])
    y = np.array([names.index(v) for _, v in windows])
    of = [np.flatnonzero(y == i) for i in range(k)]
    m1, m2 = ([np.zeros_like(p) for p in net.weights()] for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(of[i % k]) for i in range(BATCH)])
        part, mask = np.ascontiguousarray(x[pick].T), (np.arange(WINDOW)[:, None] < n[pick]).astype(np.float32)
        t1, t2 = [], []
        h = list(net.ahead.run(part, mask, t1))
        b = list(net.behind.run(part[::-1], mask[::-1], t2))[::-1]
        dv, dc, dh, db = np.zeros_like(net.v), np.zeros_like(net.c), [], []
        for t in range(WINDOW):
            a = net.label(h[t], b[t])
            a[y[pick], np.arange(BATCH)] -= 1
            a *= mask[t] / mask.sum()
            dv += np.concatenate([a @ h[t].T, a @ b[t].T], axis=1)
            dc += a.sum(axis=1, keepdims=True)
            dh.append(net.v[:, :s].T @ a)
            db.append(net.v[:, s:].T @ a)
        grads = [*net.ahead.back(part, mask, t1, dh), *net.behind.back(part[::-1], mask[::-1], t2, db[::-1]), dv, dc]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for p, g, u, w in zip(net.weights(), grads, m1, m2):
            g = g * min(1, 1 / (norm + 1e-9))
            u += 0.1 * (g - u)
            w += 0.01 * (g * g - w)
            p -= rate * (u / (1 - 0.9**step)) / (np.sqrt(w / (1 - 0.99**step)) + 1e-7)
    return net


def shares(d: DataFrame, each: int, total: int) -> dict[str, tuple[int, float]]:
    """By language: documents to take, and the share of its rows to draw so that they are hardly ever too few. At most
    ``total`` languages, the most frequent ones."""
    counted = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(total).collect()
    each = min(each, max(1, total // max(1, len(counted))))
    return {r["lang"]: (each, (each + 5 * each**0.5 + 8) / r["n"]) for r in counted}


def drawn(d: DataFrame, of: dict[str, float], windows: int) -> DataFrame:
    """(lang, u, ws): the rows of d whose hash u is below their language's share, and windows of their texts. Rows of
    equal id and text are one."""
    few = F.broadcast(d.sparkSession.createDataFrame(list(of.items()), "lang string, share double"))  # as many as languages
    # 53 bits of a hash, as a double in [0, 1).
    d = d.join(few, "lang").withColumn("u", F.shiftrightunsigned(F.xxhash64("id", "b"), 11).cast("double") / float(1 << 53))
    places = F.octet_length("b") - WINDOW + 1
    at = [F.when(places <= 1, 1).otherwise(F.pmod(F.xxhash64("id", "b", F.lit(i)), places).cast("int") + 1) for i in range(windows)]
    ws = F.array_distinct(F.array(*[F.substring("b", x, F.lit(WINDOW)) for x in at]))
    return d.filter(F.col("u") < F.col("share")).select("lang", "u", ws.alias("ws")).distinct()


def sample(d: DataFrame, each: int = FIT_EACH, total: int = FIT_ALL, windows: int = FIT_WINDOWS) -> list[tuple[bytes, str]]:
    """(window, lang) of the documents of least hash in each language: ``each`` of them, or as many as there are.

    A language is drawn again, in a share eight times as large, while it has too few: so repeated rows don't cost it any.
    """
    want, out = shares(d, each, total), []
    left = {k: s for k, (_, s) in want.items()}
    while left:
        found = defaultdict(list)
        for r in drawn(d, left, windows).collect():
            found[r["lang"]].append((r["u"], sorted(map(bytes, r["ws"]))))
        for k in [k for k, s in left.items() if s >= 1 or len(found[k]) >= want[k][0]]:
            out += [(w, k) for _, ws in sorted(found[k])[: want[k][0]] for w in ws]
            del left[k]
        left = {k: s * 8 for k, s in left.items()}
    return sorted(set(out))


def learn(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    id: str = "doc_id",
    held_out: int = 0,
    folds: int = 5,
    each: int = FIT_EACH,
    total: int = FIT_ALL,
    windows: int = FIT_WINDOWS,
) -> Network:
    """Fit on a sample outside the held-out fold: at most each documents of a language and total in all, windows of each.

    Null ids, languages and texts are left out, and so are empty texts. Rows of equal id and text count once, rows that
    share an id only are documents each.
    """
    d = docs.select(F.col(id).cast("long").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("b"))
    d = d.dropna().filter((bucket(F.col("id"), folds) != held_out) & (F.octet_length("b") > 0))
    return fit(sample(d, each, total, windows))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    lang_pred is "und", with score 0, where text is null or has no letter, or where no language was learned.
    Null ids are labelled and never held out. An empty table gives an empty result.
    """
    net = docs.sparkSession.sparkContext.broadcast(learn(docs, text, lang, id))

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if t is not None and any(map(str.isalpha, t)) else "" for t in b.column(1).to_pylist()]
        n = net.value
        if not n.languages:
            texts = [""] * len(texts)
        p = n.pool([t.encode("utf-8", "surrogatepass") for t in texts]) if n.languages else np.zeros((len(texts), 1))
        best = p.argmax(axis=1).tolist()
        names = [n.languages[k] if t else "und" for t, k in zip(texts, best)]
        scores = [min(1.0, float(p[i, k])) if t else 0.0 for i, (t, k) in enumerate(zip(texts, best))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = per_batch(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias(f"{Q}text")), f, "doc_id long, lang_pred string, score double")
    held = F.coalesce(bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
