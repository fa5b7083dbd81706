"""Byte-level BPE by prefix dynamic programming.

For each byte prefix of a piece the one token is kept that ends its encoding. Of the tokens that are a
suffix of the prefix, that is the one which forms a valid pair with the last token of what comes before it;
a pair is valid if encoding its joined bytes gives back the pair. A prefix's entry depends on the prefix
alone, so bytes can be appended, or cut off, and the encoding stays exact; after an edit in the middle only
entries from there on are made again, until a window of them as long as the longest token is as it was.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quern.llm.common import per_batch

#: The code points of Unicode's White_Space, which libraries' own \s don't all match.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces and pairs that a worker keeps; beyond that a cache starts anew.
KEPT = 600_000
#: Characters of a piece that is worth keeping.
KEPT_LENGTH = 48
#: Characters of text whose pieces are held at once.
BLOCK = 1 << 20


def compiled(pattern: str) -> regex.Pattern:
    """A tokenizer's pattern with its white space spelled out."""
    inside = regex.sub(r"\[\^\\s", lambda m: "[^" + WHITE, pattern)
    return regex.compile(inside.replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))


class Vocabulary:
    """Tokens by rank. text: lines of base64 token and rank."""

    def __init__(self, text: bytes):
        self.ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in text.splitlines() if x)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.longest = max(map(len, self.ranks), default=0)
        self.automaton = ahocorasick.Automaton()
        for t, r in self.ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (r, len(t)))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}

    def half(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, None for a single byte."""
        if token not in self.halves:
            parts = [bytes([b]) for b in self.tokens[token]]
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def valid(self, a: int, b: int) -> bool:
        """Whether a then b is how their joined bytes are encoded.

        It isn't if a merge across the border comes before the last merge on either side of it. The sides are
        undone from the outside, the later merge first, and each border so laid bare is looked at: ``bound`` is
        the rank that a merge there must not undercut. Equal ranks merge from the left.
        """
        if len(self.pairs) >= KEPT:
            self.pairs.clear()
        found = self.pairs[a << 32 | b] = self._valid(a, b)
        return found

    def _valid(self, a: int, b: int) -> bool:
        bound = 1 << 60
        while True:
            merged = self.ranks.get(self.tokens[a] + self.tokens[b])
            if merged is not None and merged < bound:
                return False
            left, right = self.half(a), self.half(b)
            # On a's side a merge of equal rank at the border would come second, on b's side first.
            if left and (a > b or not right):
                bound, a = a, left[1]
            elif right:
                bound, b = b + 1, right[0]
            else:
                return True


class Prefixes:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, data: bytes, until: int | None = None) -> "Prefixes":
        """Add bytes, and the last tokens of prefixes of up to ``until`` bytes, or all."""
        self.data += data
        v, last = self.vocabulary, self.last
        known, until = v.pairs.get, len(self.data) if until is None else until
        at = len(last)
        # Of the tokens that end at a byte, the automaton gives the longest first.
        text = self.data[max(0, at + 1 - v.longest) : until].decode("latin-1")
        base = until - len(text)
        for end, (token, n) in v.automaton.iter(text):
            end += base
            if end < at:
                continue
            if end > at:
                raise ValueError(f"no token ends at byte {at}")
            if n <= end:
                before = last[end - n]
                ok = known(before << 32 | token)
                if not (v.valid(before, token) if ok is None else ok):
                    continue
            last.append(token)
            at += 1
        if at < until:
            raise ValueError(f"no token ends at byte {at}")
        return self

    def edit(self, start: int, stop: int, data: bytes) -> "Prefixes":
        """Replace bytes start..stop-1. What follows is taken over once it runs as before."""
        old, kept = self.last[stop:], self.data[stop:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(data)
        self.data += kept
        same = 0
        while len(self.last) < len(self.data):
            at = len(self.last) - (len(self.data) - len(kept))
            if same >= self.vocabulary.longest:
                self.last += old[at:]
                break
            self.append(b"", len(self.last) + 1)
            same = same + 1 if self.last[-1] == old[at] else 0
        return self

    def ids(self) -> list[int]:
        out, at = [], len(self.last)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class Pieces(dict):
    """Ids of a piece, as text joined by spaces, made when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> str:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.vocabulary.ranks.get(data)
        ids = str(whole) if whole is not None else " ".join(map(str, Prefixes(self.vocabulary, data).ids()))
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encodes and decodes whole texts; one a worker process."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.vocabulary = Vocabulary(vocabulary)
        self.pieces = Pieces(self.vocabulary)
        self.split = compiled(pattern).findall
        self.bytes = {str(r): t for r, t in self.vocabulary.tokens.items()}

    def blocks(self, text: str):
        """Ids of the text, block by block. A piece has white space at its front only, or is white space: so a
        block can end before a single space between other characters."""
        at = 0
        while at < len(text):
            m = _SINGLE.search(text, at + BLOCK)
            end = m.start() + 1 if m else len(text)
            yield " ".join(map(self.pieces.__getitem__, self.split(text[at:end])))
            at = end

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.split(" "))) if ids else b""

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the joined ids and of the bytes they decode to."""
        n, ids, out = 0, hashlib.sha256(), hashlib.sha256()
        for block in self.blocks(text):
            ids.update(((" " if n else "") + block).encode())
            n += block.count(" ") + 1
            out.update(self.decode(block))
        return n, ids.hexdigest(), out.hexdigest()


_SINGLE = re.compile(rf"[^{WHITE}] (?=[^{WHITE}])")


@functools.lru_cache(2)
def codec(vocabulary: bytes, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def shipped(spark: SparkSession, path: str):
    """A vocabulary file's bytes for every worker. The driver reads it; its size is fixed by the vocabulary."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; null texts count as empty.

    No shuffle. Repeated rows and null ids each keep their row; an empty table gives an empty result.
    """
    file = shipped(docs.sparkSession, path)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(file.value, pattern)
        n, ids, out = zip(*[c.digests(t) for t in b.column(1).to_pylist()]) if b.num_rows else ((), (), ())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    cols = [F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    return per_batch(docs.select(*cols), f, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """docs with the column ids (array of int; null where text is null) and text decoded from them again.

    A column of docs named as ids is replaced. Others pass through as they are.
    """
    file = shipped(docs.sparkSession, path)
    docs = docs.drop(ids)
    at = docs.columns.index(text)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(file.value, pattern)
        lists, texts = [], []
        for t in b.column(at).to_pylist():
            blocks = [] if t is None else list(c.blocks(t))
            made = [np.fromstring(x, np.int32, sep=" ") for x in blocks]
            lists.append(None if t is None else np.concatenate(made) if made else np.zeros(0, np.int32))
            texts.append(None if t is None else b"".join(map(c.decode, blocks)).decode("utf-8", "surrogatepass"))
        columns = [*b.columns, pa.array(lists, pa.list_(pa.int32()))]
        columns[at] = pa.array(texts, b.column(at).type)
        return pa.RecordBatch.from_arrays(columns, [*b.schema.names, ids])

    return per_batch(docs, f, StructType([*docs.schema.fields, StructField(ids, ArrayType(IntegerType()))]))
