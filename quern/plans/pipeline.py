"""A fluent chain of operators that ends in one lazy plan: no count or collect between its steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from quern import operators as ops
from quern.functions.predicates import Predicate
from quern.plans.profile import Profile, profile_steps
from quern.sequence import Lazy, Sequence


@dataclass(frozen=True)
class Pipeline:
    seq: Sequence
    #: What the chain is made of: (label, operator), and the sequence that it begins with.
    steps: tuple = ()
    source: Sequence | None = None

    def _then(self, label: str, f) -> "Pipeline":
        return Pipeline(f(self.seq), (*self.steps, (label, f)), self.source or self.seq)

    def mask(self, predicate: Predicate, field: str = "value") -> "Pipeline":
        return self._then("predicate.mask", lambda q: ops.mask(q, predicate, field))

    def compact(self) -> "Pipeline":
        return self._then("compact", ops.compact)

    def where(self, predicate: Predicate, field: str = "value") -> "Pipeline":
        return self.mask(predicate, field).compact()

    def counted(self, count: DataFrame | Lazy, capacity: int | None = None) -> "Pipeline":
        return self._then("counted", lambda q: q.counted(count, capacity))

    def slice(self, lo: int, hi: int) -> "Pipeline":
        return self._then("slice", lambda q: q.slice(lo, hi))

    def sort(self, key_bits: int = 32) -> "Pipeline":
        return self._then("sort", lambda q: ops.sort(q, "value", key_bits))

    def sort_by_key(self, key_bits: int = 32) -> "Pipeline":
        return self._then("sort", lambda q: ops.sort(q, "key", key_bits))

    def scan(self, inclusive: bool = True) -> "Pipeline":
        return self._then("scan", lambda q: ops.scan(q, inclusive))

    def reduce(self, op: str = "sum") -> DataFrame:
        return ops.reduce(self.seq, op)

    def histogram(self, bins: int) -> DataFrame:
        return ops.histogram(self.seq, bins)

    def run_length_encode(self) -> DataFrame:
        return ops.run_length_encode(self.seq)

    def argmin_by_key(self) -> DataFrame:
        return ops.argmin_by_key(self.seq)

    def count(self) -> DataFrame:
        return self.seq.count()

    def ranked(self, out: str = "rank") -> DataFrame:
        return ops.dense(self.seq, out)

    def profile(self, label: str | None = None, last=None) -> Profile:
        """A span for each phase of each operator, each on the kept result of the one before. last: an operator that
        ends the chain, from a sequence to a DataFrame, with its label."""
        return profile_steps(self.source or self.seq, [*self.steps, *([(label or "last", last)] if last else [])])
