"""Comparison predicates. Each turns a LONG column into a BOOLEAN one that Catalyst can push down."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.domain import U32_MAX
from quern.errors import ValueOutOfDomain


class Predicate:
    def on(self, c: Column) -> Column:
        raise NotImplementedError

    def __and__(self, other: "Predicate") -> "Predicate":
        return _Both(self, other)

    def __or__(self, other: "Predicate") -> "Predicate":
        return _Either(self, other)

    def __invert__(self) -> "Predicate":
        return _Not(self)


def _operand(v: int) -> int:
    if not isinstance(v, int) or not 0 <= v <= U32_MAX:
        raise ValueOutOfDomain(f"operand {v!r}")
    return v


@dataclass(frozen=True)
class _One(Predicate):
    operand: int

    def __post_init__(self):
        _operand(self.operand)


class Equal(_One):
    def on(self, c):
        return c == self.operand


class NotEqual(_One):
    def on(self, c):
        return c != self.operand


class LessThan(_One):
    def on(self, c):
        return c < self.operand


class LessThanOrEqual(_One):
    def on(self, c):
        return c <= self.operand


class GreaterThan(_One):
    def on(self, c):
        return c > self.operand


class GreaterThanOrEqual(_One):
    def on(self, c):
        return c >= self.operand


@dataclass(frozen=True)
class Between(Predicate):
    """The closed interval; low > high matches nothing, said as a literal so that the scan is skipped."""

    low: int
    high: int

    def __post_init__(self):
        _operand(self.low)
        _operand(self.high)

    def on(self, c):
        return F.lit(False) if self.low > self.high else c.between(self.low, self.high)


@dataclass(frozen=True)
class _Both(Predicate):
    a: Predicate
    b: Predicate

    def on(self, c):
        return self.a.on(c) & self.b.on(c)


@dataclass(frozen=True)
class _Either(Predicate):
    a: Predicate
    b: Predicate

    def on(self, c):
        return self.a.on(c) | self.b.on(c)


@dataclass(frozen=True)
class _Not(Predicate):
    a: Predicate

    def on(self, c):
        return ~self.a.on(c)
