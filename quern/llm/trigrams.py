"""Boolean trigram queries from regular expressions.

A query is in disjunctive form: a list of sets of trigrams, all of one of which occur in whatever matches.
None says that the expression has no mandatory trigrams.
"""

from __future__ import annotations

import re
from itertools import product
from re import _constants as C
from re import _parser

#: Strings followed at once, and characters of a class that are told apart.
MOST, CLASS = 256, 8

Query = list[frozenset[str]] | None


def _of_strings(strings: set[str]) -> Query:
    sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    return None if not sets or not all(sets) else _least(sets)


def _least(sets: list[frozenset[str]]) -> list[frozenset[str]]:
    """Without sets that hold another one."""
    return sorted({s for s in sets if not any(t < s for t in sets)}, key=sorted)


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _least([x | y for x in a for y in b]) if len(a) * len(b) <= MOST else min(a, b, key=len)


def _either(queries: list[Query]) -> Query:
    return None if any(q is None for q in queries) else _least([s for q in queries for s in q])


def _walk(items) -> tuple[set[str] | None, Query]:
    """Of a sequence: all strings that it can match, if they are few, and else a query."""
    exact, query, whole = {""}, None, True
    for op, arg in items:
        strings, q = _one(op, arg)
        if strings is not None and len(exact) * len(strings) <= MOST:
            exact = {a + b for a, b in product(exact, strings)}
            continue
        query, whole = _both(_both(query, _of_strings(exact)), q if strings is None else None), False
        exact = {""} if strings is None else strings
    return (exact, None) if whole else (None, _both(query, _of_strings(exact)))


def _one(op, arg) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return {chr(arg)}, None
    if op is C.AT or op is C.ASSERT or op is C.ASSERT_NOT:
        return {""}, None
    if op is C.IN:
        chars = set()
        for kind, x in arg:
            span = (x, x) if kind is C.LITERAL else x if kind is C.RANGE else None
            if span is None or span[1] - span[0] >= CLASS:
                return None, None
            chars |= set(map(chr, range(span[0], span[1] + 1)))
        return (chars, None) if len(chars) <= CLASS else (None, None)
    if op is C.SUBPATTERN:
        return _walk(arg[-1])
    if op is C.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), None
        return None, _either([_of_strings(s) if s is not None else q for s, q in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = arg
        strings, q = _walk(inner)
        if strings is not None and high == 1:
            return strings | {""} if low == 0 else strings, None
        return None, None if low == 0 else _of_strings(strings) if strings is not None else q
    return None, None


def query(pattern: str, ignore_case: bool = True) -> Query:
    """Of a pattern, over texts in lower case if ignore_case."""
    strings, q = _walk(_parser.parse(pattern, re.ASCII))
    q = _of_strings(strings) if strings is not None else q
    return q if q is None or not ignore_case else _least([frozenset(t.lower() for t in s) for s in q])
