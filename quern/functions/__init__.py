"""Column functions of the u32 domain and the seven comparison predicates."""

from quern.domain import checked, wrap, wrapping_sum
from quern.functions.predicates import (
    Between,
    Equal,
    GreaterThan,
    GreaterThanOrEqual,
    LessThan,
    LessThanOrEqual,
    NotEqual,
    Predicate,
)

__all__ = ["Between", "Equal", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "NotEqual", "Predicate", "checked", "wrap", "wrapping_sum"]
