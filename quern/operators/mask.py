"""Predicate masks: a 0/1 INT column beside the data, so that a later filter folds back into the predicate."""

from pyspark.sql import functions as F

from quern.errors import PrimitiveError
from quern.functions.predicates import Predicate
from quern.sequence import Sequence


def masks(seq: Sequence, **predicates) -> Sequence:
    """One column a predicate. predicates: name=Predicate on ``value``, or name=(field, Predicate)."""
    cols = {}
    for name, p in predicates.items():
        field, p = ("value", p) if isinstance(p, Predicate) else p
        if field not in seq.fields:
            raise PrimitiveError(f"no field {field}; there are {seq.fields}")
        cols[name] = p.on(F.col(field)).cast("int")
    return seq.with_df(seq.rows.withColumns(cols))


def mask(seq: Sequence, predicate: Predicate, field: str = "value") -> Sequence:
    return masks(seq, mask=(field, predicate))
