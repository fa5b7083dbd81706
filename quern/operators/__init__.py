"""Operators: lazy functions from sequences to sequences or DataFrames. None of them runs a job."""

from quern.operators.argmin import argmin_by_key
from quern.operators.compact import compact, compact_with, selected_count
from quern.operators.histogram import histogram
from quern.operators.mask import mask, masks
from quern.operators.ranks import dense
from quern.operators.reduce import reduce
from quern.operators.run_length import run_length_encode
from quern.operators.scan import scan
from quern.operators.sort import key_width, sort

__all__ = ["argmin_by_key", "compact", "compact_with", "dense", "histogram", "key_width", "mask", "masks", "reduce", "run_length_encode", "scan", "selected_count", "sort"]
