"""quern: data-parallel primitives over ordered u32 sequences, as Spark plans."""

from quern.plans.pipeline import Pipeline
from quern.sequence import Fixed, Lazy, Sequence

__all__ = ["Fixed", "Lazy", "Pipeline", "Sequence"]
