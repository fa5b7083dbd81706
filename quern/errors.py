"""Argument and data errors. Argument errors are raised before any plan is built."""


class PrimitiveError(ValueError):
    """Base of all argument errors."""


class InvalidKeyBits(PrimitiveError):
    """A key width outside 0..32, raised for empty inputs too."""


class InvalidHistogramBinCount(PrimitiveError):
    """A bin count outside 1..max_bins."""


class CompactionLengthMismatch(PrimitiveError):
    """A host mask whose length differs from the input's."""


class InvalidCompactionFlag(PrimitiveError):
    """A host mask flag other than 0 or 1."""


class KeyExceedsBitRange(PrimitiveError):
    """A host key that needs more bits than declared."""


class ValueOutOfDomain(PrimitiveError):
    """A host value that is null or outside 0..2^32-1."""


class BufferTooSmall(PrimitiveError):
    """An output capacity below the input's."""


class RangeOutOfBounds(PrimitiveError):
    """A slice that leaves the sequence's known extent."""


class ElementCountTooLarge(PrimitiveError):
    """A known element count above 2^32-1."""


class UnorderedSequence(PrimitiveError):
    """An order-sensitive operator on a sequence without an ordinal."""
