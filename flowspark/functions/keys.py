"""Canonical keys and directions of layers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_part(c: Column) -> Column:
    """A key part as hex: tag 01 and eight bytes for numbers is what byte order compares; text is tagged 04 with a length."""
    raw = F.hex(F.encode(c.cast("string"), "utf-8"))
    return F.concat(F.lit("04"), F.lpad(F.hex((F.length(raw) / 2).cast("long")), 4, "0"), raw)


def encode_number(c: Column) -> Column:
    return F.concat(F.lit("01"), F.lpad(F.hex(c.cast("long")), 16, "0"))


def side(columns: tuple[str, ...]) -> Column:
    """One endpoint: the encoded numbers in order; null if any is."""
    return F.concat(*[encode_number(F.col(c)) for c in columns])


def canonical_key(layer) -> Column:
    """Shared parts, then the lower endpoint, then the higher."""
    parts = [encode_number(F.col(c)) for c in layer.shared]
    if layer.side_a:
        a, b = side(layer.side_a), side(layer.side_b)
        both = a.isNotNull() & b.isNotNull()
        parts += [F.when(both, F.least(a, b)), F.when(both, F.greatest(a, b))]
    return F.concat(*parts)


def direction(layer) -> Column:
    return F.when(side(layer.side_a) <= side(layer.side_b), 0).otherwise(1) if layer.side_a else F.lit(0)
