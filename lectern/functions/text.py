"""String helpers whose rules differ from Spark's own: lengths in bytes, Unicode white space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIM = r"(?U)^\s+|\s+$"


def trim(text: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(text, TRIM, "")


def collapse(text: Column) -> Column:
    """Runs of Unicode white space as one space, trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def size(text: Column) -> Column:
    """UTF-8 bytes."""
    return F.octet_length(text)


def lines(text: Column, first: int | None = None) -> Column:
    """Lines as a split on line feeds leaves them."""
    out = F.split(text, "\n", -1)
    return F.slice(out, 1, first) if first else out


def _splits(raw: Column, at: int) -> Column:
    """Whether the byte after ``at`` continues a character."""
    return F.conv(F.hex(F.substring(raw, at + 1, 1)), 16, 10).cast("int").between(0x80, 0xBF)


def prefix(text: Column, limit: int) -> Column:
    """The longest prefix of at most ``limit`` bytes that ends between characters."""
    raw = text.cast("binary")
    cut = F.lit(limit - 3)
    for back in (2, 1, 0):
        cut = F.when(~_splits(raw, limit - back), F.lit(limit - back)).otherwise(cut)
    return F.when(F.octet_length(raw) <= limit, text).otherwise(F.substring(raw, F.lit(1), cut).cast("string"))


def first_sentence(text: Column) -> Column:
    """Up to the first ``.``, ``!`` or ``?``, trimmed."""
    return trim(F.regexp_extract(text, r"^([^.!?]*)", 1))


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether any of the plain patterns occurs."""
    found = F.lit(False)
    for p in patterns:
        found = found | F.contains(text, F.lit(p))
    return found
