"""Focus terms of a question, and how they boost what mentions them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about the focus.
STOP = frozenset(
    "the an and or but nor so as if then than is are was were be been being am to of in on at by for with from into onto up out it its "
    "this that these those there here do does did done can could would should shall will may might must have has had what which who whom "
    "whose when where why how my me we us our you your they them their he she his her him too very just also not no".split()
)
WEIGHT = 100.0


def terms(question: str | None) -> list[str]:
    """Sorted distinct words of two characters or more that aren't stop words."""
    found = (w.lower() for w in re.split(r"[\W_]+", question or "") if len(w) >= 2)
    return sorted({w for w in found if w not in STOP})


def matches(text: Column, focus: list[str]) -> Column:
    """Whether any term occurs, in any case; false without terms."""
    low, found = F.lower(text), F.lit(False)
    for t in focus:
        found = found | F.contains(low, F.lit(t))
    return found


def relevance(text: Column, focus: list[str]) -> Column:
    low, n = F.lower(text), F.lit(0)
    for t in focus:
        n = n + F.contains(low, F.lit(t)).cast("int")
    return n * F.lit(WEIGHT)
