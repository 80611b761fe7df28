"""Content keys and the markers that stand for stored originals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = r"(?s)<<ccr:(.*?)>>"


def key(text: Column) -> Column:
    """Version tag and 128 bits of the digest; ``s2`` is SHA-256, which runs in the JVM."""
    return F.concat(F.lit("s2:"), F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def marker(id_: Column) -> Column:
    return F.concat(F.lit("<<ccr:"), id_, F.lit(">>"))


def markers_in(text: Column) -> Column:
    """All ids between markers, in order."""
    return F.regexp_extract_all(text, F.lit(MARKER), 1)


def first_marker(text: Column) -> Column:
    """The first marker as it stands, or null."""
    found = F.regexp_extract(text, r"(?s)<<ccr:.*?>>", 0)
    return F.when(found != "", found)


def referenced(text: Column, ccr_id: Column | None = None) -> Column:
    """Sorted distinct ids that a message refers to, by metadata or marker."""
    ids = markers_in(F.coalesce(text, F.lit("")))
    if ccr_id is not None:
        ids = F.concat(ids, F.array_compact(F.array(ccr_id)))
    return F.array_sort(F.array_distinct(ids))


def requested(text: Column) -> Column:
    """The id of a retrieval request: the marker's brackets taken off, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^<<ccr:", ""), r">>$", ""))


def content_key(roles_and_contents: Column) -> Column:
    """Key of an ordered array of (role, content) structs."""
    joined = F.array_join(F.transform(roles_and_contents, lambda m: F.concat(m["role"], F.lit("\n"), m["content"])), "\n---\n")
    return key(joined)
