"""Typed tags of folded messages: tools, error classes, file paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import prefix
from .agent import with_columns

MOST = 64
SCAN_BYTES = 65_536
MOST_PATHS = 4096
#: Error patterns and their classes, and known file extensions.
CLASSES = [("Error:", "error"), ("error:", "error"), ("ERROR", "error"), ("Traceback (most recent call last)", "traceback"), ("panicked at", "panic"), ("Exception", "exception"), ("FAILED", "failed"), ("stderr:", "stderr")]
EXTENSIONS = "rs go ts tsx js jsx py rb java kt c h cc cpp hpp cs swift sh bash zsh sql html css scss toml yaml yml json md txt proto lock cfg ini env tf hcl".split()
_PART = r"""(?U)[\s"'`(),;:\[\]{}=<>|*]+"""
_TRIM = r"(?U)^[^\p{L}\p{N}/._-]+|[^\p{L}\p{N}/._-]+$"


def error_classes(content: Column, status: Column) -> Column:
    head = prefix(content, 512)
    return F.array_compact(F.array(F.when(status == "error", "tool_error"), *[F.when(F.contains(head, F.lit(p)), c) for p, c in CLASSES]))


def paths(content: Column) -> Column:
    """Tokens like ``stem.ext``: with a slash, or an extension that is known."""
    tokens = F.transform(F.split(prefix(content, SCAN_BYTES), _PART), lambda t: F.regexp_replace(t, _TRIM, ""))
    known = r"\.(?i:" + "|".join(EXTENSIONS) + r")$"
    good = F.filter(tokens, lambda t: t.rlike(r"(?U)[\p{L}\p{N}].*\.[A-Za-z&&[\p{ASCII}]]{1,12}$") & (F.contains(t, F.lit("/")) | t.rlike(known)))
    return F.slice(good, 1, MOST_PATHS)


def tags(messages: DataFrame, span: list[str]) -> DataFrame:
    """The tags of each span of messages, sorted, distinct, at most ``MOST`` of a kind."""
    rows = with_columns(messages)
    each = rows.select(*span, F.array_compact(F.array(F.when(F.length("tool_name") > 0, F.col("tool_name")))).alias("tool_names"), error_classes(F.col("content"), F.col("tool_status")).alias("error_classes"), paths(F.col("content")).alias("file_paths"))
    kinds = ("tool_names", "error_classes", "file_paths")
    return each.groupBy(*span).agg(*[F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set(k)))), 1, MOST).alias(k) for k in kinds])


def merge(a: Column, b: Column) -> Column:
    return F.slice(F.array_sort(F.array_union(a, b)), 1, MOST)
