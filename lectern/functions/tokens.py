"""Token counts estimated from UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens added for each message, and the margin of estimates.
OVERHEAD = 4
MARGIN = 0.05


def bytes_per_token(model: str) -> float:
    return 3.5 if model.startswith("claude-") else 4.0


def estimate(text: Column, model: str = "") -> Column:
    """At least 1, else bytes over bytes per token, rounded up."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / F.lit(bytes_per_token(model)))).cast("long")


def count_messages(text: Column, model: str = "") -> Column:
    """Aggregate: tokens of all messages with their overhead."""
    return (F.sum(estimate(text, model)) + OVERHEAD * F.count("*")).cast("long")


def count_kind(model: str = "") -> Column:
    """How counts come about: always an estimate, with its method and margin."""
    return F.struct(F.lit("estimated").alias("kind"), F.lit(f"bytes/{bytes_per_token(model):.1f} heuristic").alias("method"), F.lit(MARGIN).alias("safety_margin"))


def effective_limit(limit: Column, margin: float | None = None) -> Column:
    """The limit less its margin, rounded up."""
    return (limit - F.ceil(limit * F.lit(MARGIN if margin is None else margin))).cast("long")
