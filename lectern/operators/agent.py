"""Rules for agent transcripts: one row a message, ordered by ``turn`` in ``conv_id``.

Messages have conv_id, turn, role, content and, where known, tool_name,
tool_status and pinned; missing columns count as null or false.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, tokens
from ..functions.text import any_of, prefix

#: What a failed tool's output holds, in any of its first 512 bytes.
ERROR_PATTERNS = ["Error:", "error:", "ERROR", "Traceback (most recent call last)", "panicked at", "Exception", "FAILED", "stderr:"]
ERROR_BYTES = 512
TYPES = ("system", "tool_result_error", "tool_result_success", "user", "assistant")


@dataclass(frozen=True)
class AgentPolicy:
    keep_tool_results: int = 3
    clear_stale: bool = True
    keep_recent_assistant: int = 2
    protected_tail_tokens: int | None = None


def with_columns(messages: DataFrame) -> DataFrame:
    """Messages with all columns that the rules read."""
    for name, kind in (("tool_name", "string"), ("tool_status", "string"), ("tag", "string"), ("pinned", "boolean")):
        if name not in messages.columns:
            messages = messages.withColumn(name, F.lit(None).cast(kind))
    return messages.withColumn("pinned", F.coalesce("pinned", F.lit(False)))


def classify(role: Column, content: Column, status: Column, tag: Column | None = None) -> Column:
    """What a message is: by its tag if that is valid, else role, status and error patterns."""
    failed = F.coalesce(status == "error", F.lit(False)) | any_of(prefix(content, ERROR_BYTES), ERROR_PATTERNS)
    by_role = (
        F.when(role == "system", "system")
        .when(role.isin("tool", "function"), F.when(failed, "tool_result_error").otherwise("tool_result_success"))
        .when(role == "user", "user")
        .when(role == "assistant", "assistant")
        .otherwise("unknown")
    )
    return by_role if tag is None else F.when(F.coalesce(tag.isin(*TYPES), F.lit(False)), tag).otherwise(by_role)


def _newest():
    return Window.partitionBy("conv_id").orderBy(F.desc("turn"))


def _rank(flag: Column) -> Column:
    """Which of the flagged messages this is, from the newest on; windows by conversation alone share one shuffle."""
    return F.sum(flag.cast("int")).over(_newest().rowsBetween(Window.unboundedPreceding, Window.currentRow))


def protected_tail(budget: int | None) -> Column:
    """Newest messages while the tokens of those after each are below the budget."""
    if not budget:
        return F.lit(False)
    after = F.sum(tokens.estimate(F.col("content")) + tokens.OVERHEAD).over(_newest().rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(after, F.lit(0)) < budget


def classified(messages: DataFrame) -> DataFrame:
    rows = with_columns(messages)
    return rows.withColumn("type", classify(F.col("role"), F.col("content"), F.col("tool_status"), F.col("tag")))


def recent_assistant(messages: DataFrame, keep: int = 2) -> DataFrame:
    """``recent``: the newest ``keep`` assistant messages of each conversation."""
    rows = classified(messages)
    own = F.col("type") == "assistant"
    return rows.withColumn("recent", own & (_rank(own) <= keep))


def preserve_counts(messages: DataFrame, keep: int = 2, tail: int | None = None) -> DataFrame:
    """For each conversation the messages from the first recent assistant on, and the protected tail."""
    rows = recent_assistant(messages, keep).withColumn("tail", protected_tail(tail)).withColumn("index", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    first = F.min(F.when(F.col("recent"), F.col("index")))
    return rows.groupBy("conv_id").agg((F.count("*") - F.coalesce(first, F.count("*"))).alias("recent_span"), F.sum(F.col("tail").cast("long")).alias("tail_messages"))


def clear_tool_results(messages: DataFrame, policy: AgentPolicy = AgentPolicy()) -> DataFrame:
    """Stale tool results as stubs: columns of the messages, ``type``, ``cleared`` and ``ccr_id``.

    Per conversation the newest successful results stay; pinned ones take no
    slot, those in the protected tail do.  One window over conv_id serves all.
    """
    rows = classified(messages).withColumn("tail", protected_tail(policy.protected_tail_tokens))
    counted = (F.col("type") == "tool_result_success") & ~F.col("pinned")
    stale = counted & (_rank(counted) > policy.keep_tool_results) & ~F.col("tail") if policy.clear_stale else F.lit(False)
    rows = rows.withColumn("cleared", stale)
    id_ = keys.key(F.col("content"))
    named = F.when(F.coalesce(F.length("tool_name"), F.lit(0)) > 0, F.col("tool_name")).otherwise("unknown")
    stub = F.concat(F.lit("[tool:"), named, F.lit("] result cleared ("), tokens.estimate(F.col("content")).cast("string"), F.lit(" tokens) — original retrievable via "), keys.marker(id_))
    return rows.withColumns({"ccr_id": F.when(F.col("cleared"), id_), "original": F.when(F.col("cleared"), F.col("content")), "content": F.when(F.col("cleared"), stub).otherwise(F.col("content"))})


def originals(cleared: DataFrame) -> DataFrame:
    """The stored originals of cleared messages, one for each id."""
    return cleared.where("cleared").select(F.col("ccr_id").alias("id"), "original").dropDuplicates(["id"])


def stats(messages: DataFrame, policy: AgentPolicy = AgentPolicy()) -> DataFrame:
    """Counts and tokens before and after clearing, for each conversation."""
    rows = clear_tool_results(messages, policy)
    n = lambda c: F.sum(c.cast("long"))
    before = F.coalesce("original", "content")
    success = F.col("type") == "tool_result_success"
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("messages"),
        n(success).alias("tool_results"),
        n(F.col("cleared")).alias("cleared"),
        n(success & ~F.col("cleared")).alias("kept"),
        n(F.col("pinned")).alias("pinned"),
        n(F.col("type") == "tool_result_error").alias("errors"),
        tokens.count_messages(before).alias("tokens_before"),
        tokens.count_messages(F.col("content")).alias("tokens_after"),
    )
