"""History in bands: old turns summarised, the middle compressed, recent ones as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import summary
from .agent import with_columns

CONTEXT = "[Earlier conversation context]"


def assign(messages: DataFrame, recent: int = 4, middle: int = 10) -> DataFrame:
    """``band`` of each message.

    The middle starts at a message that isn't a tool's, and not after the
    first pinned one.
    """
    w = Window.partitionBy("conv_id")
    rows = with_columns(messages).withColumns({"idx": F.row_number().over(w.orderBy("turn")) - 1, "n": F.count("*").over(w)})
    wanted = F.greatest(F.col("n") - recent - middle, F.lit(0))
    rows = rows.withColumns({"_aligned": F.coalesce(F.max(F.when(~F.col("role").isin("tool", "function") & (F.col("idx") <= wanted), F.col("idx"))).over(w), F.lit(0)), "_pinned": F.min(F.when(F.col("pinned"), F.col("idx"))).over(w)})
    start = F.when(F.col("_pinned") < F.col("_aligned"), F.col("_pinned")).otherwise(F.col("_aligned"))
    band = F.when((F.col("n") <= recent) | (F.col("idx") >= F.col("n") - recent), "recent").when(F.col("idx") >= start, "middle").otherwise("old")
    return rows.withColumn("band", band).drop("_aligned", "_pinned", "n")


def compress_history(messages: DataFrame, recent: int = 4, middle: int = 10, summarise: bool = True, summaries: DataFrame | None = None) -> DataFrame:
    """Messages after one pass: (conv_id, idx, role, content, pinned).

    Old turns become one system message, or go; it and the middle are
    compressed, pinned messages excepted.  ``summaries`` (conv_id, summary) can
    come from a summariser of one's own.
    """
    from ..plans.pipeline import CompressConfig, reduce, routed

    rows = assign(messages, recent, middle)
    rest = rows.where("band <> 'old'").select("conv_id", "turn", "role", "content", "pinned", "band")
    if summarise:
        old = rows.where("band = 'old'")
        own = summary.summarise_turns(old) if summaries is None else old.select("conv_id").distinct().join(summaries, "conv_id")
        head = own.select("conv_id", F.lit(-1).alias("turn"), F.lit("system").alias("role"), F.concat(F.lit(f"{CONTEXT}: "), F.col("summary")).alias("content"), F.lit(False).alias("pinned"), F.lit("middle").alias("band"))
        rest = rest.unionByName(head)
    config = CompressConfig(reversible=False)
    named = routed(rest, config).withColumn("compressor", F.when((F.col("band") == "middle") & ~F.col("pinned"), F.col("compressor")).otherwise("passthrough")).drop("detected")
    done = reduce(named, config)
    return done.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("idx"), "role", F.col("reduced").alias("content"), "pinned")
