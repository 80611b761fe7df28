"""Messages of content blocks: text, thinking, image, tool_use, tool_result, reference.

``blocks`` is an array of wide structs; the content of a tool result is a JSON
array of blocks in ``content_json``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions import keys, tokens
from ..sources.batches import cut_batches
from . import kernels

BLOCK = "struct<type:string,text:string,id:string,name:string,input_json:string,tool_use_id:string,is_error:boolean,content_json:string,kind:string,id_or_path:string,image:struct<kind:string,media_type:string,data:string,url:string,alt:string>>"
MEDIA_TYPE = "application/vnd.lectern.rich+json"
_INNER = "array<struct<type:string,text:string,name:string,kind:string,id_or_path:string,is_error:boolean>>"


def _plain(b: Column, inner: Column) -> Column:
    what = F.coalesce(b["image"]["media_type"], b["image"]["url"])
    return (
        F.when(b["type"] == "text", b["text"])
        .when(b["type"] == "thinking", F.concat(F.lit("[thinking] "), b["text"]))
        .when(b["type"] == "image", F.when(b["image"]["alt"].isNotNull(), F.concat(F.lit("[image: "), what, F.lit(" — "), b["image"]["alt"], F.lit("]"))).otherwise(F.concat(F.lit("[image: "), what, F.lit("]"))))
        .when(b["type"] == "tool_use", F.concat(F.lit("[tool_use "), b["name"], F.lit(": "), b["input_json"], F.lit("]")))
        .when(b["type"] == "tool_result", F.concat(F.when(F.coalesce(b["is_error"], F.lit(False)), "[tool_result error] ").otherwise("[tool_result] "), inner))
        .when(b["type"] == "reference", F.concat(F.lit("["), b["kind"], F.lit(": "), b["id_or_path"], F.lit("]")))
        .otherwise("")
    )


def flatten(text: Column, blocks: Column) -> Column:
    """A message as plain text: its text, or its blocks line by line."""
    inside = lambda b: F.array_join(F.transform(F.from_json(b["content_json"], _INNER), lambda x: F.coalesce(x["text"], x["name"], x["id_or_path"], F.lit(""))), "\n")
    rows = F.transform(blocks, lambda b: _plain(b, F.coalesce(inside(b), F.lit(""))))
    return F.coalesce(text, F.array_join(rows, "\n"), F.lit(""))


def lift(messages: DataFrame) -> DataFrame:
    """Flat messages as rich ones with text only."""
    return messages.withColumnRenamed("content", "text").withColumn("blocks", F.lit(None).cast(f"array<{BLOCK}>"))


def rich_tokens(text: Column, blocks: Column, model: str = "") -> Column:
    """Tokens with overhead; opaque blocks count at their real size."""
    data = F.aggregate(F.coalesce(blocks, F.array().cast(f"array<{BLOCK}>")), F.lit(0), lambda n, b: n + F.coalesce(F.octet_length(b["image"]["data"]), F.lit(0)))
    extra = F.ceil(data / F.lit(tokens.bytes_per_token(model)))
    return (tokens.estimate(flatten(text, blocks), model) + extra + tokens.OVERHEAD).cast("long")


def failed(blocks: Column) -> Column:
    """Whether any tool result is an error, one level down too."""
    deep = lambda b: F.coalesce(F.exists(F.from_json(b["content_json"], _INNER), lambda x: F.coalesce(x["is_error"], F.lit(False))), F.lit(False))
    return F.coalesce(F.exists(blocks, lambda b: (b["type"] == "tool_result") & (F.coalesce(b["is_error"], F.lit(False)) | deep(b))), F.lit(False))


def project(rich: DataFrame) -> DataFrame:
    """The flat messages that agent rules see: errors keep their status."""
    bad = failed(F.col("blocks"))
    name = F.get(F.filter("blocks", lambda b: b["type"] == "tool_use"), F.lit(0))["name"]
    return rich.select("conv_id", "turn", "role", flatten(F.col("text"), F.col("blocks")).alias("content"), name.alias("tool_name"), F.when(bad, "error").alias("tool_status"), F.when(bad, "tool_result_error").alias("tag"))


def rich_tags(rich: DataFrame, span: list[str]) -> DataFrame:
    """Names of tools used and ``tool_error`` where one failed."""
    names = F.transform(F.filter("blocks", lambda b: b["type"] == "tool_use"), lambda b: b["name"])
    rows = rich.select(*span, F.coalesce(names, F.array().cast("array<string>")).alias("names"), failed(F.col("blocks")).alias("bad"))
    return rows.groupBy(*span).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), 1, 64).alias("tool_names"), F.when(F.max("bad"), F.array(F.lit("tool_error"))).otherwise(F.array().cast("array<string>")).alias("error_classes"))


def compress_blocks(rich: DataFrame, thinking: bool = False) -> DataFrame:
    """Text blocks reduced; images, calls, references and failed results untouched.

    ``ccr_id`` is the key of the whole original where anything changed, and
    ``original`` its JSON.
    """
    whole = F.to_json(F.struct("role", "text", "blocks"))
    rows = rich.withColumn("original", whole)

    def shorter(text: str | None) -> str | None:
        from .conversation import detect

        return text if text is None else kernels.compress(D.ROUTES[detect(text)], text, (), False)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches, "original", 4 << 20):
            t, b = batch.schema.get_field_index("text"), batch.schema.get_field_index("blocks")
            blocks = batch.column(b).to_pylist()
            for row in blocks:
                for x in row or ():
                    if x["type"] == "text" or thinking and x["type"] == "thinking":
                        x["text"] = shorter(x["text"])
            columns = list(batch.columns)
            columns[t] = pa.array([shorter(x) for x in batch.column(t).to_pylist()], batch.schema.field(t).type)
            columns[b] = pa.array(blocks, batch.schema.field(b).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = rows.mapInArrow(run, rows.schema)
    changed = F.to_json(F.struct("role", "text", "blocks")) != F.col("original")
    return out.withColumn("ccr_id", F.when(changed, F.concat(F.lit("rich-"), keys.key(F.col("original"))))).withColumn("original", F.when(changed, F.col("original")))


def restore(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Rich messages by ccr_id; entries of another media type don't count."""
    met = requests.join(store.where(F.col("media_type") == MEDIA_TYPE).select(F.col("id").alias("ccr_id"), "original"), "ccr_id")
    own = F.from_json("original", f"role string, text string, blocks array<{BLOCK}>")
    return met.select(*requests.columns, own["role"].alias("role"), own["text"].alias("text"), own["blocks"].alias("blocks"))


def render_turns(rich: DataFrame) -> DataFrame:
    """(conv_id, run, side, blocks): turns for a provider that wants sides to alternate.

    Runs of one side are one turn.  A call and its result stay blocks only in
    adjacent turns, otherwise they become text; results come first in a turn.
    """
    side = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    text_block = F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))), BLOCK)
    rows = rich.where("role <> 'system'").withColumn("side", side).withColumn("blocks", F.coalesce("blocks", F.array(text_block)))
    rows = rows.where(F.size(F.filter("blocks", lambda b: (b["type"] != "text") | (F.length(b["text"]) > 0))) > 0)
    o = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("run", F.sum((F.coalesce(F.lag("side").over(o), F.lit("")) != F.col("side")).cast("int")).over(o))
    turns = rows.groupBy("conv_id", "run", "side").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "blocks"))), lambda x: x["blocks"])).alias("blocks"))
    calls = F.transform(F.filter("blocks", lambda b: b["type"] == "tool_use"), lambda b: b["id"])
    results = F.transform(F.filter("blocks", lambda b: b["type"] == "tool_result"), lambda b: b["tool_use_id"])
    r, none = Window.partitionBy("conv_id").orderBy("run"), F.array().cast("array<string>")
    turns = turns.withColumns({"_called": F.coalesce(F.lag(calls).over(r), none), "_answered": F.coalesce(F.lead(results).over(r), none)})

    def paired(b: Column) -> Column:
        fits = F.when(b["type"] == "tool_use", F.array_contains("_answered", b["id"])).when(b["type"] == "tool_result", F.array_contains("_called", b["tool_use_id"])).otherwise(True)
        as_text = F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), _plain(b, F.coalesce(b["content_json"], F.lit(""))).alias("text"))), BLOCK)
        return F.when(F.coalesce(fits, F.lit(False)), b).otherwise(as_text)

    blocks = F.transform("blocks", paired)
    first = F.concat(F.filter(blocks, lambda b: b["type"] == "tool_result"), F.filter(blocks, lambda b: b["type"] != "tool_result"))
    return turns.select("conv_id", "run", "side", first.alias("blocks"))


def canonical(rich: DataFrame) -> DataFrame:
    """(conv_id, content_key): the key of whole conversations over roles and blocks, without metadata."""
    part = F.concat(F.col("role"), F.lit("\x1f"), F.coalesce("text", F.lit("")), F.lit("\x1f"), F.coalesce(F.to_json("blocks"), F.lit("")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"]), "\x1e")
    return rich.groupBy("conv_id").agg(F.concat(F.lit("rich-"), keys.key(joined)).alias("content_key"))


def compact_rich(rich: DataFrame, config=None, thinking: bool = False):
    """Compact on the flat projection first, then shorten the blocks of what was kept and isn't protected.

    Returns (messages, result): folded rows are flat text, kept ones have their
    blocks; ``result`` is that of the flat cascade.
    """
    from .conversation import CompactConfig, compact

    result = compact(project(rich), config or CompactConfig())
    numbered = rich.withColumn("origin", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    protected = result.reports.select("conv_id", F.explode("protected").alias("origin")).withColumn("safe", F.lit(True))
    now = result.messages.select("conv_id", "idx", "origin", F.col("content").alias("flat"), F.col("role").alias("now_role"), F.col("ccr_id").alias("fold_id"))
    met = now.join(numbered, ["conv_id", "origin"], "left").join(protected, ["conv_id", "origin"], "left")
    same = F.col("origin").isNotNull() & F.col("fold_id").isNull() & (F.col("flat") == flatten(F.col("text"), F.col("blocks")))
    met = met.withColumn("same", F.coalesce(same, F.lit(False)))
    folded = met.where("not same").select("conv_id", "idx", F.col("now_role").alias("role"), F.col("flat").alias("text"), F.lit(None).cast(f"array<{BLOCK}>").alias("blocks"), F.col("fold_id").alias("ccr_id"), F.lit(None).cast("string").alias("original"))
    kept = met.where("same and safe").select("conv_id", "idx", "role", "text", "blocks", F.lit(None).cast("string").alias("ccr_id"), F.lit(None).cast("string").alias("original"))
    short = compress_blocks(met.where("same and safe is null").select("conv_id", "idx", "role", "text", "blocks"), thinking).select("conv_id", "idx", "role", "text", "blocks", "ccr_id", "original")
    return folded.unionByName(kept).unionByName(short), result
