"""Content compression of a table of messages: detect, route, reduce, account.

Detection, routing and accounting are expressions; only the reduction of
routed payloads leaves the JVM, in Arrow batches of the columns it needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import detect as D
from ..functions import focus as focus_
from ..functions import tokens
from ..functions.text import collapse
from ..operators import kernels
from ..sources.batches import cut_batches
from ..sources.shared import materialise
from .extensions import Compressor

BUILT_IN = tuple(kernels.COMPRESSORS)
#: Bytes of content in one Arrow batch that is reduced.
BATCH_BYTES = 4 << 20
DEFAULT = ("smart_crusher", "log_stripper", "ast_code", "semantic")


@dataclass(frozen=True)
class CompressConfig:
    enabled: tuple[str, ...] = DEFAULT
    reversible: bool = True
    align: bool = False
    question: str | None = None
    content: str = "content"
    compressors: tuple[Compressor, ...] = ()

    def __post_init__(self):
        if unknown := set(self.enabled) - set(BUILT_IN) - {c.name for c in self.compressors}:
            raise ValueError(f"unknown compressors: {sorted(unknown)}")


@dataclass
class CompressResult:
    messages: DataFrame
    originals: DataFrame
    stats: DataFrame


def align_text(text: Column) -> Column:
    """Key-sorted compact JSON where a text is JSON, else white-space runs as one space.

    Only texts that begin like JSON leave the JVM, where numbers would lose their spelling.
    """
    like = text.rlike(r'^(?U)\s*(?:[\[{"\-0-9]|(?:true|false|null|NaN|Infinity)\s*$)')

    @F.pandas_udf("string")
    def run(values):
        return values.map(lambda v: v if v is None else kernels.align(v))

    return F.when(like, run(F.when(like, text))).otherwise(collapse(text))


def minify(text: Column) -> Column:
    """Compact JSON where that is shorter, else lines joined."""

    @F.pandas_udf("string")
    def run(values):
        return values.map(lambda v: v if v is None else kernels.toon(v)[0])

    return run(text)


def routed(messages: DataFrame, config: CompressConfig = CompressConfig()) -> DataFrame:
    """Messages with detection and the compressor's name."""
    found = messages.withColumn("detected", D.detect(F.col(config.content)))
    name = D.route(F.col("detected.content_type"), config.enabled)
    for own in reversed(config.compressors):
        name = F.when(F.col("detected.content_type").isin(*own.content_types), own.name).otherwise(name) if own.content_types else name
    return found.withColumn("compressor", name)


def reduce(rows: DataFrame, config: CompressConfig) -> DataFrame:
    """``reduced``, ``saved`` and ``failed`` of routed rows; a passthrough stays as it is."""
    terms, saved = focus_.terms(config.question), "array<struct<id:string,original:string>>"
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(f"reduced string, saved {saved}, failed string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("id", pa.string()), ("original", pa.string())]))
        own = {c.name: c.run for c in config.compressors}
        for batch in cut_batches(batches, config.content, BATCH_BYTES):
            at = batch.schema.get_field_index
            done = [kernels.compress(n, t or "", terms, config.reversible, own) for n, t in zip(batch.column(at("compressor")).to_pylist(), batch.column(at(config.content)).to_pylist(), strict=True)]
            more = [pa.array([d[0] for d in done], pa.string()), pa.array([[{"id": i, "original": o} for i, o in d[1]] for d in done], kind), pa.array([d[2] for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "reduced", "saved", "failed"])

    # one branch for all rows: a split by compressor would detect each text again
    return rows.mapInArrow(run, schema)


def compress(messages: DataFrame, config: CompressConfig = CompressConfig()) -> CompressResult:
    """Messages with shorter contents, the originals that markers lead to, and totals."""
    if config.align:
        messages = messages.withColumn(config.content, align_text(F.col(config.content)))
    rows = materialise(reduce(routed(messages, config), config), "compressed")
    changed = F.col("reduced") != F.col(config.content)
    out = rows.withColumn("ccr_id", F.when(changed & F.lit(config.reversible), F.element_at("saved", -1)["id"]))
    originals = out.where(F.col("ccr_id").isNotNull()).select(F.explode("saved").alias("s")).select("s.id", "s.original").dropDuplicates(["id"])
    return CompressResult(out.withColumn(config.content, F.col("reduced")).drop("reduced", "saved"), originals, stats(rows, config))


def stats(rows: DataFrame, config: CompressConfig = CompressConfig()) -> DataFrame:
    """Messages, tokens before and after, and their ratio by compressor, and for all as ``mixed``."""
    own = rows.select("compressor", tokens.estimate(F.col(config.content)).alias("o"), F.floor(F.octet_length("reduced") / 4).alias("c"), F.col("failed").isNotNull().cast("int").alias("f"))
    sums = own.cube("compressor").agg(F.count("*").alias("messages"), F.sum("o").alias("original_tokens"), F.sum("c").alias("compressed_tokens"), F.sum("f").alias("errors"))
    return sums.select(F.coalesce("compressor", F.lit("mixed")).alias("compressor"), "messages", "original_tokens", "compressed_tokens", (F.col("compressed_tokens") / F.col("original_tokens")).alias("ratio"), "errors")


def events(rows: DataFrame) -> DataFrame:
    """The audit trail: one row for each detection, reduction and error."""
    of = lambda name, detail: F.struct(F.lit(name).alias("event"), detail.cast("string").alias("detail"))
    each = F.array_compact(F.array(of("content_detected", F.col("detected.content_type")), of("compressor_selected", F.col("compressor")), F.when(F.col("failed").isNotNull(), of("error", F.col("failed")))))
    return rows.select("conv_id", "turn", F.explode(each).alias("e")).select("conv_id", "turn", "e.*")


def observed(rows: DataFrame, name: str = "compress") -> tuple[DataFrame, Observation]:
    """``rows`` with counters that are filled by the action that runs them."""
    seen = Observation(name)
    return rows.observe(seen, F.count("*").alias("messages"), F.sum(F.octet_length("content")).alias("bytes"), F.count("failed").alias("errors")), seen
