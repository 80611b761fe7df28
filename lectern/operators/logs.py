"""Log reduction in long form: (log_id, line_no, line) rows.

Traces need a state from line to line and stay in the kernel
(:func:`lectern.operators.kernels.trace_flags`, whole texts by :func:`traces`); everything else is windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import any_of
from ..sources.batches import cut_batches
from . import kernels
from .kernels import LEVELS, LOG_FORMATS, SCORES

BATCH_BYTES = 4 << 20

SUMMARY_PATTERN = (
    r"^(?:===|---|\d+ (?:passed|failed|skipped|error|warning)|(?:Tests?|Suites?)[ :]\s*[0-9]|(?:TOTAL|Total|Summary))"
    r"|^(?:Build|Compile)(?=.*(?:succeeded|failed|complete))|^Test(?!s?[ :])(?=.*(?:succeeded|failed|complete))"
)


def level(line: Column) -> Column:
    """By the first of the words that occurs, as part of others too."""
    upper, out = F.upper(line), None
    for name, words in LEVELS:
        hit = F.contains(upper, F.lit(words[0]))
        for w in words[1:]:
            hit = hit | F.contains(upper, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def is_summary(line: Column) -> Column:
    return line.rlike(SUMMARY_PATTERN)


def similar(line: Column) -> Column:
    """A warning without what varies after its first ``:`` or ``=``."""
    head = F.regexp_extract(line, r"^([^:=]*)", 1)
    rest = F.regexp_replace(F.substring(line, F.char_length(head) + 1, F.char_length(line)), r"[0-9]+", "N")
    return F.concat(head, F.regexp_replace(F.regexp_replace(rest, r"[0-9a-fA-F]+", "H"), r"/[^\s]*", "/P/"))


def log_format(lines: DataFrame) -> DataFrame:
    """(log_id, format): of a log's first 100 lines, whichever format's words most lines hold; ties by list order."""
    head = lines.where("line_no < 100")
    counts = []
    for k, (name, parts) in enumerate(LOG_FORMATS.items()):
        counts.append(F.struct(F.sum(any_of(F.col("line"), list(parts)).cast("int")).alias("n"), F.lit(-k).alias("place"), F.lit(name).alias("name")))
    best = head.groupBy("log_id").agg(F.array_max(F.array(*counts)).alias("best"))
    return best.select("log_id", F.when(F.col("best.n") > 0, F.col("best.name")).otherwise("generic").alias("format"))


def score(level_: Column, stack: Column, summary: Column) -> Column:
    base = None
    for name, s in SCORES.items():
        base = F.when(level_ == name, s) if base is None else base.when(level_ == name, s)
    return F.least(F.lit(1.0), F.round(base + F.when(stack, 0.3).otherwise(0.0) + F.when(summary, 0.4).otherwise(0.0), 2))


def warnings_once(lines: DataFrame) -> DataFrame:
    """Warnings without those similar to an earlier one of their log."""
    warn = lines.withColumn("level", level(F.col("line"))).where("level = 'warn'").withColumn("key", similar(F.col("line")))
    return warn.withColumn("_n", F.row_number().over(Window.partitionBy("log_id", "key").orderBy("line_no"))).where("_n = 1").drop("_n")


def select_lines(lines: DataFrame, errors: int = 10, warnings: int = 5, context: int = 3, total: int = 100, least_lines: int = 50) -> DataFrame:
    """Lines that a reduced log keeps, for logs without traces; short logs keep all."""
    rows = lines.withColumns({"level": level(F.col("line")), "summary": is_summary(F.col("line"))})
    rows = rows.withColumns({"score": score(F.col("level"), F.lit(False), F.col("summary")), "key": F.when(F.col("level") == "warn", similar(F.col("line"))), "n": F.count("*").over(Window.partitionBy("log_id"))})
    of = lambda *c: Window.partitionBy("log_id", *c)
    by = rows.withColumns({
        "_first": F.row_number().over(of("level").orderBy("line_no")), "_last": F.row_number().over(of("level").orderBy(F.desc("line_no"))),
        "_of": F.count("*").over(of("level")), "_once": F.row_number().over(of("level", "key").orderBy("line_no")),
    })
    ends = (F.col("_first") == 1) | (F.col("_last") == 1)
    by = by.withColumns({
        "_rest": F.row_number().over(Window.partitionBy("log_id", "level", ends).orderBy(F.desc("score"), "line_no")),
        "_warn": F.row_number().over(Window.partitionBy("log_id", F.col("level") == "warn", F.col("_once") == 1).orderBy("line_no")),
    })
    bad = F.col("level").isin("error", "fail") & ((F.col("_of") <= errors) | ends | (F.col("_rest") <= errors - 2))
    warn = (F.col("level") == "warn") & (F.col("_once") == 1) & (F.col("_warn") <= warnings)
    chosen = by.withColumn("chosen", bad | warn | F.col("summary"))
    near = F.max(F.col("chosen").cast("int")).over(Window.partitionBy("log_id").orderBy("line_no").rowsBetween(-context, context)) == 1
    kept = chosen.withColumn("_near", near)
    rank = F.row_number().over(Window.partitionBy("log_id", "_near").orderBy(F.desc("score"), "line_no"))
    kept = kept.withColumn("kept", (F.col("n") < least_lines) | F.col("_near") & (rank <= total))
    return kept.select("log_id", "line_no", "line", "level", "summary", "score", "chosen", "kept")


def footers(selected: DataFrame) -> DataFrame:
    """For each log the lines kept and the note on those left out."""
    gone = ~F.col("kept")
    counts = selected.groupBy("log_id").agg(F.count("*").alias("lines"), F.sum(F.col("kept").cast("long")).alias("kept"), *[F.sum((gone & (F.col("level") == x)).cast("long")).alias(x) for x in ("error", "fail", "warn", "info")])
    parts = F.array_compact(F.array(*[F.when(F.col(x) > 0, F.concat(F.col(x).cast("string"), F.lit(f" {x.upper()}"))) for x in ("error", "fail", "warn", "info")]))
    note = F.when(F.size(parts) > 0, F.concat(F.lit("["), (F.col("lines") - F.col("kept")).cast("string"), F.lit(" lines omitted: "), F.array_join(parts, ", "), F.lit("]")))
    return counts.select("log_id", "lines", "kept", note.alias("note"))


def traces(rows: DataFrame, text: str) -> DataFrame:
    """``traces``: numbers of the lines inside stack traces, from 0; none for a null text."""
    schema = T.StructType([*rows.schema.fields, T.StructField("traces", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches, text, BATCH_BYTES):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            at = [[i for i, inside in enumerate(kernels.trace_flags(t.split("\n"))) if inside] if t else [] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.list_(pa.int32()))], [*batch.schema.names, "traces"])

    return rows.mapInArrow(run, schema)
