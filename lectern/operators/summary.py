"""Structured summaries of conversations: one row for each, from exploded lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, first_sentence, prefix, trim
from .agent import ERROR_PATTERNS

#: Files that a text names, and how lines of decisions and next steps begin.
FILE = r"[A-Za-z0-9_./\-]+\.(?:rs|py|ts|tsx|js|jsx|go|java|kt|rb|c|h|cpp|hpp|md|toml|yaml|yml|json|sql|sh)\b"
DECISIONS = ["decision:", "decided", "we will ", "we chose ", "chose ", "agreed "]
NEXT = ["todo", "next:", "next step"]
MOST_FILES, MOST = 50, 20


def line_class(line: Column) -> Column:
    """decision, error or next, tried in this order; null for other lines."""
    low = F.lower(line)
    starts = lambda words: F.greatest(*[low.startswith(w) for w in words])
    return F.when(starts(DECISIONS), "decision").when(any_of(line, ERROR_PATTERNS), "error").when(starts(NEXT) | line.startswith("- [ ]"), "next")


def summarize(messages: DataFrame) -> DataFrame:
    """(conv_id, intent, files, decisions, errors, next_steps, turns_covered).

    Lines and files are found in the message's row; one shuffle by conversation
    and class brings equal lines together, a second one the conversation's.
    """
    text = F.col("content")
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x, i: F.struct(i.alias("at"), trim(x).alias("line"))), lambda x: F.length(x["line"]) > 0)
    noted = F.filter(F.transform(lines, lambda x: F.struct(line_class(x["line"]).alias("class"), F.when(line_class(x["line"]) == "error", prefix(x["line"], 300)).otherwise(x["line"]).alias("line"), x["at"].alias("at"))), lambda x: x["class"].isNotNull())
    files = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(FILE), 0)), lambda f: F.struct(F.lit("file").alias("class"), f.alias("line"), F.lit(0).alias("at")))
    intent = F.when(F.col("role") == "user", F.array(F.struct(F.lit("intent").alias("class"), prefix(first_sentence(text), 200).alias("line"), F.lit(0).alias("at"))))
    # a row without notes still counts as a turn
    turn = F.array(F.struct(F.lit("turn").alias("class"), F.lit("").alias("line"), F.lit(0).alias("at")))
    kinds = "array<struct<class:string,line:string,at:int>>"
    each = messages.select("conv_id", "turn", F.explode(F.concat(turn, F.coalesce(noted.cast(kinds), F.array().cast(kinds)), F.coalesce(files.cast(kinds), F.array().cast(kinds)), F.coalesce(intent.cast(kinds), F.array().cast(kinds)))).alias("x")).select("conv_id", "turn", "x.*")
    # intents and files keep their own order: by turn, and by name
    once = each.groupBy("conv_id", "class", "line").agg(F.min(F.struct("turn", "at")).alias("seen"), F.count("*").alias("n"))
    by = Window.partitionBy("conv_id", "class").orderBy(F.when(F.col("class") == "file", F.col("line")), "seen")
    most = F.when(F.col("class") == "file", MOST_FILES).otherwise(MOST)
    ranked = once.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("class") == c, F.struct("rank", "line")))), lambda x: x["line"])
    return ranked.groupBy("conv_id").agg(
        F.coalesce(F.get(of("intent"), F.lit(0)), F.lit("")).alias("intent"), of("file").alias("files"), of("decision").alias("decisions"), of("error").alias("errors"), of("next").alias("next_steps"),
        F.sum(F.when(F.col("class") == "turn", F.col("n"))).alias("turns_covered"),
    )


def markdown(row: DataFrame) -> Column:
    """Sections that have something, with bullets, parted by blank lines."""
    bullets = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"## {title}\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")))
    intent = F.when(F.length("intent") > 0, F.concat(F.lit("## Session intent\n"), F.col("intent")))
    parts = [intent, bullets("Files touched", F.col("files")), bullets("Key decisions", F.col("decisions")), bullets("Unresolved errors", F.col("errors")), bullets("Next steps", F.col("next_steps"))]
    return F.array_join(F.array_compact(F.array(*parts)), "\n\n")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Summaries of more turns joined to earlier ones: the intent stays, lists grow, and turns
    are added only where something changed."""
    met = old.alias("a").join(new.alias("b"), "conv_id")
    lists = {c: F.slice(F.array_distinct(F.concat(F.col(f"a.{c}"), F.col(f"b.{c}"))), 1, MOST) for c in ("decisions", "errors", "next_steps")}
    files = F.slice(F.array_sort(F.array_union("a.files", "b.files")), 1, MOST_FILES)
    intent = F.when(F.length("a.intent") > 0, F.col("a.intent")).otherwise(F.col("b.intent"))
    changed = (intent != F.col("a.intent")) | (files != F.col("a.files"))
    for c, v in lists.items():
        changed = changed | (v != F.col(f"a.{c}"))
    return met.select("conv_id", intent.alias("intent"), files.alias("files"), *[v.alias(c) for c, v in lists.items()], (F.col("a.turns_covered") + F.when(changed, F.col("b.turns_covered")).otherwise(0)).alias("turns_covered"))


def summarise_turns(messages: DataFrame, limit: int = 800) -> DataFrame:
    """(conv_id, summary): first sentences in order, joined, cut at ``limit`` bytes."""
    rows = messages.select("conv_id", "turn", first_sentence(F.col("content")).alias("s")).where("s <> ''")
    joined = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"]), " | ").alias("all"))
    return joined.select("conv_id", F.when(F.octet_length("all") > limit, F.concat(prefix(F.col("all"), limit), F.lit("…"))).otherwise(F.col("all")).alias("summary"))
