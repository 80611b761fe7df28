"""Chat formatting of reply trees.

Messages point to their parents.  Self-joins that double the distance of each
ancestor pointer give every node its depth and the summed score of its path
from the root; the best leaf of each conversation is chosen, the saved pointer
tables mark its path, and the path is written as one text with turn marks and
the character spans under the loss mask.

Escaping is reversible: inside roles and texts ``<|`` with any backslashes
between the two characters gets one backslash more, so that no control string
can occur; line breaks and backslashes of roles are escaped by a backslash.

Defined results: null texts and roles count as empty; a parent that does not
exist makes its child a root; nodes on a cycle have no path and are left out;
ties of score go to the longer path, then the smaller node; conversations
whose id is null form one; an empty table gives an empty result.

A conversation is one text in the end, so one task holds the turns of one
conversation; nothing larger is brought together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

START, END = "<|im_start|>", "<|im_end|>\n"
#: The role whose texts are learned.
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    pieces = F.transform(F.split(unescape(role), r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(pieces, "\\")


def _double(open_: DataFrame, table: DataFrame) -> DataFrame:
    """Join each pointer to the row it points at: twice the distance."""
    far = table.select(F.col("conv").alias("f_conv"), F.col("node").alias("f_node"), F.col("up").alias("f_up"), F.col("total").alias("f_total"), F.col("depth").alias("f_depth"))
    met = open_.join(far, F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("up") == F.col("f_node")))
    return met.select("conv", "node", F.col("f_up").alias("up"), (F.col("total") + F.col("f_total")).alias("total"), (F.col("depth") + F.col("f_depth")).alias("depth"))


def best_paths(nodes: DataFrame) -> DataFrame:
    """(conv, node, parent, score), node unique in conv: the nodes of each best path with their depths."""
    known = nodes.select(F.col("conv").alias("p_conv"), F.col("node").alias("p_node"))
    found = nodes.join(known, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("parent") == F.col("p_node")), "left")
    table = materialise(found.select("conv", "node", F.col("p_node").alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"), F.lit(1).alias("depth")), "tree")
    largest = table.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    parents = table.select(F.col("conv").alias("p_conv"), F.col("up").alias("p_node")).where("p_node is not null").distinct()
    leaves = table.join(parents, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("node") == F.col("p_node")), "left_anti").select("conv", "node")
    # only rows that still point at an ancestor go on: a long conversation costs its own rows
    closed, jumps, now = table.where("up is null"), [], table.where("up is not null")
    for _ in range(math.ceil(math.log2(largest)) if largest > 1 else 0):
        jumps.append(now.select("conv", "node", "up"))
        met = materialise(_double(now, closed.unionByName(now)), "tree")
        closed, now = closed.unionByName(met.where("up is null")), met.where("up is not null")
    totals = closed.select("conv", "node", "total", "depth")
    ends = leaves.withColumnsRenamed({"conv": "l_conv", "node": "l_node"}).join(totals, F.col("conv").eqNullSafe(F.col("l_conv")) & (F.col("node") == F.col("l_node"))).select("conv", "node", "total", "depth")
    marked = ends.groupBy("conv").agg(F.max_by("node", F.struct("total", "depth", -F.col("node"))).alias("node"))
    for jump in reversed(jumps):
        to = jump.select(F.col("conv").alias("j_conv"), F.col("node").alias("j_node"), "up")
        up = marked.join(to, F.col("conv").eqNullSafe(F.col("j_conv")) & (F.col("node") == F.col("j_node"))).select("conv", F.col("up").alias("node"))
        marked = materialise(marked.unionByName(up), "marked")
    path = marked.withColumnsRenamed({"conv": "m_conv", "node": "m_node"})
    return path.join(totals, F.col("conv").eqNullSafe(F.col("m_conv")) & (F.col("node") == F.col("m_node"))).select("conv", "node", "depth")


def format_trees(messages: DataFrame) -> DataFrame:
    """(conv, node, parent, role, text, score) to one formatted text for each conversation.

    Columns: conv, formatted, loss_spans (start and end in characters).
    """
    path = best_paths(messages.select("conv", "node", "parent", "score"))
    texts = messages.select(F.col("conv").alias("t_conv"), F.col("node").alias("t_node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = path.join(texts, F.col("conv").eqNullSafe(F.col("t_conv")) & (F.col("node") == F.col("t_node"))).select("conv", "depth", "role", escape_role(F.col("role")).alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.select("conv", "depth", (F.col("role") == LOSS_ROLE).alias("learned"), F.concat(F.lit(START), "head", F.lit("\n")).alias("head"), "body")
    turns = turns.withColumn("size", F.char_length("head") + F.char_length("body") + len(END))
    before = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(before), F.lit(0)) + F.char_length("head")
    turns = turns.select("conv", "depth", "learned", F.concat("head", "body", F.lit(END)).alias("piece"), start.alias("start"), (start + F.char_length("body")).alias("end"))
    whole = turns.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "piece", "learned", "start", "end"))).alias("turns"))
    return whole.select(
        "conv",
        F.array_join(F.transform("turns", lambda t: t.piece), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t.learned), lambda t: F.struct(t.start.alias("start"), t.end.alias("end"))).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted text, unescaped."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    inner = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substring(p, F.lit(len(START) + 1), F.char_length(p)))
    return F.transform(inner, lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.instr(p, "\n") + 1, F.char_length(p))).alias("text")))


def learned_text(formatted: Column, spans: Column) -> Column:
    """Everything under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s.start.cast("int") + 1, (s.end - s.start).cast("int")))), "")


def chains(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """A table of turns as trees without branches; equal turns stay apart."""
    own = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    own = own.withColumn("node", F.row_number().over(order))
    return own.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
