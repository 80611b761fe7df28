"""Repeated and long paragraphs in long form: (text_id, pos, para) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.text import collapse, prefix, trim

LONG = 800


def explode(texts: DataFrame, id_: str, text: str) -> DataFrame:
    return texts.select(F.col(id_).alias("text_id"), F.posexplode(F.split(text, "\n\n", -1)).alias("pos", "para"))


def semantic(paras: DataFrame) -> DataFrame:
    """What each paragraph becomes: (text_id, pos, out_pos, out).

    The first three repeats of a text point to the first sight's place in the
    output, further ones vanish, and long paragraphs are cut.
    """
    rows = paras.withColumn("key", collapse(F.col("para"))).where("key <> ''")
    o = Window.partitionBy("text_id").orderBy("pos")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("text_id", "key").orderBy("pos")))
    repeat = (F.col("nth") > 1).cast("int")
    rows = rows.withColumn("repeats", F.sum(repeat).over(o))
    rows = rows.withColumn("emitted", (F.col("nth") == 1) | (F.col("repeats") <= 3))
    rows = rows.withColumn("out_pos", F.sum(F.col("emitted").cast("int")).over(o) - 1)
    rows = rows.withColumn("first_pos", F.min(F.when(F.col("nth") == 1, F.col("out_pos"))).over(Window.partitionBy("text_id", "key")))
    cut = F.when(F.octet_length("para") > LONG, F.concat(prefix(F.col("para"), LONG), F.lit("... [truncated]"))).otherwise(F.col("para"))
    out = F.when(F.col("nth") == 1, cut).otherwise(F.concat(F.lit("[see paragraph "), (F.col("first_pos") + 1).cast("string"), F.lit("]")))
    return rows.where("emitted").select("text_id", "pos", "out_pos", out.alias("out"))


def semantic_notes(paras: DataFrame) -> DataFrame:
    """(text_id, repeats, note): the note on repeats where there are more than five."""
    rows = paras.withColumn("key", collapse(F.col("para"))).where("key <> ''")
    counts = rows.groupBy("text_id").agg((F.count("*") - F.count_distinct("key")).alias("repeats"))
    return counts.withColumn("note", F.when(F.col("repeats") > 5, F.concat(F.lit("["), F.col("repeats").cast("string"), F.lit(" duplicate paragraphs omitted]"))))


def dedup_ref(paras: DataFrame, reversible: bool = True, threshold: int = 100) -> DataFrame:
    """What each paragraph becomes when repeats are taken out: (text_id, pos, out).

    Repeats are dropped until the bytes saved are above the threshold, from
    then on they leave a marker; repeats are found within ``text_id``.
    """
    rows = paras.withColumn("para", trim(F.col("para"))).where("para <> ''").withColumn("id", keys.key(F.col("para")))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("text_id", "id").orderBy("pos")))
    saved = F.sum(F.when(F.col("nth") > 1, F.octet_length("para")).otherwise(0)).over(Window.partitionBy("text_id").orderBy("pos"))
    mark = F.when(saved > threshold, F.concat(F.lit("\n"), keys.marker(F.col("id")))) if reversible else F.lit(None).cast("string")
    return rows.withColumn("out", F.when(F.col("nth") == 1, F.col("para")).otherwise(mark)).where("out is not null").select("text_id", "pos", "out")


def dedup_notes(paras: DataFrame, reversible: bool = True, threshold: int = 100) -> DataFrame:
    """(text_id, saved, note): what repeats saved where no marker tells."""
    rows = paras.withColumn("para", trim(F.col("para"))).where("para <> ''").withColumn("id", keys.key(F.col("para")))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("text_id", "id").orderBy("pos")))
    saved = rows.groupBy("text_id").agg(F.sum(F.when(F.col("nth") > 1, F.octet_length("para")).otherwise(0)).cast("long").alias("saved"))
    marked = F.col("saved") > threshold if reversible else F.lit(False)
    return saved.withColumn("note", F.when((F.col("saved") > 0) & ~marked, F.concat(F.lit("\n[dedup: "), F.col("saved").cast("string"), F.lit(" bytes of repeated content]"))))
