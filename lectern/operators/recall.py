"""Full-text recall over folded originals: postings and BM25 as joins and sums."""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.shared import materialise

K1, B = 1.5, 0.75
PREVIEW = 160
#: Characters that part terms, and those kept inside one.
_PART = r"""(?U)[\s"'`(),;:\[\]{}=<>|!?*&@#%+~^$]+"""
_TRIM = r"(?U)^[^\p{L}\p{N}/._\\-]+|[^\p{L}\p{N}/._\\-]+$"
_SUB = r"[/._\\-]+"


def terms(text: Column) -> Column:
    """Lower-case tokens, each followed by its parts of paths and camel case."""
    tokens = F.transform(F.split(text, _PART), lambda t: F.regexp_replace(t, _TRIM, ""))
    tokens = F.filter(tokens, lambda t: F.length(F.regexp_replace(t, r"(?U)[^\p{L}\p{N}]", "")) >= 2)

    def parts(t: Column) -> Column:
        low = F.lower(t)
        split = F.split(F.regexp_replace(t, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", "/"), _SUB)
        lowered = F.transform(split, lambda p: F.translate(p, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        return F.concat(F.array(low), F.filter(lowered, lambda p: (p != low) & (F.char_length(p) >= 2)))

    return F.flatten(F.transform(tokens, parts))


def preview(text: Column) -> Column:
    own = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(F.char_length(own) > PREVIEW, F.concat(F.substring(own, 1, PREVIEW), F.lit("…"))).otherwise(own)


def build(docs: DataFrame, id_: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(docs with length and preview, postings of id, term and tf)."""
    rows = docs.select(F.col(id_).alias("id"), terms(F.col(text)).alias("terms"), preview(F.col(text)).alias("preview"))
    postings = rows.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    return rows.select("id", F.size("terms").cast("long").alias("len"), "preview"), postings


def upsert(docs: DataFrame, new: DataFrame, tag_kinds: tuple[str, ...] = ("tool_names", "error_classes", "file_paths")) -> DataFrame:
    """An index's rows (id, text and tags) with new ones: of one id the new text, and the tags of both.

    ``new`` has a ``seq`` that orders rows of one id; ``docs`` come before.
    """
    both = docs.withColumn("seq", F.lit(-1).cast("long")).unionByName(new.withColumn("seq", F.col("seq").cast("long")))
    merged = [F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(k)))), 1, 64).alias(k) for k in tag_kinds]
    rest = [F.max_by(c, "seq").alias(c) for c in docs.columns if c not in ("id", *tag_kinds)]
    return both.groupBy("id").agg(*rest, *merged).select(*docs.columns)


def remove(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without these ids."""
    return docs.join(ids.select("id").distinct(), "id", "left_anti")


_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def query_terms(query: str) -> list[str]:
    """The same terms of a query, on the driver."""
    out: list[str] = []
    for raw in regex.split(_PART.removeprefix("(?U)"), query):
        token = regex.sub(_TRIM.removeprefix("(?U)"), "", raw)
        if len(regex.findall(r"[\p{L}\p{N}]", token)) < 2:
            continue
        low = token.lower()
        parts = regex.split(_SUB, regex.sub(r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", "/", token))
        out += [low, *(p for p in (x.translate(_ASCII_LOWER) for x in parts) if len(p) >= 2 and p != low)]
    return sorted(set(out))


def write_index(docs: DataFrame, id_: str, text: str, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The index as written tables: terms of a text are found once, and postings lie in order of
    their terms, so that a search reads the row groups of its terms only."""
    rows = materialise(docs.select(F.col(id_).alias("id"), terms(F.col(text)).alias("terms"), preview(F.col(text)).alias("preview")), "terms")

    def runs(ordered: Column) -> Column:
        """Equal terms lie together: each run is a term and its count, in the text's own row."""
        first = F.filter(F.transform(ordered, lambda t, i: F.when((i == 0) | (F.get(ordered, i - 1) != t), i)), lambda i: i.isNotNull())
        return let(first, lambda at: F.transform(at, lambda p, k: F.struct(F.get(ordered, p).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(ordered)) - p).cast("long").alias("tf"))))

    each = rows.select("id", F.size("terms").alias("len"), F.explode(let(F.array_sort("terms"), runs)).alias("p")).select("id", "len", "p.term", "p.tf")
    ordered = each.repartitionByRange(parts, "term") if parts else each.repartitionByRange("term")
    return rows.select("id", F.size("terms").cast("long").alias("len"), "preview"), materialise(ordered.sortWithinPartitions("term", "id"), "postings")


def search(docs: DataFrame, postings: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The best ``limit`` documents by BM25: (id, score, preview).

    Only postings of the query's terms are read; totals are one row.  Postings
    that carry lengths are ranked before they meet the documents.
    """
    wanted = query_terms(query)
    n, average = docs.agg(F.count("*"), F.avg("len")).first()
    hits = postings.where(F.col("term").isin(wanted))
    often = {r.term: r.df for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}
    idf = F.create_map(*[x for t in wanted for x in (F.lit(t), F.lit(often.get(t, 0)))]) if wanted else F.create_map()
    df = F.coalesce(F.try_element_at(idf, F.col("term")), F.lit(0)) if wanted else F.lit(0)
    weight = F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(float(average or 1.0))))
    # terms in order, so that sums don't depend on the shuffle
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("term", "part"))), F.lit(0.0), lambda s, x: s + x["part"]).alias("score")
    if "len" not in postings.columns:
        hits = hits.join(docs.select("id", "len"), "id")
    scored = hits.select("id", "term", part.alias("part")).groupBy("id").agg(total)
    best = scored.where("score > 0").orderBy(F.desc("score"), "id").limit(limit)
    return docs.select("id", "preview").join(F.broadcast(best), "id").orderBy(F.desc("score"), "id").select("id", "score", "preview")


def find_by_tag(folds: DataFrame, kind: str, value: str) -> DataFrame:
    """Folds that have a tag of this kind, in any case of A to Z."""
    low = lambda t: F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return folds.where(F.exists(kind, lambda t: low(t) == value.translate(_ASCII_LOWER)))
