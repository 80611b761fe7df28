"""URL filter lists by hashed expressions.

A URL becomes the expressions "host suffix + directory prefix of its path".
Their digests meet the rules' digests in an equi-join on a short hash prefix;
a match counts once the full digests agree and the path starts with the
rule's, and of several rules the longest decides.

Defined results: null URLs and those without ``://`` have an empty host and
path, which no rule fits; a rule without a host fits nothing; rules that occur
twice with both verdicts block; without a fitting rule the verdict is
``DEFAULT_VERDICT``; repeated pages are returned as often as they occur; empty
tables (of rules too) work; other columns of the pages are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A list of blocked places leaves the rest open.
DEFAULT_VERDICT = "allow"
#: Hex digits of the digest that the join uses.
PREFIX_HEX = 8
#: Rules up to this count (some 100 bytes each) are broadcast; more are salted.
BROADCAST_RULES = 50_000
#: Copies of each rule, and groups of each frequent expression, beyond that.
SALTS = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host with A-Z lower-cased, and the path up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _key(host: Column, directory: Column) -> Column:
    return F.concat(host, F.lit("\n"), directory)


def expressions(host: Column, path: Column, labels: int, depth: int) -> Column:
    """Host suffixes of up to ``labels`` labels with path directories of up to ``depth`` slashes."""
    parts, dirs = F.split(host, r"\."), F.split(path, "/")
    n, m = F.size(parts), F.size(dirs)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max(labels, 1)))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    steps = F.when(F.least(m - 1, F.lit(depth)) >= 1, F.sequence(F.lit(1), F.least(m - 1, F.lit(depth)))).otherwise(F.array().cast("array<int>"))
    prefixes = F.concat(F.array(F.lit("")), F.transform(steps, lambda k: F.concat(F.array_join(F.slice(dirs, F.lit(1), k), "/"), F.lit("/"))))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _key(h, p))))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Verdicts of all pages under ``rules`` (verdict, host, path).

    Columns: the id, url, host, path, rule, verdict.
    """
    own = rules.select(F.lower("verdict").alias("r_verdict"), F.col("host").alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path")).where("r_host <> ''").distinct()
    own = own.withColumns(
        {
            "r_dir": F.regexp_extract("r_path", r"^(?s)(.*/)?", 1),
            "r_best": F.struct((F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"), (F.col("r_verdict") == "block").cast("int").alias("blocks"), F.concat("r_host", "r_path").alias("rule")),
        }
    ).withColumn("r_digest", F.sha2(_key(F.col("r_host"), F.col("r_dir")), 256))
    about = own.agg(F.count("*"), F.max(F.size(F.split("r_host", r"\."))), F.max(F.size(F.split("r_dir", "/")) - 1)).first()
    count, labels, depth = about[0], about[1] or 1, about[2] or 0
    own = own.select(F.substring("r_digest", 1, PREFIX_HEX).alias("prefix"), "r_digest", "r_path", "r_best")

    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    # position 0 has no expression: the join keeps it as one row, by which repeated pages are counted
    urls = rows.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    urls = urls.select("id", "url", "path", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), expressions(F.col("host"), F.col("path"), labels, depth))).alias("pos", "expression"))
    urls = urls.withColumn("digest", F.sha2("expression", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX)).drop("expression")
    if count <= broadcast_rules:
        met = urls.join(F.broadcast(own), "prefix", "left")
    else:
        salted = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = urls.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["prefix", "salt"], "left")
    fits = (F.col("digest") == F.col("r_digest")) & F.col("path").startswith(F.col("r_path"))
    best = met.groupBy("id", "url").agg(F.max(F.when(fits, F.col("r_best"))).alias("best"), F.sum((F.col("pos") == 0).cast("int")).alias("times"))
    verdict = F.when(F.col("best").isNull(), DEFAULT_VERDICT).when(F.col("best.blocks") == 1, "block").otherwise("allow")
    each = best.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return each.select(F.col("id").alias(id_col), "url", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), F.col("best.rule").alias("rule"), verdict.alias("verdict"))
