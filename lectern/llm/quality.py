"""Quality rules with verdicts on hosts, by DataFrame functions only.

Each document gets its rule failures.  Failures are counted by host, the
hosts' rates are shrunk by a beta prior fitted to all hosts by moments, and a
host whose shrunk rate is above a threshold takes its documents with it.

Defined results: a null text has no words and fails; documents whose host is
null are judged by their own rules only; repeated rows are judged each; an
empty table gives an empty result; other columns are not touched.  Equal
five-word windows are found by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The characters that part words, and the symbols counted.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A document fails with fewer words, or a larger share of words in repeated windows.
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5
#: A host goes if its shrunk failure rate is above this.
HOST_RATE = 0.5
#: Rejected hosts up to this count are broadcast, else joined by a salted shuffle.
BROADCAST_HOSTS = 100_000
SALTS = 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(starts: Column) -> Column:
    """Words covered by windows at the ascending positions ``starts``."""
    steps = F.zip_with(F.slice(starts, 2, F.size(starts)), F.slice(starts, 1, F.size(starts) - 1), lambda a, b: F.least(a - b, F.lit(WINDOW)))
    return F.when(F.size(starts) == 0, 0).otherwise(F.aggregate(steps, F.lit(WINDOW), lambda total, x: total + x))


def _repeated(keys: Column) -> Column:
    """Words in windows whose key occurs twice or more."""

    def of(ordered: Column) -> Column:
        n = F.size(ordered)
        same = lambda x, i, j: F.coalesce(F.get(ordered, j)["key"] == x["key"], F.lit(False))
        twice = F.filter(ordered, lambda x, i: same(x, i, i - 1) | ((i + 1 < n) & same(x, i, i + 1)))
        return _let(F.array_sort(F.transform(twice, lambda x: x["at"])), _covered)

    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), 0).otherwise(_let(F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("at")))), of))


def _counts(words: Column) -> Column:
    n = F.size(words)

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), n - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    repeated = F.when(n <= WINDOW, 0).otherwise(_let(hashes, lambda h: _let(windows(h), _repeated)))
    return F.struct(n.cast("long").alias("n_words"), repeated.cast("long").alias("n_repeat_words"))


def word_counts(text: Column) -> Column:
    """Struct of n_words and n_repeat_words."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return _let(words, _counts)


def fails(counts: Column) -> Column:
    """The base rule on a struct of counts."""
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED_PERCENT * counts["n_words"])


def features(text: Column) -> dict[str, Column]:
    """The other counts of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.char_length(F.translate(x, SPACES, "")) > 0)
    return {
        "word_chars": F.char_length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, failed) rows to hosts with their shrunk failure rates.

    Only one row of moments reaches the driver.
    """
    hosts = judged.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("f"))
    rate = F.col("f") / F.col("n")
    k, total, failed, squares = hosts.agg(F.count("*"), F.sum("n"), F.sum("f"), F.sum(F.col("n") * rate * rate)).first()
    if not k:
        return hosts.withColumn("rate", F.lit(0.0))
    mean = failed / total
    between = max(squares / total - mean * mean - mean * (1 - mean) * k / total, 1e-9)
    strength = max(mean * (1 - mean) / between - 1, 2.0)
    return hosts.withColumn("rate", (F.col("f") + mean * strength) / (F.col("n") + strength))


def join_hosts(docs: DataFrame, host: str, rates: DataFrame, max_rate: float = HOST_RATE, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """``docs`` with a boolean ``_host_bad``; only rejected hosts are joined."""
    bad = rates.where(F.col("rate") > max_rate).select(F.col("host").alias("_bad_host"), F.lit(True).alias("_host_bad"))
    if bad.count() <= broadcast_hosts:
        met = docs.join(F.broadcast(bad), F.col(host) == F.col("_bad_host"), "left")
    else:
        salted = bad.withColumn("_bad_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(*docs.columns), F.lit(SALTS)).cast("int")
        met = docs.withColumn("_salt", salt).join(salted, (F.col(host) == F.col("_bad_host")) & (F.col("_salt") == F.col("_bad_salt")), "left").drop("_salt", "_bad_salt")
    return met.drop("_bad_host").withColumn("_host_bad", F.coalesce("_host_bad", F.lit(False)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = HOST_RATE) -> DataFrame:
    """Counts, base_failed and kept for every document."""
    own = docs.select(F.col(id_col).alias(id_col), F.col(host_col).alias("host"), F.col(text_col).cast("string").alias("text"))
    own = own.select(id_col, "host", word_counts(F.col("text")).alias("c"), *[v.alias(k) for k, v in features(F.col("text")).items()])
    own = own.select(id_col, "host", "c.n_words", "word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words", fails(F.col("c")).alias("base_failed"))
    own = materialise(own, "quality")
    rates = host_rates(own.select("host", F.col("base_failed").alias("failed")))
    met = join_hosts(own, "host", rates, max_rate)
    return met.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("_host_bad")).alias("kept"))


def keep(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = HOST_RATE) -> DataFrame:
    """The documents that pass, with the columns of the input.

    Null and empty texts have too few words and go; rows whose host is null are
    judged by their own rules only; repeated rows are judged each; other columns
    pass unread.  The texts are counted once, in a pass that writes the rows
    with their failure and without the texts that failed.
    """
    failed, rest = F.col("_lx_failed"), [c for c in docs.columns if c != text_col]
    judged = docs.withColumn("_lx_failed", fails(word_counts(F.col(text_col))))
    judged = materialise(judged.select(F.when(~failed, F.col(text_col)).alias(text_col), *rest, failed), "judged")
    rates = materialise(host_rates(judged.select(F.col(host_col).alias("host"), failed.alias("failed"))), "hosts")
    good = join_hosts(judged.where(~failed), host_col, rates, max_rate)
    return good.where(~F.col("_host_bad")).select(*docs.columns)
