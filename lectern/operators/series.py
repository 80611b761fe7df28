"""Number series, record and string arrays, and text prints in long form:
(series id, idx, value) rows, so arrays of any length stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import focus as focus_
from ..functions import keys

ERROR_WORDS = ["error", "exception", "failed", "failure", "critical", "fatal", "crash", "panic", "abort", "timeout", "denied", "rejected"]


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def statistics(rows: DataFrame, id_: str, value: str) -> DataFrame:
    """Count, least, most, mean, median, sample deviation and quartiles of finite values."""
    v = _finite(F.col(value))
    return rows.groupBy(id_).agg(
        F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.median(v).alias("median"),
        F.stddev_samp(v).alias("deviation"), F.percentile(v, 0.25).alias("p25"), F.percentile(v, 0.75).alias("p75"),
    )


def outliers(rows: DataFrame, id_: str, value: str, times: float = 2.0) -> DataFrame:
    """``outlier``: values more than ``times`` deviations from the mean."""
    w = Window.partitionBy(id_)
    v = _finite(F.col(value))
    far = F.abs(v - F.avg(v).over(w)) > times * F.stddev_samp(v).over(w)
    return rows.withColumn("outlier", F.coalesce(far, F.lit(False)))


def change_points(rows: DataFrame, id_: str, idx: str, value: str, width: int = 5, times: float = 2.0) -> DataFrame:
    """``change``: where the means of the ``width`` values before and from here on differ."""
    w, o = Window.partitionBy(id_), Window.partitionBy(id_).orderBy(idx)
    before = F.avg(value).over(o.rowsBetween(-width, -1))
    after = F.avg(value).over(o.rowsBetween(0, width - 1))
    at, n = F.row_number().over(o) - 1, F.count("*").over(w)
    far = F.abs(after - before) > times * F.stddev_samp(_finite(F.col(value))).over(w)
    return rows.withColumn("change", F.coalesce((n > 2 * width) & (at >= width) & (at < n - width) & far, F.lit(False)))


def sample_records(rows: DataFrame, id_: str, idx: str, item: str, k: int = 15, terms: list[str] = ()) -> DataFrame:
    """``kept``: the first, the last, and the longest or most relevant of ``k`` records.

    The middle ranks over all records, so fewer than ``k`` may be kept.
    """
    first, last = int(k * 0.3), int(k * 0.15)
    score = F.log1p(F.octet_length(item)) + focus_.relevance(F.col(item), list(terms))
    o, w = Window.partitionBy(id_).orderBy(idx), Window.partitionBy(id_)
    ranked = rows.withColumns({"_at": F.row_number().over(o), "_n": F.count("*").over(w), "_score": score})
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy(id_).orderBy(F.desc("_score"), idx)))
    kept = (F.col("_n") <= k) | (F.col("_at") <= first) | (F.col("_at") > F.col("_n") - last) | (F.col("_rank") <= k - first - last)
    return ranked.withColumn("kept", kept).drop("_at", "_n", "_score", "_rank")


def string_flags(rows: DataFrame, id_: str, text: str, times: float = 2.0) -> DataFrame:
    """``bad`` strings with an error word and ``odd`` ones of unusual length."""
    low, bad = F.lower(text), F.lit(False)
    for word in ERROR_WORDS:
        bad = bad | F.contains(low, F.lit(word))
    sized = rows.withColumn("_len", F.char_length(text).cast("double"))
    return outliers(sized, id_, "_len", times).withColumnRenamed("outlier", "odd").withColumn("bad", bad).drop("_len")


def simhash(text: Column) -> Column:
    """64 votes over MD5 prefixes of character four-grams, as two's complement."""
    low = F.lower(text)
    n = F.char_length(low)
    grams = F.when(n <= 3, F.array(low)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1))), lambda i: F.substring(low, i, F.lit(4))))
    half = lambda g, at: F.conv(F.substring(F.md5(g.cast("binary")), at, 8), 16, 10).cast("long")
    zero = F.array_repeat(F.lit(0), 32)

    def votes(at: int) -> Column:
        parts = F.transform(grams, lambda g: half(g, at))
        return F.aggregate(parts, zero, lambda acc, h: F.transform(acc, lambda v, i: v + F.when(F.getbit(h, i) == 1, 1).otherwise(-1)))

    def word(at: int) -> Column:
        return F.aggregate(F.transform(votes(at), lambda v, i: F.when(v > 0, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)

    return F.shiftleft(word(1), 32).bitwiseOR(word(9))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def clusters(prints: Column, near: int = 3) -> Column:
    """Greedy clusters of an array of prints, in order."""
    firsts = F.aggregate(prints, F.array().cast("array<bigint>"), lambda acc, p: F.when(F.exists(acc, lambda q: hamming(p, q) <= near), acc).otherwise(F.array_append(acc, p)))
    return F.size(firsts)


def bigram_curve(rows: DataFrame, id_: str, idx: str, text: str) -> DataFrame:
    """(id, idx, distinct): distinct lower-case word pairs seen up to each item.

    An item of one word counts as that word alone, one without words (or null) as the empty word.
    """
    # a column of its own, so that a text is split once and not again for each pair
    held = rows.select(id_, idx, F.array_remove(F.split(F.lower(text), r"\s+"), "").alias("words"))
    words, n = F.col("words"), F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array(F.concat(F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.lit(" "))))
    each = held.select(id_, idx, F.explode(pairs).alias("pair"))
    first = each.groupBy(id_, "pair").agg(F.min(idx).alias(idx)).groupBy(id_, idx).agg(F.count("*").alias("new"))
    all_ = rows.select(id_, idx).distinct().join(first, [id_, idx], "left")
    return all_.select(id_, idx, F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy(id_).orderBy(idx)).alias("distinct"))


def knee(curve: DataFrame, id_: str, idx: str, value: str) -> DataFrame:
    """(id, knee): one past the point farthest above the chord, 1 if flat, null if hardly above."""
    w = Window.partitionBy(id_)
    at, n = F.row_number().over(w.orderBy(idx)) - 1, F.count("*").over(w)
    low, high = F.first(value).over(w.orderBy(idx).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(value).over(w.orderBy(idx).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = curve.select(id_, at.alias("at"), n.alias("n"), F.col(value).alias("y"), low.alias("low"), high.alias("high"))
    above = F.when(F.col("high") != F.col("low"), (F.col("y") - F.col("low")) / (F.col("high") - F.col("low")) - F.col("at") / (F.col("n") - 1))
    best = rows.withColumn("above", above).groupBy(id_).agg(F.max("n").alias("n"), F.max(F.struct(F.col("above"), -F.col("at"))).alias("best"), F.max(F.col("high") - F.col("low")).alias("rise"))
    return best.select(id_, F.when(F.col("n") < 3, None).when(F.col("rise") == 0, 1).when(F.col("best.above") >= 0.05, 1 - F.col("best.col2")).cast("int").alias("knee"))


def split_k(total: Column, first: float = 0.3, last: float = 0.15) -> tuple[Column, Column]:
    """How many items stay at either end, halves to even."""
    a = F.least(F.greatest(F.lit(1), F.bround(total * first).cast("int")), total)
    return a, F.least(F.greatest(F.lit(1), F.bround(total * last).cast("int")), F.greatest(total - a, F.lit(0)))


def format_g(value: Column) -> Column:
    """Four significant digits; scientific from 1e4 and below 1e-4, without trailing zeros.

    Halves of the shortest decimal form round up.
    """
    sci = F.format_string("%.3e", value.cast("double"))
    power = F.regexp_extract(sci, r"e([+-]\d+)$", 1).cast("int")
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = F.lit(None).cast("string")
    for p in range(-4, 4):
        plain = F.when(power == p, F.format_string(f"%.{3 - p}f", value.cast("double"))).otherwise(plain)
    return F.when(value == 0, "0").when((power < -4) | (power >= 4), F.concat(bare(F.substring_index(sci, "e", 1)), F.lit("e"), F.regexp_extract(sci, r"e(.*)$", 1))).otherwise(bare(plain))


def record_marker(rows: DataFrame, id_: str, idx: str, item: str) -> DataFrame:
    """(id, marker): the sentinel record of a whole array of compact records."""
    whole = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(idx, item))), lambda x: x[item]), ","), F.lit("]"))
    return rows.groupBy(id_).agg(whole.alias("whole")).select(id_, F.concat(F.lit('{"_ccr_dropped":"'), keys.marker(keys.key(F.col("whole"))), F.lit('"}')).alias("marker"))


def format_number(value: Column) -> Column:
    """Whole numbers below 1e16 without a point, others as :func:`format_g` has them."""
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e16), value.cast("decimal(20,0)").cast("string")).otherwise(format_g(value))
