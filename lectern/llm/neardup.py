"""Near-duplicate classes by MinHash bands, odd sketches and full sets.

1.  Each text becomes the set of its distinct word shingles (64-bit hashes).
    Texts of equal sets form one class at once, by a digest of the set.
2.  MinHash samples of each class give bands.  In each bucket the members with
    most bucket fellows lead; every member is paired with the leaders, so a
    bucket of any size gives a number of pairs in proportion.
3.  Odd sketches, parity bitmaps of the samples, drop pairs that are far below
    the threshold by their XOR population count; the rest are confirmed on the
    full sets, and confirmed links make components.
4.  Buckets too large for their leaders to have met all pairs, whose members
    are still in several components, go through an exact prefix join: members
    can only be linked if they share one of their rarest shingles.

What can be lost is a link of two texts that share no band: with 32 bands of 4
rows (1 - 0.8 ** 4) ** 32 < 1e-7 at the threshold and less above; or one whose
sketch estimate is off by more than 0.2, over five standard deviations.

Defined results: null texts and texts without words have the empty set and are
linked with nothing; texts of fewer words than a shingle are one shingle;
repeated rows belong to one class; a null id is not used as a component's id
while there is another; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, sub_batches

SHINGLE = 4
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
#: Pairs whose sketches estimate less are dropped.
SKETCH_FLOOR = 0.6
#: Leaders of a bucket.
LEADERS = 4

_MIX = [np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _MIX[2])
    h = h * _MIX[0]
    h = h ^ (h >> _MIX[2])
    h = h * _MIX[1]
    return h ^ (h >> _MIX[2])


@lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(256), draw(SAMPLES), draw(SAMPLES)


class _Powers:
    """Powers of an odd base modulo 2 ** 64, and of its inverse, as far as needed."""

    base = 0x9E3779B97F4A7C15
    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        return factors.cumprod(dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            cls.up, cls.down = cls._powers(cls.base, size), cls._powers(pow(cls.base, -1, 1 << 64), size)
        return cls.up, cls.down


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    Words of a text are joined by one space; a shingle's hash is the polynomial
    of its bytes, taken from running sums over all texts at once.
    """
    table, _, _ = _constants()
    rows = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    at = [i for i, r in enumerate(rows) if r]
    if not at:
        return out
    raw = np.frombuffer(b" ".join([w for i in at for w in rows[i]]) + b" ", dtype=np.uint8)
    counts = np.array([len(rows[i]) for i in at])
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    up, down = _Powers.to(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), (table[raw] * up[: len(raw)]).cumsum(dtype=np.uint64)])
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    for i, a, n in zip(at, first.tolist(), counts.tolist(), strict=True):
        size = min(shingle, n)
        s, e = starts[a : a + n - size + 1], ends[a + size - 1 : a + n]
        out[i] = np.unique(_mix((sums[e] - sums[s]) * down[s]))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash samples of one set, in blocks of bounded memory."""
    _, a, b = _constants()
    low = None
    for k in range(0, len(hashes), 2048):
        part = ((hashes[k : k + 2048, None] * a + b) >> np.uint64(32)).min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return low


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the numbered samples, as 64-bit words."""
    bits = _mix(samples + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    odd = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def estimate(differing: Column) -> Column:
    """Similarity from the number of differing sketch bits."""
    inside = F.greatest(1 - 2 * differing / SKETCH_BITS, F.lit(1e-9))
    return 1 + SKETCH_BITS / (4.0 * SAMPLES) * F.log(inside)


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, *more: Column) -> DataFrame:
    """(id, n, class, bands, sketch) and ``more`` of every row, in one narrow pass."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *more)
    kind = rows.schema["id"].dataType.simpleString()
    others = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for batch in sub_batches(batches, "text"):
            sizes, classes, bands, maps = [], [], [], []
            for hashes in shingle_sets(batch.column(1).to_pylist(), shingle):
                sizes.append(len(hashes))
                classes.append(_digest(hashes) if len(hashes) else None)
                if not len(hashes):
                    bands.append(None)
                    maps.append(None)
                    continue
                samples = signature(hashes)
                key = salt.copy()
                for r in range(ROWS):
                    key = _mix(key ^ samples[r::ROWS])
                bands.append(key.view(np.int64))
                maps.append(odd_sketch(samples).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.int64())), *batch.columns[2:]],
                ["id", "n", "class", "bands", "sketch", *batch.schema.names[2:]],
            )

    return rows.mapInArrow(run, f"id {kind}, n long, class binary, bands array<long>, sketch array<long>{others}")


#: Keys of more rows than this, and than one in so many of all rows, meet by broadcast.
HOT_ROWS, HOT_KEYS = 200, 20_000


def join_hot(left: DataFrame, right: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """``left`` joined to ``right``, which has few rows of a key, without bringing a frequent key's rows together.

    ``counts`` has the number ``_n`` of left rows of each ``key``.  Keys of more
    than ``HOT_ROWS`` rows and more than a share of ``HOT_KEYS`` of them, so at
    most ``HOT_KEYS`` keys, stay where they are and get their few rows by
    broadcast; the others are shuffled.  All three are read more than once, so
    they should be written tables or cheap.
    """
    limit = max(HOT_ROWS, (counts.agg(F.sum("_n")).first()[0] or 0) // HOT_KEYS)
    hot = materialise(counts.where(F.col("_n") > limit).select(F.col(key).alias("_hot")), "hot")
    if hot.isEmpty():
        return left.join(right, key)
    few = materialise(right.join(F.broadcast(hot), F.col(key) == F.col("_hot")).drop("_hot"), "few")
    often = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left_semi").join(F.broadcast(few), key)
    rest = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left_anti").join(right, key)
    return often.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b): stars to smaller nodes until nothing changes.

    Least neighbours are found task by task first, and a hub's edges meet its
    least neighbour by broadcast, so a large group is not one task's work.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")).select("u", F.least("u", "m").alias("m"), "_n"), "low")
        large = join_hot(both, low.select("u", "m"), "u", low.select("u", "_n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")), "low")
        met = join_hot(large, low.select("u", "m"), "u", low.select("u", "_n"))
        small = met.select("u", F.col("m").alias("v")).unionByName(met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        edges = materialise(small.distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(now):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = tuple(now)


def _needed(n: Column, m: Column, percent: int) -> Column:
    """The least intersection that makes sets of n and m a link."""
    return F.ceil(percent * (n + m) / (100.0 + percent) - 1e-9)


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The links among ``pairs`` (a, b), by the full sets of their texts (class, text)."""
    left = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("a_text")), "a")
    both = left.join(texts.select(F.col("class").alias("b"), F.col("text").alias("b_text")), "b").select("a", "b", "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "a_text"):
            one, two = (shingle_sets(batch.column(k).to_pylist(), shingle) for k in (2, 3))
            keep = []
            for i, (x, y) in enumerate(zip(one, two, strict=True)):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared and 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(run, "a binary, b binary")


def prefix_pairs(members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs of ``members`` (class, root, text) of different roots that may be links: an exact prefix join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text", max_bytes=1 << 20):
            rows = [h.view(np.int64) for h in shingle_sets(batch.column(2).to_pylist(), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int64()))], ["class", "root", "hashes"])

    sets = members.select("class", "root", "text").mapInArrow(run, "class binary, root binary, hashes array<long>")
    each = materialise(sets.select("class", "root", F.size("hashes").alias("n"), F.explode("hashes").alias("h")), "shingles")
    often = each.groupBy("h").agg(F.count("*").alias("times"))
    ranked = each.join(often, "h").withColumn("at", F.row_number().over(Window.partitionBy("class").orderBy("times", "h")))
    prefix = materialise(ranked.where((F.col("times") > 1) & (F.col("at") <= F.col("n") - F.ceil(percent * F.col("n") / 100.0 - 1e-9) + 1)).select("h", "class", "root", "n", "at"), "prefix")
    other = prefix.select("h", *[F.col(c).alias(f"o_{c}") for c in ("class", "root", "n", "at")])
    # the shared shingle and at most what follows it in both can be common
    most = 1 + F.least(F.col("n") - F.col("at"), F.col("o_n") - F.col("o_at"))
    fits = (F.col("class") < F.col("o_class")) & (F.col("root") != F.col("o_root")) & (most >= _needed(F.col("n"), F.col("o_n"), percent))
    return prefix.join(other, (prefix["h"] == other["h"]) & fits).select(F.col("class").alias("a"), F.col("o_class").alias("b")).distinct()


def _rooted(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, *more: Column) -> tuple[DataFrame, DataFrame]:
    """The sketches of every row, and (class, rep, root, number of rows) of every distinct set."""
    every = materialise(sketches(docs, id_col, text_col, shingle, *more), "sketches")
    # copies come together first, task by task, and count once from here on
    own = every.where("n > 0").groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("_n"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    own = materialise(own, "distinct")
    reps = own.select("class", "rep", "_n")
    banded = own.select("class", F.explode("bands").alias("bucket"))
    # a class may have a bucket twice, by two bands of one key
    sized = materialise(banded.groupBy("bucket").agg(F.count("*").alias("members"), (F.min("class") < F.max("class")).alias("several")).where("several").drop("several"), "sizes")
    counts = sized.select("bucket", F.col("members").alias("_n"))
    members = materialise(join_hot(banded, sized, "bucket", counts), "buckets")
    degree = members.groupBy("class").agg(F.sum("members").alias("degree"))
    led = members.join(degree, "class").withColumn("at", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("degree"), "class"))).where(F.col("at") <= LEADERS)
    leaders = materialise(led.select("bucket", F.col("class").alias("leader")), "leaders")
    met = join_hot(members, leaders, "bucket", counts).where("class <> leader")
    pairs = met.select(F.least("class", "leader").alias("a"), F.greatest("class", "leader").alias("b")).distinct()
    sketch = own.select("class", "sketch", "n")
    near = pairs.join(sketch.select(F.col("class").alias("a"), F.col("sketch").alias("a_sketch"), F.col("n").alias("a_n")), "a")
    near = near.join(sketch.select(F.col("class").alias("b"), F.col("sketch").alias("b_sketch"), F.col("n").alias("b_n")), "b")
    differing = F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    near = materialise(near.where(sizes & (estimate(differing) >= SKETCH_FLOOR)).select("a", "b"), "pairs")

    ends = near.select(F.col("a").alias("class")).unionByName(near.select(F.col("b").alias("class"))).distinct()
    crowd = members.where(F.col("members") > LEADERS + 1).select("bucket", "class")
    large = crowd.select("class").distinct()
    wanted = ends.unionByName(large).distinct().join(reps, "class")
    given = docs.select(F.col(id_col).alias("t_id"), F.col(text_col).cast("string").alias("text"))
    # a class's text is that of its first id; where an id has several texts their sets are compared with the class
    some = given.join(wanted, F.col("t_id").eqNullSafe(F.col("rep"))).select("class", "text")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            digests = [_digest(h) for h in shingle_sets(batch.column(1).to_pylist(), shingle)]
            yield batch.filter(pa.array([d == c for d, c in zip(digests, batch.column(0).to_pylist(), strict=True)], pa.bool_()))

    texts = materialise(some.mapInArrow(same, "class binary, text string").dropDuplicates(["class"]), "texts")
    links = materialise(confirm(near, texts, shingle, percent), "links")
    roots = materialise(components(links), "roots")

    # members of large buckets that are not yet in one component
    rooted = crowd.join(roots, F.col("class") == F.col("node"), "left").select("bucket", "class", F.coalesce("root", "class").alias("root"))
    rooted = materialise(rooted, "rooted")
    apart = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    open_ = join_hot(rooted, apart, "bucket", counts).select("class", "root").distinct()
    late = prefix_pairs(open_.join(texts, "class"), shingle, percent)
    late = materialise(confirm(materialise(late, "pairs"), texts, shingle, percent), "links")
    if not late.isEmpty():
        roots = materialise(components(links.unionByName(late)), "roots")
    named = reps.join(roots, F.col("class") == F.col("node"), "left").select("class", "rep", F.coalesce("root", "class").alias("root"), "_n")
    return every, materialise(named, "named")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    every, named = _rooted(docs, id_col, text_col, shingle, percent)
    smallest = materialise(named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("_n")), "smallest")
    of_class = join_hot(named.select("class", "root", F.col("_n").alias("rows")), smallest.select("root", "component_id"), "root", smallest.select("root", "_n"))
    of_class = materialise(of_class.select("class", "component_id", F.col("rows").alias("_n")), "of_class")
    own = every.where("n > 0").select("id", "n", "class")
    out = join_hot(own, of_class.select("class", "component_id"), "class", of_class.select("class", "_n")).select("id", "n", "component_id")
    out = out.unionByName(every.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.withColumnRenamed("n", "n_shingles")


#: Dropped rows up to this count are broadcast, some 20 MB; more are shuffled.
BROADCAST_IDS = 500_000


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each class, in the columns of the input.

    It is a row of the smallest id, or of a null id where the class has no other.
    Rows go by their id and text, so an id that is null or used again loses only
    the copies among its rows.  Rows without words are kept.
    """
    text_hash = F.xxhash64(F.col(text_col).cast("string"))
    every, named = _rooted(docs, id_col, text_col, shingle, percent, text_hash.alias("_lx_hash"))
    own = every.where("n > 0").select(F.col("id").alias("_lx_id"), "_lx_hash", "class")
    best = named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "class")).alias("best")).select(F.col("best.class").alias("class"), F.col("best.rep").alias("rep"))
    times = own.join(best, (own["class"] == best["class"]) & F.col("_lx_id").eqNullSafe(F.col("rep")), "left_semi").groupBy("class", "_lx_id", "_lx_hash").count()
    stays = times.groupBy("class").agg(F.min(F.struct("_lx_hash", "_lx_id", "count")).alias("s")).select(F.col("s._lx_id").alias("s_id"), F.col("s._lx_hash").alias("s_hash"), F.col("s.count").alias("times"))
    stays = materialise(stays, "stays")
    same = F.col("_lx_id").eqNullSafe(F.col("s_id")) & (F.col("_lx_hash") == F.col("s_hash"))
    gone = materialise(own.join(stays, same, "left_anti").select("_lx_id", "_lx_hash").distinct(), "gone")
    this = lambda i, h: F.col(id_col).eqNullSafe(F.col(i)) & (text_hash == F.col(h))
    left = docs.join(F.broadcast(gone) if gone.count() <= broadcast_ids else gone, this("_lx_id", "_lx_hash"), "left_anti")
    repeated = stays.where("times > 1")
    if repeated.isEmpty():
        return left
    return left.join(repeated, this("s_id", "s_hash"), "left_anti").union(left.join(repeated, this("s_id", "s_hash"), "left_semi").dropDuplicates([id_col, text_col]))
