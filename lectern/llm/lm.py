"""Language-model scores from a weighted backoff automaton.

The automaton's events are the training words and one for all unknown words,
as in the base score.  Its states are the root, words, and pairs of words that
training texts continue at least ``ARC_COUNT`` times with one word:

*   an arc from a state for each word that follows it at least ``ARC_COUNT``
    times, with the discounted share of that word and what the state leaves to
    the shorter history, so that all weights of a state sum to one;
*   a failure arc from a pair to its second word and from a word to the root,
    with the weight that the discounts and rarer words leave;
*   at the root an arc for every word, discounted by its count class, and one
    for unknown words with what the discounts leave.

A text is one left-to-right traversal from the root: at each word the state
takes its arc, or fails to the shorter history until there is one, adds up the
log weights, and moves to the longest history that is a state.

The corpus is packed in blocks of whole documents.  Words of a block go to
shards of the hash space, which give them corpus counts and numbers.  The
block's distinct triples, as a trie of first, second and third words with
training counts, go to shards by their first word and come back as the counts
and sums of whole histories, in the order in which they were sent.  First
words of very many tokens are dealt by their second word too, and such pairs
by the third; only the sums of these few histories (at most ``HOT_SHARE`` of
each order) are added up apart.  So the arcs grow with the corpus, and every
task holds a block or a shard.

Defined results: null texts count as empty and are one end token; documents
whose id is null are training documents; with no training tokens the base
score is that of an empty count table and every word is the unknown one;
repeated rows count each; an empty table gives an empty result; other columns
are not read.  Words are told apart by 64-bit hashes, histories exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise, sub_batches
from .neardup import _mix

FOLDS = 10
#: Tokens of a block of documents; a longer document is a block of its own.
BLOCK_TOKENS = 1_000_000
#: Least training count of an arc from a history, at any corpus size.
ARC_COUNT = 2
#: Discount of such arcs.
DISCOUNT = 0.6
#: The base score's addition to each count.
BASE_ADD = 0.1
#: Words, and tokens with their triples, of one shard, about.
SHARD_WORDS = 400_000
SHARD_TOKENS = 1_000_000
#: Histories of more than this share of all tokens (one in so many) may be split; there are no more of an order.
HOT_SHARE = 20_000
#: Positions of one lane of the traversal.
LANE = 256
#: The end of a text as a word; no text has it, since words hold no space.
END = b" "

_PACK = zstandard.ZstdCompressor(level=1)
_UNPACK = zstandard.ZstdDecompressor()


def _z(a: np.ndarray) -> bytes:
    """An array as its byte planes, compressed."""
    return _PACK.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def _u(b: bytes, kind: str) -> np.ndarray:
    dtype = np.dtype(kind)
    planes = np.frombuffer(_UNPACK.decompress(b), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _z_sorted(a: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as their steps."""
    return _z(np.diff(a, prepend=np.uint64(0)))


def _u_sorted(b: bytes) -> np.ndarray:
    return _u(b, "<u8").cumsum(dtype=np.uint64)


def _sums(of: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by place."""
    return np.bincount(of, values, size)[:size].astype(np.int64)


# --- blocks ------------------------------------------------------------------


class _Block:
    """Documents gathered until they have enough tokens; words are numbered batch by batch."""

    def __init__(self) -> None:
        self.docs: list = []
        self.held: list[bool] = []
        self.sizes: list[np.ndarray] = []
        self.tokens: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.n = 0

    def add(self, docs: list, held: list[bool], sizes: np.ndarray, tokens: np.ndarray, hashes: np.ndarray) -> None:
        self.tokens.append(tokens + sum(map(len, self.hashes)))
        self.hashes.append(hashes)
        self.docs += docs
        self.held += held
        self.sizes.append(sizes)
        self.n += len(tokens)

    def row(self, name: str, kind: pa.DataType) -> pa.RecordBatch:
        """One row; a block's words are numbered by how often they occur in it."""
        hashes, where = np.unique(np.concatenate(self.hashes), return_inverse=True)
        tokens, sizes = where[np.concatenate(self.tokens)], np.concatenate(self.sizes)
        order = np.argsort(-np.bincount(tokens, minlength=len(hashes)), kind="stable")
        hashes = hashes[order[: np.count_nonzero(np.bincount(tokens, minlength=len(hashes)))]]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        tokens = rank[tokens]
        training = np.repeat(~np.array(self.held, bool), sizes)
        hot = _locally_hot(tokens, sizes, training, hashes)
        values = [name, self.docs, self.held, sizes, _z(tokens.astype("<i4")), hashes.tobytes(), int(training.sum()), *hot]
        longs = pa.list_(pa.int64())
        types = [pa.string(), pa.list_(kind), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), longs, longs, longs]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [f.split()[0] for f in BLOCKS.split(", ")])


BLOCKS = "block string, docs array<{kind}>, held array<boolean>, sizes array<int>, tokens binary, hashes binary, training long, hot_u array<long>, hot_v array<long>, hot_n array<long>"


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def _followed(sizes: np.ndarray) -> np.ndarray:
    """Positions that another word of the same text follows."""
    n = int(np.sum(sizes))
    inside = np.ones(n, bool)
    inside[_starts(sizes) + sizes - 1] = False
    return np.flatnonzero(inside)


def _locally_hot(tokens: np.ndarray, sizes: np.ndarray, training: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of more than their share of the block's training tokens: hashes of both words, counts."""
    least = max(2, int(training.sum()) // HOT_SHARE)
    often = np.bincount(tokens[training], minlength=len(hashes)) > least
    at = _followed(sizes)
    at = at[training[at] & often[tokens[at]] & often[tokens[at + 1]]]
    keys, counts = np.unique(tokens[at] * len(hashes) + tokens[at + 1], return_counts=True)
    keys, counts = keys[counts > least], counts[counts > least]
    return hashes[keys // len(hashes)].view(np.int64), hashes[keys % len(hashes)].view(np.int64), counts


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of texts with their ends, token numbers, and hashes of the numbered words."""
    # lower-cased as bytes: Arrow's own function reads slices of an array wrongly
    low = pa.array([t.encode().lower() for t in texts.to_pylist()], pa.large_binary()).cast(pa.large_string())
    split = pa.compute.ascii_split_whitespace(low)
    coded = split.flatten().dictionary_encode()
    words, flat = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), np.asarray(pa.compute.list_value_length(split)))
    if "" in words:  # white space at either end
        real = flat != words.index("")
        flat, of = flat[real], of[real]
    sizes = np.bincount(of, minlength=len(texts)) + 1
    tokens = np.full(len(flat) + len(texts), len(words), np.int64)
    tokens[np.arange(len(flat)) + of] = flat
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return sizes, tokens, np.append(hashes, np.uint64(xxhash.xxh3_64_intdigest(END)))


def blocks(docs: DataFrame, id_col: str, text_col: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The corpus packed in blocks, in the shared folder."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held.alias("held"))
    kind, arrow = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, block = TaskContext.get().partitionId(), 0, _Block()
        for batch in sub_batches(batches, "text", max_bytes=min(2 << 20, 4 * block_tokens), max_rows=max(1, block_tokens // 4)):
            sizes, tokens, hashes = _numbered(batch.column(1))
            block.add(batch.column(0).to_pylist(), batch.column(2).to_pylist(), sizes, tokens, hashes)
            if block.n >= block_tokens:
                yield block.row(f"{part}-{k}", arrow)
                k, block = k + 1, _Block()
        if block.docs:
            yield block.row(f"{part}-{k}", arrow)

    return materialise(rows.mapInArrow(run, BLOCKS.format(kind=kind)), "blocks")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


# --- counts of words ---------------------------------------------------------


def _deal(block: str, shard: np.ndarray, shards: int, **values: np.ndarray) -> pa.RecordBatch:
    """(block, shard, values) for each shard that has any; ``shard`` ascends."""
    ends = np.searchsorted(shard, np.arange(shards + 1)).tolist()
    cuts = [(s, a, b) for s, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
    columns = [pa.array([block] * len(cuts), pa.string()), pa.array([s for s, _, _ in cuts], pa.int32())]
    columns += [pa.array([(_z_sorted if name == "hashes" else _z)(v[a:b]) for _, a, b in cuts], pa.binary()) for name, v in values.items()]
    return pa.RecordBatch.from_arrays(columns, ["block", "shard", *values])


def _got(table: pa.Table, kind: int, column: str) -> np.ndarray:
    """What shards sent back of one kind, in the order of shards."""
    names = ("kind", "shard", column)
    parts = sorted((s, b) for k, s, b in zip(*(table.column(c).to_pylist() for c in names), strict=True) if k == kind)
    return np.concatenate([_u(b, "<i8") for _, b in parts] or [np.zeros(0, np.int64)])


def word_counts(packed: DataFrame, shards: int) -> DataFrame:
    """For each block and shard of the hash space the corpus counts and numbers of the block's words.

    Numbers start at 1 and are smaller for frequent words.  The first row of a
    shard has the number of its words seen once, twice, to five times or more.
    """
    step = np.uint64(-(-(1 << 32) // shards))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            hashes, tokens = np.frombuffer(row["hashes"], np.uint64), _u(row["tokens"], "<i4")
            training = np.repeat(~np.array(row["held"], bool), row["sizes"])
            counts, order = np.bincount(tokens[training], minlength=len(hashes)), np.argsort(hashes)
            yield _deal(row["block"], ((hashes[order] >> np.uint64(32)) // step).astype(np.int64), shards, hashes=hashes[order], counts=counts[order])

    def add(key, table):
        each = [_u_sorted(b) for b in table.column("hashes").to_pylist()]
        counts, ends = np.concatenate([_u(b, "<i8") for b in table.column("counts").to_pylist()]), np.cumsum([len(e) for e in each])[:-1]
        words, where = np.unique(np.concatenate(each), return_inverse=True)
        sums = _sums(where, counts, len(words))
        number = np.empty(len(words), np.int64)
        number[np.argsort(-sums, kind="stable")] = np.arange(len(words)) * shards + key[0].as_py() + 1
        classes = [np.bincount(np.minimum(sums, 5), minlength=6)[1:]] + [np.zeros(5, np.int64)] * (table.num_rows - 1)
        back = lambda a: pa.array([_z(b) for b in np.split(a[where], ends)], pa.binary())
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "counts": back(sums), "numbers": back(number), "classes": pa.array(classes, pa.list_(pa.int64()))})

    parts = packed.select("block", "sizes", "held", "tokens", "hashes").mapInArrow(cut, "block string, shard int, hashes binary, counts binary")
    return materialise(parts.groupBy("shard").applyInArrow(add, "block string, shard int, counts binary, numbers binary, classes array<long>"), "words")


class Root:
    """Discounted weights of single words, by count classes."""

    def __init__(self, classes: list[int], total: int):
        n1, n2, n3, n4, _ = classes
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        cut = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.5, 3 - 4 * y * n4 / n3 if n3 else 0.5]
        self.cuts = np.array([0.0, *np.clip(cut, 0.1, [0.9, 1.8, 2.7])])
        self.total = total
        self.distinct = sum(classes)
        seen = np.array([0, n1, n2, self.distinct - n1 - n2])
        self.unknown = float((seen * self.cuts).sum() / total) if total else 1.0

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of words with these counts."""
        return np.where(counts > 0, (counts - self.cuts[np.minimum(counts, 3)]) / max(self.total, 1), self.unknown)


# --- counts of histories -----------------------------------------------------


class Trie:
    """A block's distinct triples of words, and the places of its tokens in it.

    Leaves are triples in order of their pairs, pairs in order of their first
    words.  A pair at the end of a text has the leaf of no word, ``nothing``.
    """

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, words: int):
        self.nothing = words
        self.at = _followed(sizes)  # places of pairs' first words
        third = np.full(len(self.at), words, np.int64)
        more = np.flatnonzero(np.diff(self.at) == 1)
        third[more] = tokens[self.at[more] + 2]
        pairs, self.pair_at = np.unique(tokens[self.at] * np.int64(words) + tokens[self.at + 1], return_inverse=True)
        leaves, self.leaf_at = np.unique(self.pair_at * np.int64(words + 1) + third, return_inverse=True)
        self.first, self.second = np.divmod(pairs, max(words, 1))
        self.pair, self.third = np.divmod(leaves, words + 1)


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in an ascending array, and whether they are there."""
    at = np.minimum(np.searchsorted(sorted_, wanted), max(len(sorted_) - 1, 0))
    return at, sorted_[at] == wanted if len(sorted_) else np.zeros(len(wanted), bool)


class Hot:
    """Histories of more than a share of all tokens, and in how many parts each is dealt."""

    def __init__(self, total: int, shard_tokens: int):
        self.share = max(shard_tokens // 4, total // HOT_SHARE, 1)
        self.u, self.v, self.n = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def parts(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > self.share, 1 + counts // self.share, 1)

    def pairs(self, hashes: np.ndarray, trie: Trie) -> np.ndarray:
        """Parts of each of the trie's pairs."""
        out = np.ones(len(trie.first), np.int64)
        if len(self.n):
            order = np.argsort(hashes)
            (u, has_u), (v, has_v) = _find(hashes[order], self.u), _find(hashes[order], self.v)
            at, there = _find(trie.first * len(hashes) + trie.second, order[u] * len(hashes) + order[v])
            there &= has_u & has_v
            out[at[there]] = self.parts(self.n[there])
        return out


def hot_pairs(packed: DataFrame, total: int, shard_tokens: int) -> Hot:
    """Pairs of more than the share of all tokens, as far as blocks found them frequent.

    A pair is left out only if it has less than twice the share, since what
    blocks don't tell of is below the share in sum.
    """
    hot = Hot(total, shard_tokens)
    told = packed.select(F.explode(F.arrays_zip("hot_u", "hot_v", "hot_n")).alias("h")).groupBy("h.hot_u", "h.hot_v").agg(F.sum("h.hot_n").alias("n"))
    rows = told.where(F.col("n") > hot.share).collect()  # at most HOT_SHARE
    hot.u, hot.v, hot.n = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    hot.u, hot.v = hot.u.view(np.uint64), hot.v.view(np.uint64)
    return hot


def _block(left: pa.Table, right: pa.Table) -> tuple:
    """A block's row, tokens, sizes, hashes, and the corpus counts and numbers of its words."""
    row = left.to_pylist()[0]
    hashes = np.frombuffer(row["hashes"], np.uint64)
    counts, numbers = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
    order = np.argsort(hashes)
    counts[order], numbers[order] = _got(right, 0, "a"), _got(right, 0, "b")
    return row, _u(row["tokens"], "<i4").astype(np.int64), np.array(row["sizes"], np.int64), hashes, counts, numbers


class _Dealt:
    """The leaves in the order in which they are sent, with the nodes above them.

    A leaf's shard goes by the first word, for frequent ones also by the second,
    for frequent pairs by the third.
    """

    def __init__(self, trie: Trie, hashes: np.ndarray, counts: np.ndarray, hot: Hot, shards: int):
        self.by_word, self.by_pair = hot.parts(counts), hot.pairs(hashes, trie)
        spread = np.append(_mix(hashes) >> np.uint64(2), np.uint64(0)).astype(np.int64)
        place = spread[trie.first] + spread[trie.second] // 7 % self.by_word[trie.first]
        shard = (place[trie.pair] % shards + spread[trie.third] // 49 % self.by_pair[trie.pair]) % shards
        self.order = np.argsort(shard, kind="stable")
        self.shard, pair = shard[self.order], trie.pair[self.order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (self.shard[1:] != self.shard[:-1])
        self.pair_starts = np.flatnonzero(new)
        self.pairs = pair[self.pair_starts]
        first, at = trie.first[self.pairs], self.shard[self.pair_starts]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (at[1:] != at[:-1])
        self.word_starts = np.flatnonzero(new)
        self.words = first[self.word_starts]


PARTS = "block string, shard int, us binary, un binary, vs binary, vn binary, ws binary, counts binary"
SUMS = "block string, shard int, leaves binary, pairs binary, pair_sums binary, pair_arcs binary, word_sums binary, word_arcs binary, hot array<struct<u:long,v:long,c:long,s:long,n:long>>"


def history_counts(packed: DataFrame, words: DataFrame, hot: Hot, shards: int) -> DataFrame:
    """For each block and shard, in the order of what the block sent: counts of
    triples and pairs, and for pairs and first words the tokens under their
    arcs and the number of arcs."""

    def cut(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row, tokens, sizes, hashes, counts, numbers = _block(left, right)
        trie = Trie(tokens, sizes, len(hashes))
        d = _Dealt(trie, hashes, counts, hot, shards)
        held = np.repeat(np.array(row["held"], bool), sizes)[trie.at]
        own = np.bincount(trie.leaf_at[~held], minlength=len(trie.pair))[d.order]
        # the lowest bit marks histories that are dealt in parts
        us = (2 * numbers + (d.by_word > 1))[d.words]
        vs = 2 * numbers[trie.second[d.pairs]] + (d.by_pair > 1)[d.pairs]
        ws = np.append(numbers, 0)[trie.third[d.order]]
        un, vn = np.diff(np.append(d.word_starts, len(d.pairs))), np.diff(np.append(d.pair_starts, len(d.order)))
        at_pair, at_word = d.shard[d.pair_starts], d.shard[d.pair_starts][d.word_starts]
        rows = []
        for s in np.unique(d.shard).tolist():
            (a, b), (e, f), (g, h) = (np.searchsorted(x, [s, s + 1]) for x in (d.shard, at_pair, at_word))
            rows.append((row["block"], s, *map(_z, (us[g:h], un[g:h], vs[e:f], vn[e:f], ws[a:b], own[a:b]))))
        types = [pa.string(), pa.int32(), *[pa.binary()] * 6]
        names = [f.split()[0] for f in PARTS.split(", ")]
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})

    def add(table: pa.Table) -> pa.Table:
        got = {n: [_u(b, "<i8") for b in table.column(n).to_pylist()] for n in ("us", "un", "vs", "vn", "ws", "counts")}
        ends = {n: np.cumsum([len(x) for x in v])[:-1] for n, v in got.items()}
        us, un, vs, vn, ws, own = (np.concatenate(got[n]) for n in ("us", "un", "vs", "vn", "ws", "counts"))
        base = int(max(vs.max(), ws.max())) + 1
        words, u = np.unique(us, return_inverse=True)
        pairs, p = np.unique(np.repeat(u, un) * base + vs, return_inverse=True)
        leaves, t = np.unique(np.repeat(p, vn) * base + ws, return_inverse=True)
        counts = _sums(t, own, len(leaves))
        of, last = np.divmod(leaves, base)
        pair_counts = _sums(of, counts, len(pairs))
        arcs = (counts >= ARC_COUNT) & (last > 0)
        pair_sums, pair_arcs = _sums(of[arcs], counts[arcs], len(pairs)), np.bincount(of[arcs], minlength=len(pairs))
        head, second = np.divmod(pairs, base)
        whole = (pair_counts >= ARC_COUNT) & (second % 2 == 0)
        word_sums, word_arcs = _sums(head[whole], pair_counts[whole], len(words)), np.bincount(head[whole], minlength=len(words))
        some = [{"u": int(words[i]) // 2, "v": 0, "c": 0, "s": int(word_sums[i]), "n": int(word_arcs[i])} for i in np.flatnonzero(words % 2)]
        some += [{"u": int(words[head[i]]) // 2, "v": int(second[i]) // 2, "c": int(pair_counts[i]), "s": int(pair_sums[i]), "n": int(pair_arcs[i])} for i in np.flatnonzero(second % 2)]
        back = lambda a, name: pa.array([_z(b) for b in np.split(a, ends[name])], pa.binary())
        return pa.table(
            {
                "block": table.column("block"), "shard": table.column("shard"), "leaves": back(counts[t], "ws"),
                "pairs": back(pair_counts[p], "vs"), "pair_sums": back(pair_sums[p], "vs"), "pair_arcs": back(pair_arcs[p], "vs"),
                "word_sums": back(word_sums[u], "us"), "word_arcs": back(word_arcs[u], "us"),
                "hot": pa.array([some] + [[]] * (table.num_rows - 1), pa.list_(pa.struct([(c, pa.int64()) for c in "uvcsn"]))),
            }
        )

    left = packed.select("block", "sizes", "held", "tokens", "hashes").groupBy("block")
    parts = left.cogroup(_back(words).groupBy("block")).applyInArrow(cut, PARTS)
    return materialise(parts.groupBy("shard").applyInArrow(add, SUMS), "histories")


def _back(words: DataFrame, histories: DataFrame | None = None) -> DataFrame:
    """What shards sent back to blocks: words as kind 0, histories as kind 1."""
    columns = "abcdef"
    out = words.select("block", "shard", F.lit(0).alias("kind"), F.col("counts").alias("a"), F.col("numbers").alias("b"), *[F.lit(None).cast("binary").alias(c) for c in columns[2:]])
    if histories is None:
        return out
    names = ["leaves", "pairs", "pair_sums", "pair_arcs", "word_sums", "word_arcs"]
    return out.unionByName(histories.select("block", "shard", F.lit(1).alias("kind"), *[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)]))


def hot_sums(histories: DataFrame) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(first, second or 0) to (count, tokens under arcs, arcs) of histories that were dealt in parts.

    At most ``HOT_SHARE`` words and as many pairs, so the driver can hold them.
    """
    rows = histories.select(F.explode("hot").alias("h")).groupBy("h.u", "h.v").agg(*[F.sum(f"h.{c}").alias(c) for c in "csn"]).collect()
    out = {(r.u, r.v): (r.c, r.s, r.n) for r in rows}
    for (u, v), (c, _, _) in list(out.items()):
        if v and c >= ARC_COUNT:  # such a pair is an arc of its first word, which is as frequent
            _, s, n = out.get((u, 0), (0, 0, 0))
            out[u, 0] = (0, s + c, n + 1)
    return out


# --- the automaton -----------------------------------------------------------


class Automaton:
    """States, arcs and failure arcs over the words of a block, in log10.

    State 0 is the root, 1 + w a word, 1 + words + p a pair of the trie.
    """

    def __init__(self, trie: Trie, counts: np.ndarray, root: Root, leaves: np.ndarray, pairs: tuple[np.ndarray, ...], words: tuple[np.ndarray, ...]):
        """``counts`` of words, of ``leaves``; (counts, tokens under arcs, arcs) of pairs; (tokens, arcs) of words."""
        self.trie, n = trie, len(counts)
        below = root.weights(counts)
        left = lambda tokens, arcs, of: np.clip(1.0 - (tokens - DISCOUNT * arcs) / np.maximum(of, 1), 1e-12, 1.0)
        pair_counts, pair_sums, pair_arcs = pairs
        word_left, pair_left = left(*words, counts), left(pair_sums, pair_arcs, pair_counts)
        self.has_pair = pair_counts >= ARC_COUNT
        by_word = np.where(self.has_pair, (pair_counts - DISCOUNT) / np.maximum(counts, 1)[trie.first], 0.0) + word_left[trie.first] * below[trie.second]
        self.has_leaf = (leaves >= ARC_COUNT) & (trie.third < trie.nothing)
        # the pair of a leaf's second and third word
        inner = np.zeros(len(leaves), np.int64)
        at = np.flatnonzero(trie.third[trie.leaf_at] < trie.nothing)
        inner[trie.leaf_at[at]] = trie.pair_at[at + 1]
        by_pair = np.where(self.has_leaf, (leaves - DISCOUNT) / np.maximum(pair_counts, 1)[trie.pair], 0.0) + pair_left[trie.pair] * by_word[inner]
        with np.errstate(divide="ignore"):
            self.root, self.pair_arc, self.leaf_arc = np.log10(below), np.log10(by_word), np.log10(by_pair)
        # a place that a text doesn't have is the last one, which has no arc
        self.has_pair, self.has_leaf = np.append(self.has_pair, False), np.append(self.has_leaf, False)
        self.pair_arc, self.leaf_arc = np.append(self.pair_arc, 0.0), np.append(self.leaf_arc, 0.0)
        self.is_state = np.concatenate([[True], words[1] > 0, pair_arcs > 0])
        self.fail = np.concatenate([[0.0], np.log10(word_left), np.log10(pair_left)])
        self.fail_to = np.concatenate([np.zeros(1 + n, np.int64), 1 + trie.second])

    def score(self, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log10 probabilities of the block's texts: traversals from left to right.

        Texts run side by side, cut in lanes; a lane inside a text first reads
        the two words before it, which decide the state it starts in.
        """
        out, n = np.zeros(len(tokens)), self.trie.nothing
        pair, leaf = np.full(len(tokens), -1, np.int64), np.full(len(tokens), -1, np.int64)
        pair[self.trie.at + 1] = self.trie.pair_at  # of this word and the one before
        real = np.flatnonzero(self.trie.third[self.trie.leaf_at] < n)
        leaf[self.trie.at[real] + 2] = self.trie.leaf_at[real]  # and the one before that
        starts = _starts(sizes)
        lanes = -(-sizes // LANE)
        begin = np.repeat(starts, lanes) + LANE * (np.arange(int(lanes.sum())) - np.repeat(_starts(lanes), lanes))
        end = np.minimum(begin + LANE, np.repeat(starts + sizes, lanes))
        here = np.maximum(begin - 2, np.repeat(starts, lanes))
        order = np.argsort(here - end, kind="stable")  # the longest first
        here, begin, end = here[order], begin[order], end[order]
        state = np.zeros(len(here), np.int64)
        while len(here):
            s, w, p, t = state, tokens[here], pair[here], leaf[here]
            got = np.zeros(len(here))
            two = s > n
            arc = two & self.has_leaf[t]
            fails = two & ~arc
            got[fails] += self.fail[s[fails]]
            s = np.where(fails, self.fail_to[s], s)
            one = (s > 0) & ~arc
            step = one & self.has_pair[p]
            fails = one & ~step
            got[fails] += self.fail[s[fails]]
            got += np.where(arc, self.leaf_arc[t], np.where(step, self.pair_arc[p], self.root[w]))
            own = here >= begin
            out[here[own]] = got[own]
            longest = np.where((p >= 0) & self.is_state[1 + n + p], 1 + n + p, 1 + w)
            state = np.where(self.is_state[longest], longest, 0)
            here = here + 1
            on = int(np.searchsorted(-(end - here), 0, side="left"))  # lanes that go on
            here, begin, end, state = here[:on], begin[:on], end[:on], state[:on]
        return np.add.reduceat(out, starts)


def _automaton(right: pa.Table, trie: Trie, hashes: np.ndarray, counts: np.ndarray, numbers: np.ndarray, root: Root, hot: Hot, sums: dict, shards: int) -> Automaton:
    """The automaton of a block from what the shards sent back."""
    d = _Dealt(trie, hashes, counts, hot, shards)
    leaves = np.empty(len(trie.pair), np.int64)
    leaves[d.order] = _got(right, 1, "a")
    pairs = tuple(np.zeros(len(trie.first), np.int64) for _ in range(3))
    words = tuple(np.zeros(len(counts), np.int64) for _ in range(2))
    for column, values, at in zip("bcdef", (*pairs, *words), (d.pairs,) * 3 + (d.words,) * 2, strict=True):
        values[at] = _got(right, 1, column)
    for i in np.flatnonzero(d.by_pair > 1).tolist():
        for values, x in zip(pairs, sums[int(numbers[trie.first[i]]), int(numbers[trie.second[i]])], strict=True):
            values[i] = x
    for i in np.flatnonzero(d.by_word > 1).tolist():
        for values, x in zip(words, sums.get((int(numbers[i]), 0), (0, 0, 0))[1:], strict=True):
            values[i] = x
    return Automaton(trie, counts, root, leaves, pairs, words)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    packed = blocks(docs, id_col, text_col, block_tokens)
    kind, arrow = packed.schema["docs"].dataType.elementType.simpleString(), to_arrow_type(packed.schema["docs"].dataType.elementType)
    about = packed.agg(F.sum("training"), F.sum(F.octet_length("hashes") / 8), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x))).first()
    total, shards = about[0] or 0, max(1, -(-(about[2] or 0) // shard_tokens))
    words = word_counts(packed, max(1, int(-(-(about[1] or 0) // SHARD_WORDS))))
    classes = words.agg(*[F.sum(F.get("classes", F.lit(k))) for k in range(5)]).first()
    root = Root([c or 0 for c in classes], total)
    hot = hot_pairs(packed, total, shard_tokens)
    histories = history_counts(packed, words, hot, shards)
    sums = hot_sums(histories)
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row, tokens, sizes, hashes, counts, numbers = _block(left, right)
        model = _automaton(right, Trie(tokens, sizes, len(hashes)), hashes, counts, numbers, root, hot, sums, shards)
        base = np.log10((counts + BASE_ADD) / (total + BASE_ADD * (root.distinct + 1)))
        starts = _starts(sizes)
        return pa.table(
            {
                "id": pa.array(row["docs"], arrow),
                "held_out": pa.array(row["held"], pa.bool_()),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(np.add.reduceat((counts[tokens] > 0).astype(np.int64), starts)),
                "train_tokens": pa.array(np.full(len(sizes), total, np.int64)),
                "base_score": pa.array(np.add.reduceat(base[tokens], starts)),
                "score": pa.array(model.score(tokens, sizes)),
            }
        )

    left = packed.select("block", "docs", "held", "sizes", "tokens", "hashes").groupBy("block")
    return left.cogroup(_back(words, histories).groupBy("block")).applyInArrow(run, schema)
