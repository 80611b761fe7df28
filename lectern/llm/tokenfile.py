"""Token ids in word-aligned Simple-8b files.

Documents in ascending id order are cut into blocks of whole documents.  The
ids of a block are packed in sub-blocks of 128: each 64-bit word holds a 4-bit
selector and as many ids as fit the selector's width.  Ids above 60 bits are
escapes, kept beside the words and numbered by them.  Word offsets of the
sub-blocks let a block be decoded with array operations.

Files are Parquet with a row for each block, so any store that Spark writes
will do and a lost task is written again whole.

Defined results: null texts count as empty and have only their end id; null
document ids come first; rows of equal ids keep no order among themselves but
that of their texts; an empty table gives an empty file; other columns are not
read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer
from tokenizers.models import BPE

from .bpe import byte_alphabet
from .common import materialise, sub_batches

#: Ids and bits of a word by selector; the last selector is an escape.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
SUB = 128
#: A block is closed once it has this many ids.
BLOCK_IDS = 262_144
#: White-space-free strings remembered per Python worker, and the longest of them.
CACHE_WORDS = 500_000
CACHE_CHARS = 48

_COUNTS = np.array([n for n, _ in SELECTORS], dtype=np.int64)
_BITS = np.array([b for _, b in SELECTORS], dtype=np.uint64)
_EDGES = np.array([1 << b for _, b in SELECTORS], dtype=np.uint64)
_LIMIT = np.uint64(1 << 60)


_SMALL = np.searchsorted(_EDGES, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def _narrowest(ids: np.ndarray) -> np.ndarray:
    """The first selector wide enough for each id; their number where none is."""
    out = _SMALL[np.minimum(ids, np.uint64(len(_SMALL) - 1)).astype(np.int64)]
    large = np.flatnonzero(ids >= len(_SMALL))
    out[large] = np.searchsorted(_EDGES, ids[large], side="right")
    return out


#: Selectors below this one take more than eight ids.
_WIDE = 7


def _choose(need: np.ndarray, lane: np.ndarray, here: np.ndarray, width: int) -> np.ndarray:
    """The first selector that fits, looking at ``width`` ids; below ``_WIDE`` where more may."""
    most = need[lane[:, None], here[:, None] + np.arange(width)]
    np.maximum.accumulate(most, axis=1, out=most)
    fits = most[:, np.minimum(_COUNTS, width) - 1] <= np.arange(len(SELECTORS), dtype=np.uint8)
    return np.where(fits.any(axis=1), fits.argmax(axis=1), ESCAPE)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, word offset of each sub-block (and the end), escaped ids.

    All sub-blocks advance side by side, a word a step, each taking the
    selector that packs most of its next ids.
    """
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    escapes = ids[ids >= _LIMIT]
    lanes = -(-n // SUB)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), escapes
    values = np.zeros((lanes, SUB + 60), dtype=np.uint64)
    padded = np.zeros(lanes * SUB, dtype=np.uint64)
    padded[:n] = ids
    values[:, :SUB] = padded.reshape(lanes, SUB)
    need = np.zeros((lanes, SUB + 60), dtype=np.uint8)  # narrowest selector; 14: escape
    need[:, :SUB] = _narrowest(padded).reshape(lanes, SUB)
    number = np.zeros((lanes, SUB + 60), dtype=np.uint64)
    flat = np.zeros(lanes * SUB, dtype=np.uint64)
    flat[:n][ids >= _LIMIT] = np.arange(len(escapes), dtype=np.uint64)
    number[:, :SUB] = flat.reshape(lanes, SUB)
    sizes = np.minimum(SUB, n - np.arange(lanes) * SUB)
    at = np.zeros(lanes, dtype=np.int64)
    out: list[np.ndarray] = []
    who: list[np.ndarray] = []
    lane = np.arange(lanes)
    while len(lane):
        here = at[lane]
        chosen = _choose(need, lane, here, 8)
        wide = np.flatnonzero(chosen < _WIDE)
        if len(wide):  # ids of few bits: more than eight may fit
            chosen[wide] = _choose(need, lane[wide], here[wide], 60)
        words = np.empty(len(lane), dtype=np.uint64)
        taken = np.ones(len(lane), dtype=np.int64)
        for s in np.unique(chosen):
            rows = np.flatnonzero(chosen == s)
            if s == ESCAPE:
                words[rows] = number[lane[rows], here[rows]] | np.uint64(ESCAPE << 60)
                continue
            count, bits = SELECTORS[s]
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            part = values[lane[rows][:, None], here[rows][:, None] + np.arange(count)] << shifts
            words[rows] = np.bitwise_or.reduce(part, axis=1) | np.uint64(int(s) << 60)
            taken[rows] = count
        out.append(words)
        who.append(lane)
        at[lane] = here + taken
        lane = lane[at[lane] < sizes[lane]]
    lane_of = np.concatenate(who)
    order = np.argsort(lane_of, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(lane_of, minlength=lanes))])
    return np.concatenate(out)[order], offsets, escapes


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ids of a block, all words of a selector at once."""
    ids = np.zeros(n, dtype=np.uint64)
    if not n:
        return ids
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.where(chosen == ESCAPE, 1, _COUNTS[np.minimum(chosen, len(SELECTORS) - 1)])
    before = np.concatenate([[0], np.cumsum(counts)])
    lane = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = lane * SUB + before[:-1] - before[offsets[lane]]
    end = np.minimum((lane + 1) * SUB, n)
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            ids[start[rows]] = escapes[(words[rows] & (_LIMIT - np.uint64(1))).astype(np.int64)]
            continue
        count, bits = SELECTORS[s]
        values = (words[rows][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
        at = start[rows][:, None] + np.arange(count)
        inside = at < end[rows][:, None]
        ids[at[inside]] = values[inside]
    return ids


#: Marks that follow a word as one match of the split pattern.
_MARKS = "!#$%&*,.:;?|"


def _lower(text: str) -> str:
    """Lower case as the tokenizer has it, or the text as it is where that depends on neighbours."""
    if text.isascii():
        return text.lower() if "<|" not in text else text
    low = text.lower()
    return low if "<|" not in text and "\u03a3" not in text and is_normalized("NFC", text) and is_normalized("NFC", low) else text


class WordEncoder:
    """Encodes texts whose tokens never cross white space.

    Texts are cut at ASCII white space and their words numbered by Arrow, so
    that each different word of a batch is looked up once.  Words of up to
    ``CACHE_CHARS`` characters are remembered, at most about ``CACHE_WORDS``.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # words are remembered here, so the model needs no memory of its own
        self._tokenize = BPE(model["vocab"], merges, end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0).tokenize
        self._chars = dict(enumerate(byte_alphabet()))
        self._clear()

    def _clear(self) -> None:
        self._at: dict[str, int] = {}
        self._runs: dict[str, list[int]] = {}
        self._flat = np.zeros(0, np.int32)
        self._ends = np.zeros(1, np.int64)

    def _word(self, word: str) -> list[int] | None:
        """Ids of a word of letters, with marks after it or not: one or two matches of the split pattern."""
        if word.isascii() and word.isalpha() and word.islower():
            return [t.id for t in self._tokenize(word)]
        body = word.rstrip(_MARKS)
        if not body.isalpha() or word != word.lower() or not word.isascii() and not is_normalized("NFC", word):
            return None
        chars = body if body.isascii() else body.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._chars)
        ids = [t.id for t in self._tokenize(chars)]
        return ids if body == word else ids + self._marks(word[len(body) :])

    def _marks(self, run: str) -> list[int]:
        """Ids of a run of marks; there are few different ones."""
        if len(run) > CACHE_CHARS:
            return [t.id for t in self._tokenize(run)]
        if run not in self._runs:
            self._runs[run] = [t.id for t in self._tokenize(run)]
        return self._runs[run]

    def _learn(self, missing: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these words in a row, and the number of ids of each."""
        found = list(map(self._word, missing))
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([missing[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = e.ids
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        split = pa.compute.ascii_split_whitespace(pa.array(map(_lower, texts), pa.large_string()))
        sizes = np.asarray(pa.compute.list_value_length(split))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self._at) > CACHE_WORDS:
            self._clear()
        numbers = np.fromiter(map(self._at.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            short = np.fromiter(map(len, new), np.int64, len(new)) <= CACHE_CHARS
            order = np.argsort(~short, kind="stable")  # those to remember come first
            new, keep, size = [new[i] for i in order.tolist()], int(short.sum()), len(self._ends) - 1
            ids, counts = self._learn(new)
            numbers[missing[order]] = size + np.arange(len(new))
            ends, flat = np.concatenate([self._ends, self._ends[-1] + np.cumsum(counts)]), np.concatenate([self._flat, ids])
            self._at.update(zip(new[:keep], range(size, size + keep), strict=True))
            self._ends = ends[: size + keep + 1]
            self._flat = flat[: self._ends[-1]]
        else:
            flat, ends = self._flat, self._ends
        numbers = numbers[np.asarray(coded.indices)]
        first, counts = ends[numbers], ends[numbers + 1] - ends[numbers]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(first - upto[:-1], counts) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.concatenate([[0], np.cumsum(sizes)])])


@lru_cache(maxsize=2)
def load(path: str) -> WordEncoder:
    return WordEncoder(path)


FILE = "part int, block int, start_in_part long, n_ids long, docs array<{kind}>, counts array<int>, words binary, offsets binary, escapes binary"


def _blocks(batches: Iterator[pa.RecordBatch], encoder: WordEncoder, end_id: int | None, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    part, block, start = TaskContext.get().partitionId(), 0, 0
    docs: list = []
    counts: list[int] = []
    held: list[np.ndarray] = []
    n = 0

    def out() -> pa.RecordBatch:
        words, offsets, escapes = pack(np.concatenate(held) if held else np.zeros(0, np.int64))
        row = [part, block, start, n, docs, counts, words.astype("<u8").tobytes(), offsets.astype("<u4").tobytes(), escapes.astype("<u8").tobytes()]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["part", "block", "start_in_part", "n_ids", "docs", "counts", "words", "offsets", "escapes"])

    for batch in sub_batches(batches, "text", max_bytes=4 << 20):
        ids, sizes = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for i, doc in enumerate(batch.column(0).to_pylist()):
            own = ids[ends[i] : ends[i + 1]]
            if end_id is not None:
                own = np.append(own, end_id)
            docs.append(doc)
            counts.append(len(own))
            held.append(own)
            n += len(own)
            if n >= BLOCK_IDS:
                yield out()
                start, block = start + n, block + 1
                docs, counts, held, n = [], [], [], 0
    if docs:
        yield out()


def write(docs: DataFrame, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode a table into the file format, in ascending id order; the written file."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, arrow = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return materialise(ordered.mapInArrow(lambda it: _blocks(it, load(tokenizer_path), end_id, arrow), FILE.format(kind=kind)), "tokens")


def with_starts(file: DataFrame) -> DataFrame:
    """The file's blocks with ``part_start``: only one sum for each part is accumulated."""
    sums = file.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return file.join(F.broadcast(sums.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))), "part")


def decode_block(row: dict) -> np.ndarray:
    """The ids of one block row."""
    return unpack(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["offsets"], "<u4").astype(np.int64), np.frombuffer(row["escapes"], "<u8"), row["n_ids"])


def read_documents(file: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents from the file: (id, start, n_tokens, ids_crc32[, ids])."""
    kind = file.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                ids = decode_block(row)
                ends = np.concatenate([[0], np.cumsum(row["counts"])]).astype(np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                out = {
                    "id": pa.array(row["docs"], batch.schema.field("docs").type.value_type),
                    "start": pa.array(row["part_start"] + row["start_in_part"] + ends[:-1], pa.int64()),
                    "n_tokens": pa.array(np.diff(ends), pa.int64()),
                    "ids_crc32": pa.array(crcs, pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([ids[a:b].astype(np.int64).tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    more = ", ids array<bigint>" if with_ids else ""
    return with_starts(file).mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long{more}")
