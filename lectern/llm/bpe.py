"""Byte-level BPE encoding and decoding over Arrow batches.

The merges of a rank file become a ``tokenizers`` BPE model over the usual
byte-to-character alphabet.  A text is cut by the split pattern, each piece is
merged by the model.  Texts of a batch are cut at spaces and the parts numbered
by Arrow, so that each different part of a batch is looked up once; short parts
are remembered per worker.  Decimal digits and decoded bytes come from tables by
Arrow's ``take``, whose offsets are the tokens' byte offsets.

Defined results: a null text counts as empty; an empty text has no tokens;
strings of special tokens inside a text are ordinary text; repeated rows are
encoded one by one; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.models import BPE

from .common import sub_batches

#: Parts between spaces remembered per Python worker by batches of texts.
CACHE_PARTS = 500_000
#: Chunks remembered for single texts, in each of two generations.
CACHE_CHUNKS = 50_000
#: Longer chunks are encoded but not remembered.
CACHE_CHARS = 48


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte value."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return [out[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 and decimal columns."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each token of more than one byte, in rank order."""
    out = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__):
        limit, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = limit, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1], limit)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


#: White space for Python but not for the split pattern.
#: Marks that follow a word as one match of the pattern.
_MARKS = "!#$%&*,.:;?|"
_CONTROL = re.compile(r"[\x1c-\x1f]")
_CHUNK = re.compile(r"\s*\S+|\s+")


class ByteBpe:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        ranks = read_ranks(ranks_path)
        self.pieces = regex.compile(pattern).findall
        chars = byte_alphabet()
        self.to_chars = dict(enumerate(chars))
        text = lambda raw: "".join(map(chars.__getitem__, raw))
        vocab = {text(t): r for t, r in ranks.items()}
        self.model = BPE(vocab, [(text(a), text(b)) for a, b in merges_of(ranks)], ignore_merges=True, cache_capacity=0)
        self.table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.lengths = np.array([len(t) for t in self.table], dtype=np.int64)
        self._ints = list(range(len(self.table)))
        self.decimals = [str(i) for i in range(len(self.table))]
        self._first: dict[str, tuple[int, ...]] = {}
        self._led: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}
        self._at: dict[str, int] = {}
        self._flat, self._ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern, by the model."""
        if not piece.isascii() or not piece.isalnum():
            piece = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_chars)
        return [t.id for t in self.model.tokenize(piece)]

    def _merge(self, text: str) -> tuple[int, ...]:
        """Ids of a text: the model on each match of the pattern."""
        return tuple([i for piece in self.pieces(text) for i in self._piece(piece)])

    def _led_word(self, part: str) -> tuple[int, ...]:
        """Ids of a space and ``part``, which starts and ends with other than white space."""
        body = part.rstrip(_MARKS)
        if not body.isalpha():
            return self._merge(" " + part)
        if body == part:  # one match
            if part.isascii():
                return tuple([t.id for t in self.model.tokenize(self.to_chars[0x20] + part)])
            return tuple(self._piece(" " + part))
        # a word and marks: two matches
        return (*self._led_word(body), *self._marks(part[len(body) :]))

    def _marks(self, run: str) -> tuple[int, ...]:
        return self._first.get(run) or self._remember(self._first, run, tuple(self._piece(run)))

    def _led_ids(self, part: str) -> tuple[int, ...]:
        """Ids of a space and ``part``, remembered."""
        ids = self._led.get(part)
        if ids is None:
            if len(self._led) >= CACHE_CHUNKS:
                self._old, self._led = self._led, {}
            ids = self._old.get(part)
            if ids is None:
                ids = tuple(map(self._ints.__getitem__, self._led_word(part)))  # ids shared between entries
            if len(part) <= CACHE_CHARS:
                self._led[part] = ids
        return ids

    def _remember(self, cache: dict, key: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(key) <= CACHE_CHARS:
            if len(cache) >= CACHE_CHUNKS:
                cache.clear()
            ids = cache[key] = tuple(map(self._ints.__getitem__, ids))  # ids shared between entries
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``.

        A match of the pattern never continues from a non-space character into
        white space, so a text may be cut before each run of white space and
        the chunks encoded apart.
        """
        if not text:
            return []
        parts = text.split(" ")
        found = list(map(self._led.get, parts))
        found[0] = self._first.get(parts[0])
        for i, ids in enumerate(found):
            if ids is None:
                part = parts[i]
                if not part or part[0].isspace() or part[-1].isspace():
                    return self._by_chunk(text)  # a space beside other white space
                if _CONTROL.search(part):
                    return list(self._merge(text))
                found[i] = self._led_ids(part) if i else self._remember(self._first, part, self._merge(part))
        return list(chain.from_iterable(found))

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        split = pa.compute.split_pattern(pa.array(texts, pa.large_string()), " ")
        sizes = np.asarray(pa.compute.list_value_length(split))
        coded = split.flatten().dictionary_encode()
        parts, numbers = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        # parts that don't stand alone after a space, and so the texts that have them
        odd = np.fromiter((not p or p[0].isspace() or p[-1].isspace() or _CONTROL.search(p) is not None for p in parts), bool, len(parts))
        whole = np.logical_or.reduceat(odd[numbers], starts) if len(texts) else np.zeros(0, bool)
        use = np.ones(len(numbers), bool)
        use[starts] = False
        use &= ~np.repeat(whole, sizes)
        led = np.zeros(len(parts), bool)
        led[numbers[use]] = True
        if len(self._at) > CACHE_PARTS:
            self._at, self._flat, self._ends = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        place = np.fromiter(map(self._at.get, parts, repeat(-1)), np.int64, len(parts))
        place[~led] = 0
        missing = np.flatnonzero(place < 0)
        short = np.fromiter((len(parts[i]) <= CACHE_CHARS for i in missing.tolist()), bool, len(missing))
        missing, keep, size = missing[np.argsort(~short, kind="stable")], int(short.sum()), len(self._ends) - 1
        new = [parts[i] for i in missing.tolist()]
        entries = list(map(self._led_word, new))
        # first parts follow no space; they, and texts that are encoded as they are, come after the parts
        entries += [tuple(self.encode(texts[i])) if w else self._first_ids(parts[numbers[starts[i]]]) for i, w in enumerate(whole.tolist())]
        counts = np.fromiter(map(len, entries), np.int64, len(entries))
        flat = np.concatenate([self._flat, np.fromiter(chain.from_iterable(entries), np.int32, int(counts.sum()))])
        ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(counts)])
        place[missing] = size + np.arange(len(missing))
        self._at.update(zip(new[:keep], range(size, size + keep), strict=True))
        self._ends = ends[: size + keep + 1]
        self._flat = flat[: self._ends[-1]]
        at = place[numbers]
        at[starts] = size + len(new) + np.arange(len(texts))
        use[starts] = True
        counts = np.where(use, ends[at + 1] - ends[at], 0)
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(ends[at] - upto[:-1], counts) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.concatenate([starts, [len(numbers)]])])

    def _first_ids(self, part: str) -> tuple[int, ...]:
        return self._first.get(part) or self._remember(self._first, part, self._merge(part))

    def _by_chunk(self, text: str) -> list[int]:
        if _CONTROL.search(text):
            return list(self._merge(text))
        cache, out = self._first, []
        for chunk in _CHUNK.findall(text):
            out.append(cache.get(chunk) or self._remember(cache, chunk, self._merge(chunk)))
        return list(chain.from_iterable(out))

    def decode(self, ids) -> bytes:
        """The bytes of ``ids``; characters split between tokens come together again."""
        table = self.table
        return b"".join([table[i] for i in ids])

    def decode_stream(self, ids) -> Iterator[str]:
        """Text as ids arrive; a character is given out once its last byte is there."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if out := decoder.decode(self.table[i]):
                yield out
        if out := decoder.decode(b"", True):
            yield out

    def offsets(self, ids, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Byte and character offsets: where each token starts, and the end.

        A token that starts inside a character has that character's offset.
        """
        ends = np.concatenate([[0], np.cumsum(self.lengths[np.asarray(ids, dtype=np.int64)])])
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        starts = np.concatenate([np.cumsum((raw & 0xC0) != 0x80) - 1, [len(text)]])
        return ends, starts[ends]


@lru_cache(maxsize=4)
def load(ranks_path: str, pattern: str) -> ByteBpe:
    """One encoder per worker process."""
    return ByteBpe(ranks_path, pattern)


def _lists(rows: list[list[int]]) -> pa.Array:
    flat = np.fromiter(chain.from_iterable(rows), dtype=np.int32)
    return _runs(flat, np.fromiter(map(len, rows), np.int64, len(rows)))


def _runs(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def encode_batches(batches: Iterator[pa.RecordBatch], bpe: ByteBpe, with_offsets: bool = False) -> Iterator[pa.RecordBatch]:
    """(id, text) batches to (id, text, ids[, byte_starts, char_starts])."""
    for batch in sub_batches(batches, "text"):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        flat, sizes = bpe.encode_batch(texts)
        columns = {"id": batch.column(0), "text": batch.column(1), "ids": _runs(flat, sizes)}
        if with_offsets:
            rows = np.split(flat, np.cumsum(sizes)[:-1])
            both = [bpe.offsets(r, t) for r, t in zip(rows, texts, strict=True)]
            columns |= {"byte_starts": _lists([b[0].tolist() for b in both]), "char_starts": _lists([b[1].tolist() for b in both])}
        yield pa.RecordBatch.from_pydict(columns)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """Encode a table: (id, text, ids), with token offsets on request."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    more = ", byte_starts array<int>, char_starts array<int>" if with_offsets else ""
    return rows.mapInArrow(lambda it: encode_batches(it, load(ranks_path, pattern), with_offsets), f"id {kind}, text string, ids array<int>{more}")


def decode(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(id, ids) back to (id, decoded), the bytes of each row."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches):
        bpe = load(ranks_path, pattern)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "decoded": pa.array([bpe.decode(r or []) for r in rows], pa.binary())})

    return df.select("id", "ids").mapInArrow(run, f"id {kind}, decoded binary")


def round_trip_digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each row in one narrow pass and keep only digests.

    Columns: the id, ``n_tokens``, ``ids_sha256`` of the decimal ids joined by
    a space, ``decoded_sha256`` of the decoded bytes, and from the tokens' byte
    offsets ``n_split``, the tokens that start inside a character.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        bpe, sha = load(ranks_path, pattern), hashlib.sha256
        decimals, table = pa.array([f"{d} " for d in bpe.decimals], pa.large_string()), pa.array(bpe.table, pa.large_binary())
        for batch in encode_batches(batches, bpe):
            lists = batch.column(2)
            ids, ends = lists.values, np.asarray(lists.offsets).tolist()
            (text, text_at), (raw, raw_at) = (_joined(t.take(ids)) for t in (decimals, table))
            inside = np.zeros(len(ids) + 1, np.int64)
            np.cumsum((np.frombuffer(raw, np.uint8)[raw_at[:-1]] & 0xC0) == 0x80, out=inside[1:])
            spans = list(zip(ends, ends[1:], strict=False))
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column(0),
                    "n_tokens": pa.array(np.diff(ends), pa.int64()),
                    "ids_sha256": pa.array([sha(text[text_at[a] : max(text_at[b] - 1, text_at[a])]).hexdigest() for a, b in spans], pa.string()),
                    "decoded_sha256": pa.array([sha(raw[raw_at[a] : raw_at[b]]).hexdigest() for a, b in spans], pa.string()),
                    "n_split": pa.array(np.diff(inside[ends]), pa.int64()),
                }
            )

    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long")
    return out.withColumnRenamed("id", id_col)


def _joined(tokens: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all tokens in a row, and where each starts, and the end."""
    _, offsets, data = tokens.buffers()
    at = np.frombuffer(offsets, np.int64)[tokens.offset : tokens.offset + len(tokens) + 1] if offsets is not None and len(tokens) else np.zeros(len(tokens) + 1, np.int64)
    return memoryview(data) if data is not None else memoryview(b""), at
