"""Benchmark decontamination by a generalised suffix automaton.

The items' words form one suffix automaton.  Each text's words stream through
it, which at every word gives the longest match that ends there; where a window
of an item ends, its words are hit and the item is counted.  Windows hang on
the automaton's states: a state's suffixes of window length, with the items
they come from, are found along its suffix links.

Defined results: null texts have no words; an item without words has no
window; an item of fewer words than a window is one window; items that occur
twice under one id count once; a null item id is listed as ``null``; repeated
documents are judged each; empty tables (of items too) work; other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise, sub_batches

#: Words of lower-cased texts, and the window's length.  In UTF-8
#: the bytes of all characters outside ASCII are word bytes.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 13
#: A document with hits is contaminated if they are at least this share of its words.
SHARE = 1 / 20
#: Item characters in one automaton, some 200 MB; more items make more passes over the documents.
BLOCK_CHARS = 2_000_000
_TO_WORDS = bytes(b if WORD.match(bytes([b])) else 0x20 for b in bytes(range(256)).lower())


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


class Automaton:
    """Suffix automaton of all items over word numbers, with windows on its states."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        number = self.vocab.setdefault
        rows = [(item, [number(w, len(self.vocab)) for w in words(text)]) for item, text in items]
        for _, row in rows:
            last = 0
            for c in row:
                last = self._extend(last, c)
        self.own: dict[int, dict[int, set[str]]] = {}
        self.shortest = window
        for item, row in rows:
            if row:
                self._mark(item, row)
        # the nearest state along the suffix links, itself included, that has windows
        self.near = [-1] * len(self.len)
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            self.near[v] = v if v in self.own else self.near[self.link[v]] if self.link[v] >= 0 else -1

    def _extend(self, last: int, c: int) -> int:
        """Add one word after state ``last``; an existing transition is used again."""
        nxt, link, length = self.next, self.link, self.len
        q = nxt[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        """Split state ``q``: its suffixes up to p's length plus one get their own state."""
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _mark(self, item: str, row: list[int]) -> None:
        size = min(self.window, len(row))
        self.shortest = min(self.shortest, size)
        state, matched = 0, 0
        for i, c in enumerate(row):
            state, matched = self.step(state, matched, c)
            if i + 1 >= size:
                v = state
                while self.len[self.link[v]] >= size:
                    v = self.link[v]
                self.own.setdefault(v, {}).setdefault(size, set()).add(item)

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        """The state and longest matching length after one more word."""
        nxt = self.next
        while state and c not in nxt[state]:
            state = self.link[state]
            matched = self.len[state]
        to = nxt[state].get(c)
        return (0, 0) if to is None else (to, matched + 1)

    def find(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words, and the items whose windows occur."""
        spans, items = [], set()
        own, near, link, shortest = self.own, self.near, self.link, self.shortest
        numbers = np.fromiter(map(self.vocab.get, text_words, repeat(-1)), dtype=np.int32, count=len(text_words))
        # no match holds a word that no item has: only runs of known words are walked
        edges = np.concatenate([[-1], np.flatnonzero(numbers < 0), [len(numbers)]])
        for k in np.flatnonzero(np.diff(edges) > shortest):
            start = int(edges[k]) + 1
            state, matched = 0, 0
            for i, c in enumerate(numbers[start : edges[k + 1]].tolist(), start):
                state, matched = self.step(state, matched, c)
                if matched < shortest:
                    continue
                v, longest = near[state], 0
                while v > 0:
                    for size, of in own[v].items():
                        if size <= matched:
                            longest = max(longest, size)
                            items |= of
                    v = near[link[v]] if link[v] >= 0 else -1
                if longest:
                    a = i + 1 - longest
                    while spans and spans[-1][1] >= a:
                        a = min(a, spans.pop()[0])
                    spans.append((a, i + 1))
        return spans, items


def blocks(items: DataFrame, id_col: str, text_col: str, max_chars: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of bounded size, each read by itself."""
    own = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // max_chars)
    for k in range(n):
        block = own if n == 1 else own.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text) for r in block.collect()]


FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _found(batch: pa.RecordBatch, automaton: Automaton, text_col: str) -> list[dict]:
    rows = []
    for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
        own = words(text)
        spans, hit = automaton.find(own)
        rows.append({"n_words": len(own), "spans": [{"start": s, "end": e} for s, e in spans], "items": sorted(hit)})
    return rows


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``_lx`` (n_words, spans, items).

    One block of items is one narrow pass.  Of several only one is in memory at
    a time: each passes over the texts and writes the hits it finds, which join
    the rows by a number that they are written with first.
    """
    spark, column = docs.sparkSession, f"struct<{FOUND.replace(' long', ':long').replace(' array', ':array')}>"
    kind, found = to_arrow_type(T._parse_datatype_string(column)), None
    all_ = blocks(items, item_id, item_text, max_chars)
    block, more = next(all_, []), next(all_, None)
    if more is None:
        shared = spark.sparkContext.broadcast(Automaton(block, window))
        schema = docs.withColumn("_lx", F.lit(None).cast(column)).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sub_batches(batches, text_col):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_found(batch, shared.value, text_col), kind)], [*batch.schema.names, "_lx"])

        return docs.mapInArrow(run, schema)
    numbered = materialise(docs.withColumn("_lx_row", F.monotonically_increasing_id()), "numbered")
    rows = numbered.select("_lx_row", F.col(text_col).alias("_lx_text"))
    for k, block in enumerate(chain([block, more], all_)):
        shared = spark.sparkContext.broadcast(Automaton(block, window))

        def hits(batches: Iterator[pa.RecordBatch], shared=shared, every=k == 0) -> Iterator[pa.RecordBatch]:
            for batch in sub_batches(batches, "_lx_text"):
                got = _found(batch, shared.value, "_lx_text")
                at = [i for i, x in enumerate(got) if every or x["spans"]]  # the first block tells the words of all
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([got[i] for i in at], kind)], ["_lx_row", "_lx"])

        new = materialise(rows.mapInArrow(hits, f"_lx_row long, _lx {column}"), "hits")
        found = new if found is None else found.unionByName(new)
        shared.destroy()
    # spans of several blocks in order, those that touch as one
    ordered = F.array_sort(F.flatten(F.collect_list("_lx.spans")))
    merged = F.aggregate(
        ordered,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda out, s: F.when((F.size(out) > 0) & (F.element_at(out, -1)["end"] >= s["start"]), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(out, F.array(s))),
    )
    whole = found.groupBy("_lx_row").agg(F.struct(F.max("_lx.n_words").alias("n_words"), merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_lx.items")))).alias("items")).alias("_lx"))
    return numbered.join(whole, "_lx_row").drop("_lx_row").select(*docs.columns, "_lx")


def judge(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """Hits and items of every document."""
    found = find(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_lx_text")), items, "_lx_text", **more)
    hit = F.aggregate("_lx.spans", F.lit(0), lambda n, s: n + s.end - s.start).cast("long")
    return found.select(
        id_col,
        F.col("_lx.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_lx.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_lx.items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (round(1 / SHARE) * F.col("n_hit") >= F.col("n_words")))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of these ascending spans."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw.lower())]
    for s, e in reversed(spans):
        raw = raw[: at[s][0]] + raw[at[e - 1][1] :]
    return raw.decode("utf-8", "surrogatepass")


def cut(text: str, automaton: Automaton) -> str:
    """``text`` without the words of its spans; what closes up is looked at again."""
    while True:
        spans, _ = automaton.find(words(text))
        if not spans:
            return text
        text = cut_spans(text, spans)


def _put(batch: pa.RecordBatch, changed: dict[int, str], text_col: str, chars_col: str | None) -> list[pa.Array]:
    """The batch's columns with these texts and their character counts."""
    columns = list(batch.columns)
    for name, of in ((text_col, str), (chars_col, len)):
        if changed and name:
            n = batch.schema.get_field_index(name)
            values = columns[n].to_pylist()
            for i, t in changed.items():
                values[i] = of(t)
            columns[n] = pa.array(values, batch.schema.field(n).type)
    return columns


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that are not contaminated, in the columns of the input.

    Null texts and texts without words stay as they are; rows are judged each,
    so repeated ones stay repeated.  Documents above the share are left out; from others the spans are cut, and
    their character count follows the text.  One block of items does this in one
    pass.  Several mark the spans of all of them first, so that the share and
    every cut are of all items, and look again at what was cut.
    """
    own_chars = chars_col if chars_col in docs.columns else None
    limit = round(1 / SHARE)
    parts = [*islice(blocks(items, item_id, item_text, max_chars), 2)]
    if not parts:
        return docs
    if len(parts) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(Automaton(parts[0], window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in sub_batches(batches, text_col):
                kept, changed = [], {}
                for i, t in enumerate(batch.column(batch.schema.get_field_index(text_col)).to_pylist()):
                    own = words(t)
                    hit = sum(e - s for s, e in automaton.find(own)[0])
                    if hit and limit * hit >= len(own):
                        continue
                    if hit:
                        changed[i] = cut(t, automaton)
                    kept.append(i)
                yield pa.RecordBatch.from_arrays(_put(batch, changed, text_col, own_chars), batch.schema.names).take(pa.array(kept, pa.int64()))

        return docs.mapInArrow(run, docs.schema)

    def cut_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, text_col):
            n = batch.schema.get_field_index(text_col)
            spans = [[(s["start"], s["end"]) for s in x["spans"]] for x in batch.column(batch.num_columns - 1).to_pylist()]
            changed = {i: cut_spans(t, x) for i, (t, x) in enumerate(zip(batch.column(n).to_pylist(), spans, strict=True))}
            yield pa.RecordBatch.from_arrays(_put(batch, changed, text_col, own_chars)[:-1], batch.schema.names[:-1])

    hit = F.aggregate("_lx.spans", F.lit(0), lambda n, s: n + s.end - s.start).cast("long")
    more = {"item_id": item_id, "item_text": item_text, "window": window, "max_chars": max_chars}
    found = materialise(find(docs, items, text_col, **more), "decontam").where((hit == 0) | (limit * hit < F.col("_lx.n_words")))
    done = found.where(F.size("_lx.spans") == 0).drop("_lx")
    while True:
        found = found.where(F.size("_lx.spans") > 0)
        if found.isEmpty():
            return done
        found = materialise(find(found.mapInArrow(cut_found, docs.schema), items, text_col, **more), "decontam")
        done = done.union(found.where(F.size("_lx.spans") == 0).drop("_lx"))
