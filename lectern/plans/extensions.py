"""Extension points: compressors, token counters, summarisers and stores of one's own.

Each is a small class or function that travels to the executors with the
configuration that names it; nothing is registered in a process.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens

Saved = list[tuple[str, str]]


@dataclass(frozen=True)
class Compressor:
    """``run`` takes (text, focus terms, reversible) to (shorter text, originals); an error keeps the text.

    Messages of ``content_types`` are routed to it before the built-in ones.
    """

    name: str
    run: Callable[[str, list[str], bool], tuple[str, Saved]]
    content_types: tuple[str, ...] = ()


class TokenCounter(Protocol):
    """Counts tokens of a text and says how sure it is."""

    def count(self, text: str) -> int: ...
    def column(self, text: Column) -> Column: ...
    def kind(self) -> tuple[str, str | None, float]: ...


@dataclass(frozen=True)
class Estimate:
    """Tokens from UTF-8 bytes, in the JVM."""

    model: str = ""

    def count(self, text: str) -> int:
        return max(1, math.ceil(len(text.encode()) / tokens.bytes_per_token(self.model)))

    def column(self, text: Column) -> Column:
        return tokens.estimate(text, self.model)

    def kind(self) -> tuple[str, str | None, float]:
        return "estimated", f"bytes/{tokens.bytes_per_token(self.model):.1f} heuristic", tokens.MARGIN


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass(frozen=True)
class RankFile:
    """Tokens of a byte-level vocabulary, from a file of ranks that every executor can read.

    Exact for the models that use it; for others a proxy, scaled by ``factor``.
    """

    path: str
    pattern: str
    factor: float = 1.0

    def count(self, text: str) -> int:
        n = len(_encoding(self.path, self.pattern).encode_ordinary(text))
        return max(1, n if self.factor == 1.0 else math.ceil(n * self.factor))

    def column(self, text: Column) -> Column:
        @F.pandas_udf("long")
        def run(values):
            own = _encoding(self.path, self.pattern)
            lengths = [len(x) for x in own.encode_ordinary_batch(values.fillna("").tolist(), num_threads=1)]
            return values.__class__(lengths, index=values.index)

        n = run(text)
        return F.greatest(F.lit(1), n if self.factor == 1.0 else F.ceil(n * F.lit(self.factor))).cast("long")

    def kind(self) -> tuple[str, str | None, float]:
        return ("exact", None, 0.0) if self.factor == 1.0 else ("estimated", f"proxy (x{self.factor:.1f})", tokens.MARGIN)


#: Families of models by the start of their names, and the vocabulary of each; others take the first as a proxy.
FAMILIES = [(("gpt-4o", "gpt-5", "o1", "o3", "o4"), "o200k"), (("gpt-4", "gpt-3.5"), "cl100k")]
PROXY_FACTOR = 1.1


def counter_for(model: str, vocabularies: dict[str, tuple[str, str]] | None = None) -> TokenCounter:
    """The best counter there is: a vocabulary's (path and pattern by name), else the estimate."""
    name, factor = next(((v, 1.0) for starts, v in FAMILIES if model.startswith(starts)), (FAMILIES[0][1], PROXY_FACTOR))
    path, pattern = (vocabularies or {}).get(name, (None, None))
    return RankFile(path, pattern, factor) if path and os.path.exists(path) else Estimate(model)


def count_messages(counter: TokenCounter, text: Column) -> Column:
    """Aggregate: tokens of all messages with their overhead."""
    return (F.sum(counter.column(text)) + tokens.OVERHEAD * F.count("*")).cast("long")


class Originals(Protocol):
    """Where originals are kept: (id, original, ...) rows by id."""

    def save(self, new: DataFrame) -> None: ...
    def retrieve(self, requests: DataFrame, request: str) -> DataFrame: ...
    def delete(self, ids: DataFrame) -> None: ...


@dataclass(frozen=True)
class Pipeline:
    """Steps over messages, each a function from DataFrame to DataFrame, and compressors to route to."""

    compressors: tuple[Compressor, ...] = ()
    steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    options: dict = field(default_factory=dict)

    def add_compressor(self, own: Compressor) -> Pipeline:
        return Pipeline((*self.compressors, own), self.steps, self.options)

    def add_step(self, step: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return Pipeline(self.compressors, (*self.steps, step), self.options)

    def with_options(self, **options) -> Pipeline:
        return Pipeline(self.compressors, self.steps, self.options | options)

    def run(self, messages: DataFrame):
        from .pipeline import CompressConfig, compress

        for step in self.steps:
            messages = messages.transform(step)
        return compress(messages, CompressConfig(compressors=self.compressors, **self.options))
