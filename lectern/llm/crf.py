"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  Its features are shares of character classes and
shape, its own and those of the lines before and after; transitions tie
neighbours.  The field is trained on a bounded sample of labelled documents,
whose lines all take their document's label.  A document's quality is the
length-weighted mean of its lines' forward-backward marginals, turned into a
probability by a logistic fit on the same sample and the labels' base rate.

Defined results: null and empty texts are one empty line; documents without a
label are scored like others; labels that are null are not learned from; with
no labels of either class all weights are zero and scores are the base rate;
repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, sub_batches

#: Labelled documents of each class in the training sample, those with the smallest hashes.
SAMPLE_PER_CLASS = 2500
#: Bytes of text in the sample: documents are taken in the order of their hashes until it has them.
SAMPLE_BYTES = 64 << 20
#: Lines of one chain in training; longer texts are several, of which every line is learned.
CHAIN = 64
STEPS = 150
L2 = 1e-3

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "shout": b"!?",
    "bar": b"|",
    "symbol": b"#*$%&<>{}[]\\^~=_@+/",
    "stop": b".,;:",
    "high": bytes(range(128, 256)),
}
_LUT = np.zeros(256, dtype=np.uint8)
for _k, _chars in enumerate(_CLASSES.values()):
    _LUT[list(_chars)] = _k + 1
OWN = 15


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of lines with neighbours, line lengths in characters, lines of each text)."""
    counts = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "replace"), dtype=np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    code = _LUT[raw]
    upper = code == 1
    upper[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    of = lambda mask: np.add.reduceat(mask, starts, dtype=np.int32).astype(np.float64)
    size = np.maximum(of((raw & 0xC0) != 0x80) - 1, 0)  # characters without the line break
    n = np.maximum(size, 1)
    up, low, digit, space, shout, bar, symbol, stop, high = (of(upper), *(of(code == k) for k in range(2, 10)))
    gap = (code == 4) | (raw == 10)
    words = of(~gap & np.concatenate([[True], gap[:-1]]))
    w = np.maximum(words, 1)
    letters = np.maximum(up + low + high / 2, 1)
    repeat, stutter = np.zeros(len(starts)), np.zeros(len(starts))
    at = 0
    for t in texts:
        seen: set[str] = set()
        for line in t.split("\n"):
            each = line.split()
            if line in seen:
                repeat[at] = 1.0
            elif each:
                seen.add(line)
            stutter[at] = sum(map(eq, each, islice(each, 1, None)))
            at += 1
    own = np.stack(
        [
            np.ones(len(starts)), up / letters, digit / n, space / n, np.minimum(shout / w, 1), np.minimum(bar / w, 1), np.minimum(symbol / w, 3), np.minimum(stop / w, 1),
            high / n, np.minimum(n / w, 30) / 10, np.log1p(size) / 5, (size == 0).astype(float), repeat, np.minimum(words, 10) / 10, stutter / w,
        ],
        axis=1,
    )
    doc = np.repeat(np.arange(len(texts)), counts)
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = doc[1:] == doc[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    return np.concatenate([own, before, after], axis=1), size, counts


@dataclass
class Crf:
    weights: np.ndarray  # of good against bad
    pairs: np.ndarray  # (2, 2), from and to
    slope: float
    shift: float


def _logadd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward_backward(good: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of good lines, expected pair counts, and log partition of each text.

    ``good`` has the line scores of the good state; the bad state has 0.  Texts
    run in parallel, one line a step.
    """
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    order = np.argsort(-counts, kind="stable")
    lengths, at = counts[order], starts[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts with more than t lines
    unary = np.stack([np.zeros_like(good), good], axis=1)
    forward, backward = np.zeros_like(unary), np.zeros_like(unary)
    for t in range(steps):
        rows = at[: active[t]] + t
        if t == 0:
            forward[rows] = unary[rows]
        else:
            prior = forward[rows - 1]
            for s in (0, 1):
                forward[rows, s] = _logadd(prior[:, 0] + pairs[0, s], prior[:, 1] + pairs[1, s]) + unary[rows, s]
    expected = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        rows = at[: active[t + 1]] + t
        after = backward[rows + 1] + unary[rows + 1]
        for s in (0, 1):
            backward[rows, s] = _logadd(after[:, 0] + pairs[s, 0], after[:, 1] + pairs[s, 1])
    total = _logadd(*(forward + backward).T)
    inner = np.ones(len(good), dtype=bool)
    inner[starts + counts - 1] = False
    rows = np.flatnonzero(inner)
    for a in (0, 1):
        for b in (0, 1):
            expected[a, b] = np.exp(forward[rows, a] + pairs[a, b] + unary[rows + 1, b] + backward[rows + 1, b] - total[rows]).sum()
    return np.exp(forward[:, 1] + backward[:, 1] - total), expected, total[starts]


def aggregate(marginals: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals of each text's lines."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    weight = sizes + 1.0
    return np.add.reduceat(marginals * weight, starts) / np.add.reduceat(weight, starts)


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def fit(texts: list[str], labels: list[int], base: float, steps: int = STEPS) -> Crf:
    """Train on whole sampled texts; ``base`` is the share of label 1 among all training labels."""
    width, base = 3 * OWN, min(max(base, 1e-3), 1 - 1e-3)
    model = Crf(np.zeros(width), np.zeros((2, 2)), 0.0, float(np.log(base / (1 - base))))
    y = np.array(labels, dtype=np.float64)
    if len(set(labels)) < 2:
        return model
    x, sizes, counts = line_features(texts)
    line_y = np.repeat(y, counts)
    each = np.repeat(1.0 / counts, counts)  # long texts don't outweigh short ones
    pieces = -(-counts // CHAIN)
    chains = np.full(int(pieces.sum()), CHAIN, dtype=np.int64)
    chains[np.cumsum(pieces) - 1] = counts - CHAIN * (pieces - 1)
    of_chain = np.repeat(y.astype(int), pieces)
    theta, m, v = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    seen = np.zeros((2, 2))
    np.add.at(seen, (of_chain, of_chain), (chains - 1).astype(float))
    links = max(1.0, float(chains[chains > 1].sum()))
    for k in range(1, steps + 1):
        p, expected, _ = forward_backward(x @ theta[:width], chains, theta[width:].reshape(2, 2))
        slope = np.concatenate([x.T @ ((line_y - p) * each) / len(texts), ((seen - expected) / links).ravel()]) - L2 * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        theta += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    model.weights, model.pairs = theta[:width], theta[width:].reshape(2, 2)
    z = _logit(aggregate(forward_backward(x @ model.weights, counts, model.pairs)[0], sizes, counts))
    a, b = 1.0, 0.0
    for _ in range(30):  # Newton steps of the logistic fit
        p = 1 / (1 + np.exp(-(a * z + b)))
        g, w = np.array([((y - p) * z).sum() - 0.1 * a, (y - p).sum()]), p * (1 - p) + 1e-9
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum()]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(h, g), -2, 2)
    share = y.mean()
    model.slope, model.shift = float(a), float(b + np.log(base / (1 - base)) - np.log(share / (1 - share)))
    return model


def score(model: Crf, texts: list[str]) -> np.ndarray:
    x, sizes, counts = line_features(texts)
    q = aggregate(forward_backward(x @ model.weights, counts, model.pairs)[0], sizes, counts)
    return 1 / (1 + np.exp(-(model.slope * _logit(q) + model.shift)))


def fold(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS, folds: int = 5, sample_bytes: int = SAMPLE_BYTES) -> Crf:
    """Fit on labelled rows outside fold 0: at most ``per_class`` of each class and about ``sample_bytes`` of text.

    The last document taken may go beyond the bytes, so that a single long one
    is learned from too.
    """
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (F.coalesce(fold(F.col("l_id"), folds), F.lit(0)) != 0))
    rate = known.agg(F.avg("y")).first()[0]
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("l_id"), "l_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    met = own.join(F.broadcast(picked), F.col("id") == F.col("l_id")).select("id", "y", F.coalesce("text", F.lit("")).alias("text"))
    met = materialise(met.withColumn("key", F.xxhash64("id", "text")).orderBy("key", "id").limit(4 * per_class), "sample")
    # a running sum over the sample's sizes only, at most 4 * per_class rows
    before = F.coalesce(F.sum("size").over(Window.orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = met.select("key", "id", F.octet_length("text").alias("size")).withColumn("before", before).where(F.col("before") < sample_bytes).agg(F.max("key")).first()[0]
    rows = met.where(F.col("key") <= F.lit(last).cast("long")).orderBy("key", "id").collect()
    return fit([r.text or "" for r in rows], [r.y for r in rows], 0.5 if rate is None else rate)


def score_table(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """The id (or all columns) and ``_score`` of every document, in one narrow pass."""
    rows = docs.withColumn("_lx_text", F.col(text_col).cast("string")) if keep_columns else docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_lx_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "_lx_text"):
            at = batch.schema.get_field_index("_lx_text")
            scores = score(model, [t or "" for t in batch.column(at).to_pylist()])
            arrays = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(scores, pa.float64())], [*names, "_score"])

    schema = rows.drop("_lx_text").schema.add("_score", "double")
    return rows.mapInArrow(run, schema)
