"""How many items of a list are worth keeping: simhash clusters, a knee of the
bigram curve, and a check by compressed size.  Plain Python, used inside Arrow
kernels; :mod:`lectern.operators.series` has the parts as DataFrame operators."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np

MASK = (1 << 64) - 1


def simhash(text: str) -> int:
    """64 majority votes over the MD5 prefixes of character four-grams."""
    low = text.lower()
    grams = [low] if len(low) <= 3 else [low[i : i + 4] for i in range(len(low) - 3)]
    votes = np.array([int.from_bytes(hashlib.md5(g.encode()).digest()[:8], "big") for g in grams], dtype=np.uint64)
    bits = (votes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    ahead = 2 * bits.sum(axis=0).astype(np.int64) > len(grams)
    return int((ahead.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def clusters(prints: list[int], near: int = 3) -> int:
    """Greedy in order: a new cluster where no earlier one's first print is within ``near`` bits."""
    firsts: list[int] = []
    for p in prints:
        if all((p ^ q).bit_count() > near for q in firsts):
            firsts.append(p)
    return len(firsts)


def bigram_curve(items: list[str]) -> list[int]:
    """Distinct lower-case word pairs seen up to each item; one without words is the empty word."""
    seen: set[tuple[str, str]] = set()
    out = []
    for item in items:
        w = item.lower().split()
        seen |= set(zip(w, w[1:], strict=False)) if len(w) > 1 else {(w[0] if w else "", "")}
        out.append(len(seen))
    return out


def knee(curve: list[int]) -> int | None:
    """One past the point farthest above the chord; none if it is hardly above it."""
    if len(curve) < 3:
        return None
    y = np.array(curve, dtype=float)
    if y[-1] == y[0]:
        return 1
    above = (y - y[0]) / (y[-1] - y[0]) - np.arange(len(y)) / (len(y) - 1)
    k = int(above.argmax())
    return k + 1 if above[k] >= 0.05 else None


def optimal_k(items: list[str], bias: float = 1.0, least: int = 3, most: int | None = None) -> int:
    n = len(items)
    if n <= 8:
        return n
    most = n if most is None else most
    unique = clusters([simhash(x) for x in items])
    if unique <= 3:
        return min(max(least, unique), most)
    at, diversity = knee(bigram_curve(items)), unique / n
    broad = max(least, int(n * (0.3 + 0.7 * diversity)))
    k = broad if at is None else max(at, broad) if diversity > 0.7 else at
    k = min(max(least, int(k * bias)), most)
    whole = "\n".join(items).encode()
    if k < n and k < most and len(whole) >= 200:
        part = "\n".join(items[:k]).encode()
        share = lambda b: len(zlib.compress(b, 1)) / len(b) if b else 1.0
        if abs(share(whole) - share(part)) > 0.15:
            k = min(int(k * 1.2), most)
    return max(least, min(k, most))
