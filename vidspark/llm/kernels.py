"""Vectorised passes over the bytes and words of many texts at once.

A word is ``[^\\x20\\x09-\\x0D]+``. Equal words have equal 64-bit hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

CHUNK_BYTES = 2 << 20
M64 = (1 << 64) - 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all input bits (multiplications modulo 2**64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse; kept up to a chunk's length."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    out = []
    for b in (_BASE, _INVERSE):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if n <= 2 * CHUNK_BYTES:
        _POWERS[:] = out
    return out[0], out[1]


def chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as UTF-8 in groups of about ``limit`` bytes (one text at least)."""
    at, group, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if group and size + len(b) > limit:
            yield at, group
            at, group, size = i, [], 0
        group.append(b)
        size += len(b) + 1
    if group:
        yield at, group


class Words:
    """Words of a group of texts: byte spans, hashes and the slice of each text."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = b" ".join(texts) + b" "
        self.raw = data
        self.buf = np.frombuffer(data, np.uint8)
        lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.doc_at = np.concatenate(([0], np.cumsum(lens + 1)))
        space = _SPACE[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.stop = edge[0::2], edge[1::2]
        if lower:
            up = (self.buf >= 65) & (self.buf <= 90)
            self.buf = self.buf + (up.view(np.uint8) << np.uint8(5))
        self.space = space
        # Words of text i are first[i]:first[i + 1].
        self.first = np.searchsorted(self.start, self.doc_at)

    def hashes(self) -> np.ndarray:
        n = len(self.buf)
        power, inverse = powers(n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_TABLE[self.buf] * power, out=total[1:])
        return mix((total[self.stop] - total[self.start]) * inverse[self.start] + (self.stop - self.start).astype(np.uint64))

    def shapes(self) -> np.ndarray:
        """Hashes of words with runs of small, large letters and digits folded to one sign each."""
        sign = _SHAPE[self.buf]
        keep = np.ones(len(sign), bool)
        keep[1:] = (sign[1:] != sign[:-1]) | self.space[1:] | self.space[:-1]
        rank = np.cumsum(keep) - 1
        power, inverse = powers(len(sign))
        total = np.zeros(len(sign) + 1, np.uint64)
        np.cumsum(np.where(keep, _TABLE[sign] * power[rank], np.uint64(0)), out=total[1:])
        return mix((total[self.stop] - total[self.start]) * inverse[rank[self.start]] + np.uint64(1))


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE[128:] = 97


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, by their first word; ``len(words) - n + 1`` values."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(_BASE) + words[k : len(words) - n + 1 + k])
    return out

# Bits of a k-gram's hash that rank it as an anchor; the rest holds its place in the chunk.
PLACE_BITS = 24
MAX_UNITS = 1 << 22


class Rolling:
    """Hashes of any run of units, by differences of running sums."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        power, self.inverse = powers(self.n + 1)
        self.total = np.empty(self.n + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(mix(values + np.uint64(0x632BE59BD9B4E019)) * power[: self.n], out=self.total[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        span = (self.total[stop] - self.total[start]) * self.inverse[start]
        return mix(span + (stop - start).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, from running minima of blocks both ways."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchored(values: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Winnowed anchors of the texts ``values[begin:end]``, each with the windows it stands for.

    A window is ``length`` units; its anchor is the leftmost of its k-grams with the least hash, so
    equal windows have equal anchors at equal places. Neighbouring windows with one anchor form a
    segment. Returns per segment: text, first window (from the text's begin), number of windows,
    hash of the anchor's k-gram, hash of all units its windows cover.
    """
    out = []
    # Very long texts go in parts that share no window.
    step = MAX_UNITS
    parts = [(t, at, min(e, at + step + length - 1), b) for t, (b, e) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)) for at in range(b, max(b + 1, e - length + 1), step) if e - at >= length]
    i = 0
    while i < len(parts):
        j, lo = i, parts[i][1]
        while j < len(parts) and parts[j][2] - lo <= step + length and parts[j][1] >= lo:
            j += 1
        j = max(j, i + 1)
        out.append(_anchored(values, parts[i:j], length, k))
        i = j
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _anchored(values, parts, length, k):
    lo, hi = parts[0][1], max(p[2] for p in parts)
    rolling = Rolling(values[lo:hi])
    at = np.arange(hi - lo - k + 1)
    grams_ = rolling.of(at, at + k)
    low = np.uint64((1 << PLACE_BITS) - 1)
    anchor = (sliding_min((grams_ & ~low) | at.astype(np.uint64), length - k + 1) & low).astype(np.int64)
    first = np.array([p[1] - lo for p in parts])
    count = np.array([p[2] - p[1] - length + 1 for p in parts])
    # Windows that lie within one text.
    text = np.repeat(np.arange(len(parts)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(start)))
    a = start[head]
    owner = np.array([p[0] for p in parts])[text[head]]
    own = np.array([p[3] for p in parts])[text[head]]
    return owner, a + lo - own, n, grams_[anchor[head]], rolling.of(a, a + n + length - 1)
