"""Suffix-array dedup on bytes, by induced sorting of shards.

Texts are joined on winnowed anchors first (see ``repeats``), so that all 400-byte windows that may
be equal come into one shard. A shard is one byte string; its suffix array is made by induced
sorting: suffixes are classified, leftmost-smaller substrings are sorted and named, the names are
sorted recursively, and all other suffixes follow by induction in time linear in the shard. Common
prefixes are computed in text order (permuted): only where the letter before a suffix differs from
the one before its neighbour must letters be compared; elsewhere the length is one less than before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.llm.common import join_groups, map_rows, stored, stored_texts
from vidspark.llm.kernels import _TABLE, Rolling
from vidspark.llm.repeats import by_text, covers, segments, union, window_matches

LENGTH = 400
SEED = 32
# Bytes of one shard's string, and of one anchor's segments that still go into a shard.
SHARD_BYTES = 2 << 20
GROUP_BYTES = 1 << 20
RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
# Alphabets up to this size are induced bucket by bucket, larger ones suffix by suffix.
SMALL_ALPHABET = 4096


def _small(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last one is."""
    n = len(s)
    up = s[:-1] < s[1:]
    differs = np.flatnonzero(s[:-1] != s[1:])
    out = np.zeros(n, bool)
    out[-1] = True
    if len(differs):
        # Runs of one letter are decided by the first change after them.
        at = np.searchsorted(differs, np.arange(n - 1))
        out[:-1] = up[differs[np.minimum(at, len(differs) - 1)]]
    return out


def _induce(s: np.ndarray, small: np.ndarray, sigma: int, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order."""
    if sigma > SMALL_ALPHABET:
        return _induce_each(s, small, sigma, lms)
    n = len(s)
    sa = np.full(n, -1, np.int64)
    size = np.bincount(s, minlength=sigma)
    end = np.cumsum(size)
    head, tail = end - size, end.copy()
    letters = s[lms]
    seed_at = np.searchsorted(letters, np.arange(sigma + 1))

    def put(to: np.ndarray, step: int, mask: bool, of: np.ndarray) -> None:
        before = of[of > 0] - 1
        before = before[small[before] == mask]
        if not len(before):
            return
        c = s[before]
        order = np.argsort(c, kind="stable")
        c = c[order]
        times = np.bincount(c, minlength=sigma)
        rank = np.arange(len(c)) - (np.cumsum(times) - times)[c]
        if step > 0:
            sa[to[c] + rank] = before[order]
            to += times
        else:
            sa[to[c] - 1 - rank] = before[order]
            to -= times

    used = np.flatnonzero(size)
    top = head.copy()
    for c in used.tolist():
        lo = head[c]
        while lo < top[c]:
            hi = top[c]
            put(top, 1, False, sa[lo:hi])
            lo = hi
        if seed_at[c] < seed_at[c + 1]:
            put(top, 1, False, lms[seed_at[c] : seed_at[c + 1]])
    for c in used[::-1].tolist():
        hi = end[c]
        while tail[c] < hi:
            lo = tail[c]
            put(tail, -1, True, sa[lo:hi][::-1])
            hi = lo
        if head[c] < top[c]:
            put(tail, -1, True, sa[head[c] : top[c]][::-1])
    # The empty suffix precedes nothing and is not induced.
    sa[0] = n - 1
    return sa


def _induce_each(s: np.ndarray, small: np.ndarray, sigma: int, lms: np.ndarray) -> np.ndarray:
    n = len(s)
    size = np.bincount(s, minlength=sigma)
    end = np.cumsum(size)
    # The letter before each suffix where that suffix is large, and where it is small; else -1.
    before = np.full(n, -1, np.int64)
    before[1:] = s[:-1]
    large = np.full(n, -1, np.int64)
    large[1:] = np.where(small[:-1], -1, before[1:])
    lesser = np.where(large >= 0, -1, before)
    large, lesser = large.tolist(), lesser.tolist()
    sa = [0] * n
    place = end.tolist()
    for i, c in zip(lms[::-1].tolist(), s[lms[::-1]].tolist(), strict=True):
        p = place[c] = place[c] - 1
        sa[p] = i
    place = (end - size).tolist()
    for i in sa:
        c = large[i]
        if c >= 0:
            p = place[c]
            sa[p] = i - 1
            place[c] = p + 1
    place = end.tolist()
    for at in range(n - 1, -1, -1):
        i = sa[at]
        c = lesser[i]
        if c >= 0:
            p = place[c] = place[c] - 1
            sa[p] = i - 1
    sa[0] = n - 1
    return np.asarray(sa, np.int64)


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of ``s``, whose last letter 0 is the only one and the least."""
    n = len(s)
    if n < 3:
        return np.arange(n - 1, -1, -1)
    small = _small(s)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) < 2:
        return _induce(s, small, sigma, lms)
    # A first induction from the letters alone sorts the substrings between leftmost-smaller ones.
    guess = _induce(s, small, sigma, lms[np.argsort(s[lms], kind="stable")])
    order = guess[is_lms[guess]]
    names, count = _names(s, lms, order)
    if count < len(lms):
        order = lms[suffix_array(names, count)]
    else:
        order = lms[np.argsort(names, kind="stable")]
    return _induce(s, small, sigma, order)


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the substrings from each leftmost-smaller suffix to the next, in text order."""
    stop = np.empty(len(s) + 1, np.int64)
    stop[lms[:-1]] = lms[1:]
    stop[lms[-1]] = lms[-1]
    a, b = order[:-1], order[1:]
    length = stop[a] - a
    same = length == stop[b] - b
    live = np.flatnonzero(same)
    at = 0
    while len(live):
        equal = s[a[live] + at] == s[b[live] + at]
        same[live[~equal]] = False
        live = live[equal]
        live = live[length[live] > at]
        at += 1
    rank = np.concatenate(([0], np.cumsum(~same)))
    place = np.empty(len(s), np.int64)
    place[order] = rank
    return place[lms], int(rank[-1]) + 1


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, left: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix in text order, the one before it in the array and their common prefix.

    Only the ``left`` letters up to the end of a suffix's own string are compared; strings start at
    ``begin``.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    i = np.arange(n)
    # Where the letters before agree, the length is that of the suffix before, less one.
    free = (before < 0) | (before == 0) | (i == 0)
    inner = np.flatnonzero(~free)
    free[inner] = s[inner - 1] != s[before[inner] - 1]
    free[begin] = True
    at = np.flatnonzero(free & (before >= 0))
    found = np.zeros(n, np.int64)
    live, k = at, np.zeros(len(at), np.int64)
    while len(live):
        a, b = live + k, before[live] + k
        equal = (k < left[live]) & (b < n)
        equal[equal] = s[a[equal]] == s[b[equal]]
        done = ~equal
        found[live[done]] = k[done]
        live, k = live[~done], k[~done] + 1
    last = np.maximum.accumulate(np.where(free, i, 0))
    return before, np.maximum(0, found[last] - (i - last))


def repeated_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each string the starts of windows that start anywhere else in the strings too."""
    sizes = np.array([len(p) for p in parts])
    # 0 ends the shard, 1 ends a string, bytes follow.
    buf = np.frombuffer(b"\x00".join(parts) + b"\x00\x00", np.uint8).astype(np.int64) + 2
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    buf[begin + sizes] = 1
    buf[-1] = 0
    sa = suffix_array(buf, 258)
    left = np.append(np.repeat(begin + sizes, sizes + 1) - np.arange(len(buf) - 1), 0)
    before, prefix = permuted_prefixes(buf, sa, left, begin)
    hit = np.flatnonzero(prefix >= length)
    mark = np.zeros(len(buf), bool)
    mark[hit] = True
    mark[before[hit]] = True
    return [np.flatnonzero(mark[b : b + n]) for b, n in zip(begin.tolist(), sizes.tolist(), strict=True)]


def byte_units(texts: list[bytes]):
    data = b"".join(texts)
    stop = np.cumsum([len(t) for t in texts])
    return _TABLE[np.frombuffer(data, np.uint8)], np.concatenate(([0], stop[:-1])).astype(np.int64), stop


def cut_bytes(texts: list[bytes], asked: list, length: int) -> list[list[bytes]]:
    return [[t[s["at"] : s["at"] + s["n"] + length - 1] for s in items] for t, items in zip(texts, asked, strict=True)]


def reach(group: list[tuple], anchor: int, k: int, length: int) -> list[tuple]:
    """Cut segments of one anchor to what agrees with some other segment on either side of it.

    Both sides are sorted, so the longest agreement is with a neighbour. Segments whose sides do not
    add up to a window are left out.
    """
    first = group[0][3]
    at = np.arange(len(first) - k + 1)
    rolling = Rolling(_TABLE[np.frombuffer(first, np.uint8)])
    off = int(np.argmax(rolling.of(at, at + k).view(np.int64) == anchor))
    seed = first[off : off + k]
    # The anchor is the leftmost of its k-grams in every segment.
    offs = [g[3].find(seed) for g in group]
    far = []
    for sides in ([g[3][:o][::-1] for g, o in zip(group, offs, strict=True)], [g[3][o + k :] for g, o in zip(group, offs, strict=True)]):
        order = sorted(range(len(sides)), key=sides.__getitem__)
        most = [0] * len(sides)
        for x, y in zip(order, order[1:], strict=False):
            n = min(len(sides[x]), len(sides[y]))
            apart = np.flatnonzero(np.frombuffer(sides[x], np.uint8, n) != np.frombuffer(sides[y], np.uint8, n)) if n else ()
            n = int(apart[0]) if len(apart) else n
            most[x], most[y] = max(most[x], n), max(most[y], n)
        far.append(most)
    out = []
    for (rid, at_, copies, part), o, left, right in zip(group, offs, *far, strict=True):
        if left + k + right >= length:
            out.append((rid, at_ + o - left, copies, part[o - left : o + k + right]))
    return out


def shard_matches(length: int, seed: int, shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES):
    """Compare segments of one anchor in suffix arrays of shards; anchors with very many by sums."""

    def flush(rows: list[tuple]) -> pd.DataFrame:
        out = []
        for (rid, at, copies, _), starts in zip(rows, repeated_windows([r[3] for r in rows], length), strict=True):
            if copies == 1 and len(starts):
                cut = np.flatnonzero(np.diff(starts) > 1) + 1
                for run in np.split(starts, cut):
                    out.append((rid, at + int(run[0]), len(run)))
        return pd.DataFrame(out, columns=["rid", "at", "n"]).astype({"rid": "int64", "at": "int64", "n": "int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Sorted by anchor; a shard takes whole groups until it is full.
        rows: list[tuple] = []
        group: list[tuple] = []
        size, last = 0, None
        for pdf in batches:
            for rid, at, copies, part, anchor in zip(pdf.rid, pdf["at"], pdf.copies, pdf.part, pdf.anchor, strict=True):
                if anchor != last and group:
                    some = reach(group, last, seed, length)
                    rows += some
                    size, group = size + sum([len(r[3]) for r in some]), []
                    if size >= shard_bytes:
                        yield flush(rows)
                        rows, size = [], 0
                last = anchor
                group.append((rid, at, copies, part))
        rows += reach(group, last, seed, length) if group else []
        if rows:
            yield flush(rows)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rid, at, n, anchor, copies, part in zip(pdf.rid, pdf["at"], pdf.n, pdf.anchor, pdf.copies, pdf.part, strict=True):
                start = np.arange(n)
                key = Rolling(_TABLE[np.frombuffer(part, np.uint8)]).of(start, start + length)
                yield pd.DataFrame({"rid": rid, "at": at + start, "anchor": anchor, "key": key.view(np.int64), "copies": copies})

    def compare(contents: DataFrame) -> DataFrame:
        contents = stored(contents, "contents")
        sizes = contents.groupBy("anchor").agg(F.sum(F.length("part")).alias("_bytes"), F.count("*").alias("_n"))
        over = sizes.filter(F.col("_bytes") > group_bytes)
        few = contents.join(over.select("anchor"), "anchor", "left_anti")
        n = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shards = few.repartition(n, "anchor").sortWithinPartitions("anchor")
        found = shards.select("rid", "at", "copies", "part", "anchor").mapInPandas(run, "rid long, at long, n int")
        if over.isEmpty():
            return found
        big = join_groups(contents, over.select("anchor", "_n"), "anchor", "_n")
        rest = big.select("rid", "at", "n", "anchor", "copies", "part").mapInPandas(windows, "rid long, at long, anchor long, key long, copies long")
        return found.unionByName(window_matches(stored(rest, "windows")))

    return compare


def repeated_bytes(texts: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``rid, start, stop`` of bytes in strings of ``length`` that start elsewhere too."""
    found = segments(texts, byte_units, length, seed)
    return covers(texts, found, shard_matches(length, seed), cut_bytes, length)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Removes each byte in a string of ``length`` bytes that starts anywhere else too, the same
    document included. Null and empty texts have no bytes; repeated rows are each other's copies.
    """
    texts = stored_texts(docs)
    both = by_text(texts, repeated_bytes(texts, length, seed))

    def make():
        def work(texts, spans):
            out = []
            for text, own in zip(texts, spans, strict=True):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                gone = union(own, len(data))
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
                out.append((len(data), int(gone.sum()), runs, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            return list(zip(*out, strict=True)) or [[], [], [], []]

        return work

    return map_rows(both, [both["text"], both["spans"]], make, RESULT, drop=("rid", "text", "spans"))
