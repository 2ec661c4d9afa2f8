"""Substring dedup on words: seed and extend.

Seeds are winnowed runs of ``SEED`` words; documents are joined on them. Every occurrence is extended
word by word to the left and right against the others of its seed, and its maximal repeats of
``LENGTH`` words and more are kept. Pairs are not formed: of occurrences that agree on some words to
the left, the longest agreement to the right is with a neighbour in the order of what follows.
Words are compared by 64-bit hashes. Seeds with over ``GROUP_SEGMENTS`` different surroundings are
not gathered; they go through sums of window hashes, which remove the same words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.llm.common import join_groups, map_rows, parallelism, stored, stored_texts
from vidspark.llm.kernels import Rolling, Words
from vidspark.llm.repeats import by_text, covers, segments, union, window_matches

LENGTH = 35
SEED = 8
# Different surroundings of one seed that a task extends together, and rows it works on at once.
GROUP_SEGMENTS = 4096
CHUNK_ROWS = 1 << 14
RESULT = "n_words long, n_removed long, kept_sha256 string"


def word_units(texts: list[bytes]):
    w = Words(texts)
    return w.hashes(), w.first[:-1], w.first[1:]


def cut_words(texts: list[bytes], asked: list, length: int) -> list[list[bytes]]:
    """Word hashes of the asked segments."""
    values, begin, _ = word_units(texts)
    out = []
    for b, items in zip(begin.tolist(), asked, strict=True):
        out.append([values[b + s["at"] : b + s["at"] + s["n"] + length - 1].tobytes() for s in items])
    return out


def seed_places(values: np.ndarray, begin: np.ndarray, size: np.ndarray, anchor: np.ndarray, seed: int) -> np.ndarray:
    """Where each segment's seed starts; the seed is the leftmost run of its hash."""
    at = np.arange(len(values) - seed + 1)
    hit = np.flatnonzero(Rolling(values).of(at, at + seed) == np.repeat(anchor, size)[: len(at)])
    owner = np.searchsorted(begin, hit, side="right") - 1
    return hit[np.diff(owner, prepend=-1) > 0]


def maximal_repeats(values: np.ndarray, size: np.ndarray, anchor: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """``segment, start, stop`` of the maximal repeats of ``length`` words and more around a seed.

    Segments lie in ``values`` one after the other, sorted by ``anchor``. Classes of segments that agree
    on ``l`` words to the left are refined word by word. Within a class segments stay in the order of
    what follows the seed, so the furthest agreement to the right is with a neighbour. A repeat is
    maximal when one more word to the left costs words on the right.
    """
    begin = np.cumsum(size) - size
    place = seed_places(values, begin, size, anchor, seed)
    n_left, n_right = place - begin, begin + size - place - seed
    width = length - seed
    step = np.arange(width)
    # Signs beyond a side's end are 0; agreements are cut to the shorter side.
    left = np.where(step < n_left[:, None], values[np.maximum(place[:, None] - 1 - step, 0)], np.uint64(0))
    right = np.where(step < n_right[:, None], values[np.minimum(place[:, None] + seed + step, len(values) - 1)], np.uint64(0))
    group = np.cumsum(np.diff(anchor, prepend=anchor[:1]) != 0)
    live = np.lexsort((*right.T[::-1], group))
    last, out = np.full(len(size), -1), []
    for l in range(width + 2):
        now = np.full(len(size), -1)
        if l:
            live = live[n_left[live] >= l] if l <= width else live[:0]
            word = left[live, min(l, width) - 1]
            order = np.lexsort((word, group[live]))
            live, word = live[order], word[order]
            new = (np.diff(group[live], prepend=-1) != 0) | (np.diff(word, prepend=word[:1]) != 0)
            group[live] = np.cumsum(new)
        # Who is alone in a class has nobody left to agree with.
        live = live[np.bincount(group[live])[group[live]] > 1]
        a, b = live[:-1], live[1:]
        apart = right[a] != right[b]
        agree = np.where(apart.any(1), apart.argmax(1), width)
        agree = np.where(group[a] == group[b], np.minimum(agree, np.minimum(n_right[a], n_right[b])), -1)
        now[a] = agree
        now[b] = np.maximum(now[b], agree)
        kept = np.flatnonzero((last > now) & (l - 1 + seed + last >= length))
        out.append((kept, n_left[kept] - l + 1, n_left[kept] + seed + last[kept]))
        last = now
        if not len(live):
            break
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def extended(length: int, seed: int):
    """Windows of maximal repeats of segments that come sorted by seed; groups are taken whole."""

    def flush(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.frombuffer(b"".join(pdf.part), np.uint64)
        size = pdf.n.to_numpy().astype(np.int64) + length - 1
        row, start, stop = maximal_repeats(values, size, pdf.anchor.to_numpy().view(np.uint64), length, seed)
        # Segments with copies count whole already; they only serve as witnesses.
        own = pdf.copies.to_numpy()[row] == 1
        row, start, stop = row[own], start[own], stop[own]
        return pd.DataFrame({"rid": pdf.rid.to_numpy()[row], "at": pdf["at"].to_numpy()[row] + start, "n": (stop - start - length + 1).astype(np.int32)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size < CHUNK_ROWS:
                continue
            rows = pd.concat(held, ignore_index=True)
            # The last group may go on in the next batch.
            whole = int(np.searchsorted(rows.anchor.to_numpy(), rows.anchor.iloc[-1]))
            if whole:
                yield flush(rows.iloc[:whole])
            held, size = [rows.iloc[whole:]], len(rows) - whole
        if size:
            yield flush(pd.concat(held, ignore_index=True))

    return run


def window_hashes(length: int):
    """One row per window of each segment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            values = np.frombuffer(b"".join(pdf.part), np.uint64)
            n = pdf.n.to_numpy().astype(np.int64)
            begin = np.cumsum(n + length - 1) - (n + length - 1)
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = begin[row] + step
            key = Rolling(values).of(start, start + length)
            yield pd.DataFrame(
                {"rid": pdf.rid.to_numpy()[row], "at": pdf["at"].to_numpy()[row] + step, "anchor": pdf.anchor.to_numpy()[row], "key": key.view(np.int64), "copies": pdf.copies.to_numpy()[row]}
            )

    return run


def extensions(length: int, seed: int, most: int):
    """Extend the segments of each seed against each other; seeds with over ``most`` go by sums."""

    def compare(contents: DataFrame) -> DataFrame:
        contents = stored(contents.drop("seg"), "contents")
        over = stored(contents.groupBy("anchor").agg(F.count("*").alias("_n")).filter(F.col("_n") > most), "hot_seeds")
        hot = not over.isEmpty()
        few = contents.join(over.select("anchor"), "anchor", "left_anti") if hot else contents
        near = few.repartition(parallelism(contents.sparkSession), "anchor").sortWithinPartitions("anchor")
        found = near.mapInPandas(extended(length, seed), "rid long, at long, n int")
        if not hot:
            return found
        big = join_groups(contents, over, "anchor", "_n")
        windows = big.mapInPandas(window_hashes(length), "rid long, at long, anchor long, key long, copies long")
        return found.unionByName(window_matches(stored(windows, "windows")))

    return compare


def repeated_words(texts: DataFrame, length: int = LENGTH, seed: int = SEED, most: int = GROUP_SEGMENTS) -> DataFrame:
    """``rid, start, stop`` of words in windows that start elsewhere too."""
    found = segments(texts, word_units, length, seed)
    return covers(texts, found, extensions(length, seed, most), cut_words, length)


def substring_dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED, most: int = GROUP_SEGMENTS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256``.

    Removes each word in a window of ``length`` words that starts anywhere else too, the same
    document included. Null and empty texts have no words; repeated rows are each other's copies.
    """
    texts = stored_texts(docs)
    both = by_text(texts, repeated_words(texts, length, seed, most))

    def make():
        def work(texts, spans):
            out = []
            for text, own in zip(texts, spans, strict=True):
                w = Words([text.encode("utf-8", "surrogatepass")])
                gone = union(own, len(w.start))
                stay = ~gone
                kept = b" ".join([w.raw[a:b] for a, b in zip(w.start[stay].tolist(), w.stop[stay].tolist(), strict=True)])
                out.append((len(w.start), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            return list(zip(*out, strict=True)) or [[], [], []]

        return work

    return map_rows(both, [both["text"], both["spans"]], make, RESULT, drop=("rid", "text", "spans"))
