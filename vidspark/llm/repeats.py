"""Exact repeated windows over all texts, found from winnowed anchors.

A unit is a byte or a word; a window is ``length`` units. Every window has one anchor, which equal
windows share, so texts are joined on anchors only and each window is judged once. Occurrences of an
anchor with equal surroundings (segments) are added up before anything else; the content of a
segment is fetched only where an anchor has several different ones. No pairs are formed: a segment
of which there are many counts as one with a number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.llm.common import join_groups, stored
from vidspark.llm.kernels import anchored, chunks

SEGMENTS = "rid long, at long, n int, anchor long, seg long"
CHUNK = 1 << 20


def segments(texts: DataFrame, units: Callable, length: int, k: int) -> DataFrame:
    """Stored segments of all texts; ``units(list of bytes)`` gives values, begins and ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rid = pdf.rid.to_numpy()
            for first, group in chunks(pdf.text.tolist(), CHUNK):
                text, at, n, anchor, seg = anchored(*units(group), length, k)
                yield pd.DataFrame(
                    {"rid": rid[first + text], "at": at, "n": n.astype(np.int32), "anchor": anchor.view(np.int64), "seg": seg.view(np.int64)}
                )

    return stored(texts.select("rid", "text").mapInPandas(run, SEGMENTS), "segments")


def shared_segments(found: DataFrame) -> DataFrame:
    """Stored segments whose anchor occurs again, with ``alike``: all its segments are equal."""
    anchors = found.groupBy("anchor").agg(F.count("*").alias("_n"), (F.min("seg") == F.max("seg")).alias("alike"))
    # A group of one has nothing to be compared with.
    return stored(join_groups(found, anchors.filter("_n > 1"), "anchor", "_n").drop("_n"), "shared")


def covers(texts: DataFrame, found: DataFrame, compare: Callable[[DataFrame], DataFrame], content: Callable, length: int) -> DataFrame:
    """``rid, start, stop`` of units in repeated windows.

    ``content(list of bytes, list of segment lists)`` cuts segments out of texts;
    ``compare(contents)`` finds the repeated windows of different segments with one anchor.
    """
    hits = shared_segments(found)
    alike = hits.filter("alike").select("rid", "at", "n")
    mixed = hits.filter("NOT alike")
    kinds = stored(
        mixed.groupBy("anchor", "seg").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "at", "n")).alias("rep")).select("anchor", "seg", "copies", "rep.*"),
        "kinds",
    )
    many = kinds.filter("copies > 1").select("anchor", "seg", "copies")
    again = join_groups(mixed, many, ["anchor", "seg"], "copies").select("rid", "at", "n")
    asked = kinds.groupBy("rid").agg(F.collect_list(F.struct("at", "n", "anchor", "seg", "copies")).alias("asked"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, group in chunks(pdf.text.tolist(), CHUNK):
                asked = pdf.asked.iloc[first : first + len(group)].tolist()
                rows = []
                for rid, items, parts in zip(pdf.rid.iloc[first : first + len(group)], asked, content(group, asked, length), strict=True):
                    rows += [(rid, s["at"], s["n"], s["anchor"], s["seg"], s["copies"], p) for s, p in zip(items, parts, strict=True)]
                yield pd.DataFrame(rows, columns=["rid", "at", "n", "anchor", "seg", "copies", "part"])

    contents = texts.join(asked, "rid").select("rid", "text", "asked").mapInPandas(
        cut, "rid long, at long, n int, anchor long, seg long, copies long, part binary"
    )
    # Of segments with copies all windows count already; they only serve as witnesses.
    part = compare(contents)
    whole = alike.unionByName(again)
    return whole.unionByName(part.select("rid", "at", "n")).select("rid", F.col("at").alias("start"), (F.col("at") + F.col("n") + length - 1).alias("stop"))


def by_text(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Every text with its spans; only the spans move."""
    per = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    return texts.join(per, "rid", "left")


def union(spans: list | None, n: int) -> np.ndarray:
    """Mask of ``n`` units that lie in a span."""
    if not spans:
        return np.zeros(n, bool)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, [s["start"] for s in spans], 1)
    np.add.at(edge, [s["stop"] for s in spans], -1)
    return np.cumsum(edge[:n]) > 0


def window_matches(windows: DataFrame) -> DataFrame:
    """``rid, at, n=1`` of windows that some other segment has too.

    ``windows``: ``rid, at, anchor, key, copies``, one row per window of each different segment;
    ``key`` is the hash of its units. Sums combine before the shuffle, so no group is gathered.
    """
    twice = windows.groupBy("anchor", "key").agg(F.count("*").alias("_n")).filter("_n > 1")
    return join_groups(windows, twice, ["anchor", "key"], "_n").filter("copies = 1").select("rid", "at", F.lit(1).alias("n"))
