"""N-gram Jaccard self-join by MinHash banding.

Texts become sets of word n-grams; equal sets are one class from the start. Classes are cut into
bands of MinHash values, with bands and rows chosen for a target recall at the threshold, and meet on
band hashes. Instead of pairs, each bucket names its least class as hub, and a class's full n-gram
set goes once to each of its hubs, where all pairs of the hub's group are verified in blocks. A pair
that meets at several hubs counts at the least of them. Out come sums of links and a spanning forest,
never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.llm.common import join_groups, parallelism, stored, stored_texts
from vidspark.llm.components import components
from vidspark.llm.kernels import Words, chunks, grams, mix

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
# N-grams of one block of a hub's group; larger groups are verified block by block.
BLOCK_GRAMS = 1_000_000
BLOCK_SETS = 1_000
CHUNK = 1 << 21
LAST = (1 << 63) - 1


def plan_bands(threshold: float, recall: float, noise: float = 0.05) -> tuple[int, int]:
    """Bands and rows per band: the fewest rows for which pairs of half the threshold seldom meet.

    Pairs at the threshold meet with probability ``recall`` at least, pairs of half the threshold
    with ``noise`` at most.
    """
    for rows in range(1, 64):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))) if threshold < 1 else 1
        if 1 - (1 - (threshold / 2) ** rows) ** bands <= noise:
            return bands, rows
    raise ValueError("no banding for these parameters")


def gram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted hashes of each text's word n-grams, A-Z as a-z; a text of fewer words is one n-gram."""
    w = Words(texts, lower=True)
    values = w.hashes()
    all_grams = grams(values, n)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(all_grams[a : b - n + 1]))
        elif b > a:
            out.append(grams(values[a:b], b - a) + np.uint64(b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One hash per set and band, from ``bands * rows`` MinHash values."""
    out = np.zeros((len(sets), bands), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    begin = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
    h = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
    draws = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
    scratch = np.empty_like(h)
    for band in range(bands):
        key = np.full(len(full), band + 1, np.uint64)
        for row in range(rows):
            k = 2 * (band * rows + row)
            np.multiply(h, draws[k] | np.uint32(1), out=scratch)
            np.bitwise_xor(scratch, draws[k + 1], out=scratch)
            # Upper bits take part in the order of the lower ones.
            np.multiply(scratch ^ (scratch >> np.uint32(15)), np.uint32(0x2C1B3C6D), out=scratch)
            key = mix(key ^ np.minimum.reduceat(scratch, begin).astype(np.uint64))
        out[full, band] = key
    return out


def sketches(texts: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Stored ``rid, doc_id, grams, same, bands``; ``same`` is equal for equal sets only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rid = pdf.rid.to_numpy()
            for first, group in chunks(pdf.text.tolist(), CHUNK):
                sets = gram_sets(group, n)
                sums = [(int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(s)))) if len(s) else (int(r), 0) for s, r in zip(sets, rid[first:], strict=False)]
                # The number of n-grams in front keeps empty sets, which are told apart by row, from all others.
                same = [len(s).to_bytes(4, "little") + a.to_bytes(8, "little") + x.to_bytes(8, "little") for s, (a, x) in zip(sets, sums, strict=True)]
                sig = signatures(sets, bands, rows).view(np.int64)
                cut = slice(first, first + len(group))
                yield pd.DataFrame(
                    {"rid": rid[cut], "doc_id": pdf.doc_id.iloc[cut].astype("Int64"), "grams": [len(s) for s in sets], "same": same, "bands": list(sig)}
                )

    rows_ = texts.select("rid", F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows_.mapInPandas(run, "rid long, doc_id long, grams long, same binary, bands array<long>"), "sketches")


def classes_of(sketch: DataFrame) -> DataFrame:
    """Stored classes of equal sets: ``same, rep, copies, grams, keep, bands``."""
    keep = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "rid")
    return stored(
        sketch.groupBy("same").agg(
            F.min("rid").alias("rep"), F.count("*").alias("copies"), F.first("grams").alias("grams"),
            F.min(keep).alias("keep"), F.first("bands").alias("bands"),
        ),
        "classes",
    )


def hub_members(classes: DataFrame) -> DataFrame:
    """Stored ``rid, hub``: the classes of every bucket of two and more, by the bucket's least."""
    entries = stored(
        classes.filter("grams > 0").select(F.col("rep").alias("rid"), F.posexplode("bands").alias("_b", "_v")).select("rid", F.xxhash64("_b", "_v").alias("bucket")),
        "entries",
    )
    buckets = entries.groupBy("bucket").agg(F.min("rid").alias("hub"), F.count("*").alias("_n")).filter("_n > 1")
    return stored(join_groups(entries, buckets, "bucket", "_n").select("rid", "hub").distinct(), "members")


def blocks(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Stored ``rid, copies, to``: where each class's set has to go, as ``hub, i, j, mine`` rows.

    A group of few n-grams is one block. A larger one is cut into blocks by hash, and every pair of
    blocks is a task of its own.
    """
    sizes = classes.select(F.col("rep").alias("rid"), "grams", "copies")
    rows = stored(members.join(sizes, "rid"), "sized")
    cuts = rows.groupBy("hub").agg(F.sum("grams").alias("_g"), F.count("*").alias("_n"))
    n = F.greatest(F.ceil(F.col("_g") / BLOCK_GRAMS), F.ceil(F.col("_n") / BLOCK_SETS)).cast("int")
    rows = join_groups(rows, cuts.select("hub", "_n", n.alias("_blocks")), "hub", "_n")
    mine = F.pmod(F.xxhash64("rid"), F.col("_blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("_blocks") - 1)
    to = F.transform(other, lambda o: F.struct(F.col("hub"), F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j"), mine.alias("mine")))
    # A class has at most one hub per band; its blocks are as many as its groups have.
    return stored(
        rows.select("rid", "copies", "hub", to.alias("to")).groupBy("rid").agg(
            F.first("copies").alias("copies"), F.sort_array(F.collect_list("hub")).alias("hubs"), F.flatten(F.collect_list("to")).alias("to")
        ),
        "blocks",
    )


def _linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of the threshold or more."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    if m == 2:
        both = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        shared = np.array([[size[0], both], [both, size[1]]])
    else:
        owner = np.repeat(np.arange(m), size)
        values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # N-grams of a single set meet nothing; those of all sets add one to every pair.
        everywhere = int(np.count_nonzero(times == m))
        use = (times[column] > 1) & (times[column] < m)
        shared = np.full((m, m), float(everywhere))
        if use.any():
            column, owner = np.unique(column[use], return_inverse=True)[1], owner[use]
            width = max(1, 4_000_000 // m)
            for lo in range(0, int(column.max()) + 1, width):
                part = (column >= lo) & (column < lo + width)
                grid = np.zeros((m, width if part.any() else 1), np.float32)
                grid[owner[part], column[part] - lo] = 1
                shared += grid @ grid.T
    union = size[:, None] + size[None, :] - shared
    hit = shared >= threshold * union - 1e-9
    np.fill_diagonal(hit, False)
    return hit


def _roots(hit: np.ndarray) -> np.ndarray:
    """Least member of each connected part."""
    label = np.arange(len(hit))
    reach = hit | np.eye(len(hit), dtype=bool)
    while True:
        new = np.where(reach, label[None, :], len(hit)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verify(group: list[tuple], hub: int, i: int, j: int, threshold: float) -> list[tuple[int, int, int]]:
    """``rid, root, links`` within one block pair of a hub's group.

    ``group`` has (rid, copies, hubs, block, set). Pairs that share a lesser hub are left to it.
    """
    hit = _linked([g[4] for g in group], threshold)
    if i != j:
        block = np.array([g[3] for g in group])
        hit &= block[:, None] != block[None, :]
    lesser = sorted({h for g in group for h in g[2] if h < hub})
    if lesser and hit.any():
        at = {h: k for k, h in enumerate(lesser)}
        met = np.zeros((len(group), len(lesser)), np.float32)
        for r, g in enumerate(group):
            met[r, [at[h] for h in g[2] if h < hub]] = 1
        hit &= (met @ met.T) == 0
    rows = np.flatnonzero(hit.any(axis=1))
    if not len(rows):
        return []
    copies = np.array([g[1] for g in group], np.int64)
    links = hit.astype(np.int64) @ copies
    root = _roots(hit)
    rid = [g[0] for g in group]
    return [(rid[r], rid[root[r]], int(links[r])) for r in rows.tolist()]


def verified(texts: DataFrame, to: DataFrame, n: int, threshold: float) -> DataFrame:
    """Stored ``rid, root, links`` of all linked classes, per hub and block pair."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, group in chunks(pdf.text.tolist(), CHUNK):
                out = []
                for k, s in enumerate(gram_sets(group, n)):
                    row = pdf.iloc[first + k]
                    data, hubs = s.tobytes(), list(row.hubs)
                    out += [(t["hub"], t["i"], t["j"], row.rid, row.copies, hubs, t["mine"], data) for t in row.to]
                yield pd.DataFrame(out, columns=["hub", "i", "j", "rid", "copies", "hubs", "mine", "grams"])

    sent = texts.join(to, "rid").select("rid", "text", "copies", "hubs", "to").mapInPandas(
        send, "hub long, i int, j int, rid long, copies long, hubs array<long>, mine int, grams binary"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, group, out = None, [], []
        for pdf in batches:
            for hub, i, j, rid, copies, hubs, mine, data in zip(pdf.hub, pdf.i, pdf.j, pdf.rid, pdf.copies, pdf.hubs, pdf.mine, pdf.grams, strict=True):
                if at != (hub, i, j):
                    if len(group) > 1:
                        out += verify(group, *at, threshold)
                    at, group = (hub, i, j), []
                group.append((rid, copies, hubs, mine, np.frombuffer(data, np.uint64)))
            yield pd.DataFrame(out, columns=["rid", "root", "links"]).astype("int64")
            out = []
        if len(group) > 1:
            yield pd.DataFrame(verify(group, *at, threshold), columns=["rid", "root", "links"]).astype("int64")

    dealt = sent.repartition(parallelism(texts.sparkSession), "hub", "i", "j").sortWithinPartitions("hub", "i", "j", "rid")
    return stored(dealt.mapInPandas(run, "rid long, root long, links long"), "links")


def linked_classes(texts: DataFrame, words: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The sketches, and stored ``same, copies, class_keep, links`` of all classes of equal sets."""
    bands, rows = plan_bands(threshold, recall)
    sketch = sketches(texts, words, bands, rows)
    classes = classes_of(sketch)
    found = verified(texts, blocks(hub_members(classes), classes), words, threshold)
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    linked = classes.select("same", "copies", "keep", F.col("rep").alias("rid")).join(links, "rid", "left")
    linked = linked.join(roots.withColumnRenamed("node", "rid"), "rid", "left").select(
        "same", "copies", "keep", F.coalesce("root", "rid").alias("root"), F.coalesce("links", F.lit(0)).alias("links")
    )
    linked = stored(linked, "linked")
    first = linked.groupBy("root").agg(F.min("keep").alias("class_keep"), F.count("*").alias("_n"))
    return sketch, stored(join_groups(linked, first, "root", "_n").drop("root", "_n", "keep"), "classes")


def jaccard_join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, n_links``.

    Rows are linked when the sets of their word n-grams have a Jaccard similarity of ``threshold`` or
    more; ``n_links`` counts a row's links, copies of its own set included. ``class_id`` is the least
    id among the rows reachable over links (null when all have none). Rows without words are alone.
    A link is missed with probability ``1 - recall`` at most; no false one is reported.
    """
    sketch, classes = linked_classes(stored_texts(docs), words, threshold, recall)
    rows = join_groups(sketch.select("doc_id", "same"), classes, "same", "copies")
    least = F.col("class_keep.id")
    return rows.select("doc_id", F.when(least < LAST, least).alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"))


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs``, one of each class: that with the least id. Rows without words stay."""
    texts = stored_texts(docs, all_columns=True)
    sketch, classes = linked_classes(texts, words, threshold, recall)
    stay = classes.select(F.col("class_keep.rid").alias("rid")).distinct()
    kept = texts.join(stay, "rid", "left_semi")
    return kept.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
