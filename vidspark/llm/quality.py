"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal.

Features are word unigrams and bigrams, and n-grams of word shapes (runs of letters and digits
folded, signs kept), hashed to ``2**BITS`` places; a text's vector has length-normalised counts.
Training runs in rounds over a fixed number of shards dealt by a hash of the id: each shard
continues the follow-the-regularised-leader state of the last round over its rows, one by one, and
the states are averaged. Results do not depend on how many executors there are. Texts are scored as
sparse dot products with the weights, in a map over rows.
"""

from __future__ import annotations

from collections.abc import Iterator


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidspark.llm.common import bucketed, map_rows, stored, text_of
from vidspark.llm.kernels import Words, chunks, grams

BITS = 18
SHARDS = 8
ROUNDS = 4
# Bound of the labelled sample: the labels with the smallest hashes of their ids.
MAX_LABELLED = 40_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null ids belong to no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams of a group of texts, and where each text's places begin."""
    w = Words(texts, lower=True)
    kinds = []
    word = w.hashes()
    shape = Words(texts).shapes()
    for values, lengths, salt in ((word, (1, 2), 1), (shape, (1, 2, 3), 7)):
        for n in lengths:
            kinds.append((grams(values, n) + np.uint64(salt * 1_000_003 * n), n))
    doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
    place, owner = [], []
    for g, n in kinds:
        if not len(g):
            continue
        same = doc[n - 1 :] == doc[: len(doc) - n + 1]
        place.append((_spread(g[same]) & np.uint64((1 << BITS) - 1)).astype(np.int32))
        owner.append(doc[: len(doc) - n + 1][same])
    if not place:
        return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    place, owner = np.concatenate(place), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return place[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))


def _spread(x: np.ndarray) -> np.ndarray:
    return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)


def vectors(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct places and values (counts over the number of n-grams, times 10) of each text."""
    for _, group in chunks(texts):
        place, at = features(group)
        for i in range(len(group)):
            p, n = np.unique(place[at[i] : at[i + 1]], return_counts=True)
            yield p.astype(np.int32), (10.0 * n / max(1, at[i + 1] - at[i])).astype(np.float32)


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The closed-form minimiser of the regularised leader."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(rows, z: np.ndarray, n: np.ndarray) -> None:
    """Follow the regularised leader over ``rows`` of (label, weight, places, values), in place."""
    for y, cost, p, v in rows:
        zp, np_ = z[p], n[p]
        w = weights_of(zp, np_)
        s = 1.0 / (1.0 + np.exp(-np.clip(float(w @ v), -35, 35)))
        g = cost * (s - y) * v
        step = (np.sqrt(np_ + g * g) - np.sqrt(np_)) / ALPHA
        z[p] = zp + g - step * w
        n[p] = np_ + g * g


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> np.ndarray:
    """Weights from the labelled rows outside fold 1; both labels weigh the same, so 0.5 is the cut.

    At most ``max_labelled`` labels are used, those whose ids have the smallest hashes. Labels
    without id or value are left out; without any label all weights are 0.
    """
    spark = docs.sparkSession
    order = F.xxhash64("doc_id", F.lit(3))
    chosen = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("doc_id")) != 1))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .withColumn("ord", order).orderBy("ord", "doc_id").limit(max_labelled)
    )
    chosen = stored(chosen, "labels")
    counts = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    # Both labels weigh the same in the loss.
    cost = {y: total / (len(counts) * n) for y, n in counts.items()}
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    # The sample is bounded, so it may be sent to every task.
    rows = rows.join(F.broadcast(chosen), "doc_id")

    def make():
        def work(texts):
            both = list(vectors(texts))
            return [[p.tobytes() for p, _ in both], [v.tobytes() for _, v in both]]

        return work

    made = map_rows(rows, [rows["text"]], make, "places binary, vals binary", drop=("text",))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int")
    # Dealt once: the rounds read their shards from the buckets and shuffle nothing.
    made = bucketed(made.withColumn("shard", shard), SHARDS, "shard", "features")
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(ROUNDS if total else 0):
        state = spark.sparkContext.broadcast((z, n))

        # A shard is a fixed share of the bounded sample; one row of fixed size comes back from each.
        back = made.groupBy("shard").applyInPandas(_turn(state, cost), "shard int, z binary, n binary").orderBy("shard").collect()
        if not back:
            break
        z = np.mean([np.frombuffer(r["z"]) for r in back], axis=0)
        n = np.mean([np.frombuffer(r["n"]) for r in back], axis=0)
        state.unpersist()
    return weights_of(z, n).astype(np.float32)


def _turn(state, cost: dict[int, float]):
    """One round of a shard, from the shared state, in the order of the sample."""

    def turn(key, pdf):
        own = [x.copy() for x in state.value]
        pdf = pdf.sort_values(["ord", "doc_id", "places"])
        rows = zip(pdf.y, pdf.places, pdf.vals, strict=True)
        ftrl(((y, cost[y], np.frombuffer(p, np.int32), np.frombuffer(v, np.float32)) for y, p, v in rows), *own)
        return pd.DataFrame({"shard": key, "z": [own[0].tobytes()], "n": [own[1].tobytes()]})

    return turn


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with ``score`` in 0..1 and ``predicted``; a map over rows, empty texts score too."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        w = shared.value

        def work(texts):
            out = []
            for _, group in chunks(texts):
                place, at = features(group)
                sums = np.concatenate(([0.0], np.cumsum(w[place], dtype=np.float64)))
                dot = 10.0 * (sums[at[1:]] - sums[at[:-1]]) / np.maximum(1, np.diff(at))
                out.append(1.0 / (1.0 + np.exp(-np.clip(dot, -35, 35))))
            s = np.concatenate(out) if out else np.empty(0)
            return [s, (s >= 0.5).astype(np.int32)]

        return work

    return map_rows(docs, [text_of(docs)], make, "score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    out = score(ids, train(docs, labels))
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
