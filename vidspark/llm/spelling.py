"""Spelling variants: words one edit apart, found by probing edits against Bloom filters.

The vocabulary is counted with column expressions and stored. Its words go into blocked Bloom
filters, one shard per length. A task generates the hashes of all one-letter deletions and
replacements of its words at once, from running sums over the letters, and probes them; an insertion
is a deletion seen from the other word. Only positives become strings and are shuffled, to a join
with the vocabulary, which removes what the filters let through by mistake. Filters have no false
negatives, so no link is lost.

Filters are broadcast in rounds of at most ``FILTER_BYTES``: a vocabulary of any size is probed, in
more rounds, and a length too large for one round is cut into parts by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidspark.llm.common import join_groups, parallelism, stored, text_of
from vidspark.llm.kernels import mix
from vidspark.llm.urls import LOWER, UPPER

MIN_LENGTH, MIN_COUNT, TIMES = 6, 5, 5
# Letters of words, and every which misspelt run loses a letter.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
DROP_EVERY = 199
# Bytes of filters given to every executor at once.
FILTER_BYTES = 64 << 20
# A block is eight words of 32 bits; a key sets one bit in each.
BITS_PER_KEY = 16
BLOCK_BITS = 256
# Letters, of one word or of several, whose edits are hashed at once.
SLICE = 2048

_ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint32)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)


def occurrences(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``word``: each run of letters of at least ``min_length`` code points, as it is read.

    Runs are maximal and A-Z is lower-cased. Where ``DROP_EVERY`` divides the CRC-32 of the
    document's id, a colon and the run, its letter at that number modulo its length is left out.
    A null id counts as an empty one.
    """
    # Shorter runs cannot give a word; a run is matched whole, from its first letter on.
    runs = F.regexp_extract_all(text_of(docs), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    doc = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    rows = docs.select(doc.alias("doc"), F.explode(runs).alias("run"))
    rows = rows.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat_ws(":", "doc", "run").cast("binary"))
    rows = rows.select("run", h.alias("h"))
    word = F.when(F.col("h") % DROP_EVERY == 0, without(F.col("run"), F.col("h") % F.length("run"))).otherwise(F.col("run"))
    return rows.select(word.alias("word")).filter(F.length("word") >= min_length)


def without(word: Column, at: Column) -> Column:
    """``word`` less its code point ``at``, counted from 0."""
    return F.concat(F.substr(word, F.lit(1), at.cast("int")), F.substr(word, (at + 2).cast("int")))


def vocabulary_of(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """Stored ``word, n, size`` of the words with ``min_count`` occurrences over all documents."""
    words = occurrences(docs, min_length).groupBy("word").agg(F.count("*").alias("n"))
    return stored(words.filter(F.col("n") >= min_count).select("word", "n", F.length("word").alias("size")), "words")


def _codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)


def _values(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(1))


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def plain_hash(words: list[str]) -> np.ndarray:
    """Hashes of words of one length: their letters' values times powers of their place, mixed."""
    codes = np.stack([_codes(w) for w in words])
    return mix((_values(codes) * _powers(codes.shape[1], _BASE)).sum(axis=1, dtype=np.uint64))


class Edits:
    """Deletions and replacements of words of one length, as hashes first and as strings when asked for."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes = np.stack([_codes(w) for w in words])
        self.size = self.codes.shape[1]
        self.power = _powers(self.size, _BASE)
        self.terms = _values(self.codes) * self.power
        self.before = np.zeros((len(words), self.size + 1), np.uint64)
        np.cumsum(self.terms, axis=1, out=self.before[:, 1:])

    def deletions(self) -> np.ndarray:
        """Hashes by word and place."""
        # Letters behind the gap move down one place.
        behind = (self.before[:, -1:] - self.before[:, 1:]) * np.uint64(_INVERSE)
        return mix(self.before[:, :-1] + behind)

    def replacements(self, start: int, stop: int) -> np.ndarray:
        """Hashes by word, place from ``start`` to ``stop``, and letter of the alphabet."""
        rest = self.before[:, -1:] - self.terms[:, start:stop]
        return mix(rest[:, :, None] + _values(_ALPHABET) * self.power[start:stop, None])

    def without(self, word: int, at: int) -> str:
        w = self.words[word]
        return w[:at] + w[at + 1 :]

    def replaced(self, word: int, at: int, letter: int) -> str:
        w = self.words[word]
        return w[:at] + chr(_ALPHABET[letter]) + w[at + 1 :]


@dataclass(frozen=True)
class Shard:
    """The filter of the words of one length, or of one part of them by hash."""

    size: int
    part: int
    parts: int
    blocks: int


def plan_shards(counts: dict[int, int], limit: int = FILTER_BYTES) -> list[list[Shard]]:
    """Rounds of shards of at most ``limit`` bytes each, from the number of words by length."""
    rounds: list[list[Shard]] = []
    room = 0
    for size, n in sorted(counts.items()):
        total = max(1, -(-n * BITS_PER_KEY // BLOCK_BITS)) * BLOCK_BITS // 8
        parts = max(1, -(-total // max(limit, BLOCK_BITS // 8)))
        blocks = max(1, -(-n * BITS_PER_KEY // (BLOCK_BITS * parts)))
        for part in range(parts):
            need = blocks * BLOCK_BITS // 8
            if need > room:
                rounds.append([])
                room = max(limit, need)
            rounds[-1].append(Shard(size, part, parts, blocks))
            room -= need
    return rounds


def _place(hashes: np.ndarray, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """Part and block of each hash. Both come from its upper half, the bits from its lower one."""
    upper = hashes >> np.uint64(32)
    return (upper % np.uint64(shard.parts)).astype(np.int64), ((upper // np.uint64(shard.parts)) % np.uint64(shard.blocks)).astype(np.int64)


def _bit(hashes: np.ndarray, word: int) -> np.ndarray:
    lower = hashes.astype(np.uint32)
    return np.uint32(1) << ((lower * _SALTS[word]) >> np.uint32(27))


class Filters:
    """The filters of one round, as 32-bit words."""

    def __init__(self, blocks: dict[Shard, np.ndarray]):
        self.by_size: dict[int, list[tuple[Shard, np.ndarray]]] = {}
        for shard, cells in blocks.items():
            self.by_size.setdefault(shard.size, []).append((shard, cells))

    def holds(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Indices of the hashes that the filters of this length may hold."""
        found = []
        for shard, cells in self.by_size.get(size, ()):
            part, block = _place(hashes, shard)
            at = np.flatnonzero(part == shard.part)
            for word in range(8):
                at = at[cells[block[at], word] & _bit(hashes[at], word) > 0]
            found.append(at)
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def build_filters(words: DataFrame, shards: list[Shard]) -> Filters:
    """Filters of a round: bits are set in tasks and joined by block; a round's bytes are collected."""
    plan: dict[int, dict[int, Shard]] = {}
    for s in shards:
        plan.setdefault(s.size, {})[s.part] = s
    cols = [f"w{i}" for i in range(8)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, group in pdf.groupby("size"):
                names, step = group["word"].tolist(), max(1, 90 * SLICE // int(size))
                hashes = np.concatenate([plain_hash(names[at : at + step]) for at in range(0, len(names), step)])
                parts = plan[int(size)]
                part, block = _place(hashes, next(iter(parts.values())))
                mine = np.isin(part, list(parts))
                cells = {n: _bit(hashes[mine], i).view(np.int32) for i, n in enumerate(cols)}
                yield pd.DataFrame({"size": int(size), "part": part[mine], "block": block[mine], **cells})

    some = words.filter(F.col("size").isin(list(plan)))
    rows = some.select("word", "size").mapInPandas(run, "size int, part int, block long, " + ", ".join(f"{n} int" for n in cols))
    rows = rows.groupBy("size", "part", "block").agg(*[F.bit_or(n).alias(n) for n in cols]).toPandas()
    out = {s: np.zeros((s.blocks, 8), np.uint32) for s in shards}
    for (size, part), group in rows.groupby(["size", "part"]):
        out[plan[int(size)][int(part)]][group["block"]] = group[cols].to_numpy(np.int32).view(np.uint32)
    return Filters(out)


def _hits(held: Filters, edits: Edits) -> Iterator[tuple[int, str]]:
    """Number of a word and an edit of it that the filters may hold."""
    size, codes = edits.size, edits.codes
    if size - 1 in held.by_size:
        # Leaving out either of two equal letters gives one word.
        fresh = np.concatenate([np.ones((len(codes), 1), bool), codes[:, 1:] != codes[:, :-1]], axis=1)
        word, at = np.nonzero(fresh)
        for i in held.holds(edits.deletions()[fresh], size - 1):
            yield int(word[i]), edits.without(int(word[i]), int(at[i]))
    for start in range(0, size, SLICE) if size in held.by_size else ():
        # Of two words that differ in one letter, one has the larger: the pair is met once.
        larger = _ALPHABET > codes[:, start : start + SLICE, None]
        word, at, letter = np.nonzero(larger)
        for i in held.holds(edits.replacements(start, min(size, start + SLICE))[larger], size):
            yield int(word[i]), edits.replaced(int(word[i]), start + int(at[i]), int(letter[i]))


def positives(words: DataFrame, filters: Filters, sizes: list[int]) -> DataFrame:
    """``word, n, other``: edits of ``words`` that the filters may hold."""
    model = words.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = model.value
        for pdf in batches:
            for size, group in pdf.groupby("size"):
                step = max(1, SLICE // int(size))
                for at in range(0, len(group), step):
                    some = group.iloc[at : at + step]
                    names, counts = some["word"].tolist(), some["n"].tolist()
                    out = [(names[i], counts[i], other) for i, other in _hits(held, Edits(names))]
                    yield pd.DataFrame(out, columns=["word", "n", "other"])

    near = [s for size in sizes for s in (size, size + 1)]
    # The vocabulary is small on disk and each word takes a thousand probes: spread by word.
    some = words.filter(F.col("size").isin(near)).repartition(parallelism(words.sparkSession), "word")
    return some.mapInPandas(run, "word string, n long, other string")


def near_words(words: DataFrame, limit: int = FILTER_BYTES) -> DataFrame:
    """``word, n, other, other_n``: both directions of every pair of ``words`` one edit apart."""
    counts = {r["size"]: r["count"] for r in words.groupBy("size").count().collect()}
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = None
    for shards in plan_shards(counts, limit):
        found = positives(words, build_filters(words, shards), sorted({s.size for s in shards}))
        found = stored(found.join(known, "other").select("word", "n", "other", "other_n"), "near")
        pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    ends = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return pairs.select(F.explode(ends).alias("e")).select("e.*")


def roots(forms: DataFrame) -> DataFrame:
    """Stored ``word, root`` of ``forms(word, form)``: where following forms ends.

    A form has several times its word's count, so paths end, within some thirty steps; each round
    doubles how far a word looks.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        size = now.groupBy("root").agg(F.count("*").alias("_n"))
        further = join_groups(now, step.join(size, "root"), "root", "_n")
        if further.isEmpty():
            return now
        moved = further.select("word", F.col("next").alias("root"))
        now = stored(moved.unionByName(now.join(moved.select("word"), "word", "left_anti")), "roots")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = TIMES, limit: int = FILTER_BYTES) -> DataFrame:
    """One row per word of ``docs`` with ``form, root, n, n_near, form_n``.

    A word's form is its near word with the largest count, the first in code-point order on ties, if
    that is ``times`` its own; its root is the last form of the chain, or the word itself. Null and
    empty texts have no words; repeated rows count as often as they come, null ids as empty ones;
    further columns are not read. An empty table has no words. Letters other than A-Z keep their case.
    """
    words = vocabulary_of(docs, min_length, min_count)
    links = near_words(words, limit)
    first = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("word")))
    best = links.groupBy("word", "n").agg(F.count("*").alias("n_near"), first.alias("best"))
    large = -F.col("best.m") >= times * F.col("n")
    best = stored(best.select("word", "n_near", F.when(large, F.col("best.word")).alias("form"), F.when(large, -F.col("best.m")).alias("form_n")), "forms")
    ends = roots(best.filter(F.col("form").isNotNull()))
    rows = words.join(best, "word", "left").join(ends, "word", "left")
    return rows.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.col("form_n").cast("long").alias("form_n"),
    )
