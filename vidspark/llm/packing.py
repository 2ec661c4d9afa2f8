"""Packing documents into sequences whose windows keep target token proportions.

Every source is a queue of tokens. Deficit round-robin serves the queues window by window: in each
window a queue gains its share of the window's tokens as credit, is served whole tokens, and
carries the rest of the credit, its deficit, to the next window. As credit grows linearly, the
tokens served to queue ``q`` before window ``w`` are ``floor(credit)``, a closed form; any task can
place any document without the windows before it. So deficits carry across tasks as well, and
nothing but token sums per source and task is gathered.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidspark.llm.common import stored, text_of
from vidspark.llm.tokens import encoder
from vidspark.plans.scale import maybe_broadcast

LENGTH = 2048
WINDOW_SEQUENCES = 256
MAX_TASKS = 16_384

TOKENS = "part int, doc_id long, source string, before long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source_queue int"


# Credit per weight is a whole number of 2 ** -BITS tokens.
BITS = 96


class Schedule:
    """Deficit round-robin over queues with ``totals`` tokens and integer ``weights``.

    Windows have ``window`` tokens to within one token per queue. When a queue runs dry its share
    goes to the others, in proportion, from the next window on; queues of weight 0 come last, in
    proportion to their tokens.

    The credit of a queue is its weight times a credit per weight that all queues of its round
    share, so queues run dry in the order of tokens per weight, and a phase between two such
    windows takes a few numbers however many queues there are.
    """

    def __init__(self, totals: list[int], weights: list[int], window: int):
        self.totals, self.window = totals, window
        self.round = [0 if w else 1 for w in weights]
        self.weights = [w or t for w, t in zip(weights, totals, strict=True)]
        # Phases: first window, round, credit per weight at its start, credit per weight and window.
        self.phases: list[tuple[int, int, int, int]] = []
        self.starts: list[int] = []
        self.ends: list[list[int]] = [[], []]
        self.of_round: list[list[int]] = [[], []]
        at = 0
        for part in (0, 1):
            needs = sorted((self._need(q, t), q) for q, t in enumerate(totals) if t and self.round[q] == part)
            whole, credit, n = sum(self.weights[q] for _, q in needs), 0, 0
            while n < len(needs):
                step = -(-(window << BITS) // whole)
                # Windows until the next queue is empty, rounded up.
                more = -(-(needs[n][0] - credit) // step)
                self.of_round[part].append(len(self.phases))
                self.phases.append((at, part, credit, step))
                self.starts.append(at)
                at += more
                credit += more * step
                self.ends[part].append(credit)
                while n < len(needs) and needs[n][0] <= credit:
                    whole -= self.weights[needs[n][1]]
                    n += 1
        self.windows = at
        self._cache: dict[int, tuple[list[int], list[int], list[int]]] = {}

    def _need(self, q: int, tokens: int) -> int:
        """Credit per weight at which queue ``q`` has been served ``tokens``."""
        return -(-(tokens << BITS) // self.weights[q])

    def _credit(self, w: int) -> tuple[int, int]:
        """Round before window ``w``, and its credit per weight."""
        if not self.phases:
            return 0, 0
        first, part, credit, step = self.phases[max(0, bisect_right(self.starts, w) - 1)]
        return part, credit + (min(w, self.windows) - first) * step

    def _served(self, q: int, part: int, credit: int) -> int:
        if self.round[q] != part:
            return self.totals[q] if self.round[q] < part else 0
        return min(self.totals[q], (self.weights[q] * credit) >> BITS)

    def served(self, q: int, w: int) -> int:
        """Tokens of queue ``q`` in the windows before ``w``."""
        return self._served(q, *self._credit(w))

    def deficit(self, q: int, w: int) -> float:
        """Credit in tokens that queue ``q`` carries into window ``w``."""
        part, credit = self._credit(w)
        return (self.weights[q] * credit / 2**BITS if self.round[q] == part else 0) - self.served(q, w)

    def window_of(self, q: int, token: int) -> int:
        """The window that serves a token of queue ``q``."""
        part, need = self.round[q], self._need(q, token + 1)
        first, _, credit, step = self.phases[self.of_round[part][bisect_left(self.ends[part], need)]]
        # The first count of windows whose credit exceeds the tokens before this one.
        return first + -(-(need - credit) // step) - 1

    def layout(self, w: int) -> tuple[list[int], list[int], list[int]]:
        """Of window ``w``: first token, end and place in the whole output, by queue."""
        if w not in self._cache:
            if len(self._cache) > 256:
                self._cache.clear()
            now, then = self._credit(w), self._credit(w + 1)
            begin = [self._served(q, *now) for q in range(len(self.totals))]
            end = [self._served(q, *then) for q in range(len(self.totals))]
            place, at = [], sum(begin)
            for b, e in zip(begin, end, strict=True):
                place.append(at)
                at += e - b
            self._cache[w] = begin, end, place
        return self._cache[w]

    def pieces(self, q: int, token: int, n: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """``(start, length, sequence, offset)`` of a document at ``token`` of queue ``q``."""
        at = token
        while at < token + n:
            begin, end, place = self.layout(self.window_of(q, at))
            stop = min(token + n, end[q])
            here = place[q] + at - begin[q]
            while at < stop:
                take = min(stop - at, length - here % length)
                yield at - token, take, here // length, here % length
                at += take
                here += take


def tokenised(docs: DataFrame, path: str, eos: int) -> DataFrame:
    """Stored ``part, doc_id, source, before, n, ids``; ``before`` counts within task and source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, encode, seen = TaskContext.get().partitionId(), encoder(path), {}
        for pdf in batches:
            before, n, ids = [], [], []
            for s, text in zip(pdf.source, pdf.text, strict=True):
                e = encode(text)
                e = np.append(e, np.uint32(eos)).astype("<u2" if eos < 65536 and (not len(e) or e.max() < 65536) else "<u4")
                # The first byte tells the width.
                ids.append(bytes([e.itemsize]) + e.tobytes())
                n.append(len(e))
                before.append(seen.get(s, 0))
                seen[s] = before[-1] + len(e)
            yield pd.DataFrame({"part": part, "doc_id": pdf.doc_id.astype("Int64"), "source": pdf.source, "before": before, "n": n, "ids": ids})

    source = F.coalesce(docs["source"].cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), source.alias("source"))
    return stored(rows.coalesce(MAX_TASKS).mapInPandas(run, TOKENS), "tokens")


def pack(
    docs: DataFrame,
    path: str,
    mixture: Mapping[str, int] | None = None,
    length: int = LENGTH,
    window_sequences: int = WINDOW_SEQUENCES,
    eos: int = 1,
) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` tokens; only the last one may be short.

    ``mixture`` gives integer weights per source; sources it does not name come last. Without it
    the weights are the sources' tokens, so that every window looks like the whole. Each source is a
    queue: those of the mixture in its order, then the others by tokens, most first. A document's
    ids end with ``eos``; null text is empty, so each row has a token at least. Null ids and
    sources, and repeated rows, are rows like any other.
    """
    spark = docs.sparkSession
    tokens = tokenised(docs, path, eos)
    sums = stored(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "sums")
    total = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    named = dict.fromkeys(mixture or ())
    names = [*named, *sorted((s for s in total if s not in named), key=lambda s: (-total[s], s))]
    totals = [total.get(s, 0) for s in names]
    weights = totals if mixture is None else [int(mixture.get(s, 0)) for s in names]
    number = {s: q for q, s in enumerate(names)}
    schedule = spark.sparkContext.broadcast((number, Schedule(totals, weights, length * window_sequences)))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(maybe_broadcast(starts), ["source", "part"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue, plan = schedule.value
        for pdf in batches:
            out = []
            for doc, s, base, before, n, ids in zip(pdf.doc_id, pdf.source, pdf.base, pdf.before, pdf.n, pdf.ids, strict=True):
                e = np.frombuffer(ids, f"<u{ids[0]}", offset=1).astype("<u4")
                doc, q = None if pd.isna(doc) else int(doc), queue[s]
                for at, size, seq, offset in plan.pieces(q, int(base) + int(before), int(n), length):
                    out.append((doc, at, size, zlib.crc32(e[at : at + size]), n, seq, offset, q))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
            yield frame.astype({"doc_id": "Int64"})

    return placed.select("doc_id", "source", "base", "before", "n", "ids").mapInPandas(run, PIECES)
