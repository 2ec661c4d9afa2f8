"""Token-id files: concatenated ids, document boundaries as Elias-Fano sequences.

A file holds consecutive documents in ascending order of id: a head of text, the ids in two or four
bytes each, the boundaries, the document ids, and an end mark. Boundaries and document ids grow, so
each is kept as low bits of fixed width and high bits in unary, within about two bits and the low
width per entry; every 256th one bit of the unary part is noted in 32 bits, and a select reads from
the nearest note. Files do not know what lies before them: an index beside them has their sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidspark.llm.common import parallelism, text_of
from vidspark.llm.tokens import encoder
from vidspark.plans.scale import fresh_path, maybe_broadcast

# Ids of one file; a longer document has a file of its own.
FILE_TOKENS = 8 << 20
NOTED = 256
HEAD_BYTES = 256
MARK, END = "EFTOKENS1", "EFTOKENSEND\n"
FIELDS = ("part", "block", "docs", "nulls", "tokens", "width", "first_id", "ids_at", "bounds_at", "keys_at", "end")
# Documents decoded at once while a file is read through.
RUN = 4096


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers, read in place from a buffer."""

    def __init__(self, buffer):
        self.n, self.width, self.bits, notes = (int(v) for v in np.frombuffer(buffer, "<u8", 4))
        at = 32
        self.notes = np.frombuffer(buffer, "<u4", notes, at)
        at += 4 * notes
        self.high = np.frombuffer(buffer, np.uint8, -(-self.bits // 8), at)
        at += len(self.high)
        self.low = np.frombuffer(buffer, np.uint8, -(-self.n * self.width // 8), at)

    def __len__(self) -> int:
        return self.n

    def span(self, first: int, last: int) -> np.ndarray:
        """Entries ``first`` to ``last``, end exclusive: selects from the nearest note on."""
        if first >= last:
            return np.zeros(0, np.uint64)
        note = first // NOTED
        until = (last - 1) // NOTED + 1
        start = int(self.notes[note])
        stop = int(self.notes[until]) if until < len(self.notes) else self.bits
        byte = start // 8
        ones = np.flatnonzero(np.unpackbits(self.high[byte : -(-stop // 8)], bitorder="little")) + 8 * byte
        ones = ones[ones >= start][first - note * NOTED :][: last - first]
        high = (ones - np.arange(first, last)).astype(np.uint64)
        if not self.width:
            return high
        begin = first * self.width
        cells = np.unpackbits(self.low[begin // 8 : -(-last * self.width // 8)], bitorder="little")
        cells = cells[begin % 8 :][: (last - first) * self.width].reshape(-1, self.width)
        low = np.zeros(last - first, np.uint64)
        for bit in range(self.width):
            low |= cells[:, bit].astype(np.uint64) << np.uint64(bit)
        return (high << np.uint64(self.width)) | low

    def __getitem__(self, i: int) -> int:
        return int(self.span(i, i + 1)[0])

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        v = np.asarray(values, np.uint64)
        n = len(v)
        width = max(0, ((int(v[-1]) + 1) // n).bit_length() - 1) if n else 0
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = int(ones[-1]) + 1 if n else 0
        unary = np.zeros(bits, np.uint8)
        unary[ones] = 1
        cells = np.empty((n, width), np.uint8)
        for bit in range(width):
            cells[:, bit] = (v >> np.uint64(bit)) & np.uint64(1)
        notes = ones[::NOTED].astype("<u4")
        parts = [np.array([n, width, bits, len(notes)], "<u8"), notes, np.packbits(unary, bitorder="little"), np.packbits(cells.ravel(), bitorder="little")]
        return b"".join(p.tobytes() for p in parts)


class TokenFile:
    """One file, given as bytes or a memory map; nothing is copied until it is asked for."""

    def __init__(self, data):
        view = memoryview(data)
        head = bytes(view[:HEAD_BYTES]).decode("ascii").split()
        if head[0] != MARK or len(view) < int(head[len(FIELDS)]) + len(END):
            raise ValueError("not a whole token file")
        self.head = dict(zip(FIELDS, map(int, head[1:]), strict=True))
        h = self.head
        self.ids = np.frombuffer(view, f"<u{h['width']}", h["tokens"], h["ids_at"])
        self.bounds = EliasFano(view[h["bounds_at"] : h["keys_at"]])
        self.keys = EliasFano(view[h["keys_at"] : h["end"]])

    def __len__(self) -> int:
        return self.head["docs"]

    def document(self, i: int) -> np.ndarray:
        """Ids of the ``i``-th document."""
        start, stop = (int(v) for v in self.bounds.span(i, i + 2))
        return self.ids[start:stop]

    def doc_id(self, i: int) -> int | None:
        nulls = self.head["nulls"]
        return None if i < nulls else self.keys[i - nulls] + self.head["first_id"]

    def find(self, doc_id: int) -> int | None:
        """Place of the first document with this id, by bisection over selects."""
        low, high = self.head["nulls"], len(self)
        while low < high:
            mid = (low + high) // 2
            if self.doc_id(mid) < doc_id:
                low = mid + 1
            else:
                high = mid
        return low if low < len(self) and self.doc_id(low) == doc_id else None

    def runs(self) -> Iterator[tuple[list, np.ndarray]]:
        """Document ids and boundaries (one more) of consecutive documents."""
        nulls, first = self.head["nulls"], self.head["first_id"]
        for at in range(0, len(self), RUN):
            to = min(len(self), at + RUN)
            known = self.keys.span(max(0, at - nulls), max(0, to - nulls)).tolist()
            names = [None] * (to - at - len(known)) + [k + first for k in known]
            yield names, self.bounds.span(at, to + 1).astype(np.int64)


def to_file(part: int, block: int, doc_ids: list, pieces: list[np.ndarray]) -> bytes:
    """The bytes of a file but for its end mark. Null ids come first."""
    bounds = np.cumsum([0, *map(len, pieces)])
    wide = any(len(p) and p.max() > 0xFFFF for p in pieces)
    ids = np.concatenate(pieces).astype("<u4" if wide else "<u2").tobytes()
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    keys = EliasFano.encode(np.array([d - first for d in known], np.uint64))
    edges = EliasFano.encode(bounds)
    bounds_at = HEAD_BYTES + len(ids)
    keys_at = bounds_at + len(edges)
    values = (part, block, len(doc_ids), len(doc_ids) - len(known), int(bounds[-1]), 4 if wide else 2, first, HEAD_BYTES, bounds_at, keys_at, keys_at + len(keys))
    head = " ".join([MARK, *map(str, values)]).ljust(HEAD_BYTES).encode("ascii")
    return b"".join([head, ids, edges, keys])


def write_tokens(docs: DataFrame, path: str, out: str | None = None, eos: int = 0, file_tokens: int = FILE_TOKENS) -> str:
    """Ids of all texts of ``docs`` as files in ascending order of ``doc_id``; the folder they are in.

    Ids are those of the vocabulary at ``path``, and ``eos`` ends each document, so null and empty
    texts have one id. Rows with a null ``doc_id`` come first, rows with equal ones in the order of
    the input, which should be a stored table; further columns are not read. An empty table gives a folder without documents. Files
    are committed by Spark's writer; a lost executor leaves nothing half-written behind.
    """
    spark = docs.sparkSession
    out = out or fresh_path(spark, "token_files")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), text_of(docs).alias("text"))

    def blocks(batches):
        from pyspark import TaskContext

        part, block, encode = TaskContext.get().partitionId(), 0, encoder(path)
        doc_ids, pieces, size = [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([to_file(part, block, doc_ids, pieces)], pa.binary())], ["file"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(eos))
                if ids.max() <= 0xFFFF:
                    ids = ids.astype(np.uint16)
                if pieces and size + len(ids) > file_tokens:
                    yield row()
                    doc_ids, pieces, size, block = [], [], 0, block + 1
                doc_ids.append(doc)
                pieces.append(ids)
                size += len(ids)
        if pieces:
            yield row()

    # The row number parts rows of one id, so that they can go to several files.
    ordered = rows.repartitionByRange(parallelism(spark), "doc_id", "rid").sortWithinPartitions("doc_id", "rid")
    files = ordered.select("doc_id", "text").mapInArrow(blocks, "file binary")
    # Strings of Spark are plain bytes to its text writer: each row becomes a file, followed by the mark.
    writer = files.select(F.col("file").cast("string").alias("value")).write
    writer.option("lineSep", END).option("maxRecordsPerFile", 1).option("compression", "none").text(f"{out}/ids")
    index_files(spark, out).write.parquet(f"{out}/index")
    return out


def _files(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{out}/ids").filter(F.col("length") > 0)


def index_files(spark: SparkSession, out: str) -> DataFrame:
    """``part, block, docs, tokens, start``: one row per file, from the heads."""
    head = F.split(F.substring("content", 1, HEAD_BYTES).cast("string"), " ")
    cells = [head[i + 1].cast("long").alias(name) for i, name in enumerate(FIELDS) if name in ("part", "block", "docs", "tokens")]
    before = Window.orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("tokens").over(before), F.lit(0))
    return _files(spark, out).select(*cells).withColumn("start", start)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of each document in the files; ids in four bytes each."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                file = TokenFile(content.as_buffer())
                for names, bounds in file.runs():
                    ids = [file.ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    cells = [
                        pa.array([file.head["part"]] * len(names), pa.int64()), pa.array([file.head["block"]] * len(names), pa.int64()),
                        pa.array(names, pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(ids, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(cells, ["part", "block", "doc_id", "at", "n_tokens", "ids"])

    rows = _files(spark, out).select("content").mapInArrow(run, "part long, block long, doc_id long, at long, n_tokens long, ids binary")
    index = spark.read.schema("part long, block long, docs long, tokens long, start long").parquet(f"{out}/index")
    starts = index.select("part", "block", "start")
    placed = rows.join(maybe_broadcast(starts), ["part", "block"])
    return placed.select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids")


def token_files(docs: DataFrame, path: str) -> DataFrame:
    """Writes the files of ``docs`` and reads them back, with a digest of each document's ids."""
    rows = read_tokens(docs.sparkSession, write_tokens(docs, path))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
