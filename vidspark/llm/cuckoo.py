"""Exact dedup with a cuckoo-filter index over live digests.

The index is a folder of Parquet tables in one version each:

* ``members``: ``shard, digest, doc_id``, one row per live document;
* ``keys``: ``shard, digest, keep_id, group_size``, the content that filter hits are checked with;
* ``filters``: ``shard, buckets, slots``, one cuckoo filter per shard.

Digests are dealt to shards of a bounded number of keys. A task holds the filters and the keys of
its shards only. Copies are added up before they travel, so that a text with a third of all rows
sends at most ``SALTS`` rows to its shard.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.llm.common import join_groups, stored, stored_texts, text_of
from vidspark.plans.scale import fresh_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLOTS = 4
KICKS = 200
SHARD_KEYS = 250_000
SALTS = 16

KEYS = "shard int, digest binary, keep_id long, group_size long"
FILTERS = "shard int, buckets long, slots binary"
# One stream of rows per shard: its filter, its keys, then deletions, then insertions.
FILTER, KEY, DELETE, INSERT = range(4)


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four, each in one of two buckets.

    ``add`` answers False when no place is found after ``KICKS`` moves; the filter then lacks one
    fingerprint and must be built anew, larger, from the stored keys.
    """

    def __init__(self, buckets: int = 64, slots: bytes | None = None):
        self.mask = buckets - 1
        self.slots = array("H", slots if slots is not None else bytes(2 * SLOTS * buckets))

    def places(self, digest: bytes) -> tuple[int, int, int]:
        h = int.from_bytes(digest[:8], "little")
        mark = (h >> 48) or 1
        first = h & self.mask
        return mark, first, first ^ (mark * 0x5BD1E995 & self.mask)

    def _find(self, mark: int, bucket: int) -> int:
        at = bucket * SLOTS
        for k in range(at, at + SLOTS):
            if self.slots[k] == mark:
                return k
        return -1

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        return self._find(mark, a) >= 0 or self._find(mark, b) >= 0

    def add(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        for bucket in (a, b):
            k = self._find(0, bucket)
            if k >= 0:
                self.slots[k] = mark
                return True
        bucket = b
        for turn in range(KICKS):
            k = bucket * SLOTS + turn % SLOTS
            mark, self.slots[k] = self.slots[k], mark
            bucket ^= mark * 0x5BD1E995 & self.mask
            k = self._find(0, bucket)
            if k >= 0:
                self.slots[k] = mark
                return True
        return False

    def remove(self, digest: bytes) -> bool:
        """Take out one fingerprint of a digest that is known to be in the filter."""
        mark, a, b = self.places(digest)
        for bucket in (a, b):
            k = self._find(mark, bucket)
            if k >= 0:
                self.slots[k] = 0
                return True
        return False


class Shard:
    """A filter and the keys behind it: digest -> [doc_id that stays, number of documents]."""

    def __init__(self):
        self.filter = CuckooFilter()
        self.keys: dict[bytes, list] = {}

    def insert(self, digest: bytes, keep, size: int) -> None:
        if digest in self.filter:
            # A hit may be another digest with the same fingerprint; the stored content decides.
            have = self.keys.get(digest)
            if have is not None:
                have[0] = keep if have[0] is None else have[0] if keep is None else max(have[0], keep)
                have[1] += size
                return
        self.keys[digest] = [keep, size]
        if not self.filter.add(digest):
            self.resize()

    def resize(self) -> None:
        buckets = self.filter.mask + 1
        while True:
            buckets *= 2
            self.filter = CuckooFilter(buckets)
            if all(self.filter.add(d) for d in self.keys):
                return

    def delete(self, digest: bytes) -> None:
        if digest in self.filter and self.keys.pop(digest, None) is not None:
            self.filter.remove(digest)


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by shard and kind -> the new keys, then the new filter, of each shard."""
    number, shard = None, Shard()
    for pdf in batches:
        rows = zip(pdf.shard, pdf.kind, pdf.digest, pdf.keep_id, pdf.group_size, pdf.buckets, strict=True)
        for at, kind, digest, keep, size, buckets in rows:
            if at != number:
                if number is not None:
                    yield from _emit(number, shard)
                number, shard = at, Shard()
            keep = None if pd.isna(keep) else int(keep)
            if kind == INSERT:
                shard.insert(digest, keep, int(size))
            elif kind == DELETE:
                shard.delete(digest)
            elif kind == KEY:
                shard.keys[digest] = [keep, int(size)]
            else:
                shard.filter = CuckooFilter(int(buckets), digest)
    if number is not None:
        yield from _emit(number, shard)


def _emit(number: int, shard: Shard, step: int = 50_000) -> Iterator[pd.DataFrame]:
    keys = list(shard.keys)
    cols = ["shard", "kind", "digest", "keep_id", "group_size", "buckets"]
    for i in range(0, len(keys), step):
        part = keys[i : i + step]
        keep = pd.array([shard.keys[d][0] for d in part], dtype="Int64")
        yield pd.DataFrame(
            {"shard": number, "kind": KEY, "digest": part, "keep_id": keep, "group_size": [shard.keys[d][1] for d in part], "buckets": 0}
        )[cols]
    block = [(number, FILTER, shard.filter.slots.tobytes(), None, 0, shard.filter.mask + 1)]
    yield pd.DataFrame(block, columns=cols).astype({"keep_id": "Int64"})


STATE = "shard int, kind int, digest binary, keep_id long, group_size long, buckets long"


class CuckooIndex:
    """Live documents by digest; every change writes a new version and leaves the old one whole.

    Null texts count as empty; null ids take part and never win over another id. A table without
    rows gives an index without shards.
    """

    def __init__(self, spark: SparkSession, shards: int, path: str | None = None):
        self.spark, self.shards = spark, max(1, shards)
        self.path = path or fresh_path(spark, "cuckoo")
        self.version = 0

    @staticmethod
    def digests(docs: DataFrame) -> DataFrame:
        """``doc_id, digest`` of the text with A-Z in lower case."""
        text = F.translate(text_of(docs), UPPER, LOWER)
        return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))

    def _at(self, name: str, version: int | None = None) -> str:
        return f"{self.path}/v{self.version if version is None else version}/{name}"

    def members(self) -> DataFrame:
        return self.spark.read.schema("shard int, digest binary, doc_id long").parquet(self._at("members"))

    def _state(self) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(self._at("state"))

    def groups(self) -> DataFrame:
        """``digest, keep_id, group_size`` of all live digests."""
        return self._state().filter(F.col("kind") == KEY).select("digest", "keep_id", "group_size")

    def filters(self) -> DataFrame:
        return self._state().filter(F.col("kind") == FILTER).selectExpr("shard", "buckets", "digest AS slots")

    def _shard(self):
        return F.pmod(F.xxhash64("digest"), F.lit(self.shards)).cast("int")

    def _write(self, members: DataFrame, changes: DataFrame) -> None:
        if self.version:
            changes = changes.unionByName(self._state())
        state = (
            changes.repartition(self.shards, "shard")
            .sortWithinPartitions("shard", "kind")
            .mapInPandas(_apply, STATE)
        )
        state.write.parquet(self._at("state", self.version + 1))
        if members is not None:
            members.write.parquet(self._at("members", self.version + 1))
        self.version += 1

    @staticmethod
    def _added(members: DataFrame) -> DataFrame:
        """Copies added up per digest and salt; the filter meets each sum as one insertion."""
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
        return (
            members.groupBy("shard", "digest", salt.alias("_salt"))
            .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
            .select("shard", F.lit(INSERT).alias("kind"), "digest", "keep_id", "group_size", F.lit(0).cast("long").alias("buckets"))
        )

    def insert(self, digests: DataFrame) -> DataFrame:
        """Add documents; returns the stored ``shard, digest, doc_id`` rows of the new version."""
        new = digests.select(self._shard().alias("shard"), "digest", "doc_id")
        if self.version:
            new = new.unionByName(self.members())
            stored(new, "members", self._at("members", self.version + 1))
            added = self._added(digests.select(self._shard().alias("shard"), "digest", "doc_id"))
        else:
            added = self._added(stored(new, "members", self._at("members", 1)))
        self._write(None, added)
        return self.members()

    def delete(self, ids: DataFrame) -> None:
        """Drop the documents in ``ids.doc_id``; groups they leave get their next largest id."""
        ids = ids.select("doc_id").distinct()
        old = self.members()
        left = stored(old.join(ids, "doc_id", "left_anti").select(old.columns), "members", self._at("members", self.version + 1))
        hit = old.join(ids, "doc_id", "left_semi").select("shard", "digest").distinct()
        empty = [F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(0).cast("long").alias("buckets")]
        gone = hit.select("shard", F.lit(DELETE).alias("kind"), "digest", *empty)
        self._write(None, gone.unionByName(self._added(left.join(hit, ["shard", "digest"], "left_semi"))))

    def contains(self, digests: DataFrame) -> DataFrame:
        """``digests`` with ``maybe`` (the filter's answer) and ``live`` (checked with the keys)."""
        asked = digests.select(self._shard().alias("shard"), "digest").distinct()

        def probe(filters: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out = asked.copy()
            if len(filters):
                f = CuckooFilter(int(filters.buckets.iloc[0]), filters.slots.iloc[0])
                out["maybe"] = [d in f for d in out["digest"]]
            else:
                out["maybe"] = False
            return out

        # A shard holds a bounded number of keys; repeated questions about one digest are asked once.
        pairs = self.filters().groupBy("shard").cogroup(asked.groupBy("shard"))
        said = pairs.applyInPandas(probe, "shard int, digest binary, maybe boolean")
        live = said.filter("maybe").join(self.groups().select("digest"), "digest", "left_semi").select("digest", F.lit(True).alias("live"))
        said = said.drop("shard").join(live, "digest", "left")
        return digests.join(said, "digest").withColumn("live", F.coalesce("live", F.lit(False)))


def exact_dedup(docs: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are so after lower-casing A-Z; the largest id of equal texts stays.
    Null and empty texts form one group. A group of null ids alone keeps one of them. Repeated
    rows with the largest id are told apart by number, so that exactly one of them stays.
    """
    spark = docs.sparkSession
    digests = stored(CuckooIndex.digests(docs), "digests")
    index = CuckooIndex(spark, -(-digests.count() // shard_keys))
    members = index.insert(digests).drop("shard")
    rows = join_groups(members, index.groups(), "digest", "group_size")
    return _first_copy(rows).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def _first_copy(rows: DataFrame) -> DataFrame:
    """``kept`` for exactly one row of each group, also where the largest id occurs again."""
    top = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    rows = rows.withColumn("kept", top)
    # Ids that occur again are rare; only then a row number tells the copies apart.
    again = rows.filter("kept").groupBy("digest").count().filter("count > 1")
    if again.isEmpty():
        return rows
    again = again.select("digest", F.lit(True).alias("_again"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    rows = stored(rows, "copies")
    first = rows.filter("kept").join(again, "digest").groupBy("digest").agg(F.min("_row").alias("_first"))
    marks = first.select(F.col("digest").alias("_d"), "_first")
    joined = rows.join(marks, (F.col("digest") == F.col("_d")) & F.col("kept"), "left")
    return joined.withColumn("kept", F.col("kept") & F.coalesce(F.col("_row") == F.col("_first"), F.lit(True))).drop("_row", "_d", "_first")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, with all their columns; one row of each text.

    Null texts come back empty. Among repeated rows with the largest id any one stays.
    """
    texts = stored_texts(docs, all_columns=True)
    digest = F.unhex(F.sha2(F.translate("text", UPPER, LOWER).cast("binary"), 256)).alias("digest")
    ids = stored(texts.select("rid", F.col("doc_id").cast("long").alias("doc_id"), digest), "digests")
    index = CuckooIndex(docs.sparkSession, -(-ids.count() // SHARD_KEYS))
    index.insert(ids.select("doc_id", "digest"))
    # Texts that occur once are left alone: only the losers of larger groups are taken out.
    many = join_groups(ids, index.groups().filter("group_size > 1"), "digest", "group_size")
    top = many.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("rid").alias("_stay"), F.max("group_size").alias("_n"))
    lost = join_groups(ids, top, "digest", "_n").filter("rid <> _stay").select("rid")
    kept = texts.join(lost, "rid", "left_anti")
    return kept.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
