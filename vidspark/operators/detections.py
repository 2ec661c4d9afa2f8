"""Detections per frame: completion, expansion to raw frames, joins, hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidspark.schema import FRAME, KEYS, STREAM

RECT = ["x", "y", "w", "h"]


def rect(*cols: str):
    return F.struct(*[F.col(c) for c in (cols or RECT)])


def completed_frames(det: DataFrame, distinct: list[str] | None = None) -> DataFrame:
    """Frames whose received parts reached ``patch_count`` (distinct regions on request).

    A part that is delivered again counts again and does not keep its frame from completing.
    """
    if distinct:
        det = det.select(*KEYS, "patch_count", *distinct).distinct()
    return (
        det.groupBy(*KEYS)
        .agg(F.count("*").alias("received"), F.max("patch_count").alias("patch_count"))
        .filter("received >= patch_count")
        .select(*KEYS, "patch_count")
    )


def collect_complete(det: DataFrame, distinct: list[str] | None = None) -> DataFrame:
    """Found rectangles of completed frames in long form; a frame without any keeps one null row.

    The rectangles stay rows, so that a frame of any size never gathers in one task.
    """
    found = det.filter("found = 1").select(*KEYS, *RECT)
    if distinct:
        found = found.distinct()
    return completed_frames(det, distinct).join(found, KEYS, "left")


def collect_complete_multi(det: DataFrame, n_logos: int) -> DataFrame:
    """As above per logo index; every completed frame has all ``n_logos`` indexes."""
    spine = completed_frames(det).withColumn(
        "logo_index", F.explode(F.array(*[F.lit(i) for i in range(n_logos)]))
    )
    found = det.filter("found = 1").select(*KEYS, "logo_index", *RECT)
    return spine.join(found, [*KEYS, "logo_index"], "left")


def expand_samples(det: DataFrame, n: int) -> DataFrame:
    """A sampled frame's rows apply to frames ``f … f + n - 1``."""
    f = F.col(FRAME)
    return det.withColumn("sample_frame", f).withColumn(
        FRAME, F.explode(F.sequence(f, f + F.lit(n - 1)))
    )


def join_frames_detections(frames: DataFrame, det: DataFrame, arrival: str | None = None):
    """Inner join on the frame; with ``arrival`` only the earliest detection row of a frame counts."""
    if arrival:
        rest = [c for c in det.columns if c not in KEYS]
        first = F.min_by(F.struct(*rest), F.struct(arrival, *[c for c in rest if c != arrival]))
        det = det.groupBy(*KEYS).agg(first.alias("_d")).select(*KEYS, "_d.*")
    return frames.join(det, KEYS)


def join_patch_frame(patches: DataFrame, frames: DataFrame) -> DataFrame:
    """Patches meet their frame: one equi-join, the pixels are never replicated."""
    return patches.join(frames, KEYS)


def hold_detections(frames: DataFrame, n: int, bucket: int = 65_536) -> DataFrame:
    """Frame whose list is shown at each frame, as ``shown_frame``.

    ``frames`` has (stream_id, frame_id, has_list). A frame divisible by ``n`` opens a
    segment with its own list; later frames show the first list found in the segment.
    Windows run per range of ``bucket`` frames; what crosses ranges is carried by
    one summary row per range.
    """
    d = frames.select(*KEYS, "has_list").withColumn("_b", F.floor(F.col(FRAME) / bucket))
    local = Window.partitionBy(STREAM, "_b").orderBy(FRAME)
    head = (F.col(FRAME) % n == 0).cast("int")
    d = d.withColumn("_seg", F.sum(head).over(local))
    own = F.when(F.col("has_list"), F.col(FRAME))
    inside = Window.partitionBy(STREAM, "_b", "_seg").orderBy(FRAME)
    d = d.withColumn("_first", F.first(own, ignorenulls=True).over(inside))
    ends = d.groupBy(STREAM, "_b").agg(
        F.max("_seg").alias("_heads"), F.max_by("_first", FRAME).alias("_out")
    )
    over = Window.partitionBy(STREAM).orderBy("_b")
    ends = ends.withColumn("_seg2", F.sum((F.col("_heads") > 0).cast("int")).over(over))
    run = Window.partitionBy(STREAM, "_seg2").orderBy("_b")
    ends = ends.withColumn("_state", F.first("_out", ignorenulls=True).over(run))
    ends = ends.select(STREAM, "_b", F.lag("_state").over(over).alias("_in"))
    # Left, though every range has its row: no filter is pushed to one branch only, so both
    # branches keep the same exchange and Spark runs it once.
    j = d.join(ends, [STREAM, "_b"], "left")
    shown = F.when(F.col("_seg") == 0, F.coalesce("_in", "_first")).otherwise(F.col("_first"))
    return j.select(*KEYS, shown.cast("int").alias("shown_frame"))


def order_frames(df: DataFrame) -> DataFrame:
    return df.orderBy(*KEYS)


def merge_streams(**dfs: DataFrame) -> DataFrame:
    """Union of named streams with their tag in ``source``."""
    out = None
    for tag, df in dfs.items():
        d = df.withColumn("source", F.lit(tag))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def dedupe_updates(df: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """First row of each key by ``seq``; any row when no order is given."""
    if seq is None:
        return df.dropDuplicates(keys)
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(seq, *[c for c in rest if c != seq]))
    return df.groupBy(*keys).agg(first.alias("_r")).select(*keys, "_r.*")
