"""Writers: ordered frame tables, feature tables, frame-with-flow records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.schema import FRAME, STREAM


def write_video_range(df: DataFrame, first: int, last: int, path: str, parts: int = 0) -> None:
    """Frames ``first … last - 1`` as a table whose files follow (stream, frame) order."""
    kept = df.filter((F.col(FRAME) >= first) & (F.col(FRAME) < last))
    args = ([parts] if parts else []) + [STREAM, FRAME]
    kept.repartitionByRange(*args).sortWithinPartitions(STREAM, FRAME).write.mode(
        "errorifexists"
    ).parquet(path)


def write_features(df: DataFrame, path: str) -> None:
    """Feature rows ``(stream_id, frame_id, trace_id, feat)``, clustered for range reads."""
    df.repartitionByRange(STREAM, FRAME).sortWithinPartitions(STREAM, FRAME).write.mode(
        "append"
    ).parquet(path)


def split_features(
    df: DataFrame, start: int, end: int, dim: int, feat: str = "feat"
) -> tuple[DataFrame, DataFrame]:
    """Inclusive frame range: (rows of length ``dim``, rejected rows)."""
    r = df.filter(F.col(FRAME).between(start, end))
    good = F.coalesce(F.size(feat) == dim, F.lit(False))
    return r.filter(good), r.filter(~good)


def read_features(spark: SparkSession, path: str, start: int, end: int, dim: int):
    return split_features(spark.read.parquet(path), start, end, dim)


def write_frame_with_flow(frames: DataFrame, flow: DataFrame, path: str) -> None:
    """One record per frame: raw image and its flow field."""
    frames.join(flow, [STREAM, FRAME]).write.mode("append").parquet(path)
