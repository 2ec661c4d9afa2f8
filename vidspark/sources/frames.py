"""Frame sources: image folders, frame tables, numbering, ranges, sampling, pairing."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.functions.scalar import div
from vidspark.plans.scale import lagged, numbered
from vidspark.schema import EPOCH, FRAME, STREAM


def frame_time(frame: Column, fps: int = 25) -> Column:
    """Event time of a frame number, counted from a fixed non-zero base."""
    return F.timestamp_micros(
        F.unix_micros(F.to_timestamp(F.lit(EPOCH)))
        + F.floor(frame.cast("double") * 1_000_000 / fps).cast("long")
    )


def _named(df: DataFrame, prefix: str, stream_id: int) -> DataFrame:
    """Files in folders ``stream_id=…`` name their stream themselves."""
    number = F.regexp_extract("image.origin", rf"{prefix}(\d+)\.[A-Za-z]+$", 1)
    stream = F.col(STREAM).cast("int") if STREAM in df.columns else F.lit(stream_id)
    return df.filter("image.height > 0").select(
        stream.alias(STREAM),
        number.cast("int").alias(FRAME),
        F.struct(*[F.col(f"image.{c}") for c in ("height", "width", "nChannels", "mode", "data")])
        .alias("image"),
    )


def read_frames(
    spark: SparkSession, path: str, prefix: str = "frame", stream_id: int = 0
) -> DataFrame:
    """Numbered image files as frames; numbers missing on disk stay missing.

    ``path`` is the folder of one stream, or has a folder ``stream_id=…`` for each. Files that cannot
    be decoded are in ``rejected_frames``.
    """
    return _named(_image_files(spark, path, prefix), prefix, stream_id)


def rejected_frames(spark: SparkSession, path: str, prefix: str = "frame") -> DataFrame:
    """``origin`` of the numbered files that ``read_frames`` cannot decode."""
    return _image_files(spark, path, prefix).filter("image.height <= 0").select("image.origin")


def _image_files(spark, path, prefix):
    return spark.read.format("image").option("pathGlobFilter", f"{prefix}[0-9]*").load(path)


def _png(height: int, width: int, channels: int, data: bytes) -> bytes:
    """An 8-bit PNG of BGR or grey bytes."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    raw = b"".join(b"\0" + r.tobytes() for r in (a[:, :, ::-1] if channels == 3 else a))

    def chunk(tag, body):
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_frame_files(df: DataFrame, path: str, prefix: str = "frame") -> None:
    """Numbered PNG files in a folder per stream, written by the tasks that hold the frames."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        made = set()
        for b in batches:
            for r in b.itertuples():
                i, folder = r.image, f"{root}/{STREAM}={r.stream_id}"
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(f"{folder}/{prefix}{r.frame_id:06d}.png") as f:
                    f.write(_png(i["height"], i["width"], i["nChannels"], bytes(i["data"])))
            yield b[[FRAME]]

    df.select(STREAM, FRAME, "image").mapInPandas(run, f"{FRAME} int").write.format("noop").mode("overwrite").save()


def stream_frames(
    spark: SparkSession,
    path: str,
    max_per_trigger: int = 100,
    schema=None,
    glob: str | None = None,
    stream_id: int = 0,
) -> DataFrame:
    """Unbounded twin: Parquet frame tables when ``schema`` is given, else one stream's image files."""
    r = spark.readStream.option("maxFilesPerTrigger", max_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if schema is not None:
        return r.schema(schema).parquet(path)
    ddl = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    return _named(r.schema(ddl).format("image").load(path), "frame", stream_id)


def paced_stream(df: DataFrame, order: list[str], fps: int, seconds: int = 1):
    """Rate cap: ``(stream, trigger kwargs)`` taking at most ``fps * seconds`` records every ``seconds``."""
    from vidspark.streaming.run import paced

    return paced(df, order, fps * seconds), {"processingTime": f"{seconds} seconds"}


def assign_frame_ids(
    df: DataFrame, order: list[str], stream: str = STREAM, slice_rows: int | None = None
) -> DataFrame:
    """0-based frame counter per stream."""
    kw = {} if slice_rows is None else {"slice_rows": slice_rows}
    return numbered(df, [stream], order, FRAME, **kw).withColumn(FRAME, F.col(FRAME).cast("int"))


def frame_range(df: DataFrame, first: int, last: int, rebase: bool = False) -> DataFrame:
    """Frames ``[first, last)``; rebased: ``last`` included, renumbered from 0."""
    f = F.col(FRAME)
    if not rebase:
        return df.filter((f >= first) & (f < last))
    return df.filter(f.between(first, last)).withColumn(FRAME, (f - first).cast("int"))


def sample_split(df: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(all frames, every ``n``-th frame with a dense ``sample_id``)."""
    s = df.filter(F.col(FRAME) % n == 0).withColumn("sample_id", div(FRAME, n))
    return df, s


def pair_with_previous(df: DataFrame, cols: list[str], costly: bool = False) -> DataFrame:
    """Each frame with the ``cols`` of the frame before it; the first frame has no pair.

    With ``costly`` pairs are spread over all tasks, 256 frames of a stream at a time.
    """
    prev = {f"prev_{c}": c for c in cols}
    marked = df.withColumn("_here", F.lit(True))
    how = {"bucket": 256, "costly": True} if costly else {}
    out = lagged(marked, [STREAM], FRAME, {**prev, "_had": "_here"}, **how)
    return out.filter("_had").drop("_here", "_had")


def copy_range(df: DataFrame, start: int, end: int, path: str, seq: str = FRAME) -> None:
    """Append records ``[start, end)`` to another table."""
    df.filter((F.col(seq) >= start) & (F.col(seq) < end)).write.mode("append").parquet(path)


def copy_stream(df: DataFrame, start: int, end: int, path: str, checkpoint: str, seq: str = FRAME):
    """Consuming copy: the checkpoint remembers what has been taken."""
    d = df.filter((F.col(seq) >= start) & (F.col(seq) < end))
    return (
        d.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
