"""Starting streams: sources from tables, one-shot runs, ordered sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidspark.plans.scale import fresh_path, numbered
from vidspark.schema import KEYS


# Rows of one staged file: what a task of a trigger reads.
FILE_ROWS = 4096
# Folder column that numbers staged files.
STAGE_FILE = "stage_file"


def stage_rows(df: DataFrame, order: list[str], cap: int, path: str) -> int:
    """Writes ``df`` below ``path`` in slices of ``cap`` rows in ``order``; files per slice.

    All slices are written by one job, a folder for each file. A file source takes files by age, so
    files are given the time of their slice afterwards. ``order`` should tell rows apart.
    """
    spark = df.sparkSession
    whole = fresh_path(spark, "whole")
    numbered(df, [], order, "_at").write.parquet(whole)
    rows = spark.read.parquet(whole)
    total = rows.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = max(1, min(tasks, -(-min(cap, total) // FILE_ROWS)))
    # Dealt in turn, so that no file of a whole slice is empty.
    number = F.floor(F.col("_at") / F.lit(cap)) * files + F.col("_at") % files
    dealt = rows.withColumn(STAGE_FILE, number.cast("long")).drop("_at")
    before = _staged_files(spark, path)
    dealt.repartitionByRange(tasks, STAGE_FILE).write.mode("append").partitionBy(STAGE_FILE).parquet(path)
    _age(spark, path, files, before)
    return files


def _staged_files(spark: SparkSession, path: str) -> dict[str, tuple]:
    """Staged files by name: number of the folder, path, time."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    if fs.exists(root):
        found = fs.listFiles(root, True)
        while found.hasNext():
            f = found.next()
            folder = f.getPath().getParent().getName()
            if folder.startswith(f"{STAGE_FILE}="):
                out[f.getPath().toString()] = (int(folder.split("=")[1]), f.getPath(), f.getModificationTime())
    return out


def _age(spark: SparkSession, path: str, files: int, before: dict[str, tuple]) -> None:
    """A millisecond for each slice of ``files`` files, the first the oldest, all newer than those staged ``before``."""
    new = [(n // files, at, t) for name, (n, at, t) in _staged_files(spark, path).items() if name not in before]
    if not new:
        return
    start = max(t for *_, t in new) - max(n for n, *_ in new)
    start = max([start, *(t + 1 for *_, t in before.values())])
    fs = new[0][1].getFileSystem(spark._jsc.hadoopConfiguration())
    for n, at, _ in new:
        fs.setTimes(at, start + n, -1)


def paced(df: DataFrame, order: list[str], cap: int) -> DataFrame:
    """``df`` as a stream in ``order`` of which a trigger takes at most ``cap`` rows."""
    path = fresh_path(df.sparkSession, "stage")
    files = stage_rows(df, order, max(1, cap), path)
    schema = T.StructType([*df.schema.fields, T.StructField(STAGE_FILE, T.LongType())])
    stream = df.sparkSession.readStream.schema(schema).option("basePath", path).option("maxFilesPerTrigger", files)
    return stream.parquet(path).drop(STAGE_FILE)


def staged(df: DataFrame, slices: int, order: str) -> DataFrame:
    """``df`` as a stream of ``slices`` equal slices of rows, least ``order`` first, one per trigger."""
    return paced(df, [order], -(-df.count() // slices))


def drain(stream: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """Run an append stream over all available input and read its result back."""
    spark = stream.sparkSession
    out = fresh_path(spark, "drain")
    q = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint or fresh_path(spark, "state"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def for_each_epoch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str | None = None):
    """``fn(batch, epoch)`` for every available micro-batch."""
    spark = stream.sparkSession
    q = (
        stream.writeStream.foreachBatch(fn)
        .option("checkpointLocation", checkpoint or fresh_path(spark, "state"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def ordered_sink(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Sorted Parquet per epoch; a replayed epoch replaces its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        # Ranges are drawn from a sample, which would run the steps of the batch a second time.
        batch.persist()
        try:
            batch.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).write.mode("overwrite").parquet(
                f"{path}/epoch={epoch:09d}"
            )
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
