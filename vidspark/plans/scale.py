"""Helpers that keep plans safe when one key holds a large share of the rows.

Nothing here changes results: each helper has a plain form for data of a checked
size and an exact distributed form beyond it.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows one task may hold for a sorted window before the sliced form is used.
SLICE_ROWS = 4_000_000
# Slices beyond those that ``SLICE_ROWS`` asks for.
MAX_SLICES = 500
# Rows x width limit for tables handed to every executor.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Without the setting a local run gets a folder of its own; on a cluster executors would not see
    each other's files, so that is an error. Runs leave their tables there; see the README on
    cleaning up.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[\d*, ]+\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL


_LOCAL: str | None = None


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    import uuid

    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that lost executors never replay the whole lineage."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def small(df: DataFrame, row_bytes: int = 64, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` is small enough to be given to every executor."""
    n = df.count()
    return n <= rows and n * row_bytes <= BROADCAST_BYTES


def maybe_broadcast(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """Broadcast hint after a size check; beyond it Spark picks a shuffle join."""
    return F.broadcast(df) if small(df, row_bytes) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` over all shuffle partitions.

    A fixed count keeps adaptive coalescing from merging small inputs of costly Python
    groups into few tasks; the grouping that follows needs no further exchange.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    start: int = 0,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``row_number - 1 + start`` per ``keys`` in ``order``.

    A key with more than ``slice_rows`` rows is cut into range slices which are
    numbered apart and shifted by the sizes of the slices before them.
    """
    keys, order = list(keys), list(order)
    win = Window.partitionBy(*keys).orderBy(*order)

    def plain(d: DataFrame) -> DataFrame:
        return d.withColumn(out, F.row_number().over(win).cast("long") - 1 + start)

    total = df.count()
    if total <= slice_rows:
        return plain(df)
    # Each slice costs the driver a task, a file and a share of the sample that cuts the ranges.
    slices = max(2, min(-(-total // slice_rows) * 2, max(MAX_SLICES, -(-total // SLICE_ROWS) * 2)))
    if not keys:
        return _sliced(df, keys, order, out, start, slices)
    hot = cut(df.groupBy(*keys).count().filter(F.col("count") > slice_rows).select(*keys))
    if hot.isEmpty():
        return plain(df)
    big = _sliced(df.join(hot, keys, "left_semi"), keys, order, out, start, slices)
    return plain(df.join(hot, keys, "left_anti")).unionByName(big)


def _sliced(df, keys, order, out, start, slices):
    cols = df.columns
    pid = F.spark_partition_id()
    s = (
        df.repartitionByRange(slices, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_slice", pid)
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    # Slice numbers are only stable once written.
    s = cut(s)
    runs = s.groupBy("_slice", *keys).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    j = s.join(runs, ["_slice", *keys])
    number = F.col("_pos") - F.col("_first") + F.col("_base") + F.lit(start)
    return j.withColumn(out, number.cast("long")).select(*cols, out)


def lagged(
    df: DataFrame,
    keys: Sequence[str],
    step: str,
    values: dict[str, str],
    bucket: int = 4096,
    costly: bool = False,
) -> DataFrame:
    """Add columns ``values = {new: source}`` of the row with ``step - 1`` (null when absent).

    Windows cover ``(keys, step div bucket)`` only: the last row of each bucket is
    also sent to the next one. ``(keys, step)`` is unique. With ``costly`` the buckets lie in
    all shuffle partitions, for Python work that follows.
    """
    keys = list(keys)
    b = F.floor(F.col(step) / bucket)
    own = F.struct(b.alias("b"), F.lit(False).alias("halo"))
    edge = F.pmod(F.col(step), F.lit(bucket)) == bucket - 1
    to = F.when(edge, F.array(own, F.struct((b + 1).alias("b"), F.lit(True).alias("halo")))).otherwise(F.array(own))
    both = df.select("*", F.explode(to).alias("_to")).select("*", F.col("_to.b").alias("_b"), F.col("_to.halo").alias("_halo"))
    # Explicit, since a stream-wise partitioning of the input would also satisfy the window.
    both = spread(both.drop("_to"), *keys, "_b") if costly else both.drop("_to").repartition(*keys, "_b")
    w = Window.partitionBy(*keys, "_b").orderBy(step)
    prev = F.struct(F.col(step).alias("s"), *[F.col(v).alias(k) for k, v in values.items()])
    both = both.withColumn("_prev", F.lag(prev).over(w)).filter(~F.col("_halo"))
    hit = F.col("_prev.s") == F.col(step) - 1
    return both.select(*df.columns, *[F.when(hit, F.col(f"_prev.{k}")).alias(k) for k in values])


def salted(
    df: DataFrame, keys: Sequence[str], spread: Sequence[str], rows: int, out: str = "_salt"
) -> DataFrame:
    """Split every key into ``ceil(count / rows)`` hash parts of about ``rows`` rows."""
    keys = list(keys)
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    parts = F.ceil(F.col("_n") / F.lit(rows)).cast("long")
    salt = F.pmod(F.xxhash64(*spread), parts).cast("int")
    return df.join(n, keys).withColumn(out, salt).drop("_n")


def line_numbers(df: DataFrame, out: str = "line") -> DataFrame:
    """0-based line numbers over text files in (path, offset) order.

    ``df`` must come straight from ``spark.read.text`` with ``_metadata`` at hand.
    """
    t = df.select(
        *df.columns,
        F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_o"),
        F.monotonically_increasing_id().alias("_m"),
    )
    blocks = t.groupBy("_f", "_o").agg(F.min("_m").alias("_m0"), F.count("*").alias("_n"))
    # One row per input split, however many lines it has.
    w = Window.orderBy("_f", "_o").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    j = t.join(blocks, ["_f", "_o"])
    line = F.col("_m") - F.col("_m0") + F.col("_base")
    return j.select(*df.columns, line.cast("long").alias(out))
