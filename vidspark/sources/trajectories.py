"""Trajectory text files and their groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.sources.models import numeric_lines


def load_trajectories(spark: SparkSession, path: str, n: int = 1, points: int = 16) -> DataFrame:
    """Every ``n``-th line as ``(traj, end_frame, pts)``; points follow seven info columns."""
    t = numeric_lines(spark, path).filter(F.col("line") % n == 0)
    pts = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda i: F.struct(
            F.get("vals", 7 + 2 * i).alias("x"), F.get("vals", 8 + 2 * i).alias("y")
        ),
    )
    return t.select(
        (F.col("line") / n).cast("long").alias("traj"),
        F.col("vals")[0].cast("int").alias("end_frame"),
        pts.alias("pts"),
    )


def merge_groups(a: DataFrame, b: DataFrame) -> DataFrame:
    """Append list ``b`` after ``a`` (columns line, group_id), ids shifted by ``max(a)``."""
    # One-row aggregate, read on the driver.
    top, n = a.agg(F.max("group_id"), F.max("line")).first()
    shifted = b.select(
        (F.col("line") + (n if n is not None else -1) + 1).alias("line"),
        (F.col("group_id") + (top or 0)).cast("int").alias("group_id"),
    )
    return a.select("line", "group_id").unionByName(shifted)


def trajectory_line(info: str, xy: str, desc: str, shape: str):
    """One output line from four float arrays."""
    both = F.concat(F.col(info), F.col(xy), F.col(desc), F.col(shape))
    return F.concat_ws(" ", F.transform(both, lambda v: v.cast("string")))


def write_trajectory_text(df: DataFrame, path: str, info="info", xy="xy", desc="desc", shape="shape"):
    df.select(trajectory_line(info, xy, desc, shape).alias("value")).write.text(path)
