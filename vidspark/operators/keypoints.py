"""Keypoints that keep their descriptor when a picture is scaled or turned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.functions import scalespace as SS
from vidspark.operators.pixels import arrays
from vidspark.schema import KEYS

# Share of the range of grey levels by which a keypoint must stand out, per level of an octave.
CONTRAST = 0.04 * 255 / SS.LEVELS


def scale_extrema(frames: DataFrame, contrast: float = CONTRAST / 2) -> DataFrame:
    """``(keys, level, y, x, value)``: extrema of the first octave at the size of the ``gray`` image."""

    @F.pandas_udf("array<struct<level:int,y:int,x:int,value:double>>")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for p in batches:
            out = []
            for a in arrays(p):
                d = np.diff(SS.octave(SS.blur(a.astype(float), np.sqrt(SS.SIGMA**2 - SS.BLUR**2))), axis=0)
                at = SS.extrema(d, contrast)
                out.append([(int(s), int(y), int(x), float(d[s, y, x])) for s, y, x in at])
            yield pd.Series(out)

    return frames.select(*KEYS, F.explode(run("gray")).alias("_e")).select(*KEYS, "_e.*")


def scale_keypoints(frames: DataFrame, contrast: float = CONTRAST, edge: float = 10.0) -> DataFrame:
    """``(keys, kp, x, y, size, angle, descr)`` of every ``gray`` image of ``frames``.

    Extrema in scale and place, fitted between samples, with one row per main direction; ``descr`` has
    unit length and follows size and direction. Images without keypoints have no row.
    """

    @F.pandas_udf("array<struct<x:double,y:double,size:double,angle:double,descr:array<double>>>")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for p in batches:
            yield pd.Series([SS.keypoints(a, contrast, edge) for a in arrays(p)])

    e = frames.filter("gray IS NOT NULL").select(*KEYS, F.posexplode(run("gray")).alias("kp", "_k"))
    return e.select(*KEYS, "kp", "_k.*")


def scale_descriptors(
    frames: DataFrame, patches: DataFrame, contrast: float = CONTRAST, edge: float = 10.0
) -> DataFrame:
    """``patch_descriptors`` with keypoints of any size: ``(keys, patch_no, kp, x, y, descr)``.

    A frame is searched once; its keypoints go to all patches they lie in, with places relative to them.
    """
    k = scale_keypoints(frames, contrast, edge).drop("size", "angle")
    j = k.join(patches.select(*KEYS, "patch_no", "roi"), KEYS)
    inside = [(F.col(c) >= F.col(f"roi.{c}")) & (F.col(c) < F.col(f"roi.{c}") + F.col(f"roi.{s}")) for c, s in (("x", "w"), ("y", "h"))]
    at = [(F.col(c) - F.col(f"roi.{c}")).alias(c) for c in ("x", "y")]
    return j.filter(inside[0] & inside[1]).select(*KEYS, "patch_no", "kp", *at, "descr")
