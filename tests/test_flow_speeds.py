"""Dense flow on textures of known motion, and the bank left alone by detection without feedback."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidspark.operators.pixels import dense_flow

H, W = 60, 80
SPEEDS = [(0, 0), (1, 0), (0, -1), (2, 1), (-3, 2), (4, -4), (6, 3)]


def texture(seed):
    """A smooth random field, larger than a frame on every side."""
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0 : H + 40, 0 : W + 40]
    field = sum(np.sin(r.uniform(0.1, 0.35) * (np.cos(t) * x + np.sin(t) * y) + r.uniform(0, 6)) for t in r.uniform(0, np.pi, 12))
    return np.uint8(127 + 120 * field / np.abs(field).max())


@pytest.fixture(scope="module")
def flows(spark):
    rows = []
    for i, (dx, dy) in enumerate(SPEEDS):
        t = texture(i)
        a, b = t[20 : 20 + H, 20 : 20 + W], t[20 - dy : 20 - dy + H, 20 - dx : 20 - dx + W]
        rows.append((i, *[(H, W, 1, 0, bytearray(np.ascontiguousarray(m).tobytes())) for m in (a, b)]))
    image = "struct<height:int,width:int,nChannels:int,mode:int,data:binary>"
    pairs = spark.createDataFrame(rows, f"i int, prev_gray {image}, gray {image}")
    found = dense_flow(pairs).select("i", F.explode("flow").alias("r")).select("i", "r.*").collect()
    out = {}
    for r in found:
        out.setdefault(r.i, {})[r.y] = (r.u, r.v)
    return {i: tuple(np.array([rows[y][c] for y in range(H)]) for c in (0, 1)) for i, rows in out.items()}


@pytest.mark.parametrize("i", range(len(SPEEDS)))
def test_flow_follows_the_shift(flows, i):
    u, v = flows[i]
    dx, dy = SPEEDS[i]
    assert u.shape == v.shape == (H, W)
    inside = (slice(12, -12), slice(12, -12))
    off = np.hypot(u[inside] - dx, v[inside] - dy)
    assert np.median(off) < 0.1 + 0.1 * np.hypot(dx, dy) and np.quantile(off, 0.9) < 0.2 + 0.25 * np.hypot(dx, dy)


def test_detection_without_feedback_keeps_the_bank(spark, sf, monkeypatch):
    from vidspark.operators.bank import VersionedBank
    from vidspark.registry import QUERIES

    written = []
    write = VersionedBank.write
    monkeypatch.setattr(VersionedBank, "write", lambda self, e, bank: (written.append(e), write(self, e, bank))[1])
    rows = QUERIES["m6_detect_frozen_bank"](spark, sf).collect()
    assert written == [0]
    patches = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    assert len(rows) == patches and any(r.x is not None for r in rows)
