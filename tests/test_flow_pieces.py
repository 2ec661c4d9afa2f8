"""Flow, corners and descriptors of many frames at a time: as if alone, and in all tasks."""

import numpy as np
from pyspark.sql import functions as F

from vidspark.functions import kernels as K
from vidspark.operators import pixels as PX
from vidspark.params import Blocks
from vidspark.sources.frames import pair_with_previous

SIZES = [(20, 24), (16, 30)]


def images(n):
    """Frame ``f`` of stream ``s`` as arrays; streams of two sizes."""
    r = np.random.default_rng(3)
    return {(s, f): r.integers(0, 256, SIZES[s % 2]).astype(np.uint8) for s in range(6) for f in range(n)}


def frames(spark, found):
    rows = [(s, f, (*a.shape, 1, 0, bytearray(a.tobytes()))) for (s, f), a in found.items()]
    image = "struct<height:int,width:int,nChannels:int,mode:int,data:binary>"
    return spark.createDataFrame(rows, f"stream_id int, frame_id int, gray {image}")


def test_pairs_of_small_frames_are_spread_and_worked_out_as_if_alone(spark, monkeypatch):
    monkeypatch.setattr(PX, "PIECE_FRAMES", 5)
    found = images(4)
    # One task holds frames of both sizes, as tables of few bytes have few tasks.
    pairs = pair_with_previous(frames(spark, found), ["gray"], costly=True)
    flow = PX.dense_flow(pairs).select("*", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in flow}) > 1
    one = PX.dense_flow(pairs.coalesce(1)).collect()
    for rows in (flow, one):
        assert len(rows) == 18
        for r in rows:
            u, v = PX.flow_arrays([x.asDict() for x in r.flow])
            want = K.polynomial_flow(found[r.stream_id, r.frame_id - 1], found[r.stream_id, r.frame_id])
            assert np.array_equal(u, want[0]) and np.array_equal(v, want[1])


def test_another_estimator_takes_pairs_one_by_one(spark):
    found = images(2)
    pairs = pair_with_previous(frames(spark, found), ["gray"], costly=True)
    rows = PX.dense_flow(pairs, estimator=lambda a, b: (a.astype(float), b - 1.0)).collect()
    for r in rows:
        u, v = PX.flow_arrays([x.asDict() for x in r.flow])
        assert np.array_equal(u, found[r.stream_id, 0]) and np.array_equal(v, found[r.stream_id, 1] - 1.0)


def test_corners_and_descriptors_of_frames_of_two_sizes(spark):
    found = images(3)
    df = frames(spark, found).coalesce(1)
    for r in PX.corner_response(df, 4.0).collect():
        whole = K.corner_response(found[r.stream_id, r.frame_id])
        assert (r.top, r.response) == (whole.max(), whole[r.y, r.x])
    flow = PX.dense_flow(pair_with_previous(df, ["gray"])).drop("prev_gray", "gray")
    places = [(s, f, f"{s}-{f}-{k}", k, 3.5 * k + s, 2.5 * k + f) for s in range(6) for f in (1, 2) for k in range(5)]
    points = spark.createDataFrame(places, "stream_id int, frame_id int, trace_id string, idx int, x double, y double")
    b = Blocks(size=8)
    rows = PX.point_descriptors(df.join(flow, PX.KEYS).coalesce(1), points, b).collect()
    assert len(rows) == len(places)
    at = {p[2]: p for p in places}
    for r in rows:
        s, f, _, k, x, y = at[r.trace_id]
        assert (r.stream_id, r.frame_id, r.idx) == (s, f, k)
        u, v = K.polynomial_flow(found[s, f - 1], found[s, f])
        for name, m in (("hog", found[s, f]), ("mbhx", 100.0 * u), ("mbhy", 100.0 * v)):
            want = K.block_descriptors(K.orientation_integral(*K.gradients(m), b.bins), np.array([[x, y]]), b.size, b.cells, b.t_cells)
            assert np.array_equal(r[name], want[0])
