"""Distributed forms give what the plain forms give, hot keys included."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from vidspark.operators import detections as D
from vidspark.operators import matching as M
from vidspark.operators import tracking as T
from vidspark.params import Tracking
from vidspark.plans import scale


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with most rows, ties in the order column."""
    return spark.range(3000).selectExpr(
        "CASE WHEN id % 10 < 7 THEN 0 ELSE id % 40 END AS k", "id div 3 AS o", "(id * 7919) % 3000 AS i"
    )


def test_numbered_slices_hot_keys(skewed):
    plain = scale.numbered(skewed, ["k"], ["o", "i"], "n", 5)
    cut = scale.numbered(skewed, ["k"], ["o", "i"], "n", 5, slice_rows=200)
    assert rows(plain) == rows(cut)


def test_lagged_equals_lag_over_gaps(spark):
    df = spark.range(500).filter("id % 17 <> 3").selectExpr("id % 2 AS s", "CAST(id div 2 AS int) AS f", "id * 3 AS v")
    w = Window.partitionBy("s").orderBy("f")
    want = df.withColumn("p", F.when(F.lag("f").over(w) == F.col("f") - 1, F.lag("v").over(w)))
    assert rows(scale.lagged(df, ["s"], "f", {"p": "v"}, bucket=8)) == rows(want)


def hold_plain(frames, n):
    out, cur = [], None
    for f, has in sorted(frames):
        if f % n == 0:
            cur = f if has else None
        elif cur is None and has:
            cur = f
        out.append((f, cur))
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(0, 200), min_size=1), st.integers(2, 9), st.integers(0, 6))
def test_hold_across_ranges(spark, ids, n, mod):
    data = [(0, f, (f * 7 + mod) % 5 == 0) for f in sorted(ids)]
    df = spark.createDataFrame(data, "stream_id int, frame_id int, has_list boolean")
    got = D.hold_detections(df, n, bucket=16).orderBy("frame_id").collect()
    assert [(r.frame_id, r.shown_frame) for r in got] == hold_plain([(f, h) for _, f, h in data], n)


def vectors(spark, n, start, groups):
    rng = np.random.default_rng(start)
    data = [(start + i, int(i % groups), [float(v) for v in rng.integers(0, 6, 4)]) for i in range(n)]
    return spark.createDataFrame(data, "id long, g int, descr array<double>")


def test_knn_blocks_equal_shared(spark):
    q = vectors(spark, 90, 0, 5).selectExpr("id AS q", "descr")
    t = vectors(spark, 110, 1000, 4).selectExpr("id AS t", "g", "descr")
    a = rows(M.knn_match(q, t, 3))
    b = rows(M.knn_match(q, t, 3, force_blocks=25))
    assert a == b and len(a) == 90 * 4 * 3


def test_match_patches_hot_patch(spark):
    q = vectors(spark, 120, 0, 9).selectExpr("id AS q", "CASE WHEN g < 6 THEN 0 ELSE g END AS patch", "descr")
    t = vectors(spark, 80, 1000, 4).selectExpr("id AS t", "g AS tpl", "descr")
    whole = rows(M.match_patches(q, t, 0.9))
    split = rows(M.match_patches(q, t, 0.9, patch_rows=30))
    assert whole == split and whole
    assert whole == rows(M.match_rows(q, t, 0.9))


def test_track_segments_do_not_change_tracks(spark, sf):
    from vidspark.registry.tracking import tracked

    a, b = (tracked(spark, sf, n).select("trace_id", "end_frame", "status", "xs") for n in (1000, 2))
    assert rows(a) == rows(b) and a.count() > 0


def test_track_without_suppression_partner(spark):
    """A constant flow of (1, 0.5) moves a seed along a line until the length is reached."""
    flow = spark.range(0, 20).selectExpr("0 AS stream_id", "CAST(id AS int) AS frame_id").withColumn(
        "y", F.explode(F.sequence(F.lit(0), F.lit(29)))
    ).withColumns({"u": F.array_repeat(F.lit(1.0), 40), "v": F.array_repeat(F.lit(0.5), 40)})
    seeds = spark.createDataFrame([(0, 0, 1, 1, 7, 7, "0-0-1_1")], "stream_id int, frame_id int, i int, j int, x int, y int, trace_id string")
    t = T.track(flow, seeds, 40, 30, Tracking(min_distance=5, length=15), segment_frames=4).collect()
    assert len(t) == 1 and t[0].status == "finished" and t[0].end_frame == 15
    assert t[0].xs == [7 + i for i in range(16)] and t[0].ys == [7 + i / 2 for i in range(16)]


def test_line_numbers_over_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{i}\n" for i in range(40)))
    (tmp_path / "b.txt").write_text("".join(f"{i}\n" for i in range(40, 75)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32b")
    try:
        got = scale.line_numbers(spark.read.text(str(tmp_path))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.line, int(r.value)) for r in got) == [(i, i) for i in range(75)]


def test_salted_parts_are_bounded(skewed):
    s = scale.salted(skewed, ["k"], ["i"], 100)
    big = s.groupBy("k", "_salt").count().agg(F.max("count")).first()[0]
    assert big < 200 and s.count() == 3000


def test_streams_of_other_sizes_are_tracked_side_by_side(spark):
    import random

    from vidspark.operators import tracking as T
    from vidspark.params import Tracking

    rnd, p = random.Random(5), Tracking(min_distance=2.0, every=2, length=4)
    flow, seeds, size = [], [], {0: (8, 6), 1: (12, 10)}
    for s, (w, h) in size.items():
        for f in range(12):
            flow += [(s, f, y, [rnd.choice([-0.5, 0.5, 1.0]) for _ in range(w)], [rnd.choice([-0.5, 0.0, 0.5]) for _ in range(w)]) for y in range(h)]
            seeds += [(s, f, i, j, 2.0 * j + 1, 2.0 * i + 1, f"{s}-{f}-{i}_{j}") for i in range(h // 2) for j in range(w // 2)]
    flow = spark.createDataFrame(flow, "stream_id int, frame_id int, y int, u array<double>, v array<double>")
    seeds = spark.createDataFrame(seeds, "stream_id int, frame_id int, i int, j int, x double, y double, trace_id string")
    both = T.track(flow, seeds, p=p, segment_frames=5).collect()
    apart = [r for s, (w, h) in size.items() for r in T.track(flow.filter(f"stream_id = {s}"), seeds.filter(f"stream_id = {s}"), w, h, p, 5).collect()]
    assert sorted(both) == sorted(apart) and {r.stream_id for r in both} == {0, 1}


def test_every_patch_answers_for_every_logo(spark):
    from vidspark.plans.flows import answers

    patches = spark.range(3).selectExpr("id AS patch")
    meta = spark.createDataFrame([(7,), (7,), (90_000,), (-2,)], "logo_index int")
    got = answers(patches, meta)
    assert sorted(map(tuple, got.collect())) == [(p, n) for p in range(3) for n in (-2, 7, 90_000)]
    none = answers(patches, meta.limit(0))
    assert none.columns == got.columns and none.isEmpty()


def test_slices_are_bounded(spark, monkeypatch):
    """Small slices of a large table are not so many that they burden the driver."""
    seen = []
    monkeypatch.setattr(scale, "MAX_SLICES", 6)
    monkeypatch.setattr(scale, "_sliced", lambda df, keys, order, out, start, slices: seen.append(slices) or df.withColumn(out, F.lit(0)))
    scale.numbered(spark.range(1000), [], ["id"], "n", slice_rows=10)
    assert seen == [6]
