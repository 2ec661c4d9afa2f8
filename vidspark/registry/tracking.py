"""Trajectories on the pixel-per-order frames and the event traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from vidspark.operators import overlay as O
from vidspark.operators import tracking as T
from vidspark.operators.tiles import track_tiled
from vidspark.params import Tracking
from vidspark.registry.core import H, VIEWS, W, cell_frames, cells, frames, query, track_points
from vidspark.registry.relational import HASH_SQL, TRAJ_SQL, trajectory_file
from vidspark.sources import trajectories as ST

D = 2.0
P = Tracking(min_distance=D, quality=0.5, every=2, length=15)

VIEWS["v_grid"] = f"""SELECT stream_id, frame_id, i, j, CAST(j * 2 + 1 AS INTEGER) AS x, CAST(i * 2 + 1 AS INTEGER) AS y FROM v_cellframes
  CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range({H // 2})) a CROSS JOIN (SELECT CAST(range AS INTEGER) AS j FROM range({W // 2})) b"""
VIEWS["v_cand"] = """SELECT g.stream_id, g.frame_id, g.i, g.j, g.x, g.y, c.response,
    concat(CAST(g.stream_id AS VARCHAR), '-', CAST(g.frame_id AS VARCHAR), '-', CAST(g.i AS VARCHAR), '_', CAST(g.j AS VARCHAR)) AS trace_id
  FROM v_grid g JOIN v_cells c USING (stream_id, frame_id, x, y)
  JOIN (SELECT stream_id, frame_id, 0.5 * max(response) AS thr FROM v_cells GROUP BY 1, 2) t USING (stream_id, frame_id)
  WHERE c.response > thr"""
# Two live points per frame, placed by the orders of the frame.
VIEWS["v_live"] = f"""SELECT stream_id, frame_id, CAST(x AS DOUBLE) + 0.25 AS x, CAST(y AS DOUBLE) + 0.5 AS y FROM v_cells
  WHERE r < 64"""
INSIDE = f"x > 0 AND x < {W} AND y > 0 AND y < {H}"


def live(spark, sf):
    return cells(spark, sf).filter("r < 64").selectExpr("stream_id", "frame_id", "x + 0.25D AS x", "y + 0.5D AS y")


def _grid(spark, sf):
    return T.grid_points(cell_frames(spark, sf), D)


def _pixels(spark, sf):
    return cells(spark, sf).select("stream_id", "frame_id", "x", "y", "response")


@query("a6_response_threshold", "SELECT stream_id, frame_id, i, j, x, y, response FROM v_cand")
def _(spark, sf):
    r = T.response_threshold(_pixels(spark, sf), _grid(spark, sf), 0.5)
    return r.select("stream_id", "frame_id", "i", "j", "x", "y", "response")


@query(
    "j5_suppress_occupied",
    """SELECT g.* FROM v_grid g ANTI JOIN (SELECT stream_id, frame_id, CAST(floor(y / 2) AS INTEGER) AS i,
      CAST(floor(x / 2) AS INTEGER) AS j FROM v_live) o USING (stream_id, frame_id, i, j)""",
)
def _(spark, sf):
    g = T.suppress_occupied(_grid(spark, sf), live(spark, sf), D)
    return g.select("stream_id", "frame_id", "i", "j", "x", "y")


@query(
    "t2_seed_points",
    """SELECT stream_id, frame_id, i, j, x, y, trace_id FROM v_cand c ANTI JOIN (SELECT stream_id, frame_id,
      CAST(floor(y / 2) AS INTEGER) AS i, CAST(floor(x / 2) AS INTEGER) AS j FROM v_live) o USING (stream_id, frame_id, i, j)
    WHERE frame_id % 2 = 0""",
)
def _(spark, sf):
    s = T.seed_points(_pixels(spark, sf), cell_frames(spark, sf), live(spark, sf), P)
    return s.select("stream_id", "frame_id", "i", "j", "x", "y", "trace_id")


@query("t3_trace_ids", "SELECT stream_id, frame_id, i, j, trace_id FROM v_cand")
def _(spark, sf):
    r = T.response_threshold(_pixels(spark, sf), _grid(spark, sf), 0.5)
    return T.trace_ids(r).select("stream_id", "frame_id", "i", "j", "trace_id")


@query(
    "g6_flow_rows",
    """SELECT stream_id, frame_id, y, count(*) AS width, sum(u * (x + 1)) AS su, sum(v * (x + 1)) AS sv FROM v_cells GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    r = T.flow_rows(cells(spark, sf))

    def dot(c):
        return F.aggregate(
            F.transform(c, lambda a, i: a * (i + 1)), F.lit(0.0), lambda acc, a: acc + a
        )

    return r.select("stream_id", "frame_id", "y", F.size("u").cast("long").alias("width"), dot("u").alias("su"), dot("v").alias("sv"))


@query(
    "j6_advance_points",
    f"""SELECT stream_id, frame_id, x, y FROM (SELECT l.stream_id, l.frame_id, l.x + c.u AS x, l.y + c.v AS y FROM v_live l JOIN v_cells c
      ON l.stream_id = c.stream_id AND l.frame_id = c.frame_id
      AND c.x = least(greatest(CAST(floor(l.x) AS INTEGER), 0), {W - 1}) AND c.y = least(greatest(CAST(floor(l.y) AS INTEGER), 0), {H - 1})) t
    WHERE {INSIDE}""",
)
def _(spark, sf):
    return T.advance_points(live(spark, sf), T.flow_rows(cells(spark, sf)), W, H)


# Only complete frames: a half-filled last frame has no 3 x 3 neighbourhood.
VIEWS["v_whole"] = f"SELECT stream_id, frame_id FROM v_cells GROUP BY 1, 2 HAVING count(*) = {W * H}"


@query(
    "j7_advance_points_median",
    f"""WITH n AS (SELECT l.stream_id, l.frame_id, l.x AS px, l.y AS py,
      least(greatest(CAST(floor(l.x) AS INTEGER) + dx, 0), {W - 1}) AS cx, least(greatest(CAST(floor(l.y) AS INTEGER) + dy, 0), {H - 1}) AS cy
      FROM v_live l JOIN v_whole USING (stream_id, frame_id)
      CROSS JOIN (SELECT CAST(range AS INTEGER) - 1 AS dx FROM range(3)) a CROSS JOIN (SELECT CAST(range AS INTEGER) - 1 AS dy FROM range(3)) b),
    m AS (SELECT n.stream_id, n.frame_id, px + list_sort(list(c.u))[5] AS x, py + list_sort(list(c.v))[5] AS y
      FROM n JOIN v_cells c ON n.stream_id = c.stream_id AND n.frame_id = c.frame_id AND c.x = cx AND c.y = cy GROUP BY n.stream_id, n.frame_id, px, py)
    SELECT * FROM m WHERE {INSIDE}""",
)
def _(spark, sf):
    whole = cells(spark, sf).groupBy("stream_id", "frame_id").count().filter(F.col("count") == W * H)
    pts = live(spark, sf).join(whole.select("stream_id", "frame_id"), ["stream_id", "frame_id"], "left_semi")
    return T.advance_points(pts, T.flow_rows(cells(spark, sf)), W, H, median=True)


# One recursion step per frame: move live traces and seeds, then close at length.
VIEWS["v_last"] = "SELECT stream_id, max(frame_id) AS last FROM v_cells GROUP BY 1"
TRACK_SQL = f"""
WITH RECURSIVE run AS (
  SELECT stream_id, CAST(-1 AS INTEGER) AS frame_id, CAST(NULL AS VARCHAR) AS trace_id, CAST(0 AS INTEGER) AS n,
    CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, 'clock' AS status FROM v_last
  UNION ALL
  (WITH moved AS (
      SELECT r.stream_id, r.frame_id + 1 AS frame_id, r.trace_id, r.n + 1 AS n, c.u, c.v, r.x AS px, r.y AS py,
        r.x + c.u AS x, r.y + c.v AS y FROM run r
      LEFT JOIN v_cells c ON c.stream_id = r.stream_id AND c.frame_id = r.frame_id + 1
        AND c.x = least(greatest(CAST(floor(r.x) AS INTEGER), 0), {W - 1}) AND c.y = least(greatest(CAST(floor(r.y) AS INTEGER), 0), {H - 1})
      JOIN v_last l ON l.stream_id = r.stream_id AND r.frame_id < l.last WHERE r.status = 'live'),
    judged AS (
      SELECT stream_id, frame_id, trace_id, CASE WHEN coalesce({INSIDE}, false) THEN n ELSE n - 1 END AS n,
        CASE WHEN coalesce({INSIDE}, false) THEN x ELSE px END AS x, CASE WHEN coalesce({INSIDE}, false) THEN y ELSE py END AS y,
        CASE WHEN NOT coalesce({INSIDE}, false) THEN 'dropped' WHEN n > 15 THEN 'finished' ELSE 'live' END AS status FROM moved),
    clock AS (SELECT r.stream_id, r.frame_id + 1 AS frame_id FROM run r JOIN v_last l ON l.stream_id = r.stream_id AND r.frame_id < l.last
      WHERE r.status = 'clock')
    SELECT * FROM judged
    UNION ALL SELECT s.stream_id, s.frame_id, s.trace_id, 1, CAST(s.x AS DOUBLE), CAST(s.y AS DOUBLE), 'live' FROM v_cand s
      JOIN clock k ON s.stream_id = k.stream_id AND s.frame_id = k.frame_id
      LEFT JOIN (SELECT DISTINCT stream_id, CAST(floor(y / 2) AS INTEGER) AS oi, CAST(floor(x / 2) AS INTEGER) AS oj FROM judged WHERE status = 'live') o
        ON o.stream_id = s.stream_id AND o.oi = s.i AND o.oj = s.j
      WHERE s.frame_id % 2 = 0 AND o.oi IS NULL
    UNION ALL SELECT stream_id, frame_id, NULL, 0, NULL, NULL, 'clock' FROM clock))
SELECT r.stream_id, r.trace_id, r.frame_id AS end_frame, r.status, r.n AS n_points, r.x AS last_x, r.y AS last_y FROM run r
JOIN v_last l ON l.stream_id = r.stream_id WHERE r.status IN ('finished', 'dropped') OR (r.status = 'live' AND r.frame_id = l.last)"""


def tracked(spark, sf, segment_frames: int = 256):
    seeds = T.trace_ids(T.response_threshold(_pixels(spark, sf), _grid(spark, sf), 0.5))
    return T.track(T.flow_rows(cells(spark, sf)), seeds, W, H, P, segment_frames)


def _ends(t):
    return t.select(
        "stream_id", "trace_id", "end_frame", "status", F.size("xs").alias("n_points"),
        F.element_at("xs", -1).alias("last_x"), F.element_at("ys", -1).alias("last_y"),
    )


@query("t5_track", TRACK_SQL)
def _(spark, sf):
    return _ends(tracked(spark, sf))


@query("t5_track_segments", TRACK_SQL)
def _(spark, sf):
    """Traces that go on over many segments."""
    return _ends(tracked(spark, sf, 7))


@query("t5_track_tiles", TRACK_SQL)
def _(spark, sf):
    """Each stream in tiles of four cells a side."""
    seeds = T.trace_ids(T.response_threshold(_pixels(spark, sf), _grid(spark, sf), 0.5))
    return _ends(track_tiled(T.flow_rows(cells(spark, sf)), seeds, 4, W, H, P, 4))


STATS = """
st AS (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS dist FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM v_pts
  WINDOW w AS (PARTITION BY stream_id, trace_id ORDER BY idx)) t),
stats AS (SELECT stream_id, trace_id, count(*) AS n_points, avg(x) AS mean_x, avg(y) AS mean_y, stddev_pop(x) AS std_x, stddev_pop(y) AS std_y,
  coalesce(sum(dist), 0.0) AS length, coalesce(max(dist), 0.0) AS max_step FROM st GROUP BY 1, 2)"""
STAT_COLS = ["mean_x", "mean_y", "std_x", "std_y", "length", "max_step"]
STAT_ROUND = ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in STAT_COLS)


def _stats(df):
    return df.select("stream_id", "trace_id", "n_points", *[(F.round(c, 4) + 0.0).alias(c) for c in STAT_COLS])


@query("a7_trace_stats", f"WITH {STATS} SELECT stream_id, trace_id, n_points, {STAT_ROUND} FROM stats")
def _(spark, sf):
    return _stats(T.trace_stats(track_points(spark, sf)))


@query(
    "w4_displacements",
    f"""WITH {STATS} SELECT stream_id, trace_id, idx, round(dist, 4) AS dist, round((x - px) / nullif(t, 0), 4) + 0.0 AS nx,
    round((y - py) / nullif(t, 0), 4) + 0.0 AS ny
    FROM (SELECT *, sum(dist) OVER (PARTITION BY stream_id, trace_id) AS t FROM st) u WHERE px IS NOT NULL""",
)
def _(spark, sf):
    s = T.normalised_steps(track_points(spark, sf))
    return s.select("stream_id", "trace_id", "idx", F.round("dist", 4).alias("dist"),
                    (F.round("nx", 4) + 0.0).alias("nx"), (F.round("ny", 4) + 0.0).alias("ny"))


VALID = "(std_x >= 1.732 OR std_y >= 1.732) AND std_x <= 50 AND NOT (max_step > 20 AND max_step > 0.7 * length)"


@query(
    "t6_valid_traces",
    f"WITH {STATS} SELECT stream_id, trace_id, n_points, {STAT_ROUND} FROM stats WHERE {VALID} AND std_y <= 50",
)
def _(spark, sf):
    return _stats(T.valid_traces(track_points(spark, sf)))


@query(
    "t6_valid_traces_compat",
    f"WITH {STATS} SELECT stream_id, trace_id, n_points, {STAT_ROUND} FROM stats WHERE {VALID}",
)
def _(spark, sf):
    return _stats(T.valid_traces(track_points(spark, sf), compat=True))


@query(
    "t7_finished_traces",
    """SELECT stream_id, trace_id, idx, x, y FROM v_pts JOIN (SELECT trace_id FROM v_pts GROUP BY 1 HAVING count(*) = 16) t USING (trace_id)""",
)
def _(spark, sf):
    return T.finished_traces(track_points(spark, sf)).select("stream_id", "trace_id", "idx", "x", "y")


@query(
    "t7_live_points",
    """SELECT stream_id, trace_id, count(*) AS n_points, arg_max(x, idx) AS x, arg_max(y, idx) AS y FROM v_pts GROUP BY 1, 2 HAVING count(*) <= 15""",
)
def _(spark, sf):
    return T.live_points(track_points(spark, sf))


OVERLAY = """seg AS (SELECT stream_id, trace_id, idx, lag(x) OVER w AS px, lag(y) OVER w AS py, x, y, count(*) OVER (PARTITION BY stream_id, trace_id) AS n
  FROM v_pts WINDOW w AS (PARTITION BY stream_id, trace_id ORDER BY idx))"""
OVERLAY_OUT = """stream_id, trace_id, idx, CAST(round_even(px * 1.5, 0) AS INTEGER) AS x0, CAST(round_even(py * 1.25, 0) AS INTEGER) AS y0,
  CAST(round_even(x * 1.5, 0) AS INTEGER) AS x1, CAST(round_even(y * 1.25, 0) AS INTEGER) AS y1, CAST(floor(255.0 * idx / n) AS INTEGER) AS green"""


def _overlay(df):
    o = O.trace_overlay(df, 1.5, 1.25)
    return o.select("stream_id", "trace_id", "idx", "x0", "y0", "x1", "y1", "green")


@query("p17_trace_overlay", f"WITH {OVERLAY} SELECT {OVERLAY_OUT} FROM seg WHERE px IS NOT NULL")
def _(spark, sf):
    return _overlay(track_points(spark, sf))


@query(
    "t8_plot_traces",
    f"WITH {OVERLAY} SELECT {OVERLAY_OUT} FROM seg WHERE px IS NOT NULL AND abs({HASH_SQL}) % 3 > 0",
)
def _(spark, sf):
    return _overlay(T.plot_traces(track_points(spark, sf), 3))


@query(
    "j8_trace_frame_window",
    """WITH f AS (SELECT user_id % 4 AS stream_id, trace_id, chunk * 16 + 15 AS end_frame, idx, x, y FROM v_pts
      JOIN (SELECT trace_id FROM v_pts GROUP BY 1 HAVING count(*) = 16) t USING (trace_id)),
    hit AS (SELECT f.*, end_frame - 14 + idx AS frame_id, v.value FROM f JOIN v_frames v ON v.stream_id = f.stream_id AND v.frame_id = end_frame - 14 + idx
      WHERE idx < 15)
    SELECT CAST(stream_id AS INTEGER) AS stream_id, trace_id, idx, frame_id, value FROM (SELECT *, count(*) OVER (PARTITION BY stream_id, trace_id) AS n FROM hit) t WHERE n = 15""",
)
def _(spark, sf):
    t = T.finished_traces(track_points(spark, sf)).withColumn("end_frame", F.col("chunk") * 16 + 15)
    f = frames(spark, sf).select("stream_id", "frame_id", "value")
    return T.trace_frame_window(t, f).select("stream_id", "trace_id", "idx", "frame_id", "value")


@query(
    "j9_frames_in_trajectory",
    f"""WITH {TRAJ_SQL},
    hit AS (SELECT line, xs, ys, chunk * 16 + 15 - j AS frame_id, j FROM lines CROSS JOIN (SELECT CAST(range AS INTEGER) AS j FROM range(15)) r)
    SELECT f.stream_id, f.frame_id, h.line AS traj, m, CAST(trunc(xs[m]) AS INTEGER) AS x0, CAST(trunc(ys[m]) AS INTEGER) AS y0,
      CAST(trunc(xs[m + 1]) AS INTEGER) AS x1, CAST(trunc(ys[m + 1]) AS INTEGER) AS y1
    FROM hit h JOIN v_frames f ON f.frame_id = h.frame_id CROSS JOIN (SELECT CAST(range AS INTEGER) + 1 AS m FROM range(15)) r WHERE m <= 15 - j""",
)
def _(spark, sf):
    t = ST.load_trajectories(spark, trajectory_file(spark, sf))
    return O.frames_in_trajectory(frames(spark, sf).select("stream_id", "frame_id"), t)
