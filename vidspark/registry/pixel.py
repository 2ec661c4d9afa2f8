"""Pixel operators on frames whose pixels are orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from vidspark.functions import scalar as S
from vidspark.operators import overlay as O
from vidspark.operators import pixels as PX
from vidspark.operators import tiling as G
from vidspark.operators import tracking as T
from vidspark.operators.keypoints import scale_extrema
from vidspark.params import Blocks, Tiling
from vidspark.plans.scale import fresh_path
from vidspark.registry.core import H, VIEWS, W, cells, query, table, track_points
from vidspark.registry.tracking import TRACK_SQL, live, tracked
from vidspark.sources import frames as SF
from vidspark.sources import sinks as SK

KEYS = ["stream_id", "frame_id"]
BLOCKS = Blocks(size=8)

VIEWS["v_px"] = "SELECT c.* FROM v_cells c JOIN v_whole USING (stream_id, frame_id)"
VIEWS["v_gray"] = """SELECT stream_id, frame_id, y, x, CAST((114 * b + 587 * g + 299 * r + 500) // 1000 AS INTEGER) AS l FROM v_px"""


def images(spark, sf):
    return PX.image_from_cells(cells(spark, sf).select(*KEYS, "y", "x", "b", "g", "r"), W, H)


def grays(spark, sf):
    return PX.to_gray(images(spark, sf)).drop("image")


def flows(spark, sf):
    """Whole frames' flow as an array of rows."""
    r = T.flow_rows(cells(spark, sf))
    g = r.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("y", "u", "v"))).alias("flow"))
    return g.filter((F.size("flow") == H) & (F.size(F.col("flow")[H - 1]["u"]) == W))


@query(
    "s1_read_frames",
    "SELECT stream_id, frame_id, y, x, b AS c0, g AS c1, r AS c2 FROM v_px",
)
def _(spark, sf):
    """One stream is one folder of numbered files."""
    path = fresh_path(spark, "frames")
    SF.write_frame_files(images(spark, sf), path)
    return PX.pixel_rows(SF.read_frames(spark, path))


@query(
    "s13_write_frame_with_flow",
    f"""SELECT stream_id, frame_id, {W * H * 3} AS n_bytes, sum(u * (x + 1) + v * (y + 1)) AS mix FROM v_px GROUP BY 1, 2""",
)
def _(spark, sf):
    path = fresh_path(spark, "flowframes")
    SK.write_frame_with_flow(images(spark, sf), flows(spark, sf), path)
    d = spark.read.parquet(path)

    def row(r):
        u = F.aggregate(F.transform(r["u"], lambda a, i: a * (i + 1)), F.lit(0.0), lambda s, a: s + a)
        v = F.aggregate(r["v"], F.lit(0.0), lambda s, a: s + a)
        return u + v * (r["y"] + 1)

    mix = F.aggregate(F.transform("flow", row), F.lit(0.0), lambda s, a: s + a)
    return d.select(*KEYS, F.length("image.data").alias("n_bytes"), mix.alias("mix"))


@query(
    "p1_resize_area",
    """SELECT stream_id, frame_id, y // 2 AS y, x // 2 AS x, CAST(floor(avg(b) + 0.5) AS INTEGER) AS c0, CAST(floor(avg(g) + 0.5) AS INTEGER) AS c1,
    CAST(floor(avg(r) + 0.5) AS INTEGER) AS c2 FROM v_px GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    return PX.pixel_rows(PX.resize_frames(images(spark, sf), W // 2, H // 2, "area"))


@query(
    "p1_resize_linear",
    f"""WITH t AS (SELECT CAST(Y AS INTEGER) AS y, CAST(X AS INTEGER) AS x, (Y + 0.5) / 2 - 0.5 AS sy, (X + 0.5) / 2 - 0.5 AS sx
      FROM (SELECT range AS Y FROM range({2 * H})) a CROSS JOIN (SELECT range AS X FROM range({2 * W})) b),
    tap AS (SELECT y, x, dy, dx, least(greatest(CAST(floor(sy) AS INTEGER) + dy, 0), {H - 1}) AS py, least(greatest(CAST(floor(sx) AS INTEGER) + dx, 0), {W - 1}) AS px,
      CASE dy WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END * CASE dx WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END AS w
      FROM t CROSS JOIN (SELECT 0 AS dy UNION ALL SELECT 1) a CROSS JOIN (SELECT 0 AS dx UNION ALL SELECT 1) b)
    SELECT p.stream_id, p.frame_id, tap.y, tap.x, CAST(floor(sum(CAST(w AS DOUBLE) * b) + 0.5) AS INTEGER) AS c0,
      CAST(floor(sum(CAST(w AS DOUBLE) * g) + 0.5) AS INTEGER) AS c1, CAST(floor(sum(CAST(w AS DOUBLE) * r) + 0.5) AS INTEGER) AS c2
    FROM tap JOIN v_px p ON p.y = tap.py AND p.x = tap.px GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    return PX.pixel_rows(PX.resize_frames(images(spark, sf), 2 * W, 2 * H, "linear"))


# Frames twice as large, and the levels of their first octave, each blurred from the first; 4 deviations of taps, edges repeated.
VIEWS["v_taps"] = """SELECT level, i, exp(-i * i / (2 * sig * sig)) / sum(exp(-i * i / (2 * sig * sig))) OVER (PARTITION BY level) AS t
  FROM (SELECT level, sig, unnest(range(-CAST(ceil(4 * sig) AS BIGINT), CAST(ceil(4 * sig) AS BIGINT) + 1)) AS i
    FROM (SELECT CAST(range AS INTEGER) AS level, CASE range WHEN 0 THEN sqrt(1.6 * 1.6 - 0.25) ELSE CAST(1.6 AS DOUBLE) * sqrt(pow(4, range / 3.0) - 1) END AS sig
      FROM range(6)) a) b"""


UP = 2
VIEWS["v_large"] = f"""WITH t AS (SELECT CAST(Y AS INTEGER) AS y, CAST(X AS INTEGER) AS x, (Y + 0.5::DOUBLE) / {UP} - 0.5 AS sy, (X + 0.5::DOUBLE) / {UP} - 0.5 AS sx
    FROM (SELECT range AS Y FROM range({UP * H})) a CROSS JOIN (SELECT range AS X FROM range({UP * W})) b),
  tap AS (SELECT y, x, least(greatest(CAST(floor(sy) AS INTEGER) + dy, 0), {H - 1}) AS py, least(greatest(CAST(floor(sx) AS INTEGER) + dx, 0), {W - 1}) AS px,
    CASE dy WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END * CASE dx WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END AS w
    FROM t CROSS JOIN (SELECT 0 AS dy UNION ALL SELECT 1) a CROSS JOIN (SELECT 0 AS dx UNION ALL SELECT 1) b)
  SELECT p.stream_id, p.frame_id, tap.y, tap.x, CAST(floor(sum(w * l) + 0.5) AS INTEGER) AS l
  FROM tap JOIN v_gray p ON p.y = tap.py AND p.x = tap.px GROUP BY 1, 2, 3, 4"""


def _blurred(view: str, levels: str) -> str:
    """``view (…, y, x, l)`` blurred along x, then y, at every level asked for."""
    return f"""SELECT a.stream_id, a.frame_id, a.level, a.y, a.x, sum(t.t * b.l) AS l FROM (
      SELECT p.stream_id, p.frame_id, k.level, p.y, p.x FROM {view} p CROSS JOIN (SELECT DISTINCT level FROM v_taps WHERE {levels}) k) a
      JOIN v_taps t ON t.level = a.level JOIN (
        SELECT p.stream_id, p.frame_id, t.level, p.y, p.x, sum(t.t * q.l) AS l FROM {view} p JOIN v_taps t ON {levels}
        JOIN {view} q ON q.stream_id = p.stream_id AND q.frame_id = p.frame_id AND q.y = p.y
          AND q.x = least(greatest(p.x + t.i, 0), {UP * W - 1}) GROUP BY 1, 2, 3, 4, 5) b
      ON b.stream_id = a.stream_id AND b.frame_id = a.frame_id AND b.level = a.level AND b.x = a.x
        AND b.y = least(greatest(a.y + t.i, 0), {UP * H - 1}) GROUP BY 1, 2, 3, 4, 5"""


@query(
    "m1_scale_extrema",
    f"""WITH base AS MATERIALIZED ({_blurred("v_large", "t.level = 0").replace("WHERE t.level", "WHERE level")}),
    up AS MATERIALIZED ({_blurred("base", "t.level > 0").replace("WHERE t.level", "WHERE level")}),
    g AS (SELECT stream_id, frame_id, level, y, x, l FROM base UNION ALL SELECT stream_id, frame_id, level, y, x, l FROM up),
    d AS MATERIALIZED (SELECT a.stream_id, a.frame_id, a.level, a.y, a.x, b.l - a.l AS value FROM g a JOIN g b
      ON b.stream_id = a.stream_id AND b.frame_id = a.frame_id AND b.y = a.y AND b.x = a.x AND b.level = a.level + 1),
    n AS (SELECT p.stream_id, p.frame_id, p.level, p.y, p.x, any_value(p.value) AS value, max(q.value) AS hi, min(q.value) AS lo FROM d p JOIN d q
      ON q.stream_id = p.stream_id AND q.frame_id = p.frame_id AND abs(q.level - p.level) <= 1 AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1
      AND (q.level <> p.level OR q.y <> p.y OR q.x <> p.x) GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = 26)
    SELECT stream_id, frame_id, level, y, x, round(value, 4) AS value FROM n WHERE (value > 1 AND value > hi) OR (value < -1 AND value < lo)""",
)
def _(spark, sf):
    large = PX.resize_frames(grays(spark, sf), UP * W, UP * H, col="gray")
    e = scale_extrema(large, 1.0)
    return e.select(*KEYS, "level", "y", "x", F.round("value", 4).alias("value"))


@query("p2_to_gray", "SELECT stream_id, frame_id, y, x, l AS c0 FROM v_gray")
def _(spark, sf):
    return PX.pixel_rows(grays(spark, sf), "gray").select(*KEYS, "y", "x", "c0")


@query(
    "p3_crop",
    "SELECT stream_id, frame_id, y - 2 AS y, x - 3 AS x, b AS c0, g AS c1, r AS c2 FROM v_px WHERE x BETWEEN 3 AND 10 AND y BETWEEN 2 AND 7",
)
def _(spark, sf):
    roi = F.struct(F.lit(3).alias("x"), F.lit(2).alias("y"), F.lit(8).alias("w"), F.lit(6).alias("h"))
    return PX.pixel_rows(PX.crop(images(spark, sf).withColumn("roi", roi)), "crop")


def _near(view: str, val: str, dy: str = "dy", dx: str = "dx") -> str:
    """Neighbours of every pixel with repeated edges."""
    return f"""SELECT p.stream_id, p.frame_id, p.y, p.x, dy, dx, n.{val} AS nv FROM {view} p
      CROSS JOIN (SELECT CAST(range AS INTEGER) - 1 AS dy FROM range(3)) a CROSS JOIN (SELECT CAST(range AS INTEGER) - 1 AS dx FROM range(3)) b
      JOIN {view} n ON n.stream_id = p.stream_id AND n.frame_id = p.frame_id AND n.y = least(greatest(p.y + dy, 0), {H - 1})
        AND n.x = least(greatest(p.x + dx, 0), {W - 1})"""


CORNER_SQL = f"""
nb AS ({_near('v_gray', 'l')}),
sob AS (SELECT stream_id, frame_id, y, x, sum(nv * dx * (2 - abs(dy))) / 3060.0 AS gx, sum(nv * dy * (2 - abs(dx))) / 3060.0 AS gy FROM nb GROUP BY 1, 2, 3, 4),
prod AS (SELECT stream_id, frame_id, y, x, CAST(gx AS DOUBLE) * gx AS xx, CAST(gx AS DOUBLE) * gy AS xy, CAST(gy AS DOUBLE) * gy AS yy FROM sob),
box AS (SELECT p.stream_id, p.frame_id, p.y, p.x, sum(n.xx) / 2 AS xx, sum(n.xy) AS xy, sum(n.yy) / 2 AS yy FROM prod p
  CROSS JOIN (SELECT CAST(range AS INTEGER) - 1 AS dy FROM range(3)) a CROSS JOIN (SELECT CAST(range AS INTEGER) - 1 AS dx FROM range(3)) b
  JOIN prod n ON n.stream_id = p.stream_id AND n.frame_id = p.frame_id AND n.y = least(greatest(p.y + dy, 0), {H - 1}) AND n.x = least(greatest(p.x + dx, 0), {W - 1})
  GROUP BY 1, 2, 3, 4),
resp AS (SELECT *, xx + yy - sqrt((xx - yy) * (xx - yy) + xy * xy) AS response FROM box)"""


@query(
    "t1_corner_response",
    f"""WITH {CORNER_SQL}
    SELECT stream_id, frame_id, (y - 1) // 2 AS i, (x - 1) // 2 AS j, x, y, round(response, 6) + 0.0 AS response, round(top, 6) + 0.0 AS top
    FROM (SELECT *, max(response) OVER (PARTITION BY stream_id, frame_id) AS top FROM resp) t WHERE x % 2 = 1 AND y % 2 = 1""",
)
def _(spark, sf):
    r = PX.corner_response(grays(spark, sf), 2.0)
    return r.select(*KEYS, "i", "j", "x", "y", (F.round("response", 6) + 0.0).alias("response"), (F.round("top", 6) + 0.0).alias("top"))


def _bins(view: str, val: str, gain: float = 1.0) -> str:
    """Gradient magnitude of each pixel, split over its two nearest of 8 angles."""
    return f"""SELECT stream_id, frame_id, y, x, bin, sum(m) AS m FROM (
      SELECT stream_id, frame_id, y, x, unnest([low % 8, (low + 1) % 8]) AS bin, unnest([mag * (1 - (f - low)), mag * (f - low)]) AS m FROM (
        SELECT * FROM (
          SELECT *, CAST(floor(f) AS INTEGER) AS low FROM (
            SELECT stream_id, frame_id, y, x, sqrt(gx * gx + gy * gy) AS mag,
              (CASE WHEN atan2(gy, gx) < 0 THEN degrees(atan2(gy, gx)) + 360 ELSE degrees(atan2(gy, gx)) END) / 45 AS f FROM (
              SELECT p.stream_id, p.frame_id, p.y, p.x, {gain} * (CAST(r.{val} AS DOUBLE) - l.{val}) AS gx, {gain} * (CAST(d.{val} AS DOUBLE) - u.{val}) AS gy
              FROM {view} p
              JOIN {view} r ON r.stream_id = p.stream_id AND r.frame_id = p.frame_id AND r.y = p.y AND r.x = least(p.x + 1, {W - 1})
              JOIN {view} l ON l.stream_id = p.stream_id AND l.frame_id = p.frame_id AND l.y = p.y AND l.x = greatest(p.x - 1, 0)
              JOIN {view} d ON d.stream_id = p.stream_id AND d.frame_id = p.frame_id AND d.x = p.x AND d.y = least(p.y + 1, {H - 1})
              JOIN {view} u ON u.stream_id = p.stream_id AND u.frame_id = p.frame_id AND u.x = p.x AND u.y = greatest(p.y - 1, 0)) g) a) b) c) e
      GROUP BY 1, 2, 3, 4, 5"""


VIEWS["v_hog"] = _bins("v_gray", "l")
VIEWS["v_mbhx"] = _bins("v_px", "u", 100.0)
VIEWS["v_mbhy"] = _bins("v_px", "v", 100.0)


def _hist_sql(view: str, extra: str = "") -> str:
    return f"SELECT {extra}stream_id, frame_id, bin, round(sum(m), 4) + 0.0 AS value FROM {view} GROUP BY stream_id, frame_id, bin"


HOF_SQL = """SELECT stream_id, frame_id, bin, round(sum(m), 4) + 0.0 AS value FROM (
  SELECT stream_id, frame_id, unnest([CASE WHEN still THEN 8 ELSE low % 8 END, (low + 1) % 8]) AS bin,
    unnest([CASE WHEN still THEN 1 ELSE mag * (1 - (f - low)) END, CASE WHEN still THEN 0 ELSE mag * (f - low) END]) AS m FROM (
    SELECT *, mag <= 0.16 AS still FROM (
      SELECT *, CAST(floor(f) AS INTEGER) AS low FROM (
        SELECT stream_id, frame_id, sqrt(u * u + v * v) AS mag,
          (CASE WHEN atan2(v, u) < 0 THEN degrees(atan2(v, u)) + 360 ELSE degrees(atan2(v, u)) END) / 45 AS f FROM v_px) a) b) c
  UNION ALL SELECT stream_id, frame_id, CAST(range AS INTEGER), 0 FROM v_whole CROSS JOIN range(9)) d
  GROUP BY 1, 2, 3"""


@query("d1_orientation_hist", HOF_SQL)
def _(spark, sf):
    h = PX.flow_histogram(flows(spark, sf))
    return h.select(*KEYS, F.posexplode("hist").alias("bin", "value")).select(*KEYS, "bin", (F.round("value", 4) + 0.0).alias("value"))


@query("d2_hog", _hist_sql("v_hog"))
def _(spark, sf):
    h = PX.gradient_histogram(grays(spark, sf))
    return h.select(*KEYS, F.posexplode("hist").alias("bin", "value")).select(*KEYS, "bin", (F.round("value", 4) + 0.0).alias("value"))


@query("d3_mbh", _hist_sql("v_mbhx", "'x' AS axis, ") + " UNION ALL " + _hist_sql("v_mbhy", "'y' AS axis, "))
def _(spark, sf):
    h = PX.motion_histogram(flows(spark, sf))
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"mbh.{a}").alias("hist")) for a in "xy"]))
    out = h.select(*KEYS, each.alias("_h")).select("_h.axis", *KEYS, F.posexplode("_h.hist").alias("bin", "value"))
    return out.withColumn("value", F.round("value", 4) + 0.0)


@query(
    "d4_block_rect",
    """SELECT trace_id, idx, least(greatest(x - 16, 0.0), 608.0) AS bx, least(greatest(y - 16, 0.0), 448.0) AS by_ FROM v_pts""",
)
def _(spark, sf):
    p = track_points(spark, sf)
    return p.select(
        "trace_id", "idx", S.block_origin(F.col("x"), 32, F.lit(640)).alias("bx"), S.block_origin(F.col("y"), 32, F.lit(480)).alias("by_")
    )


def points(spark, sf):
    """Live points of whole frames, numbered by their place."""
    p = live(spark, sf)
    return p.select(*KEYS, F.format_string("%.2f_%.2f", "x", "y").alias("trace_id"), F.lit(0).alias("idx"), "x", "y")


def _desc_sql(view: str, name: str) -> str:
    """Cells of 2 x 2 pixels (block 8 over 3 temporal cells) around each live point."""
    return f"""SELECT * FROM (WITH pt AS (SELECT l.stream_id, l.frame_id, l.x, l.y, CAST(trunc(least(greatest(l.x - 4, 0), {W - 8})) AS INTEGER) AS x0,
        CAST(trunc(least(greatest(l.y - 4, 0), {H - 8})) AS INTEGER) AS y0 FROM v_live l JOIN v_whole USING (stream_id, frame_id)),
      slot AS (SELECT *, CAST(a.range AS INTEGER) AS ci, CAST(b.range AS INTEGER) AS cj, CAST(c.range AS INTEGER) AS bin FROM pt CROSS JOIN range(2) a CROSS JOIN range(2) b CROSS JOIN range(8) c),
      val AS (SELECT s.stream_id, s.frame_id, s.x, s.y, ci * 16 + cj * 8 + s.bin AS pos, coalesce(sum(m), 0) + 0.05 AS v FROM slot s LEFT JOIN {view} h
        ON h.stream_id = s.stream_id AND h.frame_id = s.frame_id AND h.bin = s.bin AND h.x BETWEEN x0 + ci * 2 AND least(x0 + ci * 2 + 1, {W - 1})
        AND h.y BETWEEN y0 + cj * 2 AND least(y0 + cj * 2 + 1, {H - 1}) GROUP BY 1, 2, 3, 4, 5)
      SELECT '{name}' AS channel, stream_id, frame_id, x, y, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY stream_id, frame_id, x, y) + 1e-10), 4) AS value FROM val) {name}"""


@query("d5_block_descriptor", " UNION ALL ".join(_desc_sql(f"v_{c}", c) for c in ("hog", "mbhx", "mbhy")))
def _(spark, sf):
    fr = grays(spark, sf).join(flows(spark, sf), KEYS)
    d = PX.point_descriptors(fr, points(spark, sf), BLOCKS)
    xy = F.split("trace_id", "_")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("cells")) for c in ("hog", "mbhx", "mbhy")]))
    d = d.select(*KEYS, xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"), each.alias("_c"))
    out = d.select("_c.channel", *KEYS, "x", "y", F.posexplode("_c.cells").alias("pos", "value"))
    return out.withColumn("value", F.round("value", 4))


@query(
    "a8_mean_pool",
    """SELECT CAST(vec_id // 15 AS VARCHAR) AS trace_id, CAST((vec_id % 15) // 5 AS INTEGER) AS cell, CAST(d AS INTEGER) AS d,
    round(avg(CAST(embedding[d + 1] AS DOUBLE)), 4) + 0.0 AS value FROM embeddings CROSS JOIN (SELECT range AS d FROM range(64)) r GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.lit(0).alias("stream_id"), F.expr("CAST(vec_id div 15 AS string)").alias("trace_id"), (F.col("vec_id") % 15).cast("int").alias("idx"),
        F.transform("embedding", lambda v: v.cast("double")).alias("hog"),
    )
    m = PX.mean_pool(e, ["hog"], 64)
    return m.select("trace_id", "cell", F.posexplode("hog").alias("d", "value")).withColumn("value", F.round("value", 4) + 0.0)


def finished_points(spark, sf):
    """Points of finished tracks with the frame each belongs to."""
    t = T.trace_points(tracked(spark, sf).filter("status = 'finished'"))
    return t.withColumn("frame_id", (F.col("end_frame") - 15 + F.col("idx")).cast("int"))


# The recursion of the tracker keeps every step of every trace.
D6_SQL = (
    TRACK_SQL.split("\nSELECT r.stream_id")[0]
    + f""",
fin AS (SELECT stream_id, trace_id FROM run WHERE status = 'finished'),
pt AS (SELECT r.stream_id, r.trace_id, r.frame_id, r.n - 1 AS idx, CAST(trunc(least(greatest(r.x - 4, 0), {W - 8})) AS INTEGER) AS x0,
  CAST(trunc(least(greatest(r.y - 4, 0), {H - 8})) AS INTEGER) AS y0 FROM run r JOIN fin USING (stream_id, trace_id) WHERE r.status = 'live' AND r.n <= 15),
bins AS (SELECT 0 AS ch, stream_id, frame_id, y, x, bin, m FROM v_hog UNION ALL SELECT 1, stream_id, frame_id - 1, y, x, bin, m FROM v_mbhx
  UNION ALL SELECT 2, stream_id, frame_id - 1, y, x, bin, m FROM v_mbhy),
slot AS (SELECT pt.*, CAST(a.range AS INTEGER) AS ci, CAST(b.range AS INTEGER) AS cj, CAST(c.range AS INTEGER) AS bin, CAST(e.range AS INTEGER) AS ch
  FROM pt CROSS JOIN range(2) a CROSS JOIN range(2) b CROSS JOIN range(8) c CROSS JOIN range(3) e),
val AS (SELECT s.stream_id, s.trace_id, s.idx, s.ch, ci * 16 + cj * 8 + s.bin AS pos, coalesce(sum(m), 0) + 0.05 AS v FROM slot s
  JOIN (SELECT DISTINCT ch, stream_id, frame_id FROM bins) k ON k.ch = s.ch AND k.stream_id = s.stream_id AND k.frame_id = s.frame_id
  LEFT JOIN bins h ON h.ch = s.ch AND h.stream_id = s.stream_id AND h.frame_id = s.frame_id AND h.bin = s.bin
    AND h.x BETWEEN x0 + ci * 2 AND least(x0 + ci * 2 + 1, {W - 1}) AND h.y BETWEEN y0 + cj * 2 AND least(y0 + cj * 2 + 1, {H - 1}) GROUP BY 1, 2, 3, 4, 5),
unit AS (SELECT *, v / sqrt(sum(v * v) OVER (PARTITION BY stream_id, trace_id, idx, ch) + 1e-10) AS u FROM val),
pool AS (SELECT stream_id, trace_id, ch * 96 + (idx // 5) * 32 + pos AS pos, avg(u) AS value FROM unit GROUP BY 1, 2, 3)
SELECT stream_id, trace_id, CAST(pos AS INTEGER) AS pos, round(value, 3) AS value FROM pool"""
)


def trace_table(spark, sf):
    """Feature vectors of finished traces.

    Histogram ``end - 14 + i`` is built on the image of point ``i``, one frame earlier.
    """
    fr = grays(spark, sf).join(flows(spark, sf).withColumn("frame_id", F.col("frame_id") - 1), KEYS)
    p = finished_points(spark, sf)
    d = PX.point_descriptors(fr, p.filter("idx < 15"), BLOCKS)
    ends = p.filter("idx = 0").select("stream_id", "trace_id", "end_frame")
    return PX.trace_features(d, BLOCKS).join(ends, ["stream_id", "trace_id"])


@query("d6_trace_features", D6_SQL)
def _(spark, sf):
    e = trace_table(spark, sf).select("stream_id", "trace_id", F.posexplode("feat").alias("pos", "value"))
    return e.withColumn("value", F.round(F.col("value").cast("double"), 3))


@query("t4_dense_flow")
def _(spark, sf):
    pairs = SF.pair_with_previous(grays(spark, sf), ["gray"], costly=True)
    r = PX.flow_rows(PX.dense_flow(pairs))
    return r.select(*KEYS, "y", F.size("u").alias("width"), F.round(F.array_max("u"), 3).alias("max_u"))


# Patches of 8 x 6 every 4 x 3 pixels; keypoints every 2 pixels with blocks of 4.
M1_SQL = f"""WITH patch AS (SELECT stream_id, frame_id, CAST(i * 3 + j AS INTEGER) AS patch_no, i * 4 AS rx, j * 3 AS ry FROM v_whole
    CROSS JOIN (SELECT range AS i FROM range(3)) a CROSS JOIN (SELECT range AS j FROM range(3)) b),
  kp AS (SELECT *, 2 + 2 * kx AS x, 2 + 2 * ky AS y FROM patch CROSS JOIN (SELECT range AS ky FROM range(2)) a CROSS JOIN (SELECT range AS kx FROM range(3)) b),
  cell AS (SELECT kp.stream_id, kp.frame_id, patch_no, kp.x, kp.y, (h.x - (rx + kp.x - 2)) // 2 * 16 + (h.y - (ry + kp.y - 2)) // 2 * 8 + bin AS pos, sum(m) AS m
    FROM kp JOIN v_hog h ON h.stream_id = kp.stream_id AND h.frame_id = kp.frame_id AND h.x BETWEEN rx + kp.x - 2 AND rx + kp.x + 1
      AND h.y BETWEEN ry + kp.y - 2 AND ry + kp.y + 1 GROUP BY 1, 2, 3, 4, 5, 6),
  kept AS (SELECT stream_id, frame_id, patch_no, x, y, max(m) + 0.05 AS hi, sum((m + 0.05) * (m + 0.05)) + (32 - count(*)) * 0.0025 AS ss FROM cell
    GROUP BY 1, 2, 3, 4, 5 HAVING sum(m) >= 1)
  SELECT stream_id, frame_id, patch_no, CAST(row_number() OVER (PARTITION BY stream_id, frame_id, patch_no ORDER BY y, x) - 1 AS INTEGER) AS kp,
    CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, round(hi / sqrt(ss + 1e-10), 4) AS top FROM kept"""


@query("m1_patch_descriptors", M1_SQL)
def _(spark, sf):
    g = grays(spark, sf)
    sizes = g.select(*KEYS, F.col("gray.width").alias("width"), F.col("gray.height").alias("height"))
    patches = G.grid_patches(sizes, Tiling(0.5, 0.5))
    d = PX.patch_descriptors(g, patches, step=2, b=Blocks(size=4))
    return d.select(*KEYS, "patch_no", "kp", "x", "y", F.round(F.array_max("descr"), 4).alias("top"))


RECT = ("frame_id % 8", "frame_id % 5", "frame_id % 8 + 7", "frame_id % 5 + 6")


@query(
    "p18_rasterize",
    f"""SELECT stream_id, frame_id, y, x, CASE WHEN hit THEN 255 ELSE b END AS c0, CASE WHEN hit THEN 0 ELSE g END AS c1, CASE WHEN hit THEN 255 ELSE r END AS c2
    FROM (SELECT *, x BETWEEN {RECT[0]} AND {RECT[2]} AND y BETWEEN {RECT[1]} AND {RECT[3]}
      AND (x IN ({RECT[0]}, {RECT[2]}) OR y IN ({RECT[1]}, {RECT[3]})) AS hit FROM v_px) t""",
)
def _(spark, sf):
    im = images(spark, sf)
    box = im.select(
        *KEYS, F.lit(0).alias("logo_index"), F.expr(RECT[0]).alias("x"), F.expr(RECT[1]).alias("y"), F.lit(7).alias("w"), F.lit(6).alias("h")
    )
    seg = O.colored(O.rect_outline(box, thick=1)).withColumn("z", F.lit(0))
    return PX.pixel_rows(O.rasterize(im, seg))


@query(
    "j10_stack_frames",
    f"""SELECT stream_id, frame_id, y, x, b AS c0, g AS c1, r AS c2 FROM v_px UNION ALL
    SELECT stream_id, frame_id, y + {H}, x, b, g, r FROM v_px""",
)
def _(spark, sf):
    im = images(spark, sf)
    return PX.pixel_rows(PX.stack_frames(im, im))
