"""Sources, projections, generators, detections and their joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from vidspark.functions import scalar as S
from vidspark.operators import bank as B
from vidspark.operators import detections as D
from vidspark.operators import encoding as E
from vidspark.operators import overlay as O
from vidspark.operators import tiling as G
from vidspark.params import Display
from vidspark.plans.scale import fresh_path
from vidspark.registry.core import cell_frames, detections, frames, query, raw_frames, table
from vidspark.registry.core import track_points
from vidspark.sources import frames as SF
from vidspark.sources import models as SM
from vidspark.sources import sinks as SK
from vidspark.sources import trajectories as ST

FAR = 1_000_000_000


@query("s3_assign_frame_ids", "SELECT event_id, stream_id, frame_id FROM v_frames")
def _(spark, sf):
    return frames(spark, sf).select("event_id", "stream_id", "frame_id")


@query("s3_assign_frame_ids_sliced", "SELECT event_id, stream_id, frame_id FROM v_frames")
def _(spark, sf):
    """The form for streams of more rows than one task sorts."""
    f = SF.assign_frame_ids(frames(spark, sf, numbered_ids=False), ["ts", "event_id"], slice_rows=500)
    return f.select("event_id", "stream_id", "frame_id")


@query(
    "s4_frame_range",
    f"SELECT stream_id, frame_id, event_id FROM v_frames WHERE frame_id >= 100 AND frame_id < {FAR}",
)
def _(spark, sf):
    return SF.frame_range(frames(spark, sf), 100, FAR).select("stream_id", "frame_id", "event_id")


@query(
    "s4_frame_range_rebased",
    "SELECT stream_id, frame_id - 100 AS frame_id, event_id FROM v_frames WHERE frame_id >= 100",
)
def _(spark, sf):
    return SF.frame_range(frames(spark, sf), 100, FAR, rebase=True).select("stream_id", "frame_id", "event_id")


@query(
    "s5_sample_split",
    """SELECT 'raw' AS branch, stream_id, frame_id, CAST(NULL AS INTEGER) AS sample_id FROM v_frames
    UNION ALL SELECT 'sample', stream_id, frame_id, CAST(frame_id // 5 AS INTEGER) FROM v_frames
    WHERE frame_id % 5 = 0""",
)
def _(spark, sf):
    raw, sample = SF.sample_split(frames(spark, sf), 5)
    none = F.lit(None).cast("int").alias("sample_id")
    a = raw.select(F.lit("raw").alias("branch"), "stream_id", "frame_id", none)
    return a.unionByName(sample.select(F.lit("sample").alias("branch"), "stream_id", "frame_id", "sample_id"))


@query(
    "s6_pair_with_previous",
    """SELECT b.stream_id, b.frame_id, b.value, a.value AS prev_value FROM v_frames a JOIN v_frames b
    ON a.stream_id = b.stream_id AND b.frame_id = a.frame_id + 1""",
)
def _(spark, sf):
    f = frames(spark, sf).select("stream_id", "frame_id", "value")
    return SF.pair_with_previous(f, ["value"])


@query(
    "s8_copy_range",
    f"SELECT stream_id, frame_id, event_id FROM v_frames WHERE frame_id >= 50 AND frame_id < {FAR}",
)
def _(spark, sf):
    path = fresh_path(spark, "copy")
    SF.copy_range(frames(spark, sf).select("stream_id", "frame_id", "event_id"), 50, FAR, path)
    return spark.read.parquet(path)


@query(
    "s11_write_video_range",
    f"SELECT stream_id, frame_id, value FROM v_frames WHERE frame_id >= 10 AND frame_id < {FAR}",
)
def _(spark, sf):
    path = fresh_path(spark, "video")
    SK.write_video_range(frames(spark, sf).select("stream_id", "frame_id", "value"), 10, FAR, path)
    return spark.read.parquet(path)


@query(
    "s12_features",
    """SELECT vec_id, CAST(label <> 0 AS INTEGER) AS accepted, CASE WHEN label = 0 THEN 60 ELSE 64 END AS dim
    FROM embeddings WHERE vec_id // 5 >= 2""",
)
def _(spark, sf):
    path = fresh_path(spark, "features")
    e = table(spark, sf, "embeddings")
    feat = F.when(F.col("label") == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    rows = e.select(
        F.lit(0).alias("stream_id"), F.expr("CAST(vec_id div 5 AS int)").alias("frame_id"), "vec_id",
        F.col("vec_id").cast("string").alias("trace_id"), feat.alias("feat"),
    )
    SK.write_features(rows, path)
    good, bad = SK.read_features(spark, path, 2, FAR, 64)
    both = good.withColumn("accepted", F.lit(1)).unionByName(bad.withColumn("accepted", F.lit(0)))
    return both.select("vec_id", "accepted", F.size("feat").alias("dim"))


def _write_lines(df, path):
    """(pos, value) rows as text files whose name order is the row order."""
    df.repartitionByRange("pos").sortWithinPartitions("pos").select("value").write.text(path)


def _joined(arr):
    return F.array_join(F.transform(arr, lambda v: v.cast("string")), " ")


PCA_SQL = """
SELECT 'proj' AS item, k, d, CAST((k * 7 + d * 3) % 11 - 5 AS DOUBLE) / 8 + 0.0 AS value
FROM (SELECT CAST(range AS INTEGER) AS k FROM range(10)) a CROSS JOIN
  (SELECT CAST(range AS INTEGER) AS d FROM range(64)) b
UNION ALL SELECT 'mean', 0, d, round(avg(CAST(embedding[d + 1] AS DOUBLE)), 6) + 0.0
FROM embeddings CROSS JOIN (SELECT CAST(range AS INTEGER) AS d FROM range(64)) b GROUP BY d
UNION ALL SELECT 'eig', k, 0, CAST(k + 1 AS DOUBLE) FROM (SELECT CAST(range AS INTEGER) AS k FROM range(10)) a
"""


@query("s14_load_pca", PCA_SQL)
def _(spark, sf):
    path = fresh_path(spark, "pca")
    means = table(spark, sf, "embeddings").agg(
        F.array(*[F.round(F.avg(F.col("embedding")[d].cast("double")), 6) for d in range(64)]).alias("m")
    )
    proj = F.array(*[F.lit(((k * 7 + d * 3) % 11 - 5) / 8) for k in range(10) for d in range(64)])
    eig = F.array(*[F.lit(float(k + 1)) for k in range(10)])
    rows = means.select(
        F.posexplode(F.array(F.lit("64 10"), _joined(proj), _joined(F.col("m")), _joined(eig))).alias("pos", "value")
    )
    _write_lines(rows, path)
    m = SM.load_pca(spark, path)
    zero = F.lit(0)
    return (
        m["proj"].select(F.lit("proj").alias("item"), "k", "d", "value")
        .unionByName(m["mean"].select(F.lit("mean").alias("item"), zero.alias("k"), "d", F.round("value", 6).alias("value")))
        .unionByName(m["eig"].select(F.lit("eig").alias("item"), "k", zero.alias("d"), "value"))
    )


@query(
    "s15_load_gmm",
    """SELECT k, d, round(mean, 6) + 0.0 AS mean, round(var, 6) AS var, round(prior, 6) AS prior,
    round(sqrt(prior), 6) AS sqrt_prior FROM v_gmm""",
)
def _(spark, sf):
    from vidspark.registry.encoding import gmm

    path = fresh_path(spark, "gmm")
    g = gmm(spark, sf)
    cells = F.sort_array(F.collect_list(F.struct("k", "d", "mean", "var", "prior")))
    rows = g.agg(cells.alias("c"), (F.max("d") + 1).alias("nd"), (F.max("k") + 1).alias("nk"))
    pri = F.transform(F.filter("c", lambda x: x["d"] == 0), lambda x: x["prior"])
    head = F.concat_ws(" ", F.col("nd").cast("string"), F.col("nk").cast("string"))
    rows = rows.select(F.posexplode(F.array(
        head, _joined(F.col("c.mean")), _joined(F.col("c.var")), _joined(pri))).alias("pos", "value"))
    _write_lines(rows, path)
    m = SM.load_gmm(spark, path)
    return m.select("k", "d", *[(F.round(c, 6) + 0.0).alias(c) for c in ("mean", "var", "prior", "sqrt_prior")])


@query(
    "s16_load_class_weights",
    """SELECT label AS class, CAST(d AS INTEGER) AS d, round(avg(CAST(embedding[d + 1] AS DOUBLE)), 6) + 0.0 AS w
    FROM embeddings CROSS JOIN (SELECT range AS d FROM range(64)) r GROUP BY 1, 2""",
)
def _(spark, sf):
    path = fresh_path(spark, "weights")
    e = table(spark, sf, "embeddings")
    w = e.groupBy("label").agg(F.array(*[F.avg(F.col("embedding")[d].cast("double")) for d in range(64)]).alias("m"))
    _write_lines(w.select(F.col("label").alias("pos"), _joined(F.col("m")).alias("value")), path)
    good, _bad = SM.load_class_weights(spark, path, 64)
    return good.select("class", "d", (F.round("w", 6) + 0.0).alias("w"))


@query(
    "s17_load_training_features",
    """SELECT vec_id AS line, 64 AS dim, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 4) + 0.0 AS total
    FROM embeddings""",
)
def _(spark, sf):
    path = fresh_path(spark, "train")
    e = table(spark, sf, "embeddings")
    info = F.array_repeat(F.col("vec_id").cast("double"), 39)
    feat = F.transform("embedding", lambda v: v.cast("double"))
    _write_lines(e.select(F.col("vec_id").alias("pos"), _joined(F.concat(info, feat)).alias("value")), path)
    t = SM.load_training_features(spark, path)
    total = F.aggregate("feat", F.lit(0.0), lambda a, v: a + v)
    return t.select("line", F.size("feat").alias("dim"), (F.round(total, 4) + 0.0).alias("total"))


TRAJ_SQL = """
full_t AS (SELECT user_id, chunk, list(x ORDER BY idx) AS xs, list(y ORDER BY idx) AS ys FROM v_pts
  GROUP BY 1, 2 HAVING count(*) = 16),
lines AS (SELECT row_number() OVER (ORDER BY user_id, chunk) - 1 AS line, * FROM full_t)"""


def trajectory_file(spark, sf) -> str:
    """All complete traces as a trajectory text file; end frame is the chunk's last frame."""
    path = fresh_path(spark, "traj")
    p = track_points(spark, sf)
    g = p.groupBy("user_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y"))).alias("p"))
    g = g.filter(F.size("p") == 16)
    xy = F.flatten(F.transform("p", lambda s: F.array(s["x"], s["y"])))
    info = F.array(F.col("chunk") * 16.0 + 15.0, *[F.lit(0.0)] * 6)
    _write_lines(g.select(F.struct("user_id", "chunk").alias("pos"), _joined(F.concat(info, xy)).alias("value")), path)
    return path


@query(
    "s18_load_trajectories",
    f"""WITH {TRAJ_SQL}
    SELECT CAST(line // 3 AS BIGINT) AS traj, chunk * 16 + 15 AS end_frame, list_sum(xs) AS sum_x, ys[16] AS last_y
    FROM lines WHERE line % 3 = 0""",
)
def _(spark, sf):
    t = ST.load_trajectories(spark, trajectory_file(spark, sf), 3)
    total = F.aggregate("pts", F.lit(0.0), lambda a, p: a + p["x"])
    return t.select("traj", "end_frame", total.alias("sum_x"), F.col("pts")[15]["y"].alias("last_y"))


@query(
    "s19_merge_groups",
    """SELECT c_custkey AS line, c_nationkey + 1 AS group_id FROM customer UNION ALL
    SELECT s_suppkey + 1 + (SELECT max(c_custkey) FROM customer),
      s_nationkey + 1 + (SELECT max(c_nationkey) + 1 FROM customer) FROM supplier""",
)
def _(spark, sf):
    a = table(spark, sf, "customer").selectExpr("c_custkey AS line", "c_nationkey + 1 AS group_id")
    b = table(spark, sf, "supplier").selectExpr("s_suppkey AS line", "s_nationkey + 1 AS group_id")
    return ST.merge_groups(a, b)


@query(
    "s20_write_trajectory_text",
    """SELECT concat_ws(' ', CAST(CAST(user_id AS DOUBLE) AS VARCHAR), CAST(CAST(chunk AS DOUBLE) AS VARCHAR),
      array_to_string(list_transform(list(x ORDER BY idx), lambda v: CAST(v AS VARCHAR)), ' '),
      array_to_string(list_transform(list(y ORDER BY idx), lambda v: CAST(v AS VARCHAR)), ' '),
      CAST(CAST(count(*) AS DOUBLE) AS VARCHAR)) AS value FROM v_pts GROUP BY user_id, chunk""",
)
def _(spark, sf):
    path = fresh_path(spark, "trajtext")
    g = track_points(spark, sf).groupBy("user_id", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("idx", "x", "y"))).alias("p")
    )
    rows = g.select(
        F.array(F.col("user_id").cast("double"), F.col("chunk").cast("double")).alias("info"),
        F.col("p.x").alias("xy"), F.col("p.y").alias("desc"), F.array(F.size("p").cast("double")).alias("shape"),
    )
    ST.write_trajectory_text(rows, path)
    return spark.read.text(path)


@query("p4_frames_due", "SELECT stream_id, frame_id FROM v_frames WHERE (frame_id - 1) % 3 = 0")
def _(spark, sf):
    return frames(spark, sf).filter(S.is_due("frame_id", 3, 1)).select("stream_id", "frame_id")


@query(
    "p5_patch_key",
    """SELECT stream_id, frame_id, x, y, w, h, concat(printf('N%04d', frame_id), CASE WHEN found = 0 THEN '@null'
    ELSE printf('@%d@%d@%d@%d', x, y, x + w, y + h) END) AS patch_key FROM v_det""",
)
def _(spark, sf):
    d = detections(spark, sf)
    roi = F.when(F.col("found") == 1, D.rect())
    return d.select("stream_id", "frame_id", *"xywh", S.patch_key(F.col("frame_id"), roi).alias("patch_key"))


HASH_SQL = """CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(trace_id, ''),
  lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b:
  ((a * 31 + b + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS BIGINT)"""


@query(
    "p6_string_hash",
    f"""SELECT trace_id, {HASH_SQL} AS hash, CAST(abs({HASH_SQL}) % 8 AS INTEGER) AS target
    FROM (SELECT DISTINCT trace_id FROM v_pts) t""",
)
def _(spark, sf):
    t = track_points(spark, sf).select("trace_id").distinct()
    c = F.col("trace_id")
    return t.select("trace_id", S.string_hash(c).alias("hash"), S.route(c, 8).alias("target"))


@query("p7_thin_traces", f"SELECT trace_id, idx, x, y FROM v_pts WHERE abs({HASH_SQL}) % 4 > 0")
def _(spark, sf):
    p = track_points(spark, sf)
    return p.filter(S.keep_trace(F.col("trace_id"), 4)).select("trace_id", "idx", "x", "y")


# Outlines: a detection's box pushed around by its own numbers.
QUAD = [
    ("x + w % 5", "y + h % 7"),
    ("x + w - x % 9", "y + y % 11"),
    ("x + w + x % 13", "y + h - w % 6"),
    ("x - y % 8", "y + h + x % 5 - 2"),
]
QUAD_SQL = ", ".join(
    f"CAST({a} AS DOUBLE) AS x{i}, CAST({b} AS DOUBLE) AS y{i}" for i, (a, b) in enumerate(QUAD)
)
TURNS = " AND ".join(
    f"(x{(i - 1) % 4} - x{i}) * (y{(i + 1) % 4} - y{i}) - (x{(i + 1) % 4} - x{i}) * (y{(i - 1) % 4} - y{i}) <= 0.01"
    for i in range(4)
)
SHOE = " + ".join(f"x{i} * y{(i + 1) % 4} - x{(i + 1) % 4} * y{i}" for i in range(4))


@query(
    "p8_quad_valid",
    f"""WITH q AS (SELECT stream_id, frame_id, patch_no, w, h, {QUAD_SQL} FROM v_det),
    b AS (SELECT *, greatest(0, x0, x1, x2, x3) - least(x0, x1, x2, x3) AS bw,
      greatest(0, y0, y1, y2, y3) - least(y0, y1, y2, y3) AS bh FROM q)
    SELECT stream_id, frame_id, patch_no, CAST(bw >= 10 AND bh >= 10 AND bw <= 2 * 40 AND bh <= 2 * 35
      AND abs({SHOE}) >= 0.5 * bw * bh AND {TURNS} AS INTEGER) AS valid FROM b""",
)
def _(spark, sf):
    d = detections(spark, sf, patch_no=True)
    d = d.selectExpr(
        "stream_id", "frame_id", "patch_no",
        *[f"CAST({e} AS double) AS {n}{i}" for i, p in enumerate(QUAD) for n, e in zip("xy", p)],
    )
    q = [(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4)]
    ok = S.quad_valid(q, F.lit(40), F.lit(35))
    return d.select("stream_id", "frame_id", "patch_no", ok.cast("int").alias("valid"))


@query(
    "p9_project_corners",
    """WITH b AS (SELECT stream_id, frame_id, patch_no, greatest(x - 64.0, 0.0) AS x0, least(x + w + 64.0, 639.0) AS x1,
      greatest(y - 48.0, 0.0) AS y0, least(y + h + 48.0, 479.0) AS y1 FROM v_det),
    c AS (SELECT stream_id, frame_id, patch_no, i, CASE WHEN i IN (0, 3) THEN x0 ELSE x1 END AS cx,
      CASE WHEN i < 2 THEN y0 ELSE y1 END AS cy FROM b CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range(4)) r)
    SELECT stream_id, frame_id, patch_no, i AS corner,
      round(CAST(1.5 * cx + 0.25 * cy + 7 AS DOUBLE) / CAST(0.0009765625 * cx + 0.00048828125 * cy + 1 AS DOUBLE), 4) AS px,
      round(CAST(-0.125 * cx + 1.25 * cy + 3 AS DOUBLE) / CAST(0.0009765625 * cx + 0.00048828125 * cy + 1 AS DOUBLE), 4) + 0.0 AS py
    FROM c""",
)
def _(spark, sf):
    d = detections(spark, sf, patch_no=True)
    h = [F.lit(v) for v in (1.5, 0.25, 7.0, -0.125, 1.25, 3.0, 0.0009765625, 0.00048828125, 1.0)]
    q = S.project_corners(h, D.rect(), F.lit(640), F.lit(480))
    cs = F.array(*[F.struct(F.lit(i).alias("corner"), F.round(a, 4).alias("px"), (F.round(b, 4) + 0.0).alias("py"))
                   for i, (a, b) in enumerate(q)])
    return d.select("stream_id", "frame_id", "patch_no", F.explode(cs).alias("c")).select(
        "stream_id", "frame_id", "patch_no", "c.*"
    )


@query(
    "p10_found_rect",
    f"""WITH q AS (SELECT stream_id, frame_id, patch_no, {QUAD_SQL} FROM v_det),
    b AS (SELECT stream_id, frame_id, patch_no,
      greatest(0, CAST(trunc(least(x0, x1, x2, x3) + 0.5) AS INTEGER)) AS ax,
      least(600, CAST(trunc(greatest(0, x0, x1, x2, x3) + 0.5) AS INTEGER)) AS bx,
      greatest(0, CAST(trunc(least(y0, y1, y2, y3) + 0.5) AS INTEGER)) AS ay,
      least(440, CAST(trunc(greatest(0, y0, y1, y2, y3) + 0.5) AS INTEGER)) AS by_ FROM q)
    SELECT stream_id, frame_id, patch_no, ax + 11 AS x, ay + 13 AS y, bx - ax AS w, by_ - ay AS h FROM b""",
)
def _(spark, sf):
    d = detections(spark, sf, patch_no=True)
    q = [(F.expr(f"CAST({a} AS double)") + 0.5, F.expr(f"CAST({b} AS double)") + 0.5) for a, b in QUAD]
    r = S.found_rect(q, F.lit(600), F.lit(440), F.lit(11), F.lit(13))
    return d.select("stream_id", "frame_id", "patch_no", r.alias("r")).select(
        "stream_id", "frame_id", "patch_no", "r.*"
    )


@query(
    "p11_display_state",
    """WITH a AS (SELECT stream_id, frame_id, frame_id - 45 AS adj FROM v_frames),
    b AS (SELECT *, (adj % 75) // 15 AS sec FROM a)
    SELECT stream_id, frame_id, CASE WHEN adj >= 0 THEN CAST(adj // 75 AS INTEGER) END AS win,
      CASE WHEN adj < 0 THEN 'title' WHEN sec < 3 THEN 'detecting' ELSE 'action' END AS state,
      CASE WHEN adj >= 0 AND sec < 3 THEN CAST((2 + sec) * 100 // 5 AS INTEGER) END AS percent FROM b""",
)
def _(spark, sf):
    d = O.display_state(frames(spark, sf).select("stream_id", "frame_id"), Display())
    return d.select("stream_id", "frame_id", "win", "state", "percent")


ACTION_CASE = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(S.ACTIONS))


@query(
    "p12_action_name",
    f"""SELECT event_id, CAST(CAST(floor(value) AS BIGINT) % 9 - 1 AS INTEGER) AS id,
    CASE CAST(floor(value) AS BIGINT) % 9 - 1 {ACTION_CASE} ELSE 'unknown' END AS action FROM events""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr("CAST(CAST(floor(value) AS bigint) % 9 - 1 AS int)").alias("id"))
    return e.withColumn("action", S.action_name(F.col("id")))


@query(
    "p13_class_from_name",
    "SELECT doc_id, CASE " + " ".join(f"WHEN contains(text, '{n}') THEN {i}" for i, n in enumerate(S.ACTIONS))
    + " ELSE -1 END AS class FROM documents",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.class_from_name(F.col("text")).alias("class"))


_LEVEL = "CAST((group_id * 7919 + {} * 104729 + 11 * 1299709) % 2147483647 * 48271 % 2147483647 % 255 AS INTEGER) AS {}"


@query(
    "p14_group_palette",
    "SELECT group_id, " + ", ".join(_LEVEL.format(c, n) for c, n in enumerate("bgr"))
    + " FROM (SELECT unnest(range(1, max(c_custkey) + 1)) AS group_id FROM customer) t",
)
def _(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS group_id")
    return O.group_palette(c, 11).select("group_id", "color.*")


@query(
    "p15_logo_color",
    """SELECT stream_id, frame_id, patch_no, CASE (logo_index + patch_no) % 7 WHEN 0 THEN '255,0,255' WHEN 1 THEN '0,255,255'
    WHEN 2 THEN '255,255,0' WHEN 3 THEN '255,0,0' WHEN 4 THEN '0,255,0' WHEN 5 THEN '0,0,255' ELSE '0,0,0' END AS bgr
    FROM v_det""",
)
def _(spark, sf):
    d = detections(spark, sf, patch_no=True)
    c = S.logo_color(F.col("logo_index") + F.col("patch_no"))
    text = F.concat_ws(",", *[c[k].cast("string") for k in "bgr"])
    return d.select("stream_id", "frame_id", "patch_no", text.alias("bgr"))


@query(
    "p16_rect_outline",
    """SELECT stream_id, frame_id, patch_no, side, CAST(CASE side WHEN 0 THEN x WHEN 1 THEN x + w WHEN 2 THEN x + w ELSE x END AS INTEGER) AS x0,
    CAST(CASE side WHEN 0 THEN y WHEN 1 THEN y WHEN 2 THEN y + h ELSE y + h END AS INTEGER) AS y0,
    CAST(CASE side WHEN 0 THEN x + w WHEN 1 THEN x + w WHEN 2 THEN x ELSE x END AS INTEGER) AS x1,
    CAST(CASE side WHEN 0 THEN y WHEN 1 THEN y + h WHEN 2 THEN y + h ELSE y END AS INTEGER) AS y1
    FROM v_det CROSS JOIN (SELECT CAST(range AS INTEGER) AS side FROM range(4)) s WHERE found = 1""",
)
def _(spark, sf):
    d = detections(spark, sf, patch_no=True).filter("found = 1")
    e = O.rect_outline(d.select("stream_id", "frame_id", "patch_no", *"xywh"))
    return e.select("stream_id", "frame_id", "patch_no", "side", "x0", "y0", "x1", "y1")


@query(
    "p16_quad_outline",
    f"""WITH q AS (SELECT stream_id, frame_id, patch_no, {QUAD_SQL} FROM v_det)
    """
    + " UNION ALL ".join(
        f"SELECT stream_id, frame_id, patch_no, {i} AS side, CAST(x{i} AS INTEGER) AS x0, CAST(y{i} AS INTEGER) AS y0, "
        f"CAST(x{(i + 1) % 4} AS INTEGER) AS x1, CAST(y{(i + 1) % 4} AS INTEGER) AS y1 FROM q"
        for i in range(4)
    ),
)
def _(spark, sf):
    d = detections(spark, sf, patch_no=True).selectExpr(
        "stream_id", "frame_id", "patch_no",
        *[f"CAST({e} AS double) AS q{n}{i}" for i, p in enumerate(QUAD) for n, e in zip("xy", p)],
    )
    e = O.quad_outline(d, [(f"qx{i}", f"qy{i}") for i in range(4)])
    return e.select("stream_id", "frame_id", "patch_no", "side", "x0", "y0", "x1", "y1")


GRID_SQL = """
geo AS (SELECT stream_id, frame_id, width, height, CAST(floor(width * 0.25 + 0.5) AS INTEGER) AS w,
  CAST(floor(height * 0.25 + 0.5) AS INTEGER) AS h FROM v_frames),
geo2 AS (SELECT *, CAST(floor(w * 0.5 + 0.5) AS INTEGER) AS dx, CAST(floor(h * 0.5 + 0.5) AS INTEGER) AS dy FROM geo),
geo3 AS (SELECT *, (width - w) // dx + 1 AS nx, (height - h) // dy + 1 AS ny FROM geo2),
grid AS (SELECT stream_id, frame_id, CAST(i * ny + j AS INTEGER) AS patch_no, CAST(i * dx AS INTEGER) AS x,
  CAST(j * dy AS INTEGER) AS y, w, h, CAST(nx * ny AS INTEGER) AS patch_count
  FROM geo3 CROSS JOIN (SELECT range AS i FROM range(20)) a CROSS JOIN (SELECT range AS j FROM range(20)) b
  WHERE i < nx AND j < ny)"""


def _frame_sizes(spark, sf):
    return frames(spark, sf).select("stream_id", "frame_id", "width", "height")


@query(
    "g1_grid_patches",
    f"WITH {GRID_SQL} SELECT stream_id, frame_id, patch_no, x, y, w, h, patch_count FROM grid",
)
def _(spark, sf):
    p = G.grid_patches(_frame_sizes(spark, sf))
    return p.select("stream_id", "frame_id", "patch_no", "roi.*", "patch_count")


@query(
    "g2_strip_patches",
    f"""WITH {GRID_SQL} SELECT stream_id, frame_id, count(*) AS n, CAST(sum(x * 1000 + y) AS BIGINT) AS xy,
    max(patch_count) AS patch_count FROM grid GROUP BY 1, 2""",
)
def _(spark, sf):
    p = G.split_strips(G.strip_patches(_frame_sizes(spark, sf)))
    return p.groupBy("stream_id", "frame_id").agg(
        F.count("*").alias("n"), F.sum(F.col("roi.x") * 1000 + F.col("roi.y")).alias("xy"),
        F.max("patch_count").alias("patch_count"),
    )


@query(
    "g3_sharded_patches",
    f"""WITH {GRID_SQL} SELECT stream_id, frame_id, CAST(patch_no % 5 AS INTEGER) AS shard, count(*) AS n,
    CAST(sum(x * 1000 + y) AS BIGINT) AS xy FROM grid GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    p = G.sharded_patches(_frame_sizes(spark, sf), 5)
    return p.groupBy("stream_id", "frame_id", "shard").agg(
        F.count("*").alias("n"), F.sum(F.col("roi.x") * 1000 + F.col("roi.y")).alias("xy")
    )


VIEW_DONE = """done AS (SELECT stream_id, frame_id, max(patch_count) AS patch_count FROM v_det GROUP BY 1, 2
  HAVING count(*) = max(patch_count))"""
VIEW_MULTI = f"""{VIEW_DONE},
multi AS (SELECT d.stream_id, d.frame_id, d.patch_count, l.logo_index, f.x, f.y, f.w, f.h FROM done d
  CROSS JOIN (SELECT CAST(range AS INTEGER) AS logo_index FROM range(3)) l
  LEFT JOIN (SELECT * FROM v_det WHERE found = 1) f
  ON d.stream_id = f.stream_id AND d.frame_id = f.frame_id AND l.logo_index = f.logo_index)"""


@query(
    "g4_expand_samples",
    f"""WITH {VIEW_DONE} SELECT stream_id, CAST(frame_id + k AS INTEGER) AS frame_id, frame_id AS sample_frame, patch_count
    FROM done CROSS JOIN (SELECT range AS k FROM range(4)) r""",
)
def _(spark, sf):
    return D.expand_samples(D.completed_frames(detections(spark, sf)), 4).select(
        "stream_id", "frame_id", "sample_frame", "patch_count"
    )


@query(
    "a1_collect_complete",
    f"""WITH {VIEW_DONE} SELECT d.stream_id, d.frame_id, d.patch_count, f.x, f.y, f.w, f.h FROM done d
    LEFT JOIN (SELECT * FROM v_det WHERE found = 1) f ON d.stream_id = f.stream_id AND d.frame_id = f.frame_id""",
)
def _(spark, sf):
    return D.collect_complete(detections(spark, sf))


@query(
    "a2_collect_complete_distinct",
    """WITH done AS (SELECT stream_id, frame_id, max(patch_count) AS patch_count FROM v_det GROUP BY 1, 2
      HAVING count(DISTINCT (x, y, w, h)) = max(patch_count))
    SELECT d.stream_id, d.frame_id, d.patch_count, f.x, f.y, f.w, f.h FROM done d
    LEFT JOIN (SELECT DISTINCT stream_id, frame_id, x, y, w, h FROM v_det WHERE found = 1) f
    ON d.stream_id = f.stream_id AND d.frame_id = f.frame_id""",
)
def _(spark, sf):
    return D.collect_complete(detections(spark, sf), distinct=D.RECT)


@query("a3_collect_complete_multi", f"WITH {VIEW_MULTI} SELECT * FROM multi")
def _(spark, sf):
    return D.collect_complete_multi(detections(spark, sf), 3)


@query(
    "a10_throughput",
    """SELECT stream_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS frames,
    round(count(*) / 60.0, 4) AS fps FROM v_frames GROUP BY 1, 2""",
)
def _(spark, sf):
    f = frames(spark, sf, numbered_ids=False)
    g = f.groupBy("stream_id", F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("m")).agg(
        F.count("*").alias("frames")
    )
    return g.select(
        "stream_id", F.date_format("m", "yyyy-MM-dd HH:mm").alias("minute"), "frames",
        F.round(F.col("frames") / 60.0, 4).alias("fps"),
    )


@query(
    "j1_join_frames_detections",
    """WITH first_d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, frame_id ORDER BY patch_no) AS r
      FROM v_det) t WHERE r = 1)
    SELECT f.stream_id, f.frame_id, f.status, d.patch_no, d.logo_index, d.x, d.y FROM v_raw f
    JOIN first_d d ON f.stream_id = d.stream_id AND f.frame_id = d.frame_id""",
)
def _(spark, sf):
    d = detections(spark, sf, patch_no=True).select("stream_id", "frame_id", "patch_no", "logo_index", "x", "y")
    return D.join_frames_detections(raw_frames(spark, sf), d, arrival="patch_no")


@query(
    "j2_join_patch_frame",
    """SELECT d.stream_id, d.frame_id, d.patch_no, d.x, d.y, f.status FROM v_det d JOIN v_raw f
    ON f.stream_id = d.stream_id AND f.frame_id = d.frame_id""",
)
def _(spark, sf):
    d = detections(spark, sf, patch_no=True).select("stream_id", "frame_id", "patch_no", "x", "y")
    return D.join_patch_frame(d, raw_frames(spark, sf))


@query(
    "j11_join_results_to_frames",
    """WITH f AS (SELECT stream_id, frame_id, CAST(trunc((frame_id - 15) / 75.0) AS INTEGER) AS win FROM v_frames),
    r AS (SELECT stream_id, win, CAST(count(*) % 6 AS INTEGER) AS label FROM f WHERE frame_id >= 15 GROUP BY 1, 2 HAVING count(*) >= 75)
    SELECT f.stream_id, f.frame_id, f.win, coalesce(r.label, -1) AS label FROM f LEFT JOIN r
    ON f.stream_id = r.stream_id AND f.win = r.win""",
)
def _(spark, sf):
    f = frames(spark, sf).select("stream_id", "frame_id")
    n = E.window_index(f.filter("frame_id >= 15"), 15, 75).groupBy("stream_id", "win").agg(F.count("*").alias("n"))
    r = n.filter("n >= 75").select("stream_id", "win", (F.col("n") % 6).cast("int").alias("label"))
    return E.join_results_to_frames(f, r, S.div(F.col("frame_id") - 15, 75))


@query(
    "w3_hold_detections",
    f"""WITH {VIEW_DONE},
    has AS (SELECT d.stream_id, d.frame_id, CASE WHEN max(coalesce(v.found, 0)) = 1 THEN d.frame_id END AS own
      FROM done d JOIN v_det v ON d.stream_id = v.stream_id AND d.frame_id = v.frame_id GROUP BY 1, 2),
    seg AS (SELECT *, sum(CASE WHEN frame_id % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY frame_id) AS s FROM has)
    SELECT stream_id, frame_id, min(own) OVER (PARTITION BY stream_id, s ORDER BY frame_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shown_frame FROM seg""",
)
def _(spark, sf):
    d = detections(spark, sf)
    has = d.groupBy("stream_id", "frame_id").agg(
        (F.count("*") == F.max("patch_count")).alias("done"), (F.max("found") == 1).alias("has_list")
    )
    return D.hold_detections(has.filter("done"), 7, bucket=700)


@query(
    "w5_window_index",
    "SELECT stream_id, frame_id, CAST(trunc((frame_id - 15) / 75.0) AS INTEGER) AS win FROM v_frames",
)
def _(spark, sf):
    return E.window_index(frames(spark, sf), 15, 75).select("stream_id", "frame_id", "win")


@query(
    "k1_order_frames",
    "SELECT stream_id, frame_id, event_id FROM v_frames ORDER BY stream_id, frame_id",
)
def _(spark, sf):
    return D.order_frames(frames(spark, sf).select("stream_id", "frame_id", "event_id"))


@query(
    "u1_merge_streams",
    """SELECT 'frame' AS source, stream_id, frame_id, status, CAST(NULL AS INTEGER) AS x FROM v_raw UNION ALL
    SELECT 'detection', stream_id, frame_id, NULL, x FROM v_det WHERE found = 1""",
)
def _(spark, sf):
    d = detections(spark, sf).filter("found = 1").select("stream_id", "frame_id", "x")
    return D.merge_streams(frame=raw_frames(spark, sf), detection=d).select(
        "source", "stream_id", "frame_id", "status", "x"
    )


@query(
    "u2_dedupe_updates",
    """SELECT stream_id, frame_id, logo_index, patch_no, x, y FROM (SELECT *, row_number() OVER
      (PARTITION BY stream_id, frame_id, logo_index ORDER BY patch_no) AS r FROM v_det) t WHERE r = 1""",
)
def _(spark, sf):
    d = detections(spark, sf, patch_no=True).select("stream_id", "frame_id", "logo_index", "patch_no", "x", "y")
    return D.dedupe_updates(d, ["stream_id", "frame_id", "logo_index"], "patch_no")


# Templates: one per part; brand 1 parts are the originals.
BANK_SQL = """bank AS (SELECT CAST(p_partkey % 10 AS INTEGER) AS logo_index, p_partkey AS template_id,
  CASE WHEN p_size = 1 THEN 1 ELSE 0 END AS is_original, CAST(floor(p_retailprice) AS BIGINT) % 50 AS priority,
  p_partkey AS seq FROM part)"""


def part_bank(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "CAST(p_partkey % 10 AS int) AS logo_index", "p_partkey AS template_id",
        "CASE WHEN p_size = 1 THEN 1 ELSE 0 END AS is_original",
        "CAST(floor(p_retailprice) AS bigint) % 50 AS priority", "p_partkey AS seq",
    )


@query(
    "k2_rank_templates",
    f"""WITH {BANK_SQL}, hits AS (SELECT l_orderkey AS patch, bank.* FROM lineitem JOIN bank ON l_partkey = template_id)
    SELECT patch, logo_index, template_id, is_original, priority FROM (SELECT *, row_number() OVER (PARTITION BY patch, logo_index
      ORDER BY is_original DESC, priority DESC, seq) AS r FROM hits) t WHERE r = 1""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("patch"), F.col("l_partkey").alias("template_id"))
    hits = li.join(part_bank(spark, sf), "template_id")
    return B.rank_templates(hits, ["patch", "logo_index"]).select(
        "patch", "logo_index", "template_id", "is_original", "priority"
    )


CAPPED = """SELECT logo_index, template_id, is_original, priority, seq FROM (SELECT *, row_number() OVER (PARTITION BY logo_index, is_original
  ORDER BY priority DESC, seq) AS r FROM {src}) t WHERE is_original = 1 OR r <= 4"""


@query("k3_cap_bank", f"WITH {BANK_SQL} {CAPPED.format(src='bank')}")
def _(spark, sf):
    return B.cap_bank(part_bank(spark, sf), 4)


@query(
    "j12_priority_update",
    f"""WITH {BANK_SQL}, s AS (SELECT l_partkey AS template_id, CAST(sum(l_linenumber) AS BIGINT) AS d FROM lineitem GROUP BY 1)
    SELECT logo_index, bank.template_id, is_original, CAST(priority + CASE WHEN is_original = 0 THEN coalesce(d, 0) ELSE 0 END AS BIGINT)
      AS priority, seq FROM bank LEFT JOIN s ON bank.template_id = s.template_id""",
)
def _(spark, sf):
    up = table(spark, sf, "lineitem").selectExpr(
        "CAST(l_partkey % 10 AS int) AS logo_index", "l_partkey AS template_id", "l_linenumber AS delta"
    )
    return B.priority_update(part_bank(spark, sf), up)


@query(
    "m7_update_bank",
    f"""WITH {BANK_SQL}, raw AS (SELECT CAST(l_partkey % 10 AS INTEGER) AS logo_index,
      CAST(-1 - l_orderkey AS BIGINT) AS template_id, l_partkey AS parent_id,
      (l_orderkey * 16 + l_linenumber) * 1000000 + l_partkey AS seq FROM lineitem WHERE l_returnflag = 'R'),
    new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY logo_index, template_id ORDER BY seq, parent_id) AS r FROM raw) t
      WHERE r = 1),
    gain AS (SELECT logo_index, parent_id, count(*) AS d FROM new GROUP BY 1, 2),
    cur AS (SELECT bank.logo_index, template_id, is_original, CAST(priority + CASE WHEN is_original = 0 THEN coalesce(d, 0) ELSE 0 END AS BIGINT)
      AS priority, seq FROM bank LEFT JOIN gain ON bank.logo_index = gain.logo_index AND template_id = parent_id),
    allb AS (SELECT * FROM cur UNION ALL SELECT logo_index, template_id, 0, CAST(0 AS BIGINT), seq FROM new)
    {CAPPED.format(src='allb')}""",
)
def _(spark, sf):
    found = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").selectExpr(
        "CAST(l_partkey % 10 AS int) AS logo_index", "-1 - l_orderkey AS template_id", "l_partkey AS parent_id",
        "(l_orderkey * 16 + l_linenumber) * 1000000 + l_partkey AS seq",
    )
    return B.update_bank(part_bank(spark, sf), found, 4)


def _epoch_sql(e: int) -> str:
    """Bank ``b{e + 1}`` from ``b{e}`` and the finds of epoch ``e``; hosts are taken up once."""
    return f"""n{e} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY logo_index, template_id ORDER BY seq, parent_id) AS r
        FROM raw WHERE e = {e}) t WHERE r = 1 AND (logo_index, template_id) NOT IN (SELECT (logo_index, template_id) FROM b{e}
        UNION ALL SELECT (logo_index, template_id) FROM raw WHERE e < {e})),
    c{e} AS (SELECT b.logo_index, b.template_id, is_original, CAST(priority + CASE WHEN is_original = 0 THEN coalesce(d, 0) ELSE 0 END AS BIGINT)
        AS priority, seq FROM b{e} b LEFT JOIN (SELECT logo_index, parent_id, count(*) AS d FROM n{e} GROUP BY 1, 2) g
        ON b.logo_index = g.logo_index AND b.template_id = g.parent_id
      UNION ALL SELECT logo_index, template_id, 0, CAST(0 AS BIGINT), seq FROM n{e}),
    b{e + 1} AS ({CAPPED.format(src=f'c{e}')})"""


EPOCHS = 3


@query(
    "x4_bank_log",
    f"""WITH {BANK_SQL}, b0 AS (SELECT * FROM bank), raw AS (SELECT CAST(l_partkey % 10 AS INTEGER) AS logo_index,
      CAST(-1 - l_orderkey AS BIGINT) AS template_id, l_partkey AS parent_id, (l_orderkey * 16 + l_linenumber) * 1000000 + l_partkey AS seq,
      (l_linenumber - 1) % {EPOCHS} AS e FROM lineitem WHERE l_returnflag = 'R'),
    {", ".join(_epoch_sql(e) for e in range(EPOCHS))}
    SELECT v AS version, logo_index, template_id, is_original, priority, seq FROM (SELECT 1 AS v, * FROM b1 UNION ALL SELECT 2, * FROM b2 UNION ALL SELECT 3, * FROM b3) b(v, logo_index, template_id, is_original, priority, seq)""",
)
def _(spark, sf):
    """Every version of a bank kept as a log, with a snapshot in between."""
    found = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").selectExpr(
        "CAST(l_partkey % 10 AS int) AS logo_index", "-1 - l_orderkey AS template_id", "l_partkey AS parent_id",
        "(l_orderkey * 16 + l_linenumber) * 1000000 + l_partkey AS seq", f"(l_linenumber - 1) % {EPOCHS} AS e",
    )
    log = B.BankLog(spark, every=2)
    log.write(0, part_bank(spark, sf))
    for e in range(EPOCHS):
        log.advance(e, found.filter(F.col("e") == e), 4, found.filter(F.col("e") < e))
    out = [log.read(v).select(F.lit(v).alias("version"), *B.BANK) for v in range(1, EPOCHS + 1)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "g5_grid_points",
    """SELECT stream_id, frame_id, i, j, j * 5 + 2 AS x, i * 5 + 2 AS y FROM v_cellframes
    CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range(2)) a CROSS JOIN (SELECT CAST(range AS INTEGER) AS j FROM range(3)) b""",
)
def _(spark, sf):
    from vidspark.operators.tracking import grid_points

    return grid_points(cell_frames(spark, sf), 5.0)
