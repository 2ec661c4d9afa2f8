"""Descriptor matching, geometric verification, detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from vidspark.operators import geometry as GE
from vidspark.operators import matching as M
from vidspark.operators.metric_index import MetricIndex
from vidspark.operators.bank import VersionedBank
from vidspark.params import Matching
from vidspark.plans.scale import cut, fresh_path
from vidspark.registry.core import VIEWS, bank_desc, patch_desc, query, table, track_points
from vidspark.streaming.run import for_each_epoch, staged

RATIO = 0.95

VIEWS["v_pairs"] = """
SELECT q, patch, t, tpl, sqrt(list_sum(list_transform(list_zip(v_q.descr, v_t.descr),
  lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))) AS d FROM v_q CROSS JOIN v_t"""
VIEWS["v_fwd"] = """
SELECT *, lead(d) OVER (PARTITION BY q, tpl ORDER BY d, t) AS d2,
  row_number() OVER (PARTITION BY q, tpl ORDER BY d, t) AS r FROM v_pairs"""
VIEWS["v_back"] = """
SELECT *, lead(d) OVER (PARTITION BY t, patch ORDER BY d, q) AS d2,
  row_number() OVER (PARTITION BY t, patch ORDER BY d, q) AS r FROM v_pairs"""
VIEWS["v_fwd1"] = f"SELECT q, patch, t, tpl, d FROM v_fwd WHERE r = 1 AND d < {RATIO} * d2"
VIEWS["v_back1"] = f"SELECT q, patch, t, tpl, d FROM v_back WHERE r = 1 AND d < {RATIO} * d2"
VIEWS["v_fband"] = """SELECT * FROM (SELECT *, min(d) OVER (PARTITION BY patch, tpl) AS lo,
  max(d) OVER (PARTITION BY patch, tpl) AS hi FROM v_fwd1) t WHERE d <= 3 * lo + hi / 12"""
VIEWS["v_bband"] = """SELECT * FROM (SELECT *, min(d) OVER (PARTITION BY patch, tpl) AS lo,
  max(d) OVER (PARTITION BY patch, tpl) AS hi FROM v_back1) t WHERE d <= 3 * lo + hi / 12"""
VIEWS["v_mutual"] = """SELECT f.patch, f.tpl, f.q, f.t, f.d FROM v_fband f JOIN v_bband b
  ON f.q = b.q AND f.t = b.t"""


def _knn(spark, sf):
    return M.knn_match(patch_desc(spark, sf), bank_desc(spark, sf).withColumnRenamed("tpl", "g"), 2)


def _forward(spark, sf):
    k = M.knn_match(patch_desc(spark, sf), bank_desc(spark, sf).withColumnRenamed("tpl", "g"), 2, ratio=RATIO, own="patch")
    return k.withColumnRenamed("g", "tpl")


def _back(spark, sf, wanted=None):
    k = M.knn_match(
        bank_desc(spark, sf).select(F.col("t").alias("q"), "tpl", "descr"),
        patch_desc(spark, sf).select(F.col("q").alias("t"), F.col("patch").alias("g"), "descr"),
        ratio=RATIO, own="tpl", wanted=wanted,
    )
    return M.turned(k)


def _dist():
    return F.round("d", 4).alias("d")


@query("j3_knn_match", "SELECT q, tpl, t, round(d, 4) AS d, CAST(r AS INTEGER) AS rank FROM v_fwd WHERE r <= 2")
def _(spark, sf):
    return _knn(spark, sf).select("q", F.col("g").alias("tpl"), "t", _dist(), "rank")


@query("j3_knn_match_blocks", "SELECT q, tpl, t, round(d, 4) AS d, CAST(r AS INTEGER) AS rank FROM v_fwd WHERE r <= 2")
def _(spark, sf):
    """The form for two sides that are both too large to hand out."""
    k = M.knn_match(patch_desc(spark, sf), bank_desc(spark, sf).withColumnRenamed("tpl", "g"), 2, force_blocks=256)
    return k.select("q", F.col("g").alias("tpl"), "t", _dist(), "rank")


@query("j3_knn_index", "SELECT q, tpl, t, round(d, 4) AS d, CAST(r AS INTEGER) AS rank FROM v_fwd WHERE r <= 2")
def _(spark, sf):
    """The form for two large sides that visits only blocks with a possible neighbour."""
    index = MetricIndex(bank_desc(spark, sf).withColumnRenamed("tpl", "g"), rows=16)
    return index.search(patch_desc(spark, sf), 2).select("q", F.col("g").alias("tpl"), "t", _dist(), "rank")


@query("m2_match_rows", "SELECT patch, tpl, q, t, round(d, 4) AS d FROM v_mutual")
def _(spark, sf):
    """The form for patches or banks of any size."""
    return M.match_rows(patch_desc(spark, sf), bank_desc(spark, sf), RATIO).select("patch", "tpl", "q", "t", _dist())


@query("w1_ratio_test", "SELECT q, tpl, t, round(d, 4) AS d FROM v_fwd1")
def _(spark, sf):
    return _forward(spark, sf).select("q", "tpl", "t", _dist())


@query(
    "a4_match_stats",
    """SELECT patch, tpl, round(min(d), 4) AS min_d, round(max(d), 4) AS max_d FROM v_fwd1 GROUP BY 1, 2""",
)
def _(spark, sf):
    s = M.match_stats(_forward(spark, sf), ["patch", "tpl"])
    return s.select("patch", "tpl", F.round("min_d", 4).alias("min_d"), F.round("max_d", 4).alias("max_d"))


@query("w2_band_filter", "SELECT q, patch, tpl, t, round(d, 4) AS d FROM v_bband")
def _(spark, sf):
    return M.band_filter(_back(spark, sf), ["patch", "tpl"]).select("q", "patch", "tpl", "t", _dist())


@query("j4_symmetric_matches", "SELECT patch, tpl, q, t, round(d, 4) AS d FROM v_mutual")
def _(spark, sf):
    keys = ["patch", "tpl"]
    # Read twice: pairs that the first direction has not found need not leave the tasks of the other.
    fwd = cut(M.band_filter(_forward(spark, sf), keys))
    back = _back(spark, sf, M.asked_back(fwd))
    m = M.symmetric_matches(fwd, M.band_filter(back, keys), keys)
    return m.select("patch", "tpl", "q", "t", _dist())


@query("a5_min_matches", "SELECT patch, tpl, count(*) AS n_matches FROM v_mutual GROUP BY 1, 2 HAVING count(*) >= 2")
def _(spark, sf):
    m = M.match_patches(patch_desc(spark, sf), bank_desc(spark, sf), RATIO)
    return M.min_matches(m, ["patch", "tpl"], 2)


@query("m2_match_patches", "SELECT patch, tpl, q, t, round(d, 4) AS d FROM v_mutual")
def _(spark, sf):
    m = M.match_patches(patch_desc(spark, sf), bank_desc(spark, sf), RATIO)
    return m.select("patch", "tpl", "q", "t", _dist())


# Point pairs under a known map per group, every error event an outlier. A group is half a
# user's events, told apart by the parity of the event.
GRP = "user_id * 2 + event_id % 2"
MAP = [
    "1 + (grp % 3) * 0.12", "0.06", "grp % 20 + 0.37", "0.03", "1 + (grp % 5) * 0.06", "grp % 30 + 0.37", "0.001", "0.0005", "1.0",
]
VIEWS["v_corr"] = f"""SELECT {GRP} AS grp, event_id, event_type = 'error' AS bad,
  CAST((event_id * 37) % 101 AS DOUBLE) AS x, CAST((event_id * 53) % 97 AS DOUBLE) AS y FROM events"""
VIEWS["v_map"] = "SELECT grp, count(*) FILTER (NOT bad) AS n_inliers, " + ", ".join(
    f"CAST({m} AS DOUBLE) AS h{i}" for i, m in enumerate(MAP)
) + " FROM v_corr GROUP BY grp"


def correspondences(spark, sf):
    e = table(spark, sf, "events").selectExpr(
        f"{GRP} AS grp", "event_id", "event_type = 'error' AS bad", "CAST((event_id * 37) % 101 AS double) AS sx",
        "CAST((event_id * 53) % 97 AS double) AS sy",
    )
    h = [f"CAST({m} AS double)" for m in MAP]
    w = f"({h[6]} * sx + {h[7]} * sy + 1)"
    shift = "CASE WHEN bad THEN 40 + (event_id % 7) * 11 ELSE 0 END"
    return e.selectExpr(
        "grp", "sx", "sy", f"({h[0]} * sx + {h[1]} * sy + {h[2]}) / {w} + {shift} AS dx",
        f"({h[3]} * sx + {h[4]} * sy + {h[5]}) / {w} - {shift} AS dy",
    )


ROUNDING = ", ".join(f"round(h{i}, {3 if i in (2, 5) else 4}) AS h{i}" for i in range(6))


@query("m3_fit_homography", f"SELECT grp, {ROUNDING}, CAST(n_inliers AS BIGINT) AS n_inliers FROM v_map")
def _(spark, sf):
    fit = GE.fit_homography(correspondences(spark, sf), ["grp"], 1.0)
    return fit.select(
        "grp", *[F.round(f"h{i}", 3 if i in (2, 5) else 4).alias(f"h{i}") for i in range(6)], "n_inliers"
    )


def box_sql(src: str, key: str) -> str:
    return f"""
p AS (SELECT {key}, list(x) AS xs, list(y) AS ys, CAST(ceil(count(*) * 0.9) AS INTEGER) AS need FROM {src} GROUP BY 1),
ux AS (SELECT DISTINCT {key}, x FROM {src}), uy AS (SELECT DISTINCT {key}, y FROM {src}),
edge AS (SELECT p.{key}, a.x AS x0, b.x AS x1, c.y AS y0, need,
    list_sort(list_transform(list_filter(list_zip(xs, ys), lambda z: z[1] >= a.x AND z[1] <= b.x AND z[2] >= c.y), lambda z: z[2])) AS up
  FROM p JOIN ux a USING ({key}) JOIN ux b USING ({key}) JOIN uy c USING ({key}) WHERE a.x <= b.x),
cand AS (SELECT {key}, x0, y0, x1, up[need] AS y1 FROM edge WHERE len(up) >= need),
best AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY (x1 - x0) * (y1 - y0), x0, y0, x1, y1) AS r FROM cand),
tight AS (SELECT {key}, CAST(trunc(x0) AS INTEGER) AS x, CAST(trunc(y0) AS INTEGER) AS y,
  CAST(trunc(x1 - x0) AS INTEGER) AS w, CAST(trunc(y1 - y0) AS INTEGER) AS h FROM best WHERE r = 1)"""


@query("k4_tightest_box", f"WITH {box_sql('v_pts', 'trace_id')} SELECT * FROM tight")
def _(spark, sf):
    return GE.tightest_box(track_points(spark, sf).select("trace_id", "x", "y"), ["trace_id"], 0.9)


_PX, _PY, _PW = (
    f"(h{i} * cx{{0}} + h{i + 1} * cy{{0}} + h{i + 2})" for i in (0, 3, 6)
)
TURN = " AND ".join(
    f"(x{(i - 1) % 4} - x{i}) * (y{(i + 1) % 4} - y{i}) - (x{(i + 1) % 4} - x{i}) * (y{(i - 1) % 4} - y{i}) <= 0.01"
    for i in range(4)
)
SHOELACE = " + ".join(f"x{i} * y{(i + 1) % 4} - x{(i + 1) % 4} * y{i}" for i in range(4))
VERIFY_SQL = f"""{box_sql('v_corr', 'grp')},
pad AS (SELECT t.grp, m.*, greatest(t.x - 10.1, 0) AS cx0, greatest(t.y - 9.7, 0) AS cy0, least(t.x + t.w + 10.1, 100) AS cx1,
  greatest(t.y - 9.7, 0) AS cy1, least(t.x + t.w + 10.1, 100) AS cx2, least(t.y + t.h + 9.7, 96) AS cy2, greatest(t.x - 10.1, 0) AS cx3,
  least(t.y + t.h + 9.7, 96) AS cy3 FROM tight t JOIN v_map m USING (grp)),
proj AS (SELECT grp, n_inliers, {", ".join(f"{_PX.format(i)} / {_PW.format(i)} AS x{i}, {_PY.format(i)} / {_PW.format(i)} AS y{i}" for i in range(4))} FROM pad),
ends AS (SELECT *, least(x0, x1, x2, x3) AS ax, greatest(0, x0, x1, x2, x3) AS bx, least(y0, y1, y2, y3) AS ay, greatest(0, y0, y1, y2, y3) AS dy FROM proj),
good AS (SELECT grp, n_inliers, greatest(0, CAST(trunc(ax) AS INTEGER)) AS l, least(160, CAST(trunc(bx) AS INTEGER)) AS r,
  greatest(0, CAST(trunc(ay) AS INTEGER)) AS t, least(150, CAST(trunc(dy) AS INTEGER)) AS b FROM ends WHERE bx - ax >= 10 AND dy - ay >= 10
  AND bx - ax <= 320 AND dy - ay <= 300 AND abs({SHOELACE}) >= 0.5 * (bx - ax) * (dy - ay) AND {TURN}),
verified AS (SELECT grp, l + 32 AS x, t + 24 AS y, r - l AS w, b - t AS h, CAST(n_inliers AS BIGINT) AS n_inliers FROM good)"""


def _verified(spark, sf, m=None):
    m = correspondences(spark, sf) if m is None else m
    sizes = m.select("grp").distinct().select(
        "grp", F.lit(101).alias("tw"), F.lit(97).alias("th"),
        F.struct(
            F.lit(32).alias("x"), F.lit(24).alias("y"), F.lit(160).alias("w"), F.lit(150).alias("h")
        ).alias("roi"),
    )
    return GE.verify_matches(m, sizes, ["grp"], Matching(min_matches=4))


@query("m4_verify_matches", f"WITH {VERIFY_SQL} SELECT * FROM verified")
def _(spark, sf):
    return _verified(spark, sf).select("grp", "rect.*", "n_inliers")


DETECT_SQL = f"""WITH {VERIFY_SQL}, pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp // 2 ORDER BY grp % 2) AS k FROM verified) t WHERE k = 1)
    SELECT u.patch, 0 AS logo_index, b.grp % 2 AS template_id, b.x, b.y, b.w, b.h FROM (SELECT DISTINCT user_id AS patch FROM events) u
    LEFT JOIN pick b ON b.grp // 2 = u.patch"""


@query("m5_detect", DETECT_SQL)
def _(spark, sf):
    """Groups play (patch, template): two templates of one logo compete for a patch."""
    v = _as_hits(_verified(spark, sf))
    patches = table(spark, sf, "events").selectExpr("user_id AS patch", "0 AS logo_index").distinct()
    d = GE.detect(v, _two_templates(spark, sf), patches, ["patch"])
    return d.select("patch", "logo_index", "template_id", "rect.*")


def _as_hits(v):
    return v.select(F.expr("grp div 2").alias("patch"), F.lit(0).alias("logo_index"), (F.col("grp") % 2).alias("template_id"), "rect")


def _two_templates(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id % 2 AS template_id").groupBy("template_id").count()
    return e.selectExpr(
        "0 AS logo_index", "template_id", "CAST(template_id = 0 AS int) AS is_original", "count AS priority",
        "template_id AS seq",
    )


@query("m6_detect_frozen_bank", DETECT_SQL)
def _(spark, sf):
    """Patches arrive in slices; each is verified against the templates of a bank that is written once."""
    bank, out = VersionedBank(spark), fresh_path(spark, "frozen")
    bank.write(0, _two_templates(spark, sf))
    patches = table(spark, sf, "events").selectExpr("user_id AS patch", "0 AS logo_index").distinct()
    pairs = correspondences(spark, sf).withColumn("patch", F.expr("grp div 2"))

    def detect(batch, epoch):
        own = pairs.join(batch.select("patch"), "patch", "left_semi").drop("patch")
        found = GE.detect(_as_hits(_verified(spark, sf, own)), bank.read(0), batch, ["patch"])
        found.write.mode("overwrite").parquet(f"{out}/epoch={epoch:09d}")

    for_each_epoch(staged(patches, 3, "patch"), detect)
    d = spark.read.option("basePath", out).parquet(f"{out}/*")
    return d.select("patch", "logo_index", "template_id", "rect.*")


@query(
    "m6_rank_match_counts",
    """WITH n AS (SELECT patch, tpl, count(*) AS n_matches FROM v_mutual GROUP BY 1, 2),
    b AS (SELECT tpl, count(*) AS priority FROM v_t GROUP BY 1)
    SELECT patch, CAST(tpl % 3 AS INTEGER) AS logo_index, tpl AS template_id, n_matches FROM (SELECT n.*, row_number() OVER
      (PARTITION BY patch, n.tpl % 3 ORDER BY priority DESC, n.tpl) AS r FROM n JOIN b ON n.tpl = b.tpl) t WHERE r = 1""",
)
def _(spark, sf):
    """Mutual matches of all patches with a fixed bank, best template per patch and logo by count, unverified."""
    from vidspark.operators.bank import rank_templates

    m = M.match_patches(patch_desc(spark, sf), bank_desc(spark, sf), RATIO)
    n = M.min_matches(m, ["patch", "tpl"], 1)
    bank = bank_desc(spark, sf).groupBy("tpl").agg(F.count("*").alias("priority"))
    hits = n.join(bank, "tpl").selectExpr(
        "patch", "tpl AS template_id", "tpl % 3 AS logo_index", "1 AS is_original", "priority", "tpl AS seq", "n_matches"
    )
    return rank_templates(hits, ["patch", "logo_index"]).select("patch", "logo_index", "template_id", "n_matches")
