"""Registration, and the tables' views as video-shaped inputs (Spark builder + SQL text).

All views read whole tables. Parity of ``vec_id`` assigns descriptors a role (patch or
template); every vector has one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.plans.scale import numbered
from vidspark.sources.frames import assign_frame_ids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}
# Size of the frames made from orders, one order per pixel.
W, H = 16, 12


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def with_views(body: str) -> str:
    """Prefix the views a statement needs, dependencies first."""
    done: list[str] = []

    def need(text):
        for v in re.findall(r"\bv_\w+", text):
            if v in VIEWS and v not in done:
                need(VIEWS[v])
                if v not in done:
                    done.append(v)

    need(body)
    if not done:
        return body
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in done)
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    if m:
        return f"WITH {m.group(1) or ''}{ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def placed(df: DataFrame, keys: tuple[str, ...] = ("stream_id",), out: str = "place") -> DataFrame:
    """0-based place of each row among those of its keys, as the files hold them; ``df`` has ``_metadata``."""
    at = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_r")).drop("_metadata")
    n = numbered(at, list(keys), ["_f", "_r"], out)
    return n.drop("_f", "_r")


VIEWS["v_frames"] = """
SELECT CAST(user_id % 4 AS INTEGER) AS stream_id,
  CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_id,
  event_id, ts, event_type, value,
  CASE WHEN event_type = 'view' THEN 728 ELSE 640 END AS width,
  CASE WHEN event_type = 'view' THEN 408 ELSE 480 END AS height
FROM events"""


def frames(spark, sf, numbered_ids: bool = True) -> DataFrame:
    view = F.col("event_type") == "view"
    e = table(spark, sf, "events").select(
        (F.col("user_id") % 4).cast("int").alias("stream_id"), "event_id", "ts", "event_type", "value",
        F.when(view, 728).otherwise(640).alias("width"), F.when(view, 408).otherwise(480).alias("height"),
    )
    return assign_frame_ids(e, ["ts", "event_id"]) if numbered_ids else e


VIEWS["v_raw"] = """
SELECT CAST(o_orderkey % 4 AS INTEGER) AS stream_id, CAST(o_orderkey // 4 AS INTEGER) AS frame_id,
  o_orderstatus AS status FROM orders"""


def raw_frames(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey % 4 AS int) AS stream_id", "CAST(o_orderkey div 4 AS int) AS frame_id",
        "o_orderstatus AS status",
    )


# One row per patch result; a frame with a part divisible by 97 expects one more than it gets.
VIEWS["v_det"] = """
SELECT CAST(l_orderkey % 4 AS INTEGER) AS stream_id, CAST(l_orderkey // 4 AS INTEGER) AS frame_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) - 1 AS INTEGER) AS patch_no,
  CAST(count(*) OVER (PARTITION BY l_orderkey)
    + max(CASE WHEN l_partkey % 97 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS INTEGER) AS patch_count,
  CAST(l_suppkey % 3 AS INTEGER) AS logo_index, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS found,
  CAST(l_partkey % 600 AS INTEGER) AS x, CAST((l_suppkey * 7) % 440 AS INTEGER) AS y,
  CAST(l_quantity AS INTEGER) + 10 AS w, CAST(l_quantity AS INTEGER) + 5 AS h
FROM lineitem"""


def detections(spark, sf, patch_no: bool = False) -> DataFrame:
    """Patch results; the patch number is only computed when asked for."""
    li = table(spark, sf, "lineitem")
    if patch_no:
        order = "l_linenumber l_partkey l_suppkey l_extendedprice l_quantity l_shipdate l_discount l_tax".split()
        li = numbered(li.select("l_orderkey", "l_returnflag", *order), ["l_orderkey"], order, "patch_no")
    hit = F.max(F.when(F.col("l_partkey") % 97 == 0, 1).otherwise(0))
    n = li.groupBy("l_orderkey").agg((F.count("*") + hit).cast("int").alias("patch_count"))
    return li.join(n, "l_orderkey").selectExpr(
        "CAST(l_orderkey % 4 AS int) AS stream_id", "CAST(l_orderkey div 4 AS int) AS frame_id",
        *(["CAST(patch_no AS int) AS patch_no"] if patch_no else []), "patch_count", "CAST(l_suppkey % 3 AS int) AS logo_index",
        "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS found", "CAST(l_partkey % 600 AS int) AS x",
        "CAST((l_suppkey * 7) % 440 AS int) AS y", "CAST(l_quantity AS int) + 10 AS w",
        "CAST(l_quantity AS int) + 5 AS h",
    )


VIEWS["v_q"] = "SELECT vec_id AS q, vec_id // 20 AS patch, embedding AS descr FROM embeddings WHERE vec_id % 2 = 0"
VIEWS["v_t"] = "SELECT vec_id AS t, label AS tpl, embedding AS descr FROM embeddings WHERE vec_id % 2 = 1"


def patch_desc(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").filter("vec_id % 2 = 0").selectExpr(
        "vec_id AS q", "vec_id div 20 AS patch", "embedding AS descr"
    )


def bank_desc(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").filter("vec_id % 2 = 1").selectExpr(
        "vec_id AS t", "label AS tpl", "embedding AS descr"
    )


VIEWS["v_pts"] = """
SELECT CAST(user_id % 4 AS INTEGER) AS stream_id, user_id, CAST(seq // 16 AS INTEGER) AS chunk,
  CAST(seq % 16 AS INTEGER) AS idx,
  concat(CAST(user_id AS VARCHAR), '-', CAST(seq // 16 AS VARCHAR)) AS trace_id,
  CAST(200 + (user_id % 5) * (user_id % 5) * ((event_id * 37) % 13 - 6) AS DOUBLE) / 2 AS x,
  CAST(160 + (user_id % 5) * (user_id % 5) * ((event_id * 53) % 11 - 5) AS DOUBLE) / 2 AS y
FROM (SELECT user_id, event_id,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events) t"""


def track_points(spark, sf) -> DataFrame:
    e = numbered(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], "seq")
    return e.selectExpr(
        "CAST(user_id % 4 AS int) AS stream_id", "user_id", "CAST(seq div 16 AS int) AS chunk", "CAST(seq % 16 AS int) AS idx",
        "concat(CAST(user_id AS string), '-', CAST(seq div 16 AS string)) AS trace_id",
        "CAST(200 + (user_id % 5) * (user_id % 5) * ((event_id * 37) % 13 - 6) AS double) / 2 AS x",
        "CAST(160 + (user_id % 5) * (user_id % 5) * ((event_id * 53) % 11 - 5) AS double) / 2 AS y",
    )


# Frames of 16 x 12 pixels, one order per pixel, four streams. Pixels behind the last order are
# white and do not move.
VIEWS["v_pixels"] = f"""
SELECT o_orderkey, o_custkey, o_totalprice, false AS pad FROM orders UNION ALL
SELECT unnest(range(m + 1, (m // {W * H} + 1) * {W * H})), 3, 0.0, true FROM (SELECT max(o_orderkey) AS m FROM orders) t"""
VIEWS["v_cells"] = f"""
SELECT CAST((o_orderkey // {W * H}) % 4 AS INTEGER) AS stream_id,
  CAST((o_orderkey // {W * H}) // 4 AS INTEGER) AS frame_id,
  CAST((o_orderkey % {W * H}) // {W} AS INTEGER) AS y, CAST(o_orderkey % {W} AS INTEGER) AS x,
  CASE WHEN pad THEN 0.0 ELSE CAST(o_custkey % 7 - 3 AS DOUBLE) / 2 END AS u,
  CASE WHEN pad THEN 0.0 ELSE CAST((o_custkey // 7) % 5 - 2 AS DOUBLE) / 2 END AS v,
  CAST(o_totalprice AS DOUBLE) AS response, CASE WHEN pad THEN 255 ELSE CAST(o_custkey % 256 AS INTEGER) END AS b,
  CASE WHEN pad THEN 255 ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 256 AS INTEGER) END AS g,
  CASE WHEN pad THEN 255 ELSE CAST((o_orderkey * 7 + o_custkey) % 256 AS INTEGER) END AS r
FROM v_pixels"""


def pixels(spark, sf, n: int = W * H) -> DataFrame:
    """Orders, and what the last frame of ``n`` pixels lacks."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    last = o.agg(F.max("o_orderkey").cast("long").alias("m"))
    rest = last.filter(f"(m + 1) % {n} <> 0").selectExpr(f"explode(sequence(m + 1, (m div {n} + 1) * {n} - 1)) AS o_orderkey")
    rest = rest.select("o_orderkey", F.lit(3).alias("o_custkey"), F.lit(0.0).alias("o_totalprice"), F.lit(True).alias("pad"))
    return o.withColumn("pad", F.lit(False)).unionByName(rest)


def cells(spark, sf) -> DataFrame:
    n = W * H
    return pixels(spark, sf).selectExpr(
        f"CAST((o_orderkey div {n}) % 4 AS int) AS stream_id",
        f"CAST((o_orderkey div {n}) div 4 AS int) AS frame_id",
        f"CAST((o_orderkey % {n}) div {W} AS int) AS y", f"CAST(o_orderkey % {W} AS int) AS x",
        "IF(pad, 0D, CAST(o_custkey % 7 - 3 AS double) / 2) AS u",
        "IF(pad, 0D, CAST((o_custkey div 7) % 5 - 2 AS double) / 2) AS v", "CAST(o_totalprice AS double) AS response",
        "IF(pad, 255, CAST(o_custkey % 256 AS int)) AS b",
        "IF(pad, 255, CAST(CAST(floor(o_totalprice) AS bigint) % 256 AS int)) AS g",
        "IF(pad, 255, CAST((o_orderkey * 7 + o_custkey) % 256 AS int)) AS r",
    )


VIEWS["v_cellframes"] = f"SELECT DISTINCT stream_id, frame_id, {W} AS width, {H} AS height FROM v_cells"


def cell_frames(spark, sf) -> DataFrame:
    d = cells(spark, sf).select("stream_id", "frame_id").distinct()
    return d.withColumns({"width": F.lit(W), "height": F.lit(H)})
