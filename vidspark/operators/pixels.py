"""Frame operators: resize, grey, crop, corner response, flow, histograms, descriptors.

Images pass Arrow in small batches (`spark.sql.execution.arrow.maxRecordsPerBatch`); all
other columns stay in the JVM, and pixels cross an exchange at most once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.functions import kernels as K
from vidspark.params import Blocks
from vidspark.schema import IMAGE, KEYS, MODE_BGR, MODE_GRAY, STREAM

ROWS_DDL = "array<struct<y:int,u:array<double>,v:array<double>>>"
# Frames that are worked on, and descriptors that are handed back, at a time.
PIECE_FRAMES, PIECE_POINTS = 64, 4096
# Pixels of frames of one size that a kernel works out together.
PIECE_PIXELS = 1 << 16
FLOW = pa.list_(pa.struct([("y", pa.int32()), ("u", pa.list_(pa.float64())), ("v", pa.list_(pa.float64()))]))


def arrays(p: pd.DataFrame) -> list[np.ndarray | None]:
    return [
        None if d is None else K.decode(h, w, c, d)
        for h, w, c, d in zip(p["height"], p["width"], p["nChannels"], p["data"])
    ]


def images(out: list[np.ndarray | None]) -> pd.DataFrame:
    rows = []
    for a in out:
        if a is None:
            rows.append((None,) * 5)
            continue
        c = 1 if a.ndim == 2 else a.shape[2]
        mode = MODE_GRAY if c == 1 else MODE_BGR
        rows.append((a.shape[0], a.shape[1], c, mode, np.ascontiguousarray(a).tobytes()))
    return pd.DataFrame(rows, columns=["height", "width", "nChannels", "mode", "data"])


def _image_udf(fn: Callable[[np.ndarray], np.ndarray]):
    @F.pandas_udf(IMAGE)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            # An empty batch is answered too.
            for at in range(0, max(1, len(p)), PIECE_FRAMES):
                yield images([None if a is None else fn(a) for a in arrays(p[at : at + PIECE_FRAMES])])

    return run


def resize_frames(df: DataFrame, w: int, h: int, mode: str = "linear", col: str = "image"):
    fn = {"linear": K.resize_linear, "area": K.resize_area}[mode]
    return df.withColumn(col, _image_udf(lambda a: fn(a, w, h))(col))


def to_gray(df: DataFrame, col: str = "image", out: str = "gray") -> DataFrame:
    return df.withColumn(out, _image_udf(K.gray)(col))


def crop(df: DataFrame, roi: str = "roi", col: str = "image", out: str = "crop") -> DataFrame:
    """Cut ``roi`` out of each image, in the JVM: row slices of the byte string."""
    img, r = F.col(col), F.col(roi)
    c = img["nChannels"]
    row = F.transform(
        F.sequence(r["y"], r["y"] + r["h"] - 1),
        lambda y: F.hex(F.substring(img["data"], (y * img["width"] + r["x"]) * c + 1, r["w"] * c)),
    )
    part = F.struct(
        r["h"].alias("height"),
        r["w"].alias("width"),
        c.alias("nChannels"),
        img["mode"].alias("mode"),
        F.unhex(F.array_join(row, "")).alias("data"),
    )
    return df.withColumn(out, part)


def pixel_rows(df: DataFrame, col: str = "image") -> DataFrame:
    """Pixels as rows ``(keys, y, x, c0, c1, c2)``; for checks and small frames."""
    img = F.col(col)
    n = img["height"] * img["width"]
    d = df.select(*KEYS, img.alias("_i"), F.explode(F.sequence(F.lit(0), n - 1)).alias("_p"))

    def byte(k):
        at = F.col("_p") * F.col("_i.nChannels") + k + 1
        return F.conv(F.hex(F.substring(F.col("_i.data"), at, F.lit(1))), 16, 10).cast("int")

    w = F.col("_i.width")
    cols = [F.when(F.col("_i.nChannels") > k, byte(k)).alias(f"c{k}") for k in range(3)]
    return d.select(*KEYS, F.floor(F.col("_p") / w).cast("int").alias("y"), (F.col("_p") % w).alias("x"), *cols)


def image_from_cells(cells: DataFrame, w: int, h: int) -> DataFrame:
    """Complete ``w x h`` BGR frames from pixel rows ``(keys, y, x, b, g, r)``."""
    px = F.struct(F.col("y"), F.col("x"), F.concat(*[F.lpad(F.hex(c), 2, "0") for c in "bgr"]).alias("p"))
    g = cells.groupBy(*KEYS).agg(F.sort_array(F.collect_list(px)).alias("px"))
    g = g.filter(F.size("px") == w * h)
    img = F.struct(
        F.lit(h).alias("height"), F.lit(w).alias("width"), F.lit(3).alias("nChannels"),
        F.lit(MODE_BGR).alias("mode"), F.unhex(F.array_join(F.col("px.p"), "")).alias("data"),
    )
    return g.select(*KEYS, img.alias("image"))


def corner_response(df: DataFrame, d: float, col: str = "gray") -> DataFrame:
    """Response at the grid points of spacing ``d`` and each frame's maximum (``top``)."""

    cell = pa.struct([("i", pa.int32()), ("j", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("response", pa.float64())])

    def responses(col):
        out = [None] * len(col)
        for at, stack in stacks(arrow_arrays(col)):
            r = K.corner_response(stack)
            tops = r.max(axis=(0, 1)).tolist()
            off = int(d / 2)
            ii, jj = np.indices((int(stack.shape[0] // d), int(stack.shape[1] // d)))
            y, x = np.floor(ii * d + off).astype(int), np.floor(jj * d + off).astype(int)
            places = [c.ravel().tolist() for c in (ii, jj, x, y)]
            for n, k in enumerate(at):
                vals = zip(*places, r[y, x, n].ravel().tolist())
                out[k] = {"top": tops[n], "cells": [dict(zip(("i", "j", "x", "y", "response"), v)) for v in vals]}
        return out

    @F.arrow_udf("struct<top:double,cells:array<struct<i:int,j:int,x:int,y:int,response:double>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_pieces(responses, pa.struct([("top", pa.float64()), ("cells", pa.list_(cell))]))(batches)

    r = df.select(*KEYS, run(col).alias("_r"))
    return r.select(*KEYS, F.col("_r.top").alias("top"), F.explode("_r.cells").alias("_c")).select(
        *KEYS, "top", "_c.*"
    )


def dense_flow(
    pairs: DataFrame,
    prev: str = "prev_gray",
    cur: str = "gray",
    estimator: Callable = K.polynomial_flow,
) -> DataFrame:
    """Adds ``flow`` rows (y, u[], v[]) from each pair; ``estimator(prev, cur)`` is pluggable."""

    many = K.polynomial_flows if estimator is K.polynomial_flow else None

    def moves(before, after):
        images = arrow_arrays(after)
        if many is None:
            return flow_array([estimator(x, y) for x, y in zip(arrow_arrays(before), images)])
        before, out = arrow_arrays(before), [None] * len(images)
        for at, stack in stacks(images):
            u, v = many(np.stack([before[k] for k in at], axis=-1), stack)
            for n, k in enumerate(at):
                out[k] = u[..., n], v[..., n]
        return flow_array(out)

    @F.arrow_udf(ROWS_DDL)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from in_pieces(moves, FLOW)(batches)

    return pairs.withColumn("flow", run(F.col(prev), F.col(cur)))


def flow_rows(df: DataFrame) -> DataFrame:
    """One record per flow row, keyed so that the bands of a frame spread over tasks."""
    e = df.select(*KEYS, F.explode("flow").alias("_r"))
    return e.select(*KEYS, "_r.*")


def in_pieces(fn: Callable[..., list], kind: pa.DataType):
    """A scalar Arrow function that turns a few frames at a time into Python values, or an Arrow array.

    A batch has as many frames as Spark puts in; it stays in Arrow's form.
    """

    def run(batches):
        for b in batches:
            cols = list(b) if isinstance(b, tuple) else [b]
            for at in range(0, len(cols[0]), PIECE_FRAMES):
                out = fn(*[c.slice(at, PIECE_FRAMES) for c in cols])
                yield out if isinstance(out, pa.Array) else pa.array(out, kind)

    return run


def arrow_arrays(images: pa.StructArray) -> list[np.ndarray | None]:
    return [None if i is None else K.decode(i["height"], i["width"], i["nChannels"], i["data"]) for i in images.to_pylist()]


def stacks(images: list[np.ndarray], pixels: int = PIECE_PIXELS) -> Iterator[tuple[list[int], np.ndarray]]:
    """Frames of one size put together as ``(height, width, frames)``, with their places; about ``pixels`` at a time."""
    sizes = {}
    for k, a in enumerate(images):
        sizes.setdefault(a.shape, []).append(k)
    for shape, own in sizes.items():
        n = max(1, pixels // max(1, shape[0] * shape[1]))
        for at in range(0, len(own), n):
            yield own[at : at + n], np.stack([images[k] for k in own[at : at + n]], axis=-1)


def flow_array(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Flow ``(u, v)`` of frames as an Arrow array of their rows, without a Python value per pixel."""
    shapes = [u.shape for u, _ in pairs]

    def ends(sizes):
        return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)

    wide = ends(np.repeat([w for _, w in shapes], [h for h, _ in shapes]))
    u, v = (pa.ListArray.from_arrays(wide, np.concatenate([p[c].ravel() for p in pairs])) for c in (0, 1))
    y = pa.array(np.concatenate([np.arange(h) for h, _ in shapes]), pa.int32())
    return pa.ListArray.from_arrays(ends([h for h, _ in shapes]), pa.StructArray.from_arrays([y, u, v], fields=list(FLOW.value_type)))


def arrow_flow(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Both components of one frame's flow, without a Python value per pixel."""
    v = rows.values
    order = np.argsort(v.field("y").to_numpy(zero_copy_only=False), kind="stable")
    return tuple(v.field(c).flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)[order] for c in "uv")


def gradient_histogram(df: DataFrame, col: str = "gray", bins: int = 8) -> DataFrame:
    """Whole-frame orientation histogram per frame (the last corner of the running sums)."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for p in batches:
            out = []
            for a in arrays(p):
                out.append(K.orientation_integral(*K.gradients(a), bins)[-1, -1].tolist())
            yield pd.Series(out)

    return df.withColumn("hist", run(col))


def flow_histogram(df: DataFrame, bins: int = 9, zero_below: float | None = 0.4 * 0.4) -> DataFrame:
    """Whole-frame histogram of the flow itself; its last bin counts pixels that hardly move."""

    def histograms(flow):
        return [K.orientation_integral(*arrow_flow(rows), bins, zero_below)[-1, -1].tolist() for rows in flow]

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_pieces(histograms, pa.list_(pa.float64()))(batches)

    return df.withColumn("hist", run("flow"))


def motion_histogram(df: DataFrame, bins: int = 8, gain: float = 100.0) -> DataFrame:
    """Whole-frame histograms of the gradients of both flow components."""

    def histograms(flow):
        out = []
        for rows in flow:
            hs = [K.orientation_integral(*K.gradients(gain * m), bins)[-1, -1].tolist() for m in arrow_flow(rows)]
            out.append(dict(zip("xy", hs)))
        return out

    pair = pa.struct([(c, pa.list_(pa.float64())) for c in "xy"])

    @F.arrow_udf("struct<x:array<double>,y:array<double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_pieces(histograms, pair)(batches)

    return df.withColumn("mbh", run("flow"))


def flow_arrays(rows) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(rows, key=lambda r: r["y"])
    return np.array([list(r["u"]) for r in rows], float), np.array([list(r["v"]) for r in rows], float)


def point_descriptors(frames: DataFrame, points: DataFrame, b: Blocks = Blocks()) -> DataFrame:
    """Appearance and motion descriptors of trace points, one pass per frame.

    ``frames (keys, gray, flow)``, ``points (keys, trace_id, idx, x, y)`` →
    ``(keys, trace_id, idx, hog[], mbhx[], mbhy[])``. Running sums are built where the
    frame is and never leave the task, those of frames of one size together; a frame meets its
    points as one array, of at most the frame's live traces. Flow has the size of its frame.
    """
    pts = points.groupBy(*KEYS).agg(F.collect_list(F.struct("trace_id", "idx", "x", "y")).alias("pts"))
    both = frames.select(*KEYS, "gray", "flow").join(pts, KEYS)
    types = dict(both.dtypes)
    names = ("hog", "mbhx", "mbhy")
    out = ", ".join(f"{k} {types[k]}" for k in KEYS) + ", trace_id string, idx int, "
    out += ", ".join(f"{n} array<double>" for n in names)

    def described(col, parts):
        at = pa.array(np.repeat([k for k, _, _ in parts], [len(p) for _, p, _ in parts]))
        own = [pa.concat_arrays([p.field(c) for _, p, _ in parts]) for c in ("trace_id", "idx")]
        d = np.concatenate([m for _, _, m in parts])
        ends = np.arange(0, len(d) * d.shape[2] + 1, d.shape[2], dtype=np.int32)
        cells = [pa.ListArray.from_arrays(ends, d[:, c].ravel()) for c in range(len(names))]
        return pa.RecordBatch.from_arrays(
            [*(col[k].take(at) for k in KEYS), own[0].cast(pa.string()), own[1].cast(pa.int32()), *cells],
            names=[*KEYS, "trace_id", "idx", *names],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_FRAMES):
                piece = batch.slice(at, PIECE_FRAMES)
                col = {n: piece.column(i) for i, n in enumerate(piece.schema.names)}
                # A pixel has a sum per bin of each channel.
                for own, stack in stacks(arrow_arrays(col["gray"]), PIECE_PIXELS // b.bins):
                    moves = [arrow_flow(col["flow"][k]) for k in own]
                    u, v = (np.stack([m[c] for m in moves], axis=-1) for c in (0, 1))
                    maps = np.stack([stack, 100.0 * u, 100.0 * v], axis=-1)
                    sums = K.orientation_integral(*K.gradients(maps), b.bins)
                    parts, held = [], 0
                    for n, k in enumerate(own):
                        pts = col["pts"][k].values
                        for first in range(0, len(pts), PIECE_POINTS):
                            p = pts.slice(first, PIECE_POINTS)
                            xy = np.stack([p.field(c).to_numpy(zero_copy_only=False) for c in "xy"], axis=1).astype(float)
                            parts.append((k, p, K.block_descriptors(sums[:, :, n], xy, b.size, b.cells, b.t_cells)))
                            held += len(p)
                            if held >= PIECE_POINTS:
                                yield described(col, parts)
                                parts, held = [], 0
                    if parts:
                        yield described(col, parts)

    return both.mapInArrow(run, out)


def mean_pool(desc: DataFrame, cols: list[str], dim: int, t_cells: int = 3, stride: int = 5) -> DataFrame:
    """Average descriptor of each temporal cell: ``(stream, trace_id, cell, cols)``."""
    d = desc.filter(F.col("idx") < t_cells * stride)
    d = d.withColumn("cell", F.floor(F.col("idx") / stride).cast("int"))
    aggs = [F.avg(F.get(c, F.lit(i))).alias(f"{c}_{i}") for c in cols for i in range(dim)]
    g = d.groupBy(STREAM, "trace_id", "cell").agg(*aggs)
    return g.select(
        STREAM, "trace_id", "cell", *[F.array(*[F.col(f"{c}_{i}") for i in range(dim)]).alias(c) for c in cols]
    )


def trace_features(desc: DataFrame, b: Blocks = Blocks(), length: int = 15) -> DataFrame:
    """One vector per trace: cells of each channel in order hog, mbhx, mbhy."""
    cols = ["hog", "mbhx", "mbhy"]
    m = mean_pool(desc, cols, b.dim, b.t_cells, length // b.t_cells)
    per = m.groupBy(STREAM, "trace_id").agg(
        *[F.sort_array(F.collect_list(F.struct("cell", c))).alias(c) for c in cols], F.count("*").alias("_n")
    )
    whole = per.filter(F.col("_n") == b.t_cells)
    feat = F.concat(*[F.flatten(F.col(f"{c}.{c}")) for c in cols])
    return whole.select(STREAM, "trace_id", F.transform(feat, lambda v: v.cast("float")).alias("feat"))


def patch_descriptors(
    frames: DataFrame, patches: DataFrame, step: int = 8, b: Blocks = Blocks(size=12), floor: float = 1.0
) -> DataFrame:
    """Keypoint-grid descriptors of every patch, gradients computed once per frame.

    ``frames (keys, gray)``, ``patches (keys, patch_no, roi)`` →
    ``(keys, patch_no, kp, x, y, descr)`` with x, y relative to the patch. Grid points
    without gradient energy of ``floor`` carry no keypoint.
    """
    rois = patches.groupBy(*KEYS).agg(F.collect_list(F.struct("patch_no", "roi")).alias("rois"))
    both = frames.join(rois, KEYS)

    @F.pandas_udf("array<struct<patch_no:int,kp:int,x:double,y:double,descr:array<double>>>")
    def run(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
        for g, r in batches:
            yield pd.Series([_keypoints(a, list(rs), step, b, floor) for a, rs in zip(arrays(g), r)])

    e = both.select(*KEYS, F.explode(run("gray", "rois")).alias("_d"))
    return e.select(*KEYS, "_d.*")


def _keypoints(a, rois, step, b, floor):
    integral = K.orientation_integral(*K.gradients(a), b.bins)
    h, w, _ = integral.shape
    pad = np.zeros((h + 1, w + 1))
    pad[1:, 1:] = integral.sum(axis=2)
    out = []
    half = b.size // 2
    for r in rois:
        roi = r["roi"]
        ys = np.arange(half, roi["h"] - half + 1, step)
        xs = np.arange(half, roi["w"] - half + 1, step)
        yy, xx = (m.ravel() for m in np.meshgrid(ys, xs, indexing="ij"))
        if not len(yy):
            continue
        x0, y0 = xx + roi["x"] - half, yy + roi["y"] - half
        x1, y1 = np.minimum(x0 + b.size, w), np.minimum(y0 + b.size, h)
        energy = pad[y1, x1] - pad[y0, x1] - pad[y1, x0] + pad[y0, x0]
        keep = energy >= floor
        xy = np.stack([xx + roi["x"], yy + roi["y"]], axis=1)[keep].astype(float)
        if not len(xy):
            continue
        d = K.block_descriptors(integral, xy, b.size, b.cells, b.cells)
        for k, (x, y, v) in enumerate(zip(xx[keep], yy[keep], d.tolist())):
            out.append({"patch_no": int(r["patch_no"]), "kp": k, "x": float(x), "y": float(y), "descr": v})
    return out


def stack_frames(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frames present in both results, first above second, bytes joined in the JVM.

    Frames of unequal widths or channels are an error; resize or convert them first.
    """
    j = a.select(*KEYS, F.col("image").alias("_a")).join(b.select(*KEYS, F.col("image").alias("_b")), KEYS)
    fit = F.expr("_a.width = _b.width AND _a.nChannels = _b.nChannels")
    img = F.struct(
        (F.col("_a.height") + F.col("_b.height")).alias("height"), F.col("_a.width").alias("width"),
        F.col("_a.nChannels").alias("nChannels"), F.col("_a.mode").alias("mode"),
        F.when(fit, F.concat("_a.data", "_b.data")).otherwise(F.raise_error(F.lit("stacked frames differ in width or channels")).cast("binary"))
        .alias("data"),
    )
    return j.select(*KEYS, img.alias("image"))


