"""Feature encoding and recognition: PCA, mixture posteriors, Fisher vectors, classes.

Models are tables; one of up to ``MODEL_CELLS`` cells is handed to tasks whole, a larger one in
blocks (``large_models``). Features are encoded where they lie and only per-window sums (two numbers
per cluster and dimension) are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidspark.functions import scalar as S
from vidspark.plans.scale import salted, spread
from vidspark.schema import FRAME, STREAM

MIN_PRIOR = 1e-6
# Part of a window a feature is summed in; set by ``salted``.
SALT = "_salt"
# Largest model matrix, or block of one, handed to tasks as numpy arrays.
MODEL_CELLS = 4_000_000


def _collected(df: DataFrame) -> pd.DataFrame:
    """A model table on the driver: one of up to ``MODEL_CELLS`` rows, as its callers have checked."""
    return df.toPandas()


def _small(model: DataFrame) -> bool:
    return model.count() <= MODEL_CELLS


def _matrix(p: pd.DataFrame, row: str, col: str, value: str) -> np.ndarray:
    if p.empty:
        return np.zeros((0, 0))
    m = np.zeros((int(p[row].max()) + 1, int(p[col].max()) + 1))
    m[p[row].to_numpy(int), p[col].to_numpy(int)] = p[value]
    return m


# Features that are worked on at a time.
PIECE = 1024


class Mixture:
    """Diagonal Gaussian mixture as arrays, from rows ``(k, d, mean, var, prior)``."""

    def __init__(self, model: DataFrame):
        p = _collected(model.select("k", "d", "mean", "var", "prior"))
        self.mean = _matrix(p, "k", "d", "mean")
        self.var = _matrix(p, "k", "d", "var")
        self.prior = p.groupby("k")["prior"].first().sort_index().to_numpy(float)

    @classmethod
    def of(cls, model):
        """Arrays of a model table, or its blocks if it is too large for one task."""
        from vidspark.operators.large_models import MixtureBlocks

        if isinstance(model, cls | MixtureBlocks):
            return model
        return cls(model) if _small(model) else MixtureBlocks(model)

    @property
    def shape(self) -> tuple[int, int]:
        return self.mean.shape

    def priors(self, spark) -> DataFrame:
        """(k, prior): one row per cluster."""
        rows = [(k, float(v)) for k, v in enumerate(self.prior)]
        return F.broadcast(spark.createDataFrame(rows, "k int, prior double"))

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """(rows, clusters) log of prior times density."""
        with np.errstate(divide="ignore"):
            lw = np.where(self.prior < MIN_PRIOR, -np.inf, np.log(self.prior))
        dim = self.mean.shape[1]
        base = lw - dim / 2 * np.log(2 * np.pi) - 0.5 * np.log(self.var).sum(axis=1)
        dist = np.zeros((len(x), len(self.prior)))
        for k in range(len(self.prior)):
            dist[:, k] = (((x - self.mean[k]) ** 2) / self.var[k]).sum(axis=1)
        return base - 0.5 * dist

    def posteriors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lj = self.log_joint(x)
        top = lj.max(axis=1, keepdims=True)
        e = np.exp(lj - top)
        total = e.sum(axis=1, keepdims=True)
        return e / total, (np.log(total) + top)[:, 0]

    def sums(self, x: np.ndarray, fast: bool) -> tuple[np.ndarray, np.ndarray]:
        """Unscaled first and second order sums over rows, (clusters, dims) each."""
        u, v = np.zeros_like(self.mean), np.zeros_like(self.mean)
        # A piece at a time, as each step makes tables of rows by dimensions and by clusters.
        for at in range(0, len(x), PIECE):
            part = x[at : at + PIECE]
            post, _ = self.posteriors(part)
            if fast:
                best = post.argmax(axis=1)
                post = np.zeros_like(post)
                post[np.arange(len(part)), best] = 1.0
            pu, pv = self.weighted(part, post)
            u, v = u + pu, v + pv
        return u, v

    def weighted(self, x: np.ndarray, post: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums for given posteriors, of which the least are left out."""
        post[:, self.prior < MIN_PRIOR] = 0.0
        post[post < MIN_PRIOR] = 0.0
        u, v = np.zeros_like(self.mean), np.zeros_like(self.mean)
        for k in range(len(self.prior)):
            z = (x - self.mean[k]) / np.sqrt(self.var[k])
            u[k], v[k] = post[:, k] @ z, post[:, k] @ (z * z - 1)
        return u, v


def l2_slice(df: DataFrame, start: int, n: int, feat: str = "feat", out: str = "part") -> DataFrame:
    return df.withColumn(out, S.unit_slice(F.col(feat), start, n))


class Projection:
    """PCA as arrays, from ``proj (k, d, value)`` and ``mean (d, value)``."""

    def __init__(self, proj: DataFrame, mean: DataFrame):
        self.matrix = _matrix(_collected(proj), "k", "d", "value")
        self.mean = _collected(mean).sort_values("d")["value"].to_numpy(float)

    @classmethod
    def of(cls, model):
        """Arrays of a model, or its blocks if it is too large for one task."""
        from vidspark.operators.large_models import ProjectionBlocks

        if isinstance(model, cls | ProjectionBlocks):
            return model
        return (cls if _small(model["proj"]) else ProjectionBlocks)(model["proj"], model["mean"])


def pca_project(df: DataFrame, model: Projection | dict[str, DataFrame], col: str = "part") -> DataFrame:
    """Replace ``col`` by its projection: subtract the mean, multiply row-major."""
    arrays = Projection.of(model)
    if not isinstance(arrays, Projection):
        from vidspark.operators.large_models import project as in_blocks

        return in_blocks(df, arrays, col)
    model = df.sparkSession.sparkContext.broadcast(arrays)

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model.value
        for s in batches:
            if len(s) == 0:
                yield s
                continue
            for at in range(0, len(s), PIECE):
                x = np.stack(s[at : at + PIECE].to_numpy()).astype(float)
                yield pd.Series(list((x - m.mean) @ m.matrix.T))

    return df.withColumn(col, project(col))


def gmm_posteriors(df: DataFrame, model: DataFrame | Mixture, ids: list[str], col: str = "part") -> DataFrame:
    """(ids, k, posterior, log_likelihood) for every feature and cluster."""
    arrays = Mixture.of(model)
    if not isinstance(arrays, Mixture):
        from vidspark.operators.large_models import posteriors

        return posteriors(df, arrays, ids, col).select(*ids, "log_likelihood", "k", "posterior")
    mix = df.sparkSession.sparkContext.broadcast(arrays)
    types = dict(df.dtypes)
    out = ", ".join(f"{c} {types[c]}" for c in ids) + ", post array<double>, log_likelihood double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), PIECE):
                b = whole[at : at + PIECE]
                post, ll = mix.value.posteriors(np.stack(b[col].to_numpy()).astype(float))
                yield b[ids].assign(post=list(post), log_likelihood=ll)

    wide = df.select(*ids, col).mapInPandas(run, out)
    return wide.select(*ids, "log_likelihood", F.posexplode("post").alias("k", "posterior"))


def fisher_encode(
    df: DataFrame,
    model: DataFrame | Mixture,
    windows: list[str],
    ids: list[str],
    col: str = "part",
    fast: bool = False,
    sqrt: bool = False,
    normalized: bool = False,
    rows: int = 8192,
) -> DataFrame:
    """Fisher vector per window in long form ``(windows, k, d, half, value)``.

    ``half`` 0 is first order, 1 second order. Windows are cut into parts of about
    ``rows`` features; each part is summed in one task, the parts are then added up.
    """
    arrays = Mixture.of(model)
    cut = df if SALT in df.columns else salted(df.select(*windows, *ids, col), windows, ids, rows, SALT)
    if isinstance(arrays, Mixture):
        parts = _fisher_parts(cut, arrays, windows, col, fast)
    else:
        from vidspark.operators.large_models import fisher_parts

        parts = fisher_parts(cut, arrays, windows, col, fast)
    total = parts.groupBy(*windows, "k", "d").agg(
        F.sum("n").alias("n"), F.sum("u").alias("u"), F.sum("v").alias("v")
    )
    fv = fisher_vector(total, arrays, windows)
    if sqrt:
        fv = fv.withColumn("value", signed_sqrt(F.col("value")))
    if normalized:
        # One window of the model's own size: 2 x clusters x dims rows.
        w = Window.partitionBy(*windows)
        norm = F.greatest(F.sqrt(F.sum(F.col("value") ** 2).over(w)), F.lit(1e-12))
        fv = fv.withColumn("value", F.col("value") / norm)
    return fv


def fisher_vector(total: DataFrame, arrays, windows: list[str]) -> DataFrame:
    """Vector entries ``(windows, k, d, half, value)`` from the sums ``u``, ``v`` of ``n`` features per cluster and dimension."""
    t = total.join(arrays.priors(total.sparkSession), "k")
    usable = F.col("prior") >= MIN_PRIOR
    su = F.when(usable, F.col("u") / (F.col("n") * F.sqrt("prior"))).otherwise(0.0)
    sv = F.when(usable, F.col("v") / (F.col("n") * F.sqrt(2 * F.col("prior")))).otherwise(0.0)
    return t.select(*windows, "k", "d", F.explode(F.array(
        F.struct(F.lit(0).alias("half"), su.alias("value")),
        F.struct(F.lit(1).alias("half"), sv.alias("value")),
    )).alias("_h")).select(*windows, "k", "d", "_h.half", "_h.value")


def _fisher_parts(cut: DataFrame, arrays: Mixture, windows: list[str], col: str, fast: bool) -> DataFrame:
    mix = cut.sparkSession.sparkContext.broadcast(arrays)
    types = dict(cut.dtypes)
    keys = ", ".join(f"{c} {types[c]}" for c in windows)
    out = f"{keys}, n long, k int, d int, u double, v double"

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        m = mix.value
        u, v = m.sums(np.stack(pdf[col].to_numpy()).astype(float), fast)
        kk, dd = np.indices(u.shape)
        part = pd.DataFrame({"n": len(pdf), "k": kk.ravel(), "d": dd.ravel(), "u": u.ravel(), "v": v.ravel()})
        for name, value in zip(windows, key):
            part[name] = value
        return part[[*windows, "n", "k", "d", "u", "v"]]

    return spread(cut.select(*windows, SALT, col), *windows, SALT).groupBy(*windows, SALT).applyInPandas(run, out)


def signed_sqrt(c):
    return F.signum(c) * F.sqrt(F.abs(c))


def fv_normalize(fv: DataFrame, model: DataFrame | Mixture, windows: list[str]) -> DataFrame:
    """Divide by the root prior once more, signed root, unit length per half."""
    pri = Mixture.of(model).priors(fv.sparkSession).select("k", F.sqrt("prior").alias("_sp"))
    q = fv.join(pri, "k").withColumn("value", signed_sqrt(F.try_divide("value", "_sp"))).drop("_sp")
    w = Window.partitionBy(*windows, "half")
    norm = F.sqrt(F.sum(F.col("value") ** 2).over(w))
    return q.withColumn("value", F.try_divide(F.col("value"), norm))


def score_classes(fv: DataFrame, weights: DataFrame, windows: list[str], n_classes: int) -> DataFrame:
    """Dot product of each window's vector ``(windows, pos, value)`` with every class row.

    Weights of all classes meet a position as one array, so vector rows are not multiplied.
    """
    w = weights.groupBy("pos").agg(
        F.map_from_entries(F.collect_list(F.struct("class", "w"))).alias("_w")
    )
    j = fv.join(w, "pos")
    sums = [
        F.sum(F.col("value") * F.coalesce(F.col("_w")[F.lit(c)], F.lit(0.0))).alias(f"c{c}")
        for c in range(n_classes)
    ]
    wide = j.groupBy(*windows).agg(*sums)
    cells = F.array(
        *[F.struct(F.lit(c).alias("class"), F.col(f"c{c}").alias("score")) for c in range(n_classes)]
    )
    return wide.select(*windows, F.explode(cells).alias("_c")).select(*windows, "_c.*")


def class_argmax(scores: DataFrame, windows: list[str]) -> DataFrame:
    """First class with the largest score; null when no score exists."""
    best = F.max_by(
        F.struct("class", "score"), F.struct("score", (-F.col("class")).alias("o"))
    )
    g = scores.filter("score IS NOT NULL").groupBy(*windows).agg(best.alias("_b"))
    return g.select(*windows, F.col("_b.class").alias("label"), F.col("_b.score").alias("score"))


def window_index(df: DataFrame, length: int, n: int, frame: str = FRAME) -> DataFrame:
    """Tumbling window on frame numbers after the first ``length`` frames."""
    return df.withColumn("win", S.div(F.col(frame) - length, n))


def encode_parts(
    feats: DataFrame,
    slices: list[tuple[int, int]],
    pcas: list[Projection | dict[str, DataFrame]],
    gmms: list[DataFrame | Mixture],
    windows: list[str],
    ids: list[str],
) -> DataFrame:
    """Concatenated normalised vectors ``(windows, pos, value)`` of several feature slices."""
    out = None
    base = 0
    feats = salted(feats.select(*windows, *ids, "feat"), windows, ids, 8192, SALT)
    for (start, n), pca, gmm in zip(slices, pcas, gmms):
        part = pca_project(l2_slice(feats, start, n).select(*windows, *ids, SALT, "part"), pca)
        mix = Mixture.of(gmm)
        fv = fv_normalize(fisher_encode(part, mix, windows, ids), mix, windows)
        k, d = mix.shape
        pos = F.lit(base) + F.col("half") * (k * d) + F.col("k") * d + F.col("d")
        one = fv.select(*windows, pos.cast("int").alias("pos"), "value")
        base += 2 * k * d
        out = one if out is None else out.unionByName(one)
    return out


def recognise_windows(
    feats: DataFrame,
    slices: list[tuple[int, int]],
    pcas: list[Projection | dict[str, DataFrame]],
    gmms: list[DataFrame | Mixture],
    weights: DataFrame,
    n_classes: int,
    windows: list[str],
    ids: list[str],
) -> DataFrame:
    """Label of every feature window: slices → PCA → Fisher vectors → scores → best class."""
    fv = encode_parts(feats, slices, pcas, gmms, windows, ids)
    return class_argmax(score_classes(fv, weights, windows, n_classes), windows)


def join_results_to_frames(frames: DataFrame, results: DataFrame, win) -> DataFrame:
    """Each frame with its window's label, -1 while there is none."""
    j = frames.withColumn("win", win).join(results, [STREAM, "win"], "left")
    return j.withColumn("label", F.coalesce("label", F.lit(-1)))
