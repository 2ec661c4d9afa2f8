"""Text model files: PCA, mixture, class weights, training features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.plans.scale import line_numbers


def numeric_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, vals array<double>) of space-separated files, blanks ignored."""
    t = line_numbers(spark.read.text(path))
    parts = F.filter(F.split(F.trim("value"), r"\s+"), lambda s: s != "")
    return t.select("line", F.transform(parts, lambda s: s.cast("double")).alias("vals"))


def _cells(df: DataFrame, line: int) -> DataFrame:
    return df.filter(F.col("line") == line).select(F.posexplode("vals").alias("p", "v"))


def _checked(df: DataFrame, sizes: list) -> DataFrame:
    """Attach the header pair (a, b) to every line and fail on a wrong length."""
    head = df.filter("line = 0").select(
        F.col("vals")[0].cast("int").alias("a"), F.col("vals")[1].cast("int").alias("b")
    )
    # The header is one row; it is read once on the driver to size the rest.
    a, b = head.first()
    if df.filter((F.col("line") > len(sizes)) & (F.size("vals") > 0)).head(1):
        raise ValueError(f"a model of this kind has {len(sizes) + 1} lines; the file has more")
    want = F.create_map(*[x for i, f in enumerate(sizes) for x in (F.lit(i + 1), F.lit(f(a, b)))])
    ok = F.size("vals") == want[F.col("line").cast("int")]
    msg = F.concat(F.lit("wrong length of model line "), F.col("line").cast("string"))
    guard = F.when(ok | (F.col("line") == 0), F.col("vals")).otherwise(F.raise_error(msg))
    return df.filter(F.col("line") <= len(sizes)).withColumn("vals", guard), a, b


def load_pca(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``proj (k, d, value)``, ``mean (d, value)``, ``eig (k, value)``."""
    df, ave, _ = _checked(
        numeric_lines(spark, path), [lambda a, e: a * e, lambda a, e: a, lambda a, e: e]
    )
    proj = _cells(df, 1).selectExpr(f"p div {ave} AS k", f"p % {ave} AS d", "v AS value")
    return {
        "proj": proj.selectExpr("CAST(k AS int) k", "d", "value"),
        "mean": _cells(df, 2).selectExpr("p AS d", "v AS value"),
        "eig": _cells(df, 3).selectExpr("p AS k", "v AS value"),
    }


def load_gmm(spark: SparkSession, path: str) -> DataFrame:
    """``(k, d, mean, var, prior, sqrt_prior)`` of a diagonal mixture."""
    df, dim, _ = _checked(
        numeric_lines(spark, path), [lambda d, k: d * k, lambda d, k: d * k, lambda d, k: k]
    )
    m = _cells(df, 1).withColumnRenamed("v", "mean")
    c = _cells(df, 2).withColumnRenamed("v", "var")
    p = _cells(df, 3).selectExpr("p AS k", "v AS prior", "sqrt(v) AS sqrt_prior")
    kd = m.join(c, "p").selectExpr(
        f"CAST(p div {dim} AS int) AS k", f"p % {dim} AS d", "mean", "var"
    )
    return kd.join(p, "k")


def load_class_weights(spark: SparkSession, path: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """One vector per line: (``(class, d, w)``, lines of another length)."""
    t = numeric_lines(spark, path)
    good = t.filter(F.size("vals") == dim)
    w = good.select(F.col("line").cast("int").alias("class"), F.posexplode("vals").alias("d", "w"))
    return w, t.filter(F.size("vals") != dim)


def load_training_features(spark: SparkSession, path: str, skip: int = 39) -> DataFrame:
    """(line, feat): the columns from ``skip`` on."""
    t = numeric_lines(spark, path)
    rest = F.greatest(F.size("vals") - skip, F.lit(0))
    return t.select("line", F.slice("vals", F.lit(skip + 1), rest).alias("feat"))
