"""What the operators of this folder share: tables in the shared folder, joins that stand hot keys."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vidspark.plans.scale import fresh_path

# A key counts as heavy when it holds this share of the rows, so there are at most as many of them.
HEAVY_KEYS = 500
HEAVY_ROWS = 1000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = path or fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(docs: DataFrame):
    """The text column; null counts as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def bucketed(df: DataFrame, n: int, key: str, label: str) -> DataFrame:
    """``df`` written to the shared folder as a table of ``n`` buckets by ``key``.

    Later joins and groups on ``key`` leave these rows where they are.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    rows = df.repartition(n, key).write.bucketBy(n, key).option("path", fresh_path(spark, label))
    rows.option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def stored_texts(docs: DataFrame, all_columns: bool = False) -> DataFrame:
    """``rid, doc_id, text``, and all columns as ``row`` if asked, bucketed by the row number ``rid``.

    Row numbers stand for rows, so repeated or null ids stay apart.
    """
    row = [F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("row")] if all_columns else []
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs["doc_id"], text_of(docs).alias("text"), *row)
    return bucketed(rows, parallelism(docs.sparkSession), "rid", "texts")


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str) -> DataFrame:
    """Join ``rows`` with one row per ``key`` that knows how many ``rows`` it has (``size``).

    Keys with many rows are at most ``HEAVY_KEYS``, as their sizes add up to the number of rows;
    they are broadcast, so a key with a third of all rows stays spread over all tasks. All other
    keys are shuffled. ``rows`` is read three times and should be a stored table.
    """
    limit = max(HEAVY_ROWS, rows.count() // HEAVY_KEYS)
    heavy = groups.filter(F.col(size) >= limit)
    light = groups.filter(F.col(size) < limit)
    keys = [key] if isinstance(key, str) else key
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(rest.join(light, keys))


def map_rows(df: DataFrame, inputs: list, make, result: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns ``result`` (DDL) that ``make()`` computes from ``inputs``, batch by batch.

    ``make()`` runs once per task and returns a function of one list per input that returns one
    sequence per result column. The columns of ``df`` pass through Arrow untouched; those named like
    a result, or in ``drop``, give way.
    """
    names = [part.split()[0] for part in result.split(", ")]
    keep = [f for f in df.schema if f.name not in names and f.name not in drop]
    ins = [c.alias(f"_in{i}") for i, c in enumerate(inputs)]
    rows = df.select(*[df[f"`{f.name}`"].alias(f"_c{i}") for i, f in enumerate(keep)], *ins)
    schema = ", ".join([f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(keep)] + [result])
    types = to_arrow_schema(StructType.fromDDL(result)).types
    width, n_in = len(keep), len(inputs)

    def run(batches):
        work = make()
        for batch in batches:
            out = work(*[batch.column(width + i).to_pylist() for i in range(n_in)])
            cols = [pa.array(c, type=t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:width] + cols, [*(f"_c{i}" for i in range(width)), *names])

    mapped = rows.mapInArrow(run, schema)
    return mapped.select(*[F.col(f"_c{i}").alias(f.name) for i, f in enumerate(keep)], *names)
