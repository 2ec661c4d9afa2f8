"""Connected components of an edge table by alternating large and small stars.

Each turn writes its edges to the shared folder, so lineage stays short; nodes with very many
neighbours are joined as heavy keys. No component is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.llm.common import join_groups, stored

MAX_TURNS = 64


def _star(edges: DataFrame, label: str) -> DataFrame:
    """``a, b, m``: every edge with the least of ``a`` and its neighbours."""
    edges = stored(edges, label)
    least = edges.groupBy("a").agg(F.min("b").alias("_m"), F.count("*").alias("_n"))
    return join_groups(edges, least, "a", "_n").select("a", "b", F.least("a", "_m").alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the least node it reaches."""
    down = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    down = stored(down, "edges")
    state = _state(down)
    for _ in range(MAX_TURNS if state[0] else 0):
        both = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, "large").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = _star(large, "small")
        own = small.select("a", F.col("m").alias("b"))
        rest = small.select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = stored(own.unionByName(rest).filter("a <> b").distinct(), "edges")
        now = _state(down)
        if now == state:
            break
        state = now
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {MAX_TURNS} turns")
    roots = down.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return down.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
