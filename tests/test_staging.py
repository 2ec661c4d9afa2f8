"""Streams staged from tables: rows per trigger, order of triggers, pace."""

import pytest
from pyspark.sql import functions as F

from vidspark.plans import scale
from vidspark.sources.frames import paced_stream
from vidspark.streaming import run as R


def per_epoch(stream):
    got = {}
    R.for_each_epoch(stream, lambda batch, e: got.__setitem__(e, [r["v"] for r in batch.select("v").collect()]))
    return got


@pytest.mark.parametrize("cap", [1, 7, 30, 100])
def test_no_trigger_exceeds_the_cap(spark, monkeypatch, cap):
    monkeypatch.setattr(R, "FILE_ROWS", 5)
    df = spark.range(30).select(F.pmod(F.col("id") * 17, F.lit(30)).alias("v"), F.lit("x").alias("w")).repartition(3)
    got = per_epoch(R.paced(df, ["v"], cap))
    assert [sorted(got[e]) for e in sorted(got)] == [list(range(a, min(30, a + cap))) for a in range(0, 30, cap)]


def test_large_tables_are_numbered_in_slices(spark, monkeypatch):
    """The order holds across range slices, and several files make up a trigger."""
    monkeypatch.setattr(R, "FILE_ROWS", 10)
    monkeypatch.setattr(R, "numbered", lambda df, keys, order, out: scale.numbered(df, keys, order, out, slice_rows=20))
    df = spark.range(100).select((F.col("id") % 10).alias("tens"), F.col("id").alias("v")).repartition(4)
    path = scale.fresh_path(spark, "stage")
    assert R.stage_rows(df, ["tens", "v"], 40, path) == 4
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)
    got = per_epoch(stream)
    want = sorted(range(100), key=lambda v: (v % 10, v))
    assert [sorted(got[e]) for e in sorted(got)] == [sorted(want[a : a + 40]) for a in range(0, 100, 40)]


def test_empty_table(spark):
    assert per_epoch(R.staged(spark.range(5).filter("id < 0").withColumnRenamed("id", "v"), 3, "v")) in ({}, {0: []})


def test_pace_and_rest(spark):
    """At most fps x seconds records in a trigger, triggers as far apart as asked for, nothing lost over a restart."""
    df = spark.range(25).withColumnRenamed("id", "v")
    stream, pace = paced_stream(df, ["v"], 5, 2)
    assert pace == {"processingTime": "2 seconds"}
    state, got = scale.fresh_path(spark, "state"), []

    def start():
        return stream.writeStream.foreachBatch(lambda b, e: got.append(sorted(r.v for r in b.collect()))).option("checkpointLocation", state).trigger(**pace).start()

    q = start()
    while len(got) < 1:
        q.awaitTermination(1)
    q.stop()
    q = start()
    q.processAllAvailable()
    rows = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    q.stop()
    assert max(rows) <= 10 and max(map(len, got)) <= 10
    assert sorted({v for part in got for v in part}) == list(range(25))


def test_slices_are_written_by_one_job(spark):
    """The number of jobs does not grow with the number of triggers, and the files' order is that of the rows."""
    df = spark.range(600).withColumnRenamed("id", "v")

    def jobs(cap):
        spark.sparkContext.setJobGroup(f"stage{cap}", "")
        path = scale.fresh_path(spark, "stage")
        R.stage_rows(df, ["v"], cap, path)
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"stage{cap}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n

    assert jobs(10) == jobs(300)
    got = per_epoch(R.paced(df, ["v"], 10))
    assert [sorted(got[e]) for e in sorted(got)] == [list(range(a, a + 10)) for a in range(0, 600, 10)]
