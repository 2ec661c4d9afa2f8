"""The norm of a slice is worked out once per row, and not once per entry."""

import math

import numpy as np
from pyspark.sql import functions as F

from vidspark.operators import encoding as E


def bodies(plan: str, of: str = "lambdafunction("):
    """The arguments of all functions ``of`` that a plan names."""
    at = plan.find(of)
    while at >= 0:
        depth, end = 1, at + len(of)
        while depth:
            depth += {"(": 1, ")": -1}.get(plan[end], 0)
            end += 1
        yield plan[at:end]
        at = plan.find(of, at + 1)


def test_norm_stays_out_of_lambdas(spark):
    feats = spark.range(3).select(F.array([F.col("id") + k for k in range(6)]).cast("array<float>").alias("feat"))
    plan = E.l2_slice(feats, 1, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(" in plan
    assert not [b for b in bodies(plan) if "aggregate(" in b]


def test_slices_of_null_empty_and_zero(spark):
    rows = [(0, [1.0, 3.0, 4.0, 9.0]), (1, [5.0, 0.0, 0.0, 1.0]), (2, [1.0, None, 4.0, 1.0]), (3, None), (4, []), (5, [7.0, 2.0])]
    d = spark.createDataFrame(rows, "id int, feat array<float>")
    got = {r["id"]: r["part"] for r in E.l2_slice(d, 1, 2).collect()}
    assert got == {0: [0.6, 0.8], 1: [None, None], 2: [None, None], 3: None, 4: [], 5: [1.0]}


def test_slice_equals_a_plain_sum(spark):
    x = np.random.default_rng(3).normal(size=(20, 31)).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, feat array<float>")
    for r in E.l2_slice(d, 7, 19).collect():
        part = x[r["id"], 7:26].astype(float).tolist()
        total = 0.0
        for v in part:
            total += v * v
        assert r["part"] == [v / math.sqrt(total) for v in part]
