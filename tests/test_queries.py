"""Every registered query runs; those with a SQL twin agree with it."""

import pytest

from tests.oracle import compare, connect
from vidspark.registry import ORACLES, QUERIES

# The smallest tables leave these nothing to compare.
BIGGER = {"a5_min_matches", "m6_rank_match_counts", "m2_match_patches", "m2_match_rows", "j4_symmetric_matches", "d6_trace_features"}
BIGGER_SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    if name in BIGGER:
        con, sf = connect(BIGGER_SF), BIGGER_SF
    res = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf)
    assert not res.startswith("FAIL"), res
    assert res != "EMPTY", res
