"""Models in blocks against the same models whole."""

import numpy as np
import pytest

from vidspark.operators import encoding as E
from vidspark.operators.large_models import MixtureBlocks, ProjectionBlocks

CLUSTERS, DIM = 5, 3


@pytest.fixture(scope="module")
def feats(spark):
    r = np.random.default_rng(5)
    # Ids repeat, and one feature is far from every cluster.
    rows = [(int(i % 2), int(i % 40), [float(v) for v in r.normal(size=DIM)]) for i in range(60)] + [(0, 0, [300.0, -200.0, 100.0])]
    return spark.createDataFrame(rows, "win int, id int, part array<double>").repartition(3)


@pytest.fixture(scope="module")
def model(spark):
    r = np.random.default_rng(6)
    prior = [0.3, 0.2, 0.0, 0.4, 0.1]
    cells = [(k, d, float(r.normal()), float(0.5 + r.random()), prior[k]) for k in range(CLUSTERS) for d in range(DIM)]
    return spark.createDataFrame(cells, "k int, d int, mean double, var double, prior double")


def close(a, b, keys):
    a, b = ({tuple(r[k] for k in keys): r for r in rows} for rows in (a, b))
    assert a.keys() == b.keys()
    for k in a:
        for c in a[k].asDict():
            x, y = a[k][c], b[k][c]
            assert x == y or abs(x - y) <= 1e-9 * max(1.0, abs(x)), (k, c, x, y)


@pytest.mark.parametrize("clusters", [1, 2, 4])
def test_mixture_in_blocks(monkeypatch, feats, model, clusters):
    whole = {fast: E.fisher_encode(feats, model, ["win"], ["id"], fast=fast).collect() for fast in (False, True)}
    mix = E.Mixture(model)
    want = [mix.posteriors(np.array([r.part]))for r in feats.collect()]
    monkeypatch.setattr(E, "MODEL_CELLS", clusters * DIM)
    blocks = E.Mixture.of(model)
    assert isinstance(blocks, MixtureBlocks) and blocks.shape == (CLUSTERS, DIM)
    assert max(len(m.prior) for _, m in blocks.blocks()) <= clusters
    got = E.gmm_posteriors(feats, blocks, ["id"]).collect()
    assert len(got) == 61 * CLUSTERS
    assert np.allclose(sorted(r.posterior for r in got), sorted(np.concatenate([p[0] for p, _ in want])), atol=1e-12)
    assert np.allclose(sorted(r.log_likelihood for r in got if r.k == 0), sorted(ll[0] for _, ll in want))
    for fast in (False, True):
        close(E.fisher_encode(feats, blocks, ["win"], ["id"], fast=fast).collect(), whole[fast], ["win", "k", "d", "half"])
    fv = E.fv_normalize(E.fisher_encode(feats, blocks, ["win"], ["id"]), blocks, ["win"])
    assert fv.count() == 2 * CLUSTERS * DIM * 2


@pytest.mark.parametrize("rows", [1, 3])
def test_projection_in_blocks(spark, monkeypatch, feats, rows):
    proj = spark.createDataFrame([(k, d, float(k * 10 + d)) for k in range(7) for d in range(DIM) if k != 5], "k int, d int, value double")
    mean = spark.createDataFrame([(d, float(d)) for d in range(DIM)], "d int, value double")
    m = {"proj": proj, "mean": mean}
    want = sorted(tuple(r.part) for r in E.pca_project(feats, m).collect())
    monkeypatch.setattr(E, "MODEL_CELLS", rows * DIM)
    assert isinstance(E.Projection.of(m), ProjectionBlocks)
    got = E.pca_project(feats, m)
    assert got.columns == feats.columns
    assert np.allclose(sorted(tuple(r.part) for r in got.collect()), want, rtol=1e-13)


def test_chain_in_blocks(spark, sf, monkeypatch):
    """Windows are labelled alike when every model of the chain comes in blocks."""
    from vidspark.registry import QUERIES

    want = sorted(map(tuple, QUERIES["r9_recognise_windows"](spark, sf).collect()))
    monkeypatch.setattr(E, "MODEL_CELLS", 66)
    assert sorted(map(tuple, QUERIES["r9_recognise_windows"](spark, sf).collect())) == want
