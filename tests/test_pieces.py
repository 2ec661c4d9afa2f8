"""Pixel steps work on a few frames at a time, whatever Spark puts into a batch."""

import numpy as np
import pyarrow as pa

from vidspark.operators import pixels as PX
from vidspark.params import Blocks
from vidspark.registry.pixel import KEYS, flows, grays, points


def test_batches_are_worked_on_in_pieces():
    seen = []

    def fn(a):
        seen.append(len(a))
        return a.to_pylist()

    out = list(PX.in_pieces(fn, pa.int64())([pa.array(range(1000))]))
    assert max(seen) == PX.PIECE_FRAMES and [x for o in out for x in o.to_pylist()] == list(range(1000))


def test_flow_of_unsorted_rows():
    rows = [{"y": y, "u": [y + 0.5, y], "v": [-y, 1.0]} for y in (2, 0, 1)]
    a = pa.array([[rows[0]], rows]).slice(1)
    u, v = PX.arrow_flow(a[0])
    assert u.tolist() == [[0.5, 0], [1.5, 1], [2.5, 2]] and v.tolist() == [[0, 1], [-1, 1], [-2, 1]]


def test_descriptors_come_in_bounded_records(spark, sf, monkeypatch):
    """No output record holds more than a piece of points; the rows do not depend on the piece."""
    fr = grays(spark, sf).join(flows(spark, sf), KEYS)
    whole = {tuple(r[:4]): r for r in PX.point_descriptors(fr, points(spark, sf), Blocks(size=8)).collect()}
    monkeypatch.setattr(PX, "PIECE_POINTS", 5)
    monkeypatch.setattr(PX, "PIECE_FRAMES", 2)
    small = {tuple(r[:4]): r for r in PX.point_descriptors(fr, points(spark, sf), Blocks(size=8)).collect()}
    assert whole.keys() == small.keys() and whole
    assert all(np.allclose(whole[k]["mbhx"], small[k]["mbhx"]) for k in whole)


def test_sums_of_a_mixture_take_a_piece_at_a_time(monkeypatch):
    from vidspark.operators import encoding as E

    r, seen = np.random.default_rng(0), []
    m = E.Mixture.__new__(E.Mixture)
    m.mean, m.var, m.prior = r.normal(size=(5, 3)), np.ones((5, 3)), np.full(5, 0.2)
    x = r.normal(size=(1000, 3))
    want = m.sums(x, False), m.sums(x, True)
    monkeypatch.setattr(E, "PIECE", 64)
    plain = E.Mixture.posteriors
    monkeypatch.setattr(E.Mixture, "posteriors", lambda self, p: seen.append(len(p)) or plain(self, p))
    assert np.allclose(want, (m.sums(x, False), m.sums(x, True))) and max(seen) == 64


def test_logos_are_matched_once(spark, sf, monkeypatch):
    """No plan after the matching holds the matching itself."""
    from vidspark.operators import geometry as GE
    from vidspark.registry.flows import planted

    plans, verify = [], GE.verify_matches

    def seen(matches, sizes, *args):
        plans.extend(d._jdf.queryExecution().optimizedPlan().toString() for d in (matches, sizes))
        return verify(matches, sizes, *args)

    monkeypatch.setattr(GE, "verify_matches", seen)
    assert planted(spark, sf).count() and plans
    assert not any("FlatMapGroupsInPandas" in p or "FlatMapCoGroupsInPandas" in p for p in plans)
