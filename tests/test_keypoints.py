"""Keypoints of any size and direction, and logos found by them."""

import numpy as np
import pytest

from vidspark.functions import scalespace as SS
from vidspark.operators.keypoints import CONTRAST, scale_descriptors, scale_keypoints
from vidspark.operators.pixels import images
from vidspark.params import Matching, Tiling
from vidspark.plans.flows import detect_logos
from vidspark.schema import IMAGE_DDL


def texture(seed, h, w, grain=1.5):
    """Smooth random structure in all sizes."""
    rng = np.random.default_rng(seed)
    a = sum(SS.blur(rng.normal(size=(h, w)), grain * 2**i) * 2**i for i in range(3))
    return np.clip(128 + 45 * (a - a.mean()) / a.std(), 0, 255)


def plant(back, logo, scale, turn, cx, cy):
    """``logo`` laid over ``back``, scaled and turned about its centre; (picture, corners)."""
    h, w = logo.shape
    yy, xx = np.indices(back.shape)
    c, s = np.cos(turn), np.sin(turn)
    # Smaller copies are smoothed first, as a lens would.
    src = SS.blur(logo, 0.5 * np.sqrt(1 / scale**2 - 1)) if scale < 1 else logo
    x = (c * (xx - cx) + s * (yy - cy)) / scale + (w - 1) / 2
    y = (-s * (xx - cx) + c * (yy - cy)) / scale + (h - 1) / 2
    ok = (x >= 0) & (x <= w - 1) & (y >= 0) & (y <= h - 1)
    x0, y0 = np.clip(np.floor(x), 0, w - 2).astype(int), np.clip(np.floor(y), 0, h - 2).astype(int)
    fx, fy = x - x0, y - y0
    v = sum(
        src[y0 + i, x0 + j] * (fy if i else 1 - fy) * (fx if j else 1 - fx) for i in (0, 1) for j in (0, 1)
    )
    corners = [((px * c - py * s) * scale + cx, (px * s + py * c) * scale + cy)
               for px, py in ((-w / 2, -h / 2), (w / 2, -h / 2), (w / 2, h / 2), (-w / 2, h / 2))]
    return np.where(ok, v, back), np.array(corners)


def picture(a):
    return images([np.rint(a).astype(np.uint8)]).iloc[0].to_dict()


def test_a_blob_has_its_size_and_place():
    yy, xx = np.indices((80, 90))
    blob = 200 * np.exp(-((xx - 41.3) ** 2 + (yy - 33.6) ** 2) / (2 * 5.0**2))
    found = [k[:3] for k in SS.keypoints(np.rint(blob).astype(np.uint8), CONTRAST, 10.0)]
    near = [k for k in found if abs(k[0] - 41.3) < 0.3 and abs(k[1] - 33.6) < 0.3]
    # The response of a Gaussian blob peaks about its own deviation.
    assert near and all(3.5 < k[2] < 6.5 for k in near)


def test_edges_and_flat_pictures_have_none():
    step = np.zeros((64, 64), np.uint8)
    assert SS.keypoints(step, CONTRAST, 10.0) == []
    step[:, 32:] = 200
    assert SS.keypoints(step, CONTRAST, 10.0) == []
    assert SS.keypoints(np.zeros((3, 5), np.uint8), CONTRAST, 10.0) == []


CASES = [(0.7, 0.0), (1.4, 0.0), (1.0, np.pi / 6), (1.2, -2.2)]


@pytest.fixture(scope="module")
def scenes(spark):
    logos = [texture(100 + k, 72, 84) for k in range(len(CASES))]
    frames, truth = [], []
    for k, (scale, turn) in enumerate(CASES):
        pic, corners = plant(texture(k, 190, 240, 4.0), logos[k], scale, turn, 118.0, 96.0)
        frames.append((0, k, picture(pic)))
        truth.append((*corners.min(axis=0), *corners.max(axis=0)))
    frames.append((0, len(CASES), picture(texture(55, 190, 240, 4.0))))
    t = [(k, 0, 1, 0, k, picture(a)) for k, a in enumerate(logos)]
    ddl = "logo_index int, template_id int, is_original int, priority int, seq int"
    return (
        spark.createDataFrame(frames, f"stream_id int, frame_id int, image {IMAGE_DDL}"),
        spark.createDataFrame(t, f"{ddl}, image {IMAGE_DDL}"),
        truth,
    )


def test_logos_of_other_sizes_and_directions_are_found(scenes):
    frames, templates, truth = scenes
    how = {"tiling": Tiling(1.0, 1.0), "params": Matching(reproj_threshold=2.0)}
    got = [r for r in detect_logos(frames, templates, describe=scale_descriptors, **how).collect() if r.found]
    assert sorted((r.frame_id, r.logo_index) for r in got) == [(k, k) for k in range(len(CASES))]
    for r in got:
        x0, y0, x1, y1 = truth[r.frame_id]
        both = max(0, min(x1, r.x + r.w) - max(x0, r.x)) * max(0, min(y1, r.y + r.h) - max(y0, r.y))
        # The box holds nine in ten matched points, so the corners of a turned logo lie outside.
        assert both > 0.95 * r.w * r.h and both > 0.5 * (x1 - x0) * (y1 - y0)


def test_patches_see_the_keypoints_inside_them(spark, scenes):
    from pyspark.sql import functions as F

    from vidspark.operators.pixels import to_gray

    gray = to_gray(scenes[0]).drop("image").filter("frame_id = 1")
    rois = [(0, 1, 0, (0, 0, 240, 190)), (0, 1, 1, (100, 50, 80, 60))]
    patches = spark.createDataFrame(rois, "stream_id int, frame_id int, patch_no int, roi struct<x:int,y:int,w:int,h:int>")
    d = scale_descriptors(gray, patches).collect()
    whole = {r.kp: (r.x, r.y) for r in d if r.patch_no == 0}
    part = {r.kp: (r.x + 100, r.y + 50) for r in d if r.patch_no == 1}
    assert len(whole) == scale_keypoints(gray).count() > 50
    assert part == {k: p for k, p in whole.items() if 100 <= p[0] < 180 and 50 <= p[1] < 110}
    assert abs(np.linalg.norm(d[0].descr) - 1) < 1e-9
