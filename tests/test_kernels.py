"""Pixel kernels and geometry on inputs with known answers."""

import numpy as np
import pytest

from vidspark.functions import kernels as K
from vidspark.operators.geometry import robust_transform, smallest_box


def square(dx, dy):
    rng = np.random.default_rng(1)
    a = np.full((48, 64), 20, np.uint8)
    a[14 + dy : 32 + dy, 20 + dx : 40 + dx] = rng.integers(120, 250, (18, 20))
    return a


def test_flow_of_moving_square():
    u, v = K.polynomial_flow(square(0, 0), square(2, 1))
    assert abs(np.median(u[18:28, 24:36]) - 2) < 0.3
    assert abs(np.median(v[18:28, 24:36]) - 1) < 0.3


def test_ramp_goes_to_bin_zero():
    ramp = np.tile(np.arange(30, dtype=float), (20, 1))
    h = K.orientation_integral(*K.gradients(ramp))[-1, -1]
    assert h[0] == pytest.approx(h.sum())


def test_corners_answer_at_corners():
    a = np.zeros((40, 40), np.uint8)
    a[10:30, 10:30] = 200
    r = K.corner_response(a)
    y, x = np.unravel_index(r.argmax(), r.shape)
    assert {abs(y - 9.5) < 2 or abs(y - 29.5) < 2, abs(x - 9.5) < 2 or abs(x - 29.5) < 2} == {True}


def test_block_descriptor_against_plain_sums():
    rng = np.random.default_rng(3)
    img = rng.integers(0, 255, (40, 50)).astype(float)
    gx, gy = K.gradients(img)
    integral = K.orientation_integral(gx, gy)
    per = np.diff(np.diff(integral, axis=0, prepend=0), axis=1, prepend=0)
    xy = np.array([[25.0, 20.0], [2.0, 2.0], [49.0, 39.0]])
    got = K.block_descriptors(integral, xy, 32, 2, 3)
    for (px, py), d in zip(xy, got):
        x0, y0 = int(min(max(px - 16, 0), 18)), int(min(max(py - 16, 0), 8))
        want = []
        for i in range(2):
            for j in range(2):
                cx, cy = x0 + i * 10, y0 + j * 10
                want.extend(per[cy : cy + 10, cx : cx + 10].sum(axis=(0, 1)) + 0.05)
        want = np.array(want)
        assert np.allclose(d, want / np.sqrt((want**2).sum() + 1e-10))


def test_zero_bin_counts_still_pixels():
    h = K.orientation_integral(np.zeros((4, 5)), np.zeros((4, 5)), 9, zero_below=0.16)[-1, -1]
    assert h[8] == 20 and h[:8].sum() == 0


def test_resize_means_and_centres():
    a = np.arange(16, dtype=np.uint8).reshape(4, 4)
    assert K.resize_area(a, 2, 2).tolist() == [[3, 5], [11, 13]]
    assert K.resize_linear(a, 4, 4).tolist() == a.tolist()


def test_planted_map_is_recovered():
    rng = np.random.default_rng(5)
    src = rng.uniform(0, 100, (60, 2))
    h = np.array([[1.1, 0.05, 8], [-0.04, 0.95, 5], [0.0004, 0.0002, 1]])
    p = np.hstack([src, np.ones((60, 1))]) @ h.T
    dst = p[:, :2] / p[:, 2:]
    dst[::4] += 50
    fit, ok = robust_transform(src, dst)
    assert np.allclose(fit, h, atol=1e-6) and ok.sum() == 45


@pytest.mark.parametrize("seed", range(5))
def test_smallest_box_by_trying_all(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 12, 9).astype(float), rng.integers(0, 12, 9).astype(float)
    need = 7
    best = None
    for x0 in x:
        for x1 in x:
            for y0 in y:
                for y1 in y:
                    inside = ((x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)).sum()
                    if x0 <= x1 and y0 <= y1 and inside >= need:
                        c = ((x1 - x0) * (y1 - y0), x0, y0, x1, y1)
                        best = c if best is None or c < best else best
    assert smallest_box(x, y, np.ones(9, int), need) == best


@pytest.mark.parametrize("share", [0.4, 0.25, 0.2])
def test_planted_map_is_recovered_from_few_inliers(share):
    h = np.array([[1.1, 0.05, 5], [0.02, 0.95, 3], [1e-4, 2e-4, 1]])
    k = int(80 * share)
    for seed in range(4):
        rng = np.random.default_rng(seed)
        src = rng.uniform(0, 200, (80, 2))
        p = np.hstack([src, np.ones((80, 1))]) @ h.T
        dst = p[:, :2] / p[:, 2:]
        dst[k:] += rng.uniform(20, 90, (80 - k, 2))
        assert np.flatnonzero(robust_transform(src, dst)[1]).tolist() == list(range(k))


def test_unequal_widths_do_not_stack(spark):
    from vidspark.operators.pixels import images, stack_frames
    from vidspark.schema import IMAGE_DDL

    one, two = (
        spark.createDataFrame([(0, 0, images([np.zeros((2, w), np.uint8)]).iloc[0].to_dict())], f"stream_id int, frame_id int, image {IMAGE_DDL}")
        for w in (3, 4)
    )
    assert stack_frames(one, one).first().image.height == 4
    with pytest.raises(Exception, match="differ in width"):
        stack_frames(one, two).collect()


def test_planted_logos_are_found_in_their_frames(spark):
    """Template k is cut from frame k at (16, 12)."""
    from vidspark.registry.flows import planted

    sf = "/root/testdata/sf0.01"
    hit = [r for r in planted(spark, sf).collect() if r.found]
    assert {r.frame_id for r in hit} == {r.logo_index for r in hit} == {0, 1, 2, 3, 4}
    for r in hit:
        assert r.frame_id == r.logo_index
        w = min(r.x + r.w, 40) - max(r.x, 16)
        h = min(r.y + r.h, 32) - max(r.y, 12)
        assert w * h >= 0.8 * r.w * r.h


def test_image_folder_keeps_channel_order(spark, tmp_path):
    from vidspark.operators.pixels import images, pixel_rows
    from vidspark.schema import IMAGE_DDL
    from vidspark.sources.frames import read_frames, rejected_frames, write_frame_files

    a = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    img = images([a]).iloc[0].to_dict()
    df = spark.createDataFrame([(5, 7, img)], f"stream_id int, frame_id int, image {IMAGE_DDL}")
    write_frame_files(df, str(tmp_path / "f"))
    broken = tmp_path / "f" / "stream_id=5" / "frame000008.png"
    broken.write_bytes(b"no image")
    back = read_frames(spark, str(tmp_path / "f"))
    got = {(r.y, r.x): (r.c0, r.c1, r.c2) for r in pixel_rows(back).collect()}
    assert [(r.stream_id, r.frame_id) for r in back.collect()] == [(5, 7)]
    assert [r.origin.rsplit("/", 1)[-1] for r in rejected_frames(spark, str(tmp_path / "f")).collect()] == [broken.name]
    assert got == {(y, x): tuple(int(v) for v in a[y, x]) for y in range(2) for x in range(3)}


def test_directions_share_their_two_nearest_bins():
    for degrees in (5, 50, 340, 350, 355):
        gx, gy = (np.full((1, 1), f(np.radians(degrees))) for f in (np.cos, np.sin))
        h = K.orientation_integral(gx, gy)[-1, -1]
        low, share = int(degrees // 45), degrees % 45 / 45
        want = np.zeros(8)
        want[low], want[(low + 1) % 8] = 1 - share, share
        assert np.allclose(h, want)
    gx, gy = (np.full((1, 1), f(np.radians(355))) for f in (np.cos, np.sin))
    old = K.orientation_integral(gx, gy, compat=True)[-1, -1]
    assert np.isclose(old[0], 8 / 9) and np.isclose(old[1], 1 / 9)
    # On a half circle opposite directions are one.
    there, back = (K.orientation_integral(s * gx, s * gy, circle=180.0)[-1, -1] for s in (1, -1))
    assert np.allclose(there, back) and np.isclose(there.sum(), 1)


def test_a_repeated_part_keeps_its_frame(spark):
    from vidspark.operators import detections as D

    parts = [(0, 7, 2, 1), (0, 7, 2, 1), (0, 7, 2, 0), (0, 8, 2, 1)]
    det = spark.createDataFrame(parts, "stream_id int, frame_id int, patch_count int, found int")
    assert [r.frame_id for r in D.completed_frames(det).collect()] == [7]
