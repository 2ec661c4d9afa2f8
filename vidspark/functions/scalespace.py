"""Scale-space kernels on one grey image: blur levels, extrema, refinement, direction, descriptor.

After the published method of difference-of-Gaussian keypoints; not bit-exact with any library.
"""

from __future__ import annotations

import numpy as np

from vidspark.functions.kernels import convolve, gradients, resize_linear

# Blur of an octave's first level, levels per doubling of the scale, blur an image is taken to have.
SIGMA, LEVELS, BLUR = 1.6, 3, 0.5
DIM = 4 * 4 * 8


def taps(sigma: float) -> np.ndarray:
    """Gaussian weights up to four deviations."""
    i = np.arange(-int(np.ceil(4 * sigma)), int(np.ceil(4 * sigma)) + 1)
    w = np.exp(-(i**2) / (2 * sigma**2))
    return w / w.sum()


def blur(a: np.ndarray, sigma: float) -> np.ndarray:
    return convolve(convolve(a, taps(sigma), 1), taps(sigma), 0)


def octave(first: np.ndarray) -> np.ndarray:
    """Levels of one octave, each blurred from the first, whose blur is ``SIGMA``."""
    extra = [SIGMA * np.sqrt(4 ** (i / LEVELS) - 1) for i in range(1, LEVELS + 3)]
    return np.stack([first, *(blur(first, s) for s in extra)])


def extrema(d: np.ndarray, contrast: float) -> np.ndarray:
    """(level, y, x) of the differences ``d`` above or below all 26 neighbours and over ``contrast``."""
    if min(d.shape) < 3:
        return np.zeros((0, 3), int)
    mid = d[1:-1, 1:-1, 1:-1]
    high, low = mid > contrast, mid < -contrast
    for s, y, x in np.ndindex(3, 3, 3):
        if (s, y, x) != (1, 1, 1):
            near = d[s : s + mid.shape[0], y : y + mid.shape[1], x : x + mid.shape[2]]
            high, low = high & (mid > near), low & (mid < near)
    return np.argwhere(high | low) + 1


def refine(d: np.ndarray, at: np.ndarray, contrast: float, edge: float) -> np.ndarray:
    """Positions (level, y, x) between samples, from a quadratic fit of at most five steps.

    Left out are points that do not settle, that are faint at the fitted place, or that lie on an
    edge: one principal curvature over ``edge`` times the other.
    """
    at, out, top = at.copy(), [], np.array(d.shape) - 2
    unit = np.eye(3, dtype=int)
    for _ in range(5):
        if not len(at):
            break

        def value(step, at=at):
            return d[tuple((at + step).T)]

        v = value(0)
        g = np.stack([(value(e) - value(-e)) / 2 for e in unit], axis=1)
        h = np.empty((len(at), 3, 3))
        for i, a in enumerate(unit):
            for j, b in enumerate(unit):
                if i == j:
                    h[:, i, j] = value(a) + value(-a) - 2 * v
                else:
                    h[:, i, j] = (value(a + b) - value(a - b) - value(b - a) + value(-a - b)) / 4
        sound = np.abs(np.linalg.det(h)) > 1e-12
        h[~sound] = np.eye(3)
        off = -np.linalg.solve(h, g[:, :, None])[:, :, 0]
        still = sound & (np.abs(off) <= 0.5).all(axis=1)
        trace, det = h[:, 1, 1] + h[:, 2, 2], h[:, 1, 1] * h[:, 2, 2] - h[:, 1, 2] ** 2
        strong = np.abs(v + 0.5 * (g * off).sum(axis=1)) > contrast
        good = still & strong & (det > 0) & (trace**2 * edge < (edge + 1) ** 2 * det)
        out.append(at[good] + off[good])
        move = sound & ~still & (np.abs(off) < 1e3).all(axis=1)
        at = at[move] + np.rint(off[move]).astype(int)
        at = at[((at >= 1) & (at <= top)).all(axis=1)]
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3))


def _around(size: np.ndarray, y: float, x: float, r: int):
    """Pixels inside the image within ``r`` of a point, and their offsets."""
    ys = np.arange(max(int(round(y)) - r, 1), min(int(round(y)) + r + 1, size[0] - 1))
    xs = np.arange(max(int(round(x)) - r, 1), min(int(round(x)) + r + 1, size[1] - 1))
    yy, xx = (m.ravel() for m in np.meshgrid(ys, xs, indexing="ij"))
    return yy, xx, yy - y, xx - x


def directions(mag: np.ndarray, ang: np.ndarray, y: float, x: float, sigma: float) -> list[float]:
    """Main gradient directions near a point: peaks of a smoothed histogram of 36 bins, from 0.8 of the top on."""
    yy, xx, dy, dx = _around(np.array(mag.shape), y, x, int(round(4.5 * sigma)))
    w = mag[yy, xx] * np.exp(-(dy**2 + dx**2) / (2 * (1.5 * sigma) ** 2))
    hist = np.bincount((np.floor(ang[yy, xx] / (2 * np.pi) * 36 + 0.5).astype(int)) % 36, w, 36)
    for _ in range(2):
        hist = (np.roll(hist, 1) + hist + np.roll(hist, -1)) / 3
    before, after = np.roll(hist, 1), np.roll(hist, -1)
    peaks = np.flatnonzero((hist > before) & (hist > after) & (hist >= 0.8 * hist.max()))
    bend = (before - after)[peaks] / (2 * (before + after - 2 * hist)[peaks])
    return list((peaks + bend) % 36 / 36 * 2 * np.pi)


def descriptor(mag, ang, y: float, x: float, sigma: float, turn: float) -> np.ndarray:
    """4 x 4 cells of 8 directions, turned by ``turn``, shared with the nearest cells and bins; unit length."""
    cell = 3 * sigma
    yy, xx, dy, dx = _around(np.array(mag.shape), y, x, int(round(cell * np.sqrt(2) * 2.5)))
    c, s = np.cos(turn), np.sin(turn)
    q, p = (c * dx + s * dy) / cell, (-s * dx + c * dy) / cell
    w = mag[yy, xx] * np.exp(-(p**2 + q**2) / 8)
    at = np.stack([p + 1.5, q + 1.5, (ang[yy, xx] - turn) % (2 * np.pi) / (2 * np.pi) * 8])
    low = np.floor(at).astype(int)
    part = at - low
    out = np.zeros(DIM)
    for corner in np.ndindex(2, 2, 2):
        i, j, k = (low[n] + corner[n] for n in range(3))
        share = np.prod([part[n] if corner[n] else 1 - part[n] for n in range(3)], axis=0)
        ok = (i >= 0) & (i < 4) & (j >= 0) & (j < 4)
        out += np.bincount(((i * 4 + j) * 8 + k % 8)[ok], (w * share)[ok], DIM)
    for _ in range(2):
        out = np.minimum(out / max(np.linalg.norm(out), 1e-12), 0.2)
    return out / max(np.linalg.norm(out), 1e-12)


def keypoints(img: np.ndarray, contrast: float, edge: float) -> list[tuple]:
    """(x, y, size, angle, descriptor) of a grey image, searched from twice its size down to 16 pixels."""
    h, w = img.shape
    first = blur(resize_linear(img, 2 * w, 2 * h).astype(float), np.sqrt(SIGMA**2 - (2 * BLUR) ** 2))
    out, scale = [], 0.5
    while min(first.shape) >= 16:
        g = octave(first)
        d = np.diff(g, axis=0)
        found = refine(d, extrema(d, contrast / 2), contrast, edge)
        for level in np.unique(np.rint(found[:, 0]).astype(int)):
            gx, gy = gradients(g[level])
            mag, ang = np.hypot(gx, gy), np.arctan2(gy, gx) % (2 * np.pi)
            for s, y, x in found[np.rint(found[:, 0]).astype(int) == level]:
                sigma = SIGMA * 2 ** (s / LEVELS)
                for turn in directions(mag, ang, y, x, sigma):
                    # Pixel centres of the doubled image lie a quarter of a pixel off.
                    place = (x * scale - 0.25, y * scale - 0.25, sigma * scale, turn)
                    out.append((*place, descriptor(mag, ang, y, x, sigma, turn)))
        first, scale = g[LEVELS][::2, ::2], scale * 2
    return out
