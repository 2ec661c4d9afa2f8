"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

``A - s I = P L D L' P'`` with the pivots of Bunch and Kaufman; by Sylvester's law of inertia the
signs in ``D`` count the eigenvalues above ``s``. Bisection on these counts isolates the k-th
eigenvalue, Rayleigh quotient iteration finds it with cubic convergence, and two more counts certify
that it is the k-th. Eigenvalues that rounding cannot part stay in one slice; their vectors are kept
apart by projecting out those found before.
"""

from __future__ import annotations

import numpy as np

_ALPHA = (1 + np.sqrt(17)) / 8
_EPS = np.finfo(float).eps
_STEPS = 12


class Factors:
    """``P L D L' P'`` of a symmetric matrix; ``D`` has blocks of one and two rows."""

    def __init__(self, a: np.ndarray):
        a = np.array(a, float)
        n = len(a)
        self.order = np.arange(n)
        self.lower = np.eye(n)
        self.blocks: list[tuple[int, np.ndarray]] = []
        k = 0
        while k < n:
            size = self._pivot(a, k)
            self._eliminate(a, k, size)
            k += size

    def _pivot(self, a: np.ndarray, k: int) -> int:
        """Brings the pivot of step ``k`` to its place; its size."""
        column = np.abs(a[k + 1 :, k])
        most = column.max(initial=0.0)
        if abs(a[k, k]) >= _ALPHA * most:
            return 1
        r = k + 1 + int(column.argmax())
        row = np.abs(a[r, k:])
        row[r - k] = 0
        widest = row.max()
        if abs(a[k, k]) * widest >= _ALPHA * most * most:
            return 1
        if abs(a[r, r]) >= _ALPHA * widest:
            self._swap(a, k, r, k)
            return 1
        self._swap(a, k + 1, r, k)
        return 2

    def _swap(self, a: np.ndarray, i: int, j: int, done: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            self.order[[i, j]] = self.order[[j, i]]
            self.lower[[i, j], :done] = self.lower[[j, i], :done]

    def _eliminate(self, a: np.ndarray, k: int, size: int) -> None:
        block, at = a[k : k + size, k : k + size].copy(), k + size
        self.blocks.append((k, block))
        rest = a[at:, k:at]
        if not rest.any():
            return
        factor = rest / block[0, 0] if size == 1 else rest @ _inverse(block)
        a[at:, at:] -= factor @ rest.T
        self.lower[at:, k:at] = factor

    def positive(self) -> int:
        """How many eigenvalues are above zero. A block of two rows has one of each sign."""
        return sum(1 if len(b) == 2 else int(b[0, 0] > 0) for _, b in self.blocks)

    def solve(self, v: np.ndarray, tiny: float) -> np.ndarray:
        """A solution of ``A z = v``; pivots below ``tiny`` are raised to it."""
        z = v[self.order].astype(float)
        for i in range(len(z)):
            z[i + 1 :] -= self.lower[i + 1 :, i] * z[i]
        for k, b in self.blocks:
            if len(b) == 1:
                z[k] /= b[0, 0] if abs(b[0, 0]) > tiny else tiny
            else:
                z[k : k + 2] = _inverse(b) @ z[k : k + 2]
        for i in range(len(z) - 1, 0, -1):
            z[i - 1] -= self.lower[i:, i - 1] @ z[i:]
        out = np.empty_like(z)
        out[self.order] = z
        return out


def _inverse(b: np.ndarray) -> np.ndarray:
    # Scaled by the larger off-diagonal entry, so that the determinant neither over- nor underflows.
    off = b[0, 1]
    p, q = b[0, 0] / off, b[1, 1] / off
    return np.array([[q, -1.0], [-1.0, p]]) / ((p * q - 1.0) * off)


class Slices:
    """Counts of eigenvalues above a shift, kept for all later slices."""

    def __init__(self, a: np.ndarray):
        self.a = a
        reach = np.abs(a).sum(axis=1).max()
        self.tolerance = 4 * len(a) * _EPS * reach
        self.counts = {-2 * reach - 1.0: len(a), 2 * reach + 1.0: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = Factors(self.a - shift * np.eye(len(self.a))).positive()
        return self.counts[shift]

    def around(self, k: int) -> tuple[float, float]:
        """The tightest known slice with the k-th largest eigenvalue."""
        return max(s for s, n in self.counts.items() if n >= k), min(s for s, n in self.counts.items() if n < k)

    def isolate(self, k: int) -> tuple[float, float]:
        """A slice with the k-th eigenvalue alone, or as thin as rounding allows."""
        low, high = self.around(k)
        while self.above(low) - self.above(high) > 1 and high - low > self.tolerance:
            low, high = self.halve(k)
        return low, high

    def halve(self, k: int) -> tuple[float, float]:
        low, high = self.around(k)
        self.above((low + high) / 2)
        return self.around(k)


def _apart(v: np.ndarray, found: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - found.T @ (found @ v)
    return v / np.linalg.norm(v)


def _iterate(a: np.ndarray, shift: float, found: np.ndarray, tolerance: float, seed: int) -> tuple[float, np.ndarray, float]:
    """Rayleigh quotient iteration from ``shift``: value, unit vector and residual."""
    size, tiny = len(a), max(tolerance * _EPS, np.finfo(float).tiny)
    v = _apart(np.random.default_rng(seed).standard_normal(size), found)
    best = (0.0, v, np.inf)
    for step in range(_STEPS):
        v = _apart(Factors(a - shift * np.eye(size)).solve(v, tiny), found)
        value = float(v @ a @ v)
        left = float(np.linalg.norm(a @ v - value * v))
        if left < best[2]:
            best = value, v, left
        elif step > 2:
            break
        # Two steps at the middle of the slice turn the start towards its eigenvector.
        shift = value if step else shift
    return best


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit vectors as rows.

    Of each vector the largest entry is positive, the first such one on ties.
    """
    a = (np.asarray(a, float) + np.asarray(a, float).T) / 2
    size = len(a)
    scale = np.abs(a).max(initial=0.0)
    if scale == 0:
        return np.zeros(min(count, size)), np.eye(size)[:count]
    a = a / scale
    slices, values, found = Slices(a), [], np.zeros((0, size))
    for k in range(1, min(count, size) + 1):
        low, high = slices.isolate(k)
        while True:
            value, v, left = _iterate(a, (low + high) / 2, found, slices.tolerance, k)
            # Vectors of one cluster leave what they mix up, a tolerance each, to the next ones.
            allowed = k * slices.tolerance
            margin = 4 * allowed
            inside = left <= allowed and low - margin <= value <= high + margin
            if inside and slices.above(value - margin) >= k > slices.above(value + margin):
                break
            if high - low <= slices.tolerance:
                raise ArithmeticError(f"eigenvalue {k} does not converge")
            low, high = slices.halve(k)
        values.append(value)
        found = np.vstack([found, v])
    # Within a cluster they come as they are found.
    order = np.argsort(-np.array(values), kind="stable")
    values, found = np.array(values)[order], found[order]
    signs = np.sign(found[np.arange(len(found)), np.abs(found).argmax(axis=1)])
    return values * scale, found * signs[:, None]
