"""Singular values and right singular vectors of a small square matrix.

Householder reflections make the matrix upper bidiagonal. The differential qd algorithm with
shifts (dqds; Fernando and Parlett, 1994) then finds the singular values to high relative
accuracy, as it never subtracts quantities of equal size. A vector is read off the twisted
factorisation of the shifted tridiagonal matrix at the index where it is closest to singular
(Dhillon and Parlett, 2004). Vectors of singular values that lie close together are made
orthogonal to each other; where a value repeats, inverse iteration finds the further ones.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Relative distance below which values count as close.
CLOSE = 1e-3


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right transformation ``P`` with ``A = Q B P^T``."""
    a = np.array(matrix, dtype=float)
    n = a.shape[1]
    right = np.eye(n)
    for k in range(n):
        _reflect(a[k:, k:], a[k:, k])
        if k + 2 < n:
            v = _reflect(a[k:, k + 1 :].T, a[k, k + 1 :])
            if v is not None:
                block = right[:, k + 1 :]
                block -= 2.0 * np.outer(block @ v, v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), right


def _reflect(block: np.ndarray, column: np.ndarray) -> np.ndarray | None:
    """Apply to ``block`` the reflection that turns ``column`` into a multiple of the first axis."""
    scale = np.abs(column).max()
    if scale == 0.0:
        return None
    v = column / scale
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    v /= np.linalg.norm(v)
    block -= 2.0 * np.outer(v, v @ block)
    return v


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One transform; the third array holds the ``d`` whose signs tell whether the shift was too large."""
    n = len(q)
    new_q, new_e, ds = np.empty(n), np.empty(n - 1), np.empty(n)
    d = q[0] - shift
    for i in range(n - 1):
        ds[i] = d
        new_q[i] = d + e[i]
        if d < 0.0 or new_q[i] <= 0.0:
            ds[i:] = -1.0
            return new_q, new_e, ds
        ratio = q[i + 1] / new_q[i]
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
    ds[n - 1] = new_q[n - 1] = d
    return new_q, new_e, ds


def squared_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(len(diagonal))
    # A zero on the diagonal becomes a value that is nothing beside the largest.
    q = np.maximum((diagonal / scale) ** 2, EPS**4)
    e = (upper / scale) ** 2
    found: list[float] = []
    parts = [(q, e, 0.0)]
    while parts:
        q, e, taken = parts.pop()
        while len(q) > 1:
            small = np.flatnonzero(e <= EPS**2 * (np.minimum(q[:-1], q[1:]) + taken))
            if len(small) and small[-1] == len(q) - 2:
                found.append(q[-1] + taken)
                q, e = q[:-1], e[:-1]
                continue
            if len(small):
                cut = small[-1] + 1
                parts.append((q[:cut], e[: cut - 1], taken))
                q, e = q[cut:], e[cut:]
                continue
            # The sum of the inverses of an unshifted transform bounds the smallest value from below.
            plain = _dqds(q, e, 0.0)
            with np.errstate(divide="ignore", over="ignore"):
                shift = 1.0 / np.sum(1.0 / np.maximum(plain[2], np.finfo(float).tiny))
            shift = max(shift, _last_pair(q, e))
            moved = _dqds(q, e, shift) if shift > 0.0 else plain
            while moved[2].min() < 0.0:
                shift = shift / 2.0 if shift > EPS * plain[2].min() else 0.0
                moved = _dqds(q, e, shift) if shift else plain
            q, e, taken = moved[0], moved[1], taken + shift
        found.append(q[0] + taken)
    return np.sort(np.array(found))[::-1] * scale**2


def _last_pair(q: np.ndarray, e: np.ndarray) -> float:
    """The smaller eigenvalue of the last two rows, lessened by what couples them to the rest."""
    a, b, c = q[-2] + (e[-3] if len(e) > 2 else 0.0), e[-1] * q[-2], q[-1] + e[-1]
    half, mean = (a - c) / 2.0, (a + c) / 2.0
    low = mean - np.hypot(half, np.sqrt(b))
    return max(0.0, low - np.sqrt(e[-2] * q[-2]) if len(e) > 1 else low * (1.0 - 4.0 * EPS))


def _away_from_zero(pivot: float) -> float:
    return pivot if abs(pivot) > 1e-200 else 1e-200


def twisted_vector(diagonal: np.ndarray, upper: np.ndarray, value: float, avoid: np.ndarray) -> np.ndarray:
    """Unit eigenvector of ``B^T B`` for ``value``, orthogonal to the rows of ``avoid``."""
    n = len(diagonal)
    if n == 1:
        return np.ones(1)
    square = np.maximum(diagonal**2, EPS**4)
    lower = np.copysign(np.abs(upper) / np.sqrt(square[:-1]), diagonal[:-1] * upper)
    main = square + np.append(0.0, square[:-1] * lower**2)
    off = square[:-1] * lower
    # From the top with stationary, from the bottom with progressive steps, both without
    # subtracting the value from an entry of the matrix itself.
    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(n - 1), np.empty(n - 1)
    s[0] = -value
    for i in range(n - 1):
        down[i] = off[i] / _away_from_zero(square[i] + s[i])
        s[i + 1] = down[i] * lower[i] * s[i] - value
    p[n - 1] = square[n - 1] - value
    for i in range(n - 2, -1, -1):
        coupling = off[i] * lower[i]
        pivot = _away_from_zero(coupling + p[i + 1])
        up[i] = off[i] / pivot
        p[i] = square[i] * (p[i + 1] / pivot if coupling else 1.0) - value
    gamma = np.abs(s + p + value)
    for twist in np.argsort(gamma, kind="stable"):
        z = np.zeros(n)
        z[twist] = 1.0
        for i in range(twist - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(twist + 1, n):
            z[i] = -up[i - 1] * z[i - 1]
        with np.errstate(over="ignore"):
            size = np.linalg.norm(z)
        # What is left of the product with the shifted matrix is gamma, at the twist alone.
        if not np.isfinite(size) or (len(avoid) and gamma[twist] > 16.0 * n * EPS * main.max() * size):
            break
        if not len(avoid):
            return z / size
        if np.linalg.norm(z - avoid.T @ (avoid @ z)) > 0.5 * size:
            return _orthogonal(z, avoid)
    return _iterate(main, off, value, avoid)


def _orthogonal(z: np.ndarray, avoid: np.ndarray) -> np.ndarray:
    for _ in range(2):
        z = z - avoid.T @ (avoid @ z)
    return z / np.linalg.norm(z)


def _iterate(main: np.ndarray, off: np.ndarray, value: float, avoid: np.ndarray) -> np.ndarray:
    """Inverse iteration from seeded starts, for one more vector of a repeated value."""
    # The shift is off by more than rounding, so that the matrix can be solved with.
    shifted = main - value + 1e-12 * main.max()
    matrix = np.diag(shifted) + np.diag(off, 1) + np.diag(off, -1)
    z = _orthogonal(np.random.default_rng(len(avoid)).normal(size=len(main)), avoid)
    for _ in range(4):
        z = _orthogonal(np.linalg.solve(matrix, z), avoid)
    return z


def leading_right_vectors(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values, falling, and the first ``count`` right vectors as rows."""
    diagonal, upper, right = bidiagonalise(matrix)
    values = squared_values(diagonal, upper)
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0)) or 1.0
    vectors = np.empty((0, len(values)))
    for i in range(min(count, len(values))):
        close = [j for j in range(i) if values[j] - values[i] <= CLOSE * values[i] + EPS * values[0]]
        z = twisted_vector(diagonal / scale, upper / scale, values[i] / scale**2, vectors[close])
        vectors = np.vstack([vectors, z])
    return values, vectors @ right.T
