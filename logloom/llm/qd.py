"""Singular values and right singular vectors of a small dense matrix by the qd algorithms.

Householder reflections make the matrix upper bidiagonal, the differential qd algorithm with shifts
(dqds) finds the singular values, each to high relative accuracy, and a twisted factorisation of
``B'B - s^2 I`` gives each vector from both ends of the matrix towards the row where its residual is
least. Where singular values lie too close for that, the factorisation serves inverse iterations that
are kept orthogonal to the vectors before them.

The matrix is the triangular factor of a table, so its size depends on the table's columns only.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.finfo(np.float64).eps)
#: Relative gap between neighbouring eigenvalues from which a vector needs no others to be orthogonal to.
SEPARATE = 1e-3
#: Steps of dqds per eigenvalue after which something must be wrong with the numbers.
MOST_STEPS = 200


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and beta such that x - beta v (v'x) has zeros behind its first entry."""
    scale = np.abs(x).max(initial=0.0)
    if len(x) < 2 or scale == 0.0 or not x[1:].any():
        return x, 0.0
    v = x / scale
    v[0] += math.copysign(float(np.linalg.norm(v)), v[0])
    return v, 2.0 / float(v @ v)


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, right) of B = U' matrix right, with orthogonal U and right."""
    width = matrix.shape[1]
    a = np.zeros((max(width, len(matrix)), width))
    a[: len(matrix)] = matrix
    right = np.eye(width)
    for k in range(width):
        v, beta = _reflector(a[k:, k])
        if beta:
            a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        if k < width - 2:
            v, beta = _reflector(a[k, k + 1 :])
            if beta:
                a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ v, v)
                right[:, k + 1 :] -= beta * np.outer(right[:, k + 1 :] @ v, v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy()[: max(width - 1, 0)], right


def _step(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float], float, int] | None:
    """One dqds step: (q, e, smallest d, where a d fell below zero or -1); None if numbers broke."""
    nq, ne, d = [], [], q[0] - tau
    least = d
    for i, off in enumerate(e):
        if d < 0:
            return [], [], d, i
        top = d + off
        if top == 0:
            nq.append(0.0)
            ne.append(0.0)
            d = q[i + 1] - tau
        else:
            t = q[i + 1] / top
            nq.append(top)
            ne.append(off * t)
            d = d * t - tau
        least = min(least, d)
    if not math.isfinite(d):
        return None
    if d < 0:
        return [], [], d, len(e)
    nq.append(d)
    return nq, ne, least, -1


def _of_two(q1: float, e1: float, q2: float) -> tuple[float, float]:
    """Both eigenvalues of the 2x2 qd array, the larger one first."""
    trace, product = q1 + e1 + q2, q1 * q2
    if trace == 0:
        return 0.0, 0.0
    big = (trace + math.sqrt(max(0.0, (q1 - q2) ** 2 + e1 * (e1 + 2 * (q1 + q2))))) / 2
    return big, product / big


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Eigenvalues of B'B, falling, from the squares of B's diagonal and superdiagonal.

    Shifts stay below the smallest eigenvalue (a step that shows otherwise is repeated with less), so
    nothing is ever subtracted that was not there and small eigenvalues keep their digits.
    """
    found: list[float] = []
    parts = [(list(q), list(e), 0.0)]
    tiny = EPS * EPS
    steps, most = 0, MOST_STEPS * max(1, len(q))
    while parts:
        q, e, sigma = parts.pop()
        while True:
            while len(q) > 2 and e[-1] <= tiny * (sigma + q[-1]):
                found.append(sigma + q.pop())
                e.pop()
            if len(q) <= 2:
                if len(q) == 2:
                    found += [sigma + x for x in _of_two(q[0], e[0], q[1])]
                elif q:
                    found.append(sigma + q[0])
                break
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= tiny * (sigma + min(q[i], q[i + 1]))), None)
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:
                q.reverse()
                e.reverse()
            steps += 1
            if steps > most:
                raise ArithmeticError("dqds does not converge: the matrix holds what is not a number")
            tau = _of_two(q[-2], e[-1], q[-1])[1] * (1 - 4 * EPS)
            for _ in range(3):
                made = _step(q, e, tau)
                if made is None:
                    tau = 0.0
                elif made[3] < 0:
                    break
                else:  # a late failure shows how much less would do
                    tau = max(0.0, (tau + made[2]) * (1 - 2 * EPS)) if made[3] == len(e) and tau + made[2] > 0 else tau / 4
            else:
                tau = 0.0
                made = _step(q, e, tau)
            if made is None:
                raise ArithmeticError("dqds does not converge: the matrix holds what is not a number")
            q, e = made[0], made[1]
            sigma += tau
    return sorted(found, reverse=True)


class Twisted:
    """The factorisation of L D L' - shift I that meets at the row ``at`` with the least pivot."""

    def __init__(self, d: list[float], low: list[float], shift: float):
        n, least = len(d), EPS * EPS * max(max(map(abs, d)), abs(shift)) or EPS
        self.down, self.up, self.top, self.bottom = [0.0] * (n - 1), [0.0] * (n - 1), [0.0] * n, [0.0] * n
        s, forward = -shift, [-shift]
        for i in range(n - 1):
            self.top[i] = d[i] + s or least
            self.down[i] = d[i] * low[i] / self.top[i]
            s = self.down[i] * low[i] * s - shift
            forward.append(s)
        p, backward = d[-1] - shift, [0.0] * n
        backward[-1] = p
        for i in range(n - 2, -1, -1):
            self.bottom[i + 1] = d[i] * low[i] * low[i] + p or least
            t = d[i] / self.bottom[i + 1]
            self.up[i] = low[i] * t
            p = p * t - shift
            backward[i] = p
        pivots = [a + b + shift for a, b in zip(forward, backward, strict=True)]
        self.at = min(range(n), key=lambda i: abs(pivots[i]) if math.isfinite(pivots[i]) else math.inf)
        self.pivot = pivots[self.at] if math.isfinite(pivots[self.at]) else least

    def vector(self) -> np.ndarray:
        """The solution of N z = e at the twist, not normed; its residual is the pivot over its norm."""
        z = np.zeros(len(self.top))
        z[self.at] = 1.0
        for i in range(self.at - 1, -1, -1):
            z[i] = -self.down[i] * z[i + 1]
        for i in range(self.at, len(z) - 1):
            z[i + 1] = -self.up[i] * z[i]
        return z

    def solve(self, b: np.ndarray) -> np.ndarray:
        y, n = b.astype(float).tolist(), len(b)
        for i in range(self.at):
            y[i + 1] -= self.down[i] * y[i]
        for i in range(n - 1, self.at, -1):
            y[i - 1] -= self.up[i - 1] * y[i]
        for i in range(n):
            y[i] /= self.top[i] if i < self.at else self.bottom[i] if i > self.at else self.pivot or EPS * EPS
        for i in range(self.at - 1, -1, -1):
            y[i] -= self.down[i] * y[i + 1]
        for i in range(self.at + 1, n):
            y[i] -= self.up[i - 1] * y[i - 1]
        return np.array(y)


def _norm(z: np.ndarray) -> np.ndarray:
    largest = np.abs(z).max()
    z = z / largest
    return z / np.linalg.norm(z)


def _orthogonal(z: np.ndarray, to: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in to:
            z = z - (other @ z) * other
    return z


def _vectors(a: np.ndarray, b: np.ndarray, values: list[float]) -> list[np.ndarray]:
    """Eigenvectors of B'B for falling eigenvalues of one unreduced block."""
    n = len(a)
    if n == 1:
        return [np.ones(1)]
    d, low = (a * a).tolist(), (b / a[:-1]).tolist()
    made: list[np.ndarray] = []
    first = 0  # where the cluster of values began
    random = np.random.default_rng(0)
    for k, value in enumerate(values):
        near = lambda i, j: abs(values[i] - values[j]) <= SEPARATE * max(abs(values[i]), abs(values[j]))
        if k and not near(k - 1, k):
            first = k
        if first == k and not (k + 1 < len(values) and near(k, k + 1)):
            z = None
            for _ in range(3):  # each correction by the Rayleigh quotient makes the pivot smaller
                twisted = Twisted(d, low, value)
                z = twisted.vector()
                norm = float(np.abs(z).max())
                step = twisted.pivot / norm / float((z / norm) @ (z / norm)) / norm
                if not math.isfinite(step) or abs(step) <= 4 * EPS * abs(value):
                    break
                value += step
            made.append(_norm(z))
            continue
        shift = value * (1 + 2 * EPS * (k - first))
        twisted = Twisted(d, low, shift)
        z = _norm(random.standard_normal(n))
        for _ in range(4):
            z = _norm(_orthogonal(_norm(twisted.solve(z)), made[first:k]))
        made.append(z)
    return made


def right_singular(matrix: np.ndarray, count: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(singular values falling, their right singular vectors as columns), the first ``count`` of them."""
    width = matrix.shape[1]
    a, b, right = bidiagonal(np.asarray(matrix, dtype=np.float64))
    scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(width)[:count], right[:, :count]
    a, b = a / scale, b / scale
    a[np.abs(a) < EPS / 64] = EPS / 64  # beyond what the matrix itself is known to
    b[np.abs(b) <= EPS / 4 * np.sqrt(np.abs(a[:-1] * a[1:]))] = 0.0
    ends = [0, *(np.flatnonzero(b == 0.0) + 1).tolist(), width]
    found = []
    for start, end in zip(ends[:-1], ends[1:], strict=True):
        values = dqds((a[start:end] ** 2).tolist(), (b[start : end - 1] ** 2).tolist())
        found += [(value, start, end, k) for k, value in enumerate(values)]
    found.sort(key=lambda f: -f[0])
    found = found[:count]
    vectors = np.zeros((width, len(found)))
    for start, end in zip(ends[:-1], ends[1:], strict=True):
        places = [(n, f[0]) for n, f in enumerate(found) if f[1] == start]
        for (n, _), z in zip(places, _vectors(a[start:end], b[start : end - 1], [v for _, v in places]), strict=True):
            vectors[start:end, n] = z
    return np.sqrt([f[0] for f in found]) * scale, right @ vectors
