"""Eigendecompositions kept up to date by rank-one changes (numpy, one process).

A spectrum is (values, vectors): eigenvalues in rising order and one column for each.
``rank_one`` adds ``weight * v v^T`` to the matrix behind it. In the old basis the change
is a diagonal plus ``weight * z z^T``; its eigenvalues are the roots of the secular
equation 1 + weight * sum(z_j^2 / (d_j - x)) = 0, one between every two neighbours of the
diagonal. Entries that cannot move an eigenvalue are deflated first. The vectors are
made from a z recomputed for the found roots, so they stay orthogonal to the last digits
even where a root is less exact.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Rounds of the root search. It is bracketed, so leaving it early costs digits only.
ROUNDS = 40


def secular_roots(d: np.ndarray, z: np.ndarray, weight: float) -> np.ndarray:
    """Differences d_j - x_i (row i) for all roots x_i; ``d`` rises, no z is zero."""
    k = len(d)
    squares = weight * z * z
    upper = np.append(d[1:], d[-1] + squares.sum())
    gap = upper - d
    below = np.tri(k)
    above = 1.0 - below
    middle = d[None, :] - (d + gap / 2)[:, None]
    right = 1 + (squares / middle).sum(1) < 0  # the root lies in the right half
    right[-1] = False  # there is no pole right of the last root
    origin = np.where(right, upper, d)
    far = d[None, :] - origin[:, None]
    low, high = np.where(right, -gap, 0.0), np.where(right, 0.0, gap)
    low, high = np.where(right, low / 2, low), np.where(right, high, high / 2)
    high[-1] = gap[-1]
    x = (low + high) / 2
    row = np.arange(k)
    left_pole = far[row, row]
    right_pole = np.append(far[row[:-1], row[1:]], gap[-1] - (origin[-1] - d[-1]))
    delta, share = np.empty_like(far), np.empty_like(far)
    with np.errstate(all="ignore"):
        for _ in range(ROUNDS):
            np.subtract(far, x[:, None], out=delta)
            np.divide(squares, delta, out=share)
            down = np.einsum("ij,ij->i", share, below)
            up = np.einsum("ij,ij->i", share, above)
            f = 1 + down + up
            done = np.abs(f) <= 4 * EPS * (1 - down + up)
            if done.all():
                break
            high, low = np.where(f > 0, x, high), np.where(f <= 0, x, low)
            a, b = left_pole - x, right_pole - x
            np.divide(share, delta, out=share)
            psi = np.einsum("ij,ij->i", share, below)
            phi = np.einsum("ij,ij->i", share, above)
            # two poles and a constant, fitted to value and slope on both sides
            c = f - a * psi - b * phi
            p = (a + b) * f - a * b * (psi + phi)
            q = a * b * f
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0.0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            new = x + step
            good = (new > low) & (new < high)
            new = np.where(good, new, (low + high) / 2)
            if (done | (new == x)).all():
                break
            x = np.where(done, x, new)
    return far - x[:, None]


def _deflate_equal(d, z, vectors, tolerance):
    """Turn pairs of nearly equal diagonal entries so that one z of each vanishes."""
    last = -1
    for j in range(len(d)):
        if z[j] == 0.0:
            continue
        if last >= 0:
            tau = np.hypot(z[j], z[last])
            c, s = z[j] / tau, z[last] / tau
            if abs((d[j] - d[last]) * c * s) <= tolerance:
                z[j], z[last] = tau, 0.0
                one, two = vectors[:, last].copy(), vectors[:, j].copy()
                vectors[:, last], vectors[:, j] = c * one - s * two, s * one + c * two
                d[last], d[j] = (
                    d[last] * c * c + d[j] * s * s,
                    d[last] * s * s + d[j] * c * c,
                )
        last = j


def rank_one(
    values: np.ndarray, vectors: np.ndarray, v: np.ndarray, weight: float
) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of the matrix plus ``weight * v v^T``; ``weight`` is not negative."""
    z = v @ vectors
    length = float(np.sqrt(z @ z))
    if not weight > 0 or not length > 0:
        return values, vectors
    z, weight = z / length, weight * length * length
    scale = max(abs(values[-1]), abs(values[0]), weight)
    tolerance = 8 * EPS * scale
    z = np.where(weight * np.abs(z) <= tolerance, 0.0, z)
    alive = np.flatnonzero(z)
    d = values
    near = np.diff(d[alive]) * np.abs(z[alive[1:]] * z[alive[:-1]]) <= tolerance
    if near.any():
        d, vectors = d.copy(), vectors.copy()
        _deflate_equal(d, z, vectors, tolerance)
        alive = np.flatnonzero(z)
    new_values = d.copy()
    new_vectors = vectors
    if len(alive):
        poles, part = d[alive], z[alive]
        order = np.argsort(poles, kind="stable")
        alive, poles, part = alive[order], poles[order], part[order]
        apart = secular_roots(poles, part, weight)  # [i, j] = d_j - x_i
        # z for which the found roots are exact
        ratio = poles[:, None] - poles[None, :]
        np.fill_diagonal(ratio, 1.0)
        exact = np.sqrt(np.abs(np.prod(-apart / ratio, axis=0)))
        turn = np.copysign(exact, part) / apart
        turn /= np.sqrt((turn * turn).sum(1))[:, None]
        row = np.arange(len(poles))
        new_values[alive] = poles[row] - apart[row, row]
        new_vectors = vectors.copy()
        new_vectors[:, alive] = vectors[:, alive] @ turn.T
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


class Spread:
    """Count, exact sums and spectrum of the scatter around the mean of whole vectors."""

    def __init__(self, dims: int):
        self.n = 0
        self.sums = [0] * dims
        self.mean = np.zeros(dims)
        self.values = np.zeros(dims)
        self.vectors = np.eye(dims)

    def add(self, x: np.ndarray) -> None:
        """One vector more: the scatter grows by n / (n + 1) of its distance squared."""
        apart = x - self.mean
        weight = self.n / (self.n + 1)
        self.values, self.vectors = rank_one(self.values, self.vectors, apart, weight)
        self.n += 1
        self.mean = self.mean + apart / self.n

    def merge(self, other: Spread) -> None:
        """Take in another spread, one of its components after the other."""
        if not other.n:
            return
        n = self.n + other.n
        apart = other.mean - self.mean
        steps = [(other.vectors[:, j], other.values[j]) for j in range(len(other.values))]
        if self.n:
            steps.append((apart, self.n * other.n / n))
        for v, weight in steps:
            self.values, self.vectors = rank_one(self.values, self.vectors, v, weight)
        self.mean = self.mean + apart * (other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n = n
