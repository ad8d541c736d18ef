"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

By Sylvester's law the pivots of an LDLᵀ factorisation of ``V - s I`` have as many positive
signs as ``V`` has eigenvalues above ``s``. Halving intervals by such counts isolates each
leading eigenvalue, Rayleigh quotient iteration then converges cubically to it, and counts
on both sides of what was found certify that it has the number it was given.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Pivots below this share of the largest entry of their column take their neighbour along.
PIVOT = (1 + 17**0.5) / 8
#: Eigenvalues nearer than this, times the spectrum's bound, are found as one group.
CLUSTER = 1e-9
#: Half width of the interval whose counts certify a number, times that bound.
SLACK = 1e-12
ROUNDS = 40


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed ``shift``: the positive pivots of LDLᵀ.

    Pivots are of one or two rows by Bunch and Kaufman, so that an indefinite matrix
    factors stably. A pivot of two rows has one positive and one negative eigenvalue.
    """
    a = matrix - shift * np.eye(len(matrix))
    tiny = EPS * max(np.abs(a).max(initial=0.0), np.finfo(float).tiny)
    positive, at, n = 0, 0, len(a)

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j], at:] = a[[j, i], at:]
            a[at:, [i, j]] = a[at:, [j, i]]

    while at < n:
        below = np.abs(a[at + 1 :, at])
        most = below.max(initial=0.0)
        wide = False
        if max(most, abs(a[at, at])) <= tiny:
            at += 1  # a zero column: an eigenvalue equal to the shift, not above it
            continue
        if abs(a[at, at]) < PIVOT * most:
            row = at + 1 + int(below.argmax())
            beside = np.abs(a[row, at:])
            beside[row - at] = 0.0
            other = beside.max()
            if abs(a[at, at]) * other < PIVOT * most**2:
                if abs(a[row, row]) >= PIVOT * other:
                    swap(at, row)
                else:
                    swap(at + 1, row)
                    wide = True
        if wide:
            column = a[at + 2 :, at : at + 2]
            a[at + 2 :, at + 2 :] -= column @ np.linalg.solve(a[at : at + 2, at : at + 2], column.T)
            positive += 1
            at += 2
        else:
            column = a[at + 1 :, at]
            a[at + 1 :, at + 1 :] -= np.outer(column, column / a[at, at])
            positive += a[at, at] > 0
            at += 1
    return int(positive)


def isolated(matrix: np.ndarray, wanted: int, bound: float) -> list[tuple[float, float, int, int]]:
    """Intervals (low, high, eigenvalues above low, above high) that hold the leading ones.

    Falling and disjoint. Each holds one eigenvalue, or several within CLUSTER.
    """
    n = len(matrix)
    todo, done = [(-bound, bound, n, 0)], []
    while todo:
        low, high, over_low, over_high = todo.pop()
        if over_low == over_high or over_high >= wanted:
            continue
        if over_low - over_high == 1 or high - low <= CLUSTER * bound:
            done.append((low, high, over_low, over_high))
            continue
        middle = (low + high) / 2
        count = min(max(above(matrix, middle), over_high), over_low)
        todo += [(low, middle, over_low, count), (middle, high, count, over_high)]
    return sorted(done, reverse=True)


def solved(matrix: np.ndarray, shift: float, right: np.ndarray, bound: float) -> np.ndarray:
    """``(matrix - shift I)^-1 right``, next to the shift where that is an eigenvalue."""
    for nudge in (0.0, 1.0, -1.0, 3.0):
        try:
            x = np.linalg.solve(matrix - (shift + nudge * EPS * bound) * np.eye(len(matrix)), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all():
            return x
    raise ArithmeticError("no shift next to an eigenvalue could be solved for")


def rayleigh(matrix: np.ndarray, low: float, high: float, start: np.ndarray, bound: float):
    """The eigenpair that the iteration reaches from the middle of (low, high]."""
    x = start / np.linalg.norm(start)
    middle = (low + high) / 2
    for _ in range(2):  # towards the vector of the eigenvalue next to the middle
        x = solved(matrix, middle, x, bound)
        x /= np.linalg.norm(x)
    last = np.inf
    for _ in range(ROUNDS):
        value = float(x @ matrix @ x)
        residual = np.linalg.norm(matrix @ x - value * x)
        if residual >= last or residual <= EPS * bound:
            break
        last = residual
        x = solved(matrix, value, x, bound)
        x /= np.linalg.norm(x)
    return float(x @ matrix @ x), x


def certified(matrix: np.ndarray, value: float, place: int, slack: float) -> bool:
    """Whether ``place`` eigenvalues lie above ``value``, give or take ``slack``."""
    return above(matrix, value + slack) <= place < above(matrix, value - slack)


def group(matrix: np.ndarray, low: float, high: float, size: int, bound: float, rng) -> list:
    """Eigenpairs of a cluster: subspace iteration, turned so that they are orthogonal."""
    basis = np.linalg.qr(rng.standard_normal((len(matrix), size)))[0]
    for _ in range(4):
        basis = np.linalg.qr(solved(matrix, (low + high) / 2, basis, bound))[0]
    small = basis.T @ matrix @ basis
    for _ in range(ROUNDS):  # Jacobi rotations of the small matrix of Rayleigh quotients
        for i in range(size):
            for j in range(i + 1, size):
                if abs(small[i, j]) <= EPS * bound * EPS:
                    continue
                angle = 0.5 * np.arctan2(2 * small[i, j], small[i, i] - small[j, j])
                turn = np.eye(size)
                turn[[i, j], [i, j]] = np.cos(angle)
                turn[i, j], turn[j, i] = -np.sin(angle), np.sin(angle)
                small, basis = turn.T @ small @ turn, basis @ turn
        if np.abs(small - np.diag(np.diag(small))).max(initial=0.0) <= EPS * EPS * bound:
            break
    pairs = [(float(small[i, i]), basis[:, i]) for i in range(size)]
    return sorted(pairs, key=lambda pair: -pair[0])


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and their unit eigenvectors as rows.

    Eigenvalues that are zero to working precision are left out. Signs are such that a
    vector's largest entry is positive. ArithmeticError if a count contradicts the numbering.
    """
    n = len(matrix)
    bound = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    if not bound:
        return np.empty(0), np.empty((0, n))
    scaled = matrix / bound  # the spectrum within -1 to 1
    rng = np.random.default_rng(7)
    found: list[tuple[float, np.ndarray]] = []
    for low, high, over_low, over_high in isolated(scaled, min(most, n), 1.0 + 4 * EPS):
        if over_low - over_high > 1:
            found += group(scaled, low, high, over_low - over_high, 1.0, rng)
            continue
        while True:
            pair = rayleigh(scaled, low, high, rng.standard_normal(n), 1.0)
            if certified(scaled, pair[0], over_high, SLACK):
                break
            # It went to a neighbour: start nearer to the one wanted.
            if high - low <= SLACK:
                raise ArithmeticError(f"eigenvalue {over_high + 1} is not found in its interval")
            middle = (low + high) / 2
            low, high = (middle, high) if above(scaled, middle) > over_high else (low, middle)
        found.append(pair)
    found.sort(key=lambda pair: -pair[0])
    values, vectors = [], []
    for place, (value, x) in enumerate(found[:most]):
        if value <= 8 * n * EPS:
            break
        for _ in range(2):
            for y in vectors:
                x = x - (x @ y) * y
        x = x / np.linalg.norm(x)
        if not certified(scaled, value, place, 4 * CLUSTER if _crowded(found, place) else SLACK):
            raise ArithmeticError(f"eigenvalue {place + 1} is not where the counts place it")
        values.append(value * bound)
        vectors.append(x * np.sign(x[np.abs(x).argmax()]))
    return np.array(values), np.array(vectors).reshape(-1, n)


def _crowded(found: list, place: int) -> bool:
    value = found[place][0]
    return any(abs(value - v) <= 4 * CLUSTER for i, (v, _) in enumerate(found) if i != place)
