"""Cutting stock by column generation, on a histogram of item sizes.

Minimise the number of bins of ``capacity`` that hold ``demand[i]`` items of size
``sizes[i]``: a linear program whose columns are patterns (how many items of each size share
a bin). A knapsack dynamic program prices patterns against the dual values; the basis inverse
is kept and updated. The work depends on the number of sizes, not on the number of items.
"""

from __future__ import annotations

import numpy as np

GAP = 4e-3  # the relaxation is solved to within this share of its bound
LONGEST = 3_000  # columns generated at most; what is open then goes to whole patterns below


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    usable = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        top, n = best[room - 1], usable[room]
        if n:
            gain = best[room - sizes[:n]]
            gain += values[:n]
            i = gain.argmax()
            if gain[i] > top:
                top, choice[room] = gain[i], i
        best[room] = top
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[capacity]), pattern


def relaxed_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and their fractional counts in a near-optimal covering.

    Revised simplex: a column with the largest gain enters, the ratio test picks the one that
    leaves, and the basis inverse is updated. A surplus column enters when a dual value turns
    negative. Demands are moved by less than a millionth so that ties do not stall.
    """
    m = len(sizes)
    target = demand * (1 + 1e-6 * np.random.default_rng(m).random(m)) + 1e-6
    fits = capacity // sizes
    columns, cost = np.diag(fits).astype(float), np.ones(m)
    inverse = np.diag(1.0 / fits)
    count = target / fits
    for turn in range(LONGEST):
        values = cost @ inverse
        low = int(values.argmin())
        if values[low] < -1e-7:
            pattern, price = np.zeros(m), 0.0
            pattern[low] = -1.0
        else:
            worth, found = best_pattern(sizes, np.maximum(values, 0), capacity)
            if worth <= 1 + GAP:  # total / worth bounds the optimum from below
                break
            pattern, price = found.astype(float), 1.0
        move = inverse @ pattern
        up = np.flatnonzero(move > 1e-8)
        if not len(up):
            break
        ratio = np.maximum(count[up], 0) / move[up]
        least = ratio.min()
        ties = up[ratio <= least + 1e-12 * max(1.0, least)]
        out = int(ties[move[ties].argmax()])
        count -= least * move
        count[out] = least
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        columns[:, out], cost[out] = pattern, price
        if turn % 100 == 99:
            inverse = np.linalg.pinv(columns) if np.linalg.cond(columns) > 1e12 else np.linalg.inv(columns)
            count = inverse @ target
    real = cost > 0
    return np.rint(columns[:, real]).astype(np.int64), np.maximum(count[real], 0)


def first_fit(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with counts by filling bins with the largest size that fits, whole runs at once."""
    left, plan = demand.copy(), []
    while left.any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for i in range(len(sizes) - 1, -1, -1):
            n = min(left[i], room // sizes[i])
            if n > 0:
                pattern[i], room = n, room - n * sizes[i]
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left -= times * pattern
        plan.append((pattern, times))
    return plan


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole counts that pack every item exactly once.

    Fractional counts are rounded down; the items left, fewer than one bin per pattern, are
    filled in directly.
    """
    if not len(sizes):
        return []
    columns, count = relaxed_patterns(sizes, demand.astype(float), capacity)
    left, plan = demand.astype(np.int64).copy(), []
    for j in np.argsort(-count, kind="stable").tolist():
        pattern = columns[:, j]
        used = pattern > 0
        most = (left[used] // pattern[used]).min() if used.any() else 0
        times = min(int(count[j] + 1e-3), int(most))
        if times > 0:
            plan.append((pattern.copy(), times))
            left -= times * pattern
    return plan + first_fit(sizes, left, capacity)
