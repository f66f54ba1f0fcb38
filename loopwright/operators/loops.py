"""Closed walking loops on a matrix of distances: the small numeric core of the routing tasks."""

from __future__ import annotations

import numpy as np

EPS = 1e-9
#: Near stops that a change is looked for at.
NEAR = 10


class Draws:
    """The 32-bit seeded generator, one draw after the other."""

    def __init__(self, seed: int):
        self._state = seed & 0xFFFFFFFF

    def __call__(self) -> float:
        self._state = (self._state + 0x6D2B79F5) & 0xFFFFFFFF
        x = self._state
        x = (x ^ (x >> 15)) * (x | 1) & 0xFFFFFFFF
        x ^= (x + ((x ^ (x >> 7)) * (x | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return (x ^ (x >> 14)) / 4294967296.0


def length(t: np.ndarray, d: np.ndarray) -> float:
    return float(d[t, np.roll(t, -1)].sum()) if len(t) > 1 else 0.0


def nearest_neighbour(members: np.ndarray, d: np.ndarray, start: int) -> np.ndarray:
    left = np.ones(len(members), bool)
    at = int(np.flatnonzero(members == start)[0])
    order = [at]
    left[at] = False
    own = d[np.ix_(members, members)]
    for _ in range(len(members) - 1):
        at = int(np.argmin(np.where(left, own[at], np.inf)))
        left[at] = False
        order.append(at)
    return members[order]


def _two_opt(t: np.ndarray, d: np.ndarray) -> np.ndarray | None:
    """The tour after its best exchange of two legs; None if none shortens it."""
    n = len(t)
    m = d[np.ix_(t, t)]
    leg = m[np.arange(n), np.roll(np.arange(n), -1)]
    change = m + np.roll(m, (-1, -1), (0, 1)) - leg[:, None] - leg[None, :]
    change[np.tril_indices(n, 1)] = 0
    change[0, n - 1] = 0
    i, j = divmod(int(np.argmin(change)), n)
    return np.r_[t[: i + 1], t[i + 1 : j + 1][::-1], t[j + 1 :]] if change[i, j] < -EPS else None


def _or_opt(t: np.ndarray, d: np.ndarray) -> np.ndarray | None:
    """The tour after the best move of a run of one to three stops, either way round."""
    n, m = len(t), d[np.ix_(t, t)]
    at = np.arange(n)
    after = np.roll(at, -1)
    leg = m[at, after]
    best, found = -EPS, None
    for run in range(1, min(3, n - 3) + 1):
        last, before, following = (at + run - 1) % n, (at - 1) % n, (at + run) % n
        gain = m[before, at] + m[last, following] - m[before, following]
        forward = m[at].copy() + m[last][:, after] - leg[None, :] - gain[:, None]
        backward = m[last] + m[at][:, after] - leg[None, :] - gain[:, None]
        # not into the run itself, nor where it stands
        offset = (at[None, :] - before[:, None]) % n
        blocked = offset <= run
        for cost, turned in ((forward, False), (backward, True)):
            cost[blocked] = np.inf
            k = int(np.argmin(cost))
            if cost.flat[k] < best:
                best, found = float(cost.flat[k]), (run, *divmod(k, n), turned)
    if found is None:
        return None
    run, i, p, turned = found
    moved = t[(i + np.arange(run)) % n]
    rest = t[(i + run + np.arange(n - run)) % n]
    place = int(np.flatnonzero(rest == t[p])[0]) + 1
    return np.r_[rest[:place], moved[::-1] if turned else moved, rest[place:]]


def improve(t: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exchanges and moves until neither shortens the loop; under four stops there is nothing to do.

    Most of the way goes by the first change found among near stops; whole rounds then make sure that no change is left.
    """
    if len(t) < 4:
        return t
    own = d[np.ix_(t, t)]
    order = list(range(len(t)))
    shorten(order, own.tolist(), np.argsort(own + np.diag(np.full(len(t), np.inf)), axis=1)[:, :NEAR].tolist(), list(range(len(t))), order[:])
    t = t[order]
    for _ in range(50):
        better = _two_opt(t, d)
        if better is None:
            better = _or_opt(t, d)
        if better is None:
            break
        t = better
    return t


def shorten(tour: list[int], d: list[list[float]], near: list[list[int]], at: list[int], doubtful: list[int]) -> None:
    """Shortens a loop in place by the first exchange or move found about stops in doubt, until no stop is.

    `at` holds each stop's place in the tour, and -1 for stops of other loops; `near` lists stops by distance. A change puts the stops at its ends in doubt again.
    """
    n = len(tour)
    if n < 4:
        return
    waiting = doubtful[::-1]
    while waiting:
        a = waiting.pop()
        touched = _exchanged(tour, d, near[a], at, a, n) or _moved(tour, d, near[a], at, a, n)
        if touched:
            waiting.extend(touched)
            waiting.append(a)


def _exchanged(tour, d, near, at, a, n):
    """Two legs exchanged for two others, one of them from a to a near stop."""
    row, i = d[a], at[a]
    for step in (1, -1):
        b = tour[(i + step) % n]
        leg = row[b]
        for c in near:
            if row[c] >= leg - EPS:
                break
            j = at[c]
            if j < 0:
                continue
            e = tour[(j + step) % n]
            if leg - row[c] + d[c][e] - d[b][e] > EPS:
                # what lies between the legs is turned
                low, high = (i + 1, j) if step == 1 else (i, j - 1)
                if low > high:
                    low, high = (j + 1, i) if step == 1 else (j, i - 1)
                part = tour[low : high + 1]
                part.reverse()
                tour[low : high + 1] = part
                for k in range(low, high + 1):
                    at[tour[k]] = k
                return [b, c, e]
    return None


def _moved(tour, d, near, at, a, n):
    """A run of one to three stops that begins or ends with a, moved beside a near stop of a."""
    row, i = d[a], at[a]
    for run in range(1, min(3, n - 3) + 1):
        for step in (1, -1):
            last, before, after = tour[(i + step * (run - 1)) % n], tour[(i - step) % n], tour[(i + step * run) % n]
            gain = row[before] + d[last][after] - d[before][after]
            if gain <= EPS:
                continue
            for c in near:
                if row[c] >= gain:
                    break
                j = at[c]
                if j < 0 or (step * (j - i)) % n < run:
                    continue
                for side in (1, -1):
                    x = tour[(j + side) % n]
                    if (step * (at[x] - i)) % n < run:  # beside the run itself: what is beyond it
                        x = after if c == before else before
                    if gain - row[c] - d[last][x] + d[c][x] > EPS:
                        stops = [tour[(i + step * k) % n] for k in range(run)]
                        gone = set(stops)
                        rest = [s for s in tour if s not in gone]
                        k = rest.index(c)
                        if rest[(k + 1) % len(rest)] == x:
                            rest[k + 1 : k + 1] = stops
                        else:
                            rest[k:k] = stops[::-1]
                        tour[:] = rest
                        for k, s in enumerate(rest):
                            at[s] = k
                        return [before, after, last, c, x]
            if run == 1:
                break
    return None


def solve_tour(members: np.ndarray, d: np.ndarray, initial: np.ndarray | None = None, starts: int = 4) -> tuple[np.ndarray, float]:
    """The best loop found over the members: from a given order, or from evenly spaced nearest-neighbour tours."""
    members = np.asarray(members, np.int64)
    n = len(members)
    if n <= 2:
        return members, length(members, d)
    k = min(starts, n)
    orders = [initial] if initial is not None else [nearest_neighbour(members, d, members[s * n // k]) for s in range(k)]
    done = [improve(o, d) for o in orders]
    lengths = [length(o, d) for o in done]
    best = int(np.argmin(lengths))
    return done[best], lengths[best]


def warm_start(before: np.ndarray, members: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The stops that stay in their order, each newcomer where it costs least."""
    members = np.asarray(members, np.int64)
    order = before[np.isin(before, members)]
    for x in members[~np.isin(members, order)]:
        if len(order) < 2:
            order = np.r_[order, x]
            continue
        following = np.roll(order, -1)
        p = int(np.argmin(d[order, x] + d[x, following] - d[order, following]))
        order = np.r_[order[: p + 1], x, order[p + 1 :]]
    return order


def rotate_to_start(t: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Starts after the longest leg, the first of equal ones."""
    if len(t) < 3:
        return t
    return np.roll(t, -(int(np.argmax(d[t, np.roll(t, -1)])) + 1))


def count_components(members: np.ndarray, d: np.ndarray, link: float) -> int:
    """Pieces of the members that hang together by steps of at most `link`."""
    near = d[np.ix_(members, members)] <= link
    left, pieces = np.ones(len(members), bool), 0
    while left.any():
        pieces += 1
        front = np.zeros(len(members), bool)
        front[int(np.argmax(left))] = True
        while front.any():
            left &= ~front
            front = near[front].any(axis=0) & left
    return pieces


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull of (x, y) rows without collinear vertices."""
    p = points[np.lexsort((points[:, 1], points[:, 0]))]
    if len(p) < 3:
        return p

    def chain(rows):
        out: list[np.ndarray] = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))
