"""Delaunay flips inside a block of triangles, in one task: rounds of flips that touch no triangle twice, the worst edge of each neighbourhood first, until none is left.

A block holds all triangles on its vertices. Those with all three vertices in it are its own; the others are only looked at. An edge is decided here if both of its triangles are the block's own: every triangle on its ends
and on the third corners is then known, and no other block changes them.
"""

from __future__ import annotations

import math

import numpy as np


def _angle(opposite: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """As ``geometry.angle``."""
    true = (s1 > 0) & (s2 > 0)
    below = np.where(true, 2.0 * s1 * s2, 1.0)
    below = np.where(below == 0, 1.0, below)
    return np.where(true, np.arccos(np.clip((s1 * s1 + s2 * s2 - opposite * opposite) / below, -1.0, 1.0)), 0.0)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a[:, 1] * b[:, 2] - a[:, 2] * b[:, 1], a[:, 2] * b[:, 0] - a[:, 0] * b[:, 2], a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]], 1)


class Flipper:
    """``corners``: numbers of points, a row a triangle. Half-edge 3 f + k runs from corner k of triangle f to the next one."""

    def __init__(self, points: np.ndarray, corners: np.ndarray, own: np.ndarray, open_: np.ndarray, least: float):
        self.p, self.t, self.own, self.least = points, corners.copy(), own, least
        n = len(corners)
        self.n = len(points)
        src, dst = self.t.ravel(), self.t[:, [1, 2, 0]].ravel()
        key = self.key(src, dst)
        order = np.argsort(key, kind="stable")
        order = order[(src != dst)[order]]
        s = key[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(s)])
        one, two = order[first[size == 2]], order[first[size == 2] + 1]
        turned = src[one] != src[two]
        self.twin = np.full(3 * n, -1, np.int64)
        self.twin[one[turned]], self.twin[two[turned]] = two[turned], one[turned]
        self.first_keys = s[first]
        self.edges = set(self.first_keys.tolist())
        face = np.arange(3 * n) // 3
        self.touched = open_[face] | ((self.twin >= 0) & open_[self.twin // 3])
        self.excess = np.zeros(3 * n)
        self.made = 0

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a, b) * self.n + np.maximum(a, b)

    def around(self, e: np.ndarray) -> tuple[np.ndarray, ...]:
        """v1, v2, w, u of half-edges that have a twin."""
        f, k, h, j = e // 3, e % 3, self.twin[e] // 3, self.twin[e] % 3
        return self.t[f, k], self.t[f, (k + 1) % 3], self.t[f, (k + 2) % 3], self.t[h, (j + 2) % 3]

    def judge(self, e: np.ndarray) -> None:
        """Sets the excess of edges by half-edges; 0 where the edge is good, turns a triangle over or isn't decided here. It is kept at the half-edge that runs upwards."""
        self.excess[e] = 0
        e = e[self.twin[e] >= 0]
        self.excess[self.twin[e]] = 0
        e = e[self.own[e // 3] & self.own[self.twin[e] // 3]]
        v1, v2, w, u = self.around(e)
        e = np.unique(np.where(v1 < v2, e, self.twin[e]))
        for i in range(0, len(e), 1 << 17):
            part = e[i : i + (1 << 17)]
            v1, v2, w, u = self.around(part)
            p, q, r, s = self.p[v1], self.p[v2], self.p[w], self.p[u]
            d = _distance(p, q)
            over = _angle(d, _distance(p, r), _distance(q, r)) + _angle(d, _distance(p, s), _distance(q, s)) - math.pi
            one, two = _cross(s - p, r - p), _cross(q - s, r - s)
            up = one[:, 0] * two[:, 0] + one[:, 1] * two[:, 1] + one[:, 2] * two[:, 2] > 0
            self.excess[part] = np.where((over > self.least) & up & (w != u), over, 0)

    def chosen(self) -> np.ndarray:
        """Edges to flip now: no triangle is on two of them, no two make the same edge."""
        e = np.flatnonzero(self.excess > 0)
        v1, v2, w, u = self.around(e)
        new = self.key(w, u)
        free = np.fromiter((k not in self.edges for k in new.tolist()), bool, len(e))
        e, v1, v2, new = e[free], v1[free], v2[free], new[free]
        order = np.lexsort((-v2, -v1, self.excess[e]))
        e, new = e[order], new[order]
        f, h, rank = e // 3, self.twin[e] // 3, np.arange(len(e))
        best = np.full(len(self.t), -1, np.int64)
        np.maximum.at(best, f, rank)
        np.maximum.at(best, h, rank)
        mine = np.flatnonzero((best[f] == rank) & (best[h] == rank))[::-1]
        return e[mine][np.unique(new[mine], return_index=True)[1]]

    def flip(self, e: np.ndarray) -> None:
        v1, v2, w, u = self.around(e)
        o = self.twin[e]
        f, h = e // 3, o // 3
        after, before = lambda x: x // 3 * 3 + (x + 1 - x // 3 * 3) % 3, lambda x: x // 3 * 3 + (x + 2 - x // 3 * 3) % 3
        old = np.concatenate([after(e), before(e), after(o), before(o)])
        new = np.concatenate([3 * h + 1, 3 * f + 2, 3 * f, 3 * h])
        across = self.twin[old]
        moved = np.arange(len(self.twin))
        moved[old] = new
        across = np.where(across >= 0, moved[across], -1)
        self.edges.difference_update(self.key(v1, v2).tolist())
        self.edges.update(self.key(w, u).tolist())
        self.t[f], self.t[h] = np.stack([v1, u, w], 1), np.stack([u, v2, w], 1)
        self.twin[new] = across
        both = across >= 0
        self.twin[across[both]] = new[both]
        self.twin[3 * f + 1], self.twin[3 * h + 2] = 3 * h + 2, 3 * f + 1
        self.touched[new] = True
        self.touched[across[both]] = True
        self.touched[3 * f + 1] = self.touched[3 * h + 2] = True
        self.judge(np.concatenate([new, 3 * f + 1]))
        self.made += len(e)

    def run(self, max_rounds: int) -> None:
        self.judge(np.flatnonzero(self.twin > np.arange(len(self.twin))))
        for _ in range(max_rounds):
            e = self.chosen()
            if not len(e):
                return
            self.flip(e)
        raise RuntimeError(f"flips did not settle in {max_rounds} rounds")

    def left_open(self) -> np.ndarray:
        """Own triangles with an edge that has changed and isn't decided here, as the triangle on its other side isn't the block's own."""
        other = np.where(self.twin >= 0, self.twin // 3, 0)
        return self.own & (self.touched & (self.twin >= 0) & ~self.own[other]).reshape(-1, 3).any(1)

    def freed(self) -> np.ndarray:
        """Triangles beside an edge that isn't decided here and could not be flipped before, as the edge that this makes was there; now it is gone."""
        e = np.flatnonzero(self.twin > np.arange(len(self.twin)))
        e = e[~(self.own[e // 3] & self.own[self.twin[e] // 3])]
        _, _, w, u = self.around(e)
        lost = self.first_keys[~np.fromiter((k in self.edges for k in self.first_keys.tolist()), bool, len(self.first_keys))]
        e = e[np.isin(self.key(w, u), lost)]
        out = np.zeros(len(self.t), bool)
        out[e // 3] = out[self.twin[e] // 3] = True
        return out
