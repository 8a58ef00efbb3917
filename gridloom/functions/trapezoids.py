"""Regions with slanted edges, as trapezoids, in numpy; used inside Arrow tasks.

A region is an array of rows (y1, y2, left1, right1, left2, right2): between two
heights, the ends along x at the lower and at the upper one. Operands are cut at the
heights of all corners and crossings of edges; between two of these no edges cross, so
their order along x tells what is in, and pieces between the same two edges are
joined again. A last column more, the number of a plane, makes it a stack of regions
that do not see each other. The functions are those of :mod:`regions`, for one that
works on either.
"""

from __future__ import annotations

import numpy as np

from gridloom.functions.regions import ranked, stretches

EMPTY = np.zeros((0, 6))
#: Pairs of edges that are tried for a crossing at once.
_PAIRS = 2_000_000


def from_edges(edges: np.ndarray) -> np.ndarray:
    """The region inside outlines that run against the clock, as edges (xa, ya, xb, yb); outlines are united."""
    return _combined([_upward(edges)], lambda a: a)


def _upward(edges: np.ndarray) -> np.ndarray:
    """(x1, y1, x2, y2, step): edges from low to high, with what crossing them to the right adds."""
    down = edges[:, 3] < edges[:, 1]
    up = np.where(down[:, None], edges[:, [2, 3, 0, 1]], edges[:, :4])
    return np.concatenate([up, np.where(down, 1.0, -1.0)[:, None], edges[:, 4:]], axis=1)[edges[:, 1] != edges[:, 3]]


def _sides(region: np.ndarray) -> np.ndarray:
    y1, y2, left1, right1, left2, right2 = region[:, :6].T
    one, plane = np.ones(len(region)), region[:, 6:].T
    return np.concatenate([np.stack([left1, y1, left2, y2, one, *plane], axis=1), np.stack([right1, y1, right2, y2, -one, *plane], axis=1)])


def _crossings(e: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heights at which two edges of a plane cross, and one of the two; ``first`` and ``last`` are the places of their ends among heights."""
    order = np.argsort(first, kind="stable")
    e, first, last = e[order], first[order], last[order]
    low, high = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    n = np.maximum(np.searchsorted(first, last) - np.arange(len(e)) - 1, 0)  # those that begin below the end of this one
    bound = np.r_[0, np.cumsum(n)]
    found, of = [np.zeros(0)], [np.zeros(0, np.int64)]
    start = 0
    while start < len(e):
        stop = max(int(np.searchsorted(bound, bound[start] + _PAIRS, "right")) - 1, start + 1)
        i = np.repeat(np.arange(start, stop), n[start:stop])
        j = np.arange(len(i)) - np.repeat(bound[start:stop] - bound[start], n[start:stop]) + i + 1
        near = (low[i] < high[j]) & (high[i] > low[j]) & (slope[i] != slope[j])
        i, j = i[near], j[near]
        # where both lines are at the same x, within both edges
        y = e[i, 1] + (e[j, 0] - e[i, 0] + (e[i, 1] - e[j, 1]) * slope[j]) / (slope[i] - slope[j])
        both = (y > e[j, 1]) & (y < np.minimum(e[i, 3], e[j, 3]))
        found.append(y[both])
        of.append(order[i[both]])
        start = stop
    return np.concatenate(found), np.concatenate(of)


def _combined(operands: list[np.ndarray], rule) -> np.ndarray:
    known = [o for o in operands if len(o)]
    if not known:
        return EMPTY
    e = np.concatenate(known)
    which = np.repeat(np.arange(len(operands)), [len(o) for o in operands])
    plane = e[:, 5] if e.shape[1] > 5 else np.zeros(len(e))
    ends, planes = np.r_[e[:, 1], e[:, 3]], np.r_[plane, plane]
    rank, _, _ = ranked(ends, planes)
    y, of = _crossings(e, rank[: len(e)], rank[len(e) :])
    rank, ys, planes = ranked(np.r_[ends, y], np.r_[planes, plane[of]])
    k, slab = stretches(rank[: len(e)], rank[len(e) : 2 * len(e)])
    x, base, slope = e[k, 0], e[k, 1], (e[:, 2] - e[:, 0])[k]
    tall = e[k, 3] - base
    below, above = (x + (h - base) * slope / tall for h in (ys[slab], ys[slab + 1]))
    order = np.lexsort((below + above, slab))
    k, slab, below, above = k[order], slab[order], below[order], above[order]
    # outlines are closed, so the sums are back at zero where a slab ends
    owner, step = which[k], e[k, 4]
    inside = rule(*(np.cumsum(np.where(owner == o, step, 0)) > 0.5 for o in range(len(operands))))
    change = inside != np.r_[False, inside[:-1]]
    left, right = np.flatnonzero(change & inside), np.flatnonzero(change & ~inside)
    out = np.stack([ys[slab[left]], ys[slab[left] + 1], below[left], below[right], above[left], above[right], planes[slab[left]]], axis=1)
    order = np.lexsort((slab[left], k[right], k[left]))
    out, s, a, b = out[order], slab[left][order], k[left][order], k[right][order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (s[1:] != s[:-1] + 1)
    begin = np.flatnonzero(fresh)
    end = np.r_[begin[1:], len(out)][: len(begin)] - 1
    joined = np.stack([out[begin, 0], out[end, 1], out[begin, 2], out[begin, 3], out[end, 4], out[end, 5], out[begin, 6]], axis=1)
    joined = joined[area_of(joined) > 0]
    return joined[np.lexsort((joined[:, 2], joined[:, 0], joined[:, 6])), : e.shape[1] + 1]


def combined(operands: list[np.ndarray], rule) -> np.ndarray:
    """The region where ``rule`` of the operands holds; nowhere outside all of them."""
    return _combined([_sides(o) for o in operands], rule)


def dissolved(region: np.ndarray) -> np.ndarray:
    return combined([region], lambda a: a)


def boxed(field: np.ndarray) -> np.ndarray:
    """A box (x1, y1, x2, y2), or the boxes of a stack, as a region."""
    return field.reshape(-1, field.shape[-1])[:, [1, 3, 0, 2, 0, 2, *range(4, field.shape[-1])]].astype(float)


def complement(region: np.ndarray, field: np.ndarray) -> np.ndarray:
    return combined([boxed(field), region], lambda f, a: f & ~a)


def grown(region: np.ndarray, axis: str, n: float) -> np.ndarray:
    """Every point moved up to n along one axis, both ways; n <= 0 changes nothing."""
    if n <= 0 or not len(region):
        return region
    if axis == "W":
        return dissolved(region + np.array([0, 0, -n, n, -n, n, 0])[: region.shape[1]])
    y1, y2, left1, right1, left2, right2 = region[:, :6].T
    plane = region[:, 6:].T
    corners = [(left1, y1), (right1, y1), (right2, y2), (left2, y2)]
    shapes = [region + np.array([s, s, 0, 0, 0, 0, 0])[: region.shape[1]] for s in (-n, n)]
    edges = []
    for (xa, ya), (xb, yb) in zip(corners, corners[1:] + corners[:1], strict=True):  # what each side passes over
        swap = xa > xb
        xa, ya, xb, yb = np.where(swap, xb, xa), np.where(swap, yb, ya), np.where(swap, xa, xb), np.where(swap, ya, yb)
        ring = [(xa, ya - n), (xb, yb - n), (xb, yb + n), (xa, ya + n)]
        edges += [np.stack([px, py, qx, qy, *plane], axis=1) for (px, py), (qx, qy) in zip(ring, ring[1:] + ring[:1], strict=True)]
    return _combined([np.concatenate([*map(_sides, shapes), _upward(np.concatenate(edges))])], lambda a: a)


#: What a region grows to, as an operand.
moved = grown


def shrunk(region: np.ndarray, axis: str, n: float, field: np.ndarray) -> np.ndarray:
    """The field without what its empty part grows into; the field's edge stays."""
    return region if n <= 0 else complement(grown(complement(region, field), axis, n), field)


def clipped(region: np.ndarray, field: np.ndarray) -> np.ndarray:
    x1, y1, x2, y2 = (field[region[:, 6].astype(np.int64)] if region.shape[1] > 6 else field.reshape(1, -1)).T[:4]
    if ((region[:, [2, 4]].min(axis=1, initial=np.inf) >= x1) & (region[:, 0] >= y1) & (region[:, [3, 5]].max(axis=1, initial=-np.inf) <= x2) & (region[:, 1] <= y2)).all():
        return region
    return combined([region, boxed(field)], lambda a, f: a & f)


def area_of(region: np.ndarray) -> np.ndarray:
    y1, y2, left1, right1, left2, right2 = region[:, :6].T
    return (y2 - y1) * (right1 - left1 + right2 - left2) / 2


def area(region: np.ndarray) -> float:
    return float(area_of(region).sum())
