"""Regions of the plane as disjoint boxes, in numpy; used inside Arrow tasks.

A region is an array of rows (x1, y1, x2, y2) that do not overlap: runs along x
first, then equal runs along y are one box. With a fifth column, the number of a
plane, it is a stack of regions that do not see each other; a field then has a row
for each plane, in order. Operands are cut at the heights of all edges of their
plane, and the pieces of each stretch between two heights are sorted along x, so
that work goes with the pieces. Where there are very many pieces, a plane is swept
along y instead: the edges along x are kept once, with the number of boxes of each
operand over each stretch between them, and an edge along y changes the stretches
under it; memory goes with the edges. Both ways give the same boxes. Holes need no
care.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np

EMPTY = np.zeros((0, 4))
#: Pieces up to which they are all sorted at once.
SMALL = 1_000_000


def boxes(rows) -> np.ndarray:
    """Boxes of positive area with their corners in order."""
    b = np.asarray(rows, float)
    b = b.reshape(-1, b.shape[1] if b.ndim == 2 else 4)
    b = np.concatenate([np.minimum(b[:, :2], b[:, 2:4]), np.maximum(b[:, :2], b[:, 2:4]), b[:, 4:]], axis=1)
    return b[(b[:, 2] > b[:, 0]) & (b[:, 3] > b[:, 1])]


def ranked(y: np.ndarray, plane: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each height's place among the distinct ones of all planes, plane after plane; these heights and their planes."""
    order = np.lexsort((y, plane))
    y, plane = y[order], plane[order]
    fresh = np.ones(len(y), bool)
    fresh[1:] = (y[1:] != y[:-1]) | (plane[1:] != plane[:-1])
    rank = np.empty(len(y), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    return rank, y[fresh], plane[fresh]


def stretches(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that reach from one place to another: row and place of every step on the way."""
    n = high - low
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + low[k]


def _cut(b: np.ndarray, which: np.ndarray, operands: int, rule, low: np.ndarray, high: np.ndarray, ys: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The region where ``rule`` of the operands holds, from pieces between the heights ``ys``."""
    xs, at = np.unique(b[:, [0, 2]], return_inverse=True)
    at = at.reshape(-1, 2)
    k, slab = stretches(low, high)
    key = np.concatenate([slab * len(xs) + at[k, 0], slab * len(xs) + at[k, 1]])
    order = np.argsort(key)
    key, step = key[order], np.where(order < len(k), 1, -1)
    last = np.ones(len(key), bool)
    last[:-1] = key[1:] != key[:-1]
    owner = which[k[order % len(k)]] if operands > 1 else None
    inside = rule(*(np.cumsum(step if owner is None else np.where(owner == o, step, 0))[last] > 0 for o in range(operands)))
    # nothing is in where a stretch ends, so each run ends in its own
    key, before = key[last], np.r_[False, inside[:-1]]
    (row, start), (_, end) = np.divmod(key[inside & ~before], len(xs)), np.divmod(key[before & ~inside], len(xs))
    order = np.lexsort((row, end, start))
    row, start, end = row[order], start[order], end[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1]) | (row[1:] != row[:-1] + 1)
    first = np.flatnonzero(fresh)
    top = np.r_[first[1:], len(row)][: len(first)] - 1
    out = np.stack([xs[start[first]], ys[row[first]], xs[end[first]], ys[row[top] + 1], planes[row[first]]], axis=1)
    return out[np.lexsort((out[:, 0], out[:, 1], out[:, 4]))]


def swept(operands: list[np.ndarray], rule, xs: np.ndarray) -> np.ndarray:
    """The region where ``rule`` of the operands holds, by a sweep along y.

    ``starts`` holds the runs that are in at the present y, in order, each by its first
    stretch, with the stretch after it and the y from which it has been the same. An
    edge takes out the runs that it touches and puts in what is there now; runs that
    are not the same any more become boxes.
    """
    b = np.concatenate(operands)
    which = np.repeat(np.arange(len(operands)), [len(o) for o in operands]).tolist()
    low, high = np.searchsorted(xs, b[:, 0]).tolist(), np.searchsorted(xs, b[:, 2]).tolist()
    at = np.r_[b[:, 1], b[:, 3]]
    order = np.argsort(at, kind="stable")
    at, order = at[order], order.tolist()
    count = np.zeros((len(operands), len(xs)), np.int32)
    starts: list[int] = []
    until: dict[int, int] = {}
    since: dict[int, float] = {}
    out: list[tuple[int, float, int, float]] = []
    edges = [*np.flatnonzero(np.r_[True, at[1:] != at[:-1]]).tolist(), len(at)]
    for first, last in zip(edges[:-1], edges[1:], strict=True):
        y, spans = float(at[first]), []
        for k in order[first:last]:
            k, step = (k, 1) if k < len(b) else (k - len(b), -1)
            count[which[k], low[k] : high[k]] += step
            spans.append((low[k], high[k]))
        spans.sort()
        while spans:  # stretches that touch are looked at together
            left, right = spans.pop()
            while spans and spans[-1][1] >= left:
                more = spans.pop()
                left, right = more[0], max(right, more[1])
            change = np.flatnonzero(np.diff(rule(*(c[left:right] > 0 for c in count)).astype(np.int8), prepend=0, append=0)).tolist()
            new = [(s + left, e + left) for s, e in zip(change[::2], change[1::2], strict=True)]
            i = bisect_left(starts, left)
            if i and until[starts[i - 1]] >= left:
                i -= 1
            old = [(s, until[s]) for s in starts[i : bisect_right(starts, right)]]
            if old and old[0][0] < left:  # what sticks out to either side stays in
                new[:1] = [(old[0][0], new[0][1])] if new and new[0][0] == left else [(old[0][0], left), *new[:1]]
            if old and old[-1][1] > right:
                new[-1:] = [(new[-1][0], old[-1][1])] if new and new[-1][1] == right else [*new[-1:], (right, old[-1][1])]
            if new == old:
                continue
            for s, e in set(old).difference(new):
                if (began := since.pop(s)) < y:
                    out.append((s, began, e, y))
                del until[s]
            for s, e in set(new).difference(old):
                until[s], since[s] = e, y
            starts[i : i + len(old)] = [s for s, _ in new]
    if not out:
        return EMPTY
    found = np.array(out)
    found[:, 0], found[:, 2] = xs[found[:, 0].astype(np.int64)], xs[found[:, 2].astype(np.int64)]
    return found[np.lexsort((found[:, 0], found[:, 1]))]


def combined(operands: list[np.ndarray], rule) -> np.ndarray:
    """The region where ``rule`` of the operands' masks holds; nowhere outside all of them.

    The boxes of an operand may overlap.
    """
    known = [o for o in operands if len(o)]
    if not known:
        return EMPTY
    b = np.concatenate(known)
    width = b.shape[1]
    which = np.repeat(np.arange(len(operands)), [len(o) for o in operands])
    plane = b[:, 4] if width > 4 else np.zeros(len(b))
    rank, ys, planes = ranked(np.r_[b[:, 1], b[:, 3]], np.r_[plane, plane])
    low, high = rank[: len(b)], rank[len(b) :]
    if (high - low).sum() <= SMALL:
        return _cut(b, which, len(operands), rule, low, high, ys, planes)[:, :width]
    if planes[0] == planes[-1]:
        found = swept([o[:, :4] for o in operands], rule, np.unique(b[:, [0, 2]]))
        return np.concatenate([found, np.full((len(found), width - 4), plane[0])], axis=1)
    distinct = np.unique(planes)
    half = distinct[len(distinct) // 2]
    parts = [combined([o[keep(o[:, 4])] if len(o) else o for o in operands], rule) for keep in (lambda p: p < half, lambda p: p >= half)]
    return np.concatenate([x for x in parts if len(x)] or [EMPTY])


def dissolved(b: np.ndarray) -> np.ndarray:
    return combined([boxes(b)], lambda a: a)


def boxed(field: np.ndarray) -> np.ndarray:
    """A field, or the fields of a stack, as a region."""
    return field.reshape(-1, field.shape[-1])


def moved(b: np.ndarray, axis: str, n: float) -> np.ndarray:
    """Boxes, which may overlap, that cover what a region grows to along one axis, both ways."""
    by = np.zeros(b.shape[1])
    by[[0, 2] if axis == "W" else [1, 3]] = -n, n
    return b + by


def grown(b: np.ndarray, axis: str, n: float) -> np.ndarray:
    """Every point moved up to n along one axis, both ways; n <= 0 changes nothing."""
    return b if n <= 0 or not len(b) else dissolved(moved(b, axis, n))


def complement(b: np.ndarray, field: np.ndarray) -> np.ndarray:
    return combined([boxed(field), b], lambda f, a: f & ~a)


def shrunk(b: np.ndarray, axis: str, n: float, field: np.ndarray) -> np.ndarray:
    """The field without what its empty part grows into; the field's edge stays."""
    if n <= 0:
        return b
    return complement(grown(complement(b, field), axis, n), field)


def clipped(b: np.ndarray, field: np.ndarray) -> np.ndarray:
    f = field[b[:, 4].astype(np.int64)] if b.shape[1] > 4 else boxed(field)
    return boxes(np.concatenate([np.maximum(b[:, :2], f[:, :2]), np.minimum(b[:, 2:4], f[:, 2:4]), b[:, 4:]], axis=1)[(b[:, 0] < f[:, 2]) & (b[:, 2] > f[:, 0]) & (b[:, 1] < f[:, 3]) & (b[:, 3] > f[:, 1])])


def area(b: np.ndarray) -> float:
    return float(((b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])).sum())
