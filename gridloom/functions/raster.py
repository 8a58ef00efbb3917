"""Small rasters in numpy: masks of boxes, blur, and template matching."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def masks(boxes: np.ndarray, plane: np.ndarray, planes: int, x0, y0, nm_per_px: float, height: int, width: int) -> np.ndarray:
    """Pixels in any of the boxes of each plane; row 0 is at the top, both end pixels count.

    ``x0`` and ``y0`` are one corner for all or one a box.
    """
    return _summed(boxes, plane, planes, None, x0, y0, nm_per_px, height, width) > 0


def _summed(boxes: np.ndarray, plane: np.ndarray, planes: int, weight: np.ndarray | None, x0, y0, nm_per_px: float, height: int, width: int) -> np.ndarray:
    """The weights, or the number, of the boxes over each pixel of each plane; whole numbers under 2**52.

    Every box marks its four corners, and the marks are summed along both axes.
    """
    cols = np.rint((boxes[:, [0, 2]] - np.reshape(x0, (-1, 1))) / nm_per_px).astype(np.int64)
    rows = (height - 1) - np.rint((boxes[:, [1, 3]] - np.reshape(y0, (-1, 1))) / nm_per_px).astype(np.int64)
    (c1, c2), (r2, r1) = cols.T, rows.T
    seen = (c2 >= 0) & (r2 >= 0) & (c1 < width) & (r1 < height)
    c1, r1 = np.maximum(c1, 0)[seen], np.maximum(r1, 0)[seen]
    c2, r2 = np.minimum(c2, width - 1)[seen] + 1, np.minimum(r2, height - 1)[seen] + 1
    at = plane[seen] * ((height + 1) * (width + 1))
    corners = np.concatenate([at + r * (width + 1) + c for r, c in ((r1, c1), (r2, c2), (r1, c2), (r2, c1))])
    one = np.ones(len(at)) if weight is None else weight[seen].astype(float)
    marks = np.bincount(corners, np.concatenate([one, one, -one, -one]), planes * (height + 1) * (width + 1))
    small = np.abs(one).sum() < 2**31
    marks = marks.reshape(planes, height + 1, width + 1).astype(np.int32 if small else np.int64)
    for along in (1, 2):
        np.cumsum(marks, axis=along, out=marks)
    return marks[:, :height, :width]


def mask(boxes: np.ndarray, x0: float, y0: float, nm_per_px: float, height: int, width: int) -> np.ndarray:
    """One plane of :func:`masks`."""
    return masks(boxes, np.zeros(len(boxes), np.int64), 1, x0, y0, nm_per_px, height, width)[0]


def filled(edges: np.ndarray, plane: np.ndarray, planes: int, x0, y0, nm_per_px: float, height: int, width: int, even_odd: bool = False) -> np.ndarray:
    """Pixels of each plane whose centres lie inside the outlines given by directed edges (xa, ya, xb, yb).

    Every edge marks where it crosses the middle of a row of pixels; summed along the
    row, the marks are how often outlines go around a centre. Inside is where that is
    not 0, so outlines of one direction are united, or with ``even_odd`` where it is
    odd. Of a border the left and the lower part belong to the inside.
    """
    xa, ya, xb, yb = edges.T.astype(float)
    x0, y0 = np.broadcast_to(x0, len(edges)), np.broadcast_to(y0, len(edges))
    low, high = (np.clip(np.ceil((v - y0) / nm_per_px - 0.5), 0, height).astype(np.int64) for v in (np.minimum(ya, yb), np.maximum(ya, yb)))
    n = high - low
    e = np.repeat(np.arange(len(edges)), n)
    row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[e]
    y = y0[e] + (row + 0.5) * nm_per_px
    x = xa[e] + (y - ya[e]) * (xb[e] - xa[e]) / (yb[e] - ya[e])
    col = np.clip(np.ceil((x - x0[e]) / nm_per_px - 0.5), 0, width).astype(np.int64)
    at = (plane[e] * height + height - 1 - row) * (width + 1) + col
    marks = np.bincount(at, np.where(yb > ya, -1.0, 1.0)[e], planes * height * (width + 1)).reshape(planes, height, width + 1)
    around = np.rint(marks.cumsum(axis=2)[:, :, :width]).astype(np.int64)
    return (around % 2 if even_odd else around) != 0


def ring_points(lists) -> tuple[np.ndarray, np.ndarray]:
    """(points, where each ring's begin) of an Arrow column of arrays of (x, y), none of them null."""
    lists = lists.combine_chunks()
    lists = lists.chunk(0) if hasattr(lists, "chunk") else lists
    points = np.stack([lists.flatten().field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")], axis=1)
    return points, np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()


def ring_edges(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, polygon of each edge) of polygons whose points begin at ``starts``, all turned against the clock."""
    n = np.diff(np.r_[starts, len(points)])
    of = np.repeat(np.arange(len(starts)), n)
    after = np.arange(1, len(points) + 1)
    after[starts + n - 1] = starts
    edges = np.concatenate([points, points[after]], axis=1).astype(float)
    area = np.bincount(of, edges[:, 0] * edges[:, 3] - edges[:, 2] * edges[:, 1], len(starts))
    back = area[of] < 0
    edges[back] = edges[back][:, [2, 3, 0, 1]]
    return edges, of


def top_planes(boxes: np.ndarray, ids: np.ndarray, plane: np.ndarray, planes: int, *grid) -> tuple[np.ndarray, np.ndarray]:
    """The ids that there are, in order, and for each pixel of each plane 1 and more for the largest over it, 0 for none.

    The boxes of each id over a pixel are counted in bits of their own of one number,
    which is thus at least as large as the largest id's lowest bit.
    """
    height, width = grid[-2:]
    known, at = np.unique(ids, return_inverse=True)
    out = np.zeros((planes, height, width), np.int64)
    bits = max(1, int(np.bincount(plane, minlength=1).max()).bit_length())
    each = max(1, min(30, 52 - len(boxes).bit_length()) // bits)
    for first in range(0, len(known), each):
        n = min(each, len(known) - first)
        own = (at >= first) & (at < first + n)
        corner = [v if np.ndim(v) == 0 else np.asarray(v)[own] for v in grid[:2]]
        seen = _summed(boxes[own], plane[own], planes, np.left_shift(1, bits * (at[own] - first)), *corner, *grid[2:])
        for k in range(n):
            out[seen >= 1 << (bits * k)] = first + k + 1
    return known, out


def label_planes(boxes: np.ndarray, ids: np.ndarray, plane: np.ndarray, planes: int, *grid) -> np.ndarray:
    """Label of each pixel of each plane; a larger id covers a smaller one, 0 is none."""
    known, top = top_planes(boxes, ids, plane, planes, *grid)
    return np.r_[0, known].astype(np.int32)[top]


def labels(boxes: np.ndarray, ids: np.ndarray, *grid) -> np.ndarray:
    """One plane of :func:`label_planes`."""
    return label_planes(boxes, ids, np.zeros(len(boxes), np.int64), 1, *grid)[0]


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur of the last two axes, one after the other; edges are mirrored."""
    if sigma <= 0:
        return image.astype(float)
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    out = image.astype(float)
    for axis in (-1, -2):  # along each axis a product with the kernel's places, mirrored ones included
        n = image.shape[axis]
        of = np.pad(np.arange(n), reach, mode="reflect")
        places = np.zeros((n, n))
        np.add.at(places, (np.repeat(np.arange(n), len(kernel)), of[np.arange(n)[:, None] + np.arange(len(kernel))].ravel()), np.tile(kernel, n))
        out = out @ places.T if axis == -1 else places @ out
    return out


def correlation(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised correlation of the mean-free template at every place it fits, over the last two axes."""
    h, w = template.shape[-2:]
    high, wide = shape = image.shape[-2:]
    centred = template - template.mean(axis=(-2, -1), keepdims=True)
    # what comes around in a product of the image's size lies before the places where the template fits
    full = np.fft.irfft2(np.fft.rfft2(image, shape) * np.fft.rfft2(centred[..., ::-1, ::-1], shape), shape)
    dot = full[..., h - 1 :, w - 1 :]
    down, across = (np.tri(n - k + 1, n, k - 1) - np.tri(n - k + 1, n, -1) for n, k in ((high, h), (wide, w)))

    def sums(x: np.ndarray) -> np.ndarray:
        return down @ (x @ across.T)

    spread = np.maximum(sums(image * image) - sums(image) ** 2 / (h * w), 0)
    norm = np.sqrt(spread * (centred**2).sum(axis=(-2, -1), keepdims=True))
    return np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 1e-9)


def peak_offset(before, at, after):
    """Where a parabola through three neighbours peaks, within half a step."""
    bend = before - 2 * at + after
    steps = np.divide(0.5 * (before - after), bend, out=np.zeros_like(bend, float), where=bend < 0)
    return np.clip(steps, -0.5, 0.5)


def matches(images: np.ndarray, templates: np.ndarray, radius: int, nm_per_px: float) -> np.ndarray:
    """Rows (dx_nm, dy_nm, score): how each layout must move to fit its image.

    A template's border of ``radius`` pixels is cut off, so that it can be tried
    at all offsets up to it. A flat image or template gives zeros. A pattern that
    sits to the right in the image gives a negative dx, one that sits lower a
    positive dy.
    """
    n, height, width = images.shape
    radius = min(radius, (min(height, width) - 1) // 2)
    out = np.zeros((n, 3))
    if radius < 1 or not n:
        return out
    inner = templates[:, radius : height - radius, radius : width - radius]
    clear = (images.std(axis=(1, 2)) > 0) & (inner.std(axis=(1, 2)) > 0)
    if not clear.any():
        return out
    scores = correlation(images[clear].astype(float), inner[clear].astype(float))
    k = np.arange(len(scores))
    high, wide = scores.shape[1:]
    r, c = np.divmod(scores.reshape(len(scores), -1).argmax(axis=1), wide)
    best = scores[k, r, c]
    near = lambda a, b: scores[k, np.clip(a, 0, high - 1), np.clip(b, 0, wide - 1)]
    ex = c - radius + np.where((c > 0) & (c < wide - 1), peak_offset(near(r, c - 1), best, near(r, c + 1)), 0)
    ey = r - radius + np.where((r > 0) & (r < high - 1), peak_offset(near(r - 1, c), best, near(r + 1, c)), 0)
    out[clear] = np.stack([-ex * nm_per_px, ey * nm_per_px, best], axis=1)
    return out


def match(image: np.ndarray, template: np.ndarray, radius: int, nm_per_px: float) -> tuple[float, float, float]:
    """One row of :func:`matches`."""
    return tuple(matches(image[None], template[None], radius, nm_per_px)[0].tolist())


def runs(image: np.ndarray) -> np.ndarray:
    """Rows (r1, c1, r2, c2), ends past the last pixel: the true pixels as disjoint boxes.

    Runs along a row, of which equal ones in rows that follow are one box.
    """
    change = np.diff(np.pad(image.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, start), (_, end) = np.nonzero(change == 1), np.nonzero(change == -1)
    order = np.lexsort((row, end, start))
    row, start, end = row[order], start[order], end[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1]) | (row[1:] != row[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(row)] - 1 if len(row) else first
    return np.stack([row[first], start[first], row[last] + 1, end[first]], axis=1)


def spread(image: np.ndarray, reach: int, axis: str) -> np.ndarray:
    """True pixels, of one plane or a stack, moved up to ``reach`` along columns (W) or rows (H)."""
    if reach <= 0:
        return image
    along = image.ndim - (1 if axis == "W" else 2)
    pad = [(0, 0)] * image.ndim
    pad[along] = (reach + 1, reach)
    total = np.pad(image.astype(np.int64), pad).cumsum(axis=along)
    n, width = image.shape[along], 2 * reach + 1
    return np.take(total, range(width, width + n), along) > np.take(total, range(n), along)


def moves(tree: tuple, nm_per_px: float) -> int:
    """How many pixels outside a plane can matter: moves in whole pixels, summed along a path."""
    own = round(tree[3] / nm_per_px) if tree[0] in ("grow", "shrink") else 0
    return own + max((moves(x, nm_per_px) for x in tree[1:] if isinstance(x, tuple)), default=0)


def evaluate(tree: tuple, masks: dict[str, np.ndarray], nm_per_px: float) -> np.ndarray:
    """A layer formula on masks, planes or stacks of them; moves are rounded to whole pixels.

    The faster choice for dense fields; against the vector form it can differ by
    a pixel at edges that move. A shrink does not eat from the image's edge.
    """
    op = tree[0]
    if op == "ref":
        return masks[tree[1]]
    a = evaluate(tree[1], masks, nm_per_px)
    if op == "not":
        return ~a
    if op == "grow":
        return spread(a, round(tree[3] / nm_per_px), tree[2])
    if op == "shrink":
        return ~spread(~a, round(tree[3] / nm_per_px), tree[2])
    b = evaluate(tree[2], masks, nm_per_px)
    return a & b if op == "&" else a | b if op == "|" else a & ~b


def colored(labels_: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Label map to colours; labels past the palette start it again."""
    out = palette[(labels_.astype(int) - 1) % len(palette)]
    return np.where((labels_ > 0)[..., None], out, 0).astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """A grey (H, W) or colour (H, W, 3) picture of bytes as a PNG file."""
    height, width = image.shape[:2]
    rows = np.ascontiguousarray(image, np.uint8).reshape(height, -1)
    raw = np.pad(rows, ((0, 0), (1, 0))).tobytes()  # each row starts with filter 0
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
