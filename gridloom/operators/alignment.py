"""Images against their layout: shapes in view, rasters, match and pixel counts.

Fields are drawn a block of images at a time: the shapes of a block are marked on
one stack of planes, and blur, correlation and peaks run over the whole stack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import raster
from gridloom.operators import layer_algebra
from gridloom.operators.overlap import bbox_join

#: Images that are drawn at once.
BLOCK = 64
#: States of an image before it is matched, in the order they are tried, and after.
NO_COORDS, MISSING, NO_SCALE, FLAT, OK = "no-coords", "missing-file", "no-scale", "flat", "ok"


def in_view(shapes: DataFrame, images: DataFrame, fov: int, *more: str) -> DataFrame:
    """Shapes in each image's field, once each, with the image's centre and ``more`` of its columns."""
    half = fov // 2
    fields = images.select("image_id", "cx", "cy", *more, *((F.col(c) + s * half).alias(n) for n, c, s in (("qx1", "cx", -1), ("qy1", "cy", -1), ("qx2", "cx", 1), ("qy2", "cy", 1))))
    return bbox_join(shapes, fields, fov).select("image_id", "cx", "cy", *more, "layer", "x1", "y1", "x2", "y2")


def fields_at(images: DataFrame, corner_x, corner_y, fov: int, *, flip_y: bool = False) -> DataFrame:
    """(image_id, qx1..qy2): the field around each defect, placed by its chip's corner."""
    y = -F.col("yrel") if flip_y else F.col("yrel")
    centre, half = {"x": F.col("xrel") - corner_x, "y": y - corner_y}, fov // 2
    return images.select("image_id", *((centre[a] + s * half).alias(f"q{a}{k}") for k, s in ((1, -1), (2, 1)) for a in "xy"))


def state() -> Column:
    """Why an image cannot be matched, in the order of the checks; null if it can."""
    return F.when(~F.col("has_coords"), NO_COORDS).when(~F.col("has_file"), MISSING).when(F.coalesce(F.col("nm_per_px"), F.lit(0)) <= 0, NO_SCALE)


def _blocks(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows of up to BLOCK whole keys, from batches sorted by key; with each row's place and the keys."""
    held: pa.Table | None = None

    def split(rows: pa.Table, last: bool) -> Iterator[pa.Table]:
        k = rows[key].to_numpy()
        starts = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)]
        if not last:
            starts = starts[:-1]
        for i in range(0, len(starts) - 1, BLOCK):
            a, b = int(starts[i]), int(starts[min(i + BLOCK, len(starts) - 1)])
            yield rows.slice(a, b - a)
        if not last:
            yield rows.slice(int(starts[-1]))

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        if len(rows):
            *ready, held = split(rows, False)
            for part in ready:
                keys, place = np.unique(part[key].to_numpy(), return_inverse=True)
                yield part, place, keys
    if held is not None and len(held):
        for part in split(held, True):
            keys, place = np.unique(part[key].to_numpy(), return_inverse=True)
            yield part, place, keys


def _by_image(rows: DataFrame) -> DataFrame:
    return rows.repartition("image_id").sortWithinPartitions("image_id")


def _boxes(rows: pa.Table) -> np.ndarray:
    return np.stack([rows[c].to_numpy().astype(float) for c in ("x1", "y1", "x2", "y2")], axis=1)


def _corners(rows: pa.Table, fov: int) -> tuple[np.ndarray, np.ndarray]:
    return rows["cx"].to_numpy() - fov / 2, rows["cy"].to_numpy() - fov / 2


def label_counts(seen: DataFrame, fov: int, pixels: int) -> DataFrame:
    """(image_id, layer, n_pixels): pixels by the topmost layer of each image."""
    scale = fov / pixels

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, place, keys in _blocks(batches, "image_id"):
            layers, found = raster.top_planes(_boxes(rows), rows["layer"].to_numpy(), place, len(keys), *_corners(rows, fov), scale, pixels, pixels)
            width = len(layers) + 1
            n = np.bincount((found + width * np.arange(len(keys))[:, None, None]).ravel(), minlength=width * len(keys)).reshape(-1, width)[:, 1:]
            image, k = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys[image]), pa.array(layers[k].astype(np.int32)), pa.array(n[image, k].astype(np.int64))], ["image_id", "layer", "n_pixels"])

    return _by_image(seen).mapInArrow(work, "image_id long, layer int, n_pixels long")


def polygon_pixels(seen: DataFrame, fov: int, pixels: int, even_odd: bool = False) -> DataFrame:
    """(image_id, layer, n_pixels): pixels whose centres lie in polygons, by image and layer.

    ``seen`` holds image_id, cx, cy, layer and the points ``pts`` of each polygon in view.
    Polygons of a layer are united; with ``even_odd`` what two of them cover is out.
    """
    scale = fov / pixels

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, place, keys in _blocks(batches, "image_id"):
            layers, layer = np.unique(rows["layer"].to_numpy(), return_inverse=True)
            edges, of = raster.ring_edges(*raster.ring_points(rows["pts"]))
            x0, y0 = _corners(rows, fov)
            drawn = raster.filled(edges, (place * len(layers) + layer)[of], len(keys) * len(layers), x0[of], y0[of], scale, pixels, pixels, even_odd)
            n = drawn.sum(axis=(1, 2)).reshape(len(keys), len(layers))
            i, k = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(layers[k].astype(np.int32)), pa.array(n[i, k].astype(np.int64))], ["image_id", "layer", "n_pixels"])

    return _by_image(seen).mapInArrow(work, "image_id long, layer int, n_pixels long")


def formula_pixels(images: DataFrame, shapes: DataFrame, formula: str, layers: dict[str, tuple[int, int]], fov: int, pixels: int) -> DataFrame:
    """(image_id, n_pixels): pixels of each image's field in which a layer formula holds.

    Moves are rounded to whole pixels. Planes have a margin as wide as all moves, so
    shapes outside a field grow into it. An image that sees none of the layers has
    what the formula makes of empty planes. Names without a layer are errors.
    """
    tree, scale = layer_algebra.parse(formula)[1], fov / pixels
    names = sorted(layer_algebra.names(tree))
    if unknown := [n for n in names if n not in layers]:
        raise ValueError(f"unknown names: {', '.join(unknown)}")
    margin = raster.moves(tree, scale)
    margin += margin % 2  # an even shift keeps what lies between two pixels where it is
    size = pixels + 2 * margin
    inner = np.s_[:, margin : margin + pixels, margin : margin + pixels]
    numbers = [F.when((F.col("layer") == layers[n][0]) & (F.col("datatype") == layers[n][1]), F.lit(i)) for i, n in enumerate(names)]
    drawn = shapes.select(F.explode(F.array_compact(F.array(*numbers))).alias("layer"), "x1", "y1", "x2", "y2")
    wide = round(fov + 2 * margin * scale)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, place, keys in _blocks(batches, "image_id"):
            plane = rows["layer"].to_numpy().astype(np.int64) * len(keys) + place
            x0, y0 = (at - margin * scale for at in _corners(rows, fov))
            planes = raster.masks(_boxes(rows), plane, len(names) * len(keys), x0, y0, scale, size, size).reshape(len(names), len(keys), size, size)
            found = raster.evaluate(tree, dict(zip(names, planes, strict=True)), scale)[inner]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(found.sum(axis=(1, 2), dtype=np.int64))], ["image_id", "n_pixels"])

    blank = raster.evaluate(tree, {n: np.zeros((1, size, size), bool) for n in names}, scale)[inner]
    counted = _by_image(in_view(drawn, images, wide)).mapInArrow(work, "image_id long, n_pixels long")
    return images.select("image_id").join(counted, "image_id", "left").select("image_id", F.coalesce("n_pixels", F.lit(int(blank.sum())).cast("long")).alias("n_pixels"))


def matched(images: DataFrame, shapes: DataFrame, grey: dict[int, int], fov: int, pixels: int, radius: int, sigma: float = 1.0) -> DataFrame:
    """(image_id, dx_nm, dy_nm, score, status): every image against its layout.

    ``images`` holds centres (cx, cy), what :func:`state` looks at, and the drift
    (ox, oy) in nm with which the picture was taken; it is drawn from the drifted
    shapes, the template from the layout. A template has one grey value for each
    layer of ``grey``; the larger layer number covers. Images that cannot be
    matched have their state and zeros; so have those, as flat, whose template
    has nothing in view or no contrast.
    """
    scale = fov / pixels
    known = images.withColumn("_state", state())
    drawn = shapes.where(F.col("layer").isin(list(grey)))
    seen = in_view(drawn, known.where("_state is null"), fov, "ox", "oy")
    palette = np.zeros(max(grey, default=0) + 1)
    palette[list(grey)] = list(grey.values())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, place, keys in _blocks(batches, "image_id"):
            b, layer, (x0, y0) = _boxes(rows), rows["layer"].to_numpy(), _corners(rows, fov)
            drift = np.stack([rows[c].to_numpy().astype(float) for c in ("ox", "oy", "ox", "oy")], axis=1)
            template, image = (raster.blurred(palette[raster.label_planes(x, layer, place, len(keys), x0, y0, scale, pixels, pixels)], sigma) for x in (b, b + drift))
            found = raster.matches(image, template, radius, scale)
            status = np.where(found[:, 2] > 0, OK, FLAT)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(found[:, i]) for i in range(3)), pa.array(status, pa.string())], ["image_id", "dx_nm", "dy_nm", "score", "status"])

    done = _by_image(seen).mapInArrow(work, "image_id long, dx_nm double, dy_nm double, score double, status string")
    out = known.select("image_id", "_state").join(done, "image_id", "left")
    return out.select("image_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("dx_nm", "dy_nm", "score")), F.coalesce("_state", "status", F.lit(FLAT)).alias("status"))


def lowest_corner(cx, cy, width_px, height_px, nm_per_px) -> tuple[Column, Column]:
    """Lower left corner of a field for masks, whose rows are counted from one pixel higher."""
    return F.col(cx) - F.col(width_px) / 2.0 * F.col(nm_per_px), F.col(cy) - (F.col(height_px) / 2.0 - 1.0) * F.col(nm_per_px)
