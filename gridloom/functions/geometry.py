"""Column functions of coordinates, scales and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Field of view in nm, and nm per unit of the catalogue's mm and um.
DEFAULT_FOV_NM, NM_PER_MM, NM_PER_UM = 1500.0, 1e6, 1e3


def to_layout(xrel, yrel, corner_x, corner_y, negate_y: bool = False) -> tuple[Column, Column]:
    """Defect position relative to a chip's corner; y may point the other way."""
    y = -F.col(yrel) if negate_y else F.col(yrel)
    return F.col(xrel) - F.lit(corner_x), y - F.lit(corner_y)


def corner_from_die(die, centre, chip) -> Column:
    """Chip corner in nm from die size, centre and chip size in mm."""
    return (F.col(die) / 2 + F.col(centre) - F.col(chip) / 2) * NM_PER_MM


def chip_corner(chip, offset) -> Column:
    """Chip corner in nm from its place and layout offset in um."""
    return (F.col(chip) - F.col(offset)) * NM_PER_UM


def anchor(coarse, refined) -> Column:
    """Coarse position moved by the match result where there is one."""
    return F.col(coarse) + F.coalesce(F.col(refined), F.lit(0))


def around(centre, size) -> tuple[Column, Column]:
    """Both ends of a span of that size."""
    half = F.lit(size) / 2 if not isinstance(size, Column) else size / 2
    return F.col(centre) - half, F.col(centre) + half


def nm_per_px(manual, fov_w, width_px) -> Column:
    """A positive manual scale, else field width by pixels."""
    return F.when(F.col(manual) > 0, F.col(manual)).otherwise(F.col(fov_w) / F.greatest(F.lit(1), F.col(width_px)))


def grid_to_nm(value, unit: float) -> Column:
    """File grid to nm, ties to even."""
    return F.rint(F.col(value) * (1000.0 / unit)).cast("long")


def to_pixel(value, low, scale, rows=None) -> Column:
    """Pixel number, ties to even; counted from the far end if ``rows`` is given."""
    at = (F.col(value) - F.col(low)) / F.col(scale)
    return F.rint(at if rows is None else F.col(rows) - 1 - at).cast("long")


def from_pixel(pixel, low, scale) -> Column:
    return F.col(low) + F.col(pixel) * F.col(scale)


def ring(x1, y1, x2, y2) -> Column:
    """The four corners of a box, as an array of points."""
    corners = [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]
    return F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners))


def ring_box(points) -> list[Column]:
    """The box around an array of points."""
    value = lambda a: F.transform(points, lambda p: p[a])
    return [F.array_min(value("x")), F.array_min(value("y")), F.array_max(value("x")), F.array_max(value("y"))]


def page_for_ordinal(pages, ordinal) -> Column:
    """The page of a 1-based ordinal; past the end the last one, null if none."""
    n = F.size(pages)
    return F.when(n > 0, F.get(pages, F.least(F.greatest(ordinal, F.lit(1)), n) - 1))


def quarter_turn(angle) -> Column:
    """Whether an angle is within 0.01 degrees of a quarter turn."""
    off = F.pmod(F.col(angle), F.lit(90.0))
    return F.least(off, 90.0 - off) <= 0.01


def turn_matrix(q: Column, flip: Column) -> list[Column]:
    """a, b, c, d of a mirror (y) followed by q quarter turns."""
    q = F.pmod(q, F.lit(4))
    cos = F.when(q == 0, 1).when(q == 2, -1).otherwise(0)
    sin = F.when(q == 1, 1).when(q == 3, -1).otherwise(0)
    s = F.when(flip, -1).otherwise(1)
    return [cos, -sin * s, sin, cos * s]


def moved_box(m: list[Column], t: list[Column], box: list[Column]) -> list[Column]:
    """The box around a box after the transform; exact for quarter turns."""
    xs = [m[0] * box[i] + m[1] * box[j] + t[0] for i in (0, 2) for j in (1, 3)]
    ys = [m[2] * box[i] + m[3] * box[j] + t[1] for i in (0, 2) for j in (1, 3)]
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]
