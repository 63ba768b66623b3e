"""Box, quad and angle geometry as columns. Boxes are four columns or an array (left, top, right, bottom)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]


def box_of(array: Column) -> list[Column]:
    return [array[k] for k in range(4)]


def valid(box: Box) -> Column:
    """Four numbers with positive width and height."""
    x0, y0, x1, y1 = box
    return F.coalesce((x1 > x0) & (y1 > y0), F.lit(False))


def _guarded(box: Box, fine: Column) -> Column:
    return F.when(fine, F.array(*box))


def clamped(box: Box, width: Column, height: Column, swap: bool = True) -> list[Column]:
    """The sides of clamp(), also of an empty box. Rounding keeps order, so that each side is rounded once."""
    x0, y0, x1, y1 = (c.cast("double") for c in box)
    left, right, top, bottom = (F.least(x0, x1), F.greatest(x0, x1), F.least(y0, y1), F.greatest(y0, y1)) if swap else (x0, x1, y0, y1)
    inside = lambda v, most: F.greatest(F.lit(0), F.least(F.rint(v).cast("int"), (most - 1).cast("int")))
    return [inside(left, width), inside(top, height), inside(right, width), inside(bottom, height)]


def clamp(box: Box, width: Column, height: Column, swap: bool = True) -> Column:
    """Half-even rounding, corners in order (or null if they are not and swap is off), inside the page; null if empty."""
    out = clamped(box, width, height, swap)
    return _guarded(out, valid(out))


def normalise_1000(box: Box, width: Column, height: Column) -> Column:
    """Thousandths of the page, truncated and clipped; null for an invalid box."""
    of = lambda v, whole: F.greatest(F.lit(0), F.least(F.lit(1000), (1000 * v / whole).cast("int")))
    x0, y0, x1, y1 = box
    return _guarded([of(x0, width), of(y0, height), of(x1, width), of(y1, height)], valid(box) & (width > 0) & (height > 0))


def to_pixels(box: Box, width: Column, height: Column) -> Column:
    """Thousandths back to pixels, half-even."""
    x0, y0, x1, y1 = box
    return F.array(*[F.bround(v * whole / 1000).cast("int") for v, whole in ((x0, width), (y0, height), (x1, width), (y1, height))])


def to_unit(box: Box) -> list[Column]:
    """Thousandths to 0..1."""
    return [F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / 1000)) for v in box]


def union(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Aggregate: the box around all valid boxes of a group, null if there is none."""
    fine = valid((x0, y0, x1, y1))
    low, high = (lambda v: F.min(F.when(fine, v))), (lambda v: F.max(F.when(fine, v)))
    return F.when(F.count_if(fine) > 0, F.array(low(x0), low(y0), high(x1), high(y1)))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length by the shorter of two intervals."""
    shared = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    shorter = F.least(F.greatest(F.lit(0.0), a1 - a0), F.greatest(F.lit(0.0), b1 - b0))
    return shared / F.greatest(F.lit(1e-6), shorter)


#: Names of the pair features, in order.
PAIR_FEATURES = ["cx_i", "cy_i", "w_i", "h_i", "cx_j", "cy_j", "w_j", "h_j", "dx", "dy", "abs_dx", "abs_dy", "distance", "sin", "cos", "overlap_x", "overlap_y", "gap_x", "gap_y", "right", "left", "below", "above", "area_i", "area_j", "area_ratio", "same_row", "same_col"]


def pair_features(i: Box, j: Box) -> dict[str, Column]:
    """28 features of two unit boxes: places, offsets, direction, overlaps, gaps, areas and alignment."""
    centre = lambda a, b: (a + b) / 2
    size = lambda a, b: F.greatest(F.lit(0.0), b - a)
    cxi, cyi, wi, hi = centre(i[0], i[2]), centre(i[1], i[3]), size(i[0], i[2]), size(i[1], i[3])
    cxj, cyj, wj, hj = centre(j[0], j[2]), centre(j[1], j[3]), size(j[0], j[2]), size(j[1], j[3])
    dx, dy = cxj - cxi, cyj - cyi
    distance = F.sqrt(dx * dx + dy * dy)
    gap = lambda a, b: F.greatest(F.lit(0.0), F.greatest(i[a], j[a]) - F.least(i[b], j[b]))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    near = lambda d, a, b: 1 / (1 + F.abs(d) / F.greatest(F.lit(1e-6), (a + b) / 2))
    values = [
        cxi, cyi, wi, hi, cxj, cyj, wj, hj, dx, dy, F.abs(dx), F.abs(dy), distance,
        F.when(distance > 0, dy / distance).otherwise(0.0), F.when(distance > 0, dx / distance).otherwise(1.0),
        overlap_ratio(i[0], i[2], j[0], j[2]), overlap_ratio(i[1], i[3], j[1], j[3]), gap(0, 2), gap(1, 3),
        flag(dx > 0), flag(dx < 0), flag(dy > 0), flag(dy < 0), wi * hi, wj * hj, wj * hj / F.greatest(wi * hi, F.lit(1e-6)),
        near(dy, hi, hj), near(dx, wi, wj),
    ]
    return dict(zip(PAIR_FEATURES, values, strict=True))


def quad_of_box(box: Box) -> Column:
    """Corners from the top left clockwise, as an array of (x, y)."""
    x0, y0, x1, y1 = (c.cast("double") for c in box)
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def box_of_quad(quad: Column) -> Column:
    """The box around an array of (x, y), half-even; null if empty."""
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    out = [F.bround(f(v)).cast("int") for f, v in ((F.array_min, xs), (F.array_min, ys), (F.array_max, xs), (F.array_max, ys))]
    return _guarded(out, valid(out))


def normal_angle(degrees: Column) -> Column:
    """An angle of a line, in [-90, 90)."""
    return F.pmod(degrees + 90, F.lit(180.0)) - 90


def quad_angle(quad: Column) -> Column:
    """The direction of a quad's top and bottom edges together, or of its longest edge if they cancel; degrees."""
    edge = lambda a, b: (quad[b]["x"] - quad[a]["x"], quad[b]["y"] - quad[a]["y"])
    unit = lambda e: [F.when((n := F.sqrt(e[0] * e[0] + e[1] * e[1])) > 1e-6, v / n).otherwise(0.0) for v in e]
    top, bottom = unit(edge(0, 1)), unit(edge(3, 2))
    x, y = top[0] + bottom[0], top[1] + bottom[1]
    edges = [edge(k, (k + 1) % 4) for k in range(4)]
    longest = F.array_max(F.array(*[F.struct((e[0] * e[0] + e[1] * e[1]).alias("n"), F.lit(-k).alias("k"), e[0].alias("x"), e[1].alias("y")) for k, e in enumerate(edges)]))
    return normal_angle(F.degrees(F.when(F.sqrt(x * x + y * y) > 1e-6, F.atan2(y, x)).otherwise(F.atan2(longest["y"], longest["x"]))))


def relative_angle(head: Column, dependent: Column) -> Column:
    return normal_angle(dependent - head)


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of (x, y)."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    terms = F.zip_with(points, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2


def rotate_point(x: Column, y: Column, width: Column, height: Column, degrees: Column) -> tuple[Column, Column]:
    """A point after the page turns counter-clockwise about its centre onto a canvas that holds all of it."""
    a = F.radians(degrees)
    wide, high = rotated_size(width, height, degrees)
    u, v = x - width / 2, y - height / 2
    return F.cos(a) * u + F.sin(a) * v + wide / 2, -F.sin(a) * u + F.cos(a) * v + high / 2


def rotated_size(width: Column, height: Column, degrees: Column) -> tuple[Column, Column]:
    a = F.radians(degrees)
    c, s = F.abs(F.cos(a)), F.abs(F.sin(a))
    return F.ceil(F.round(width * c + height * s, 9)), F.ceil(F.round(width * s + height * c, 9))


def angle_encoding(angle: Column, mode: str) -> Column:
    """none: nothing; scalar: the angle by 90; sincos: sine and cosine of twice the angle; a null angle is all zeros."""
    twice = F.radians(2 * angle)
    made = {"none": [], "scalar": [angle / 90], "sincos": [F.sin(twice), F.cos(twice)]}[mode]
    return F.array(*[F.coalesce(v, F.lit(0.0)) for v in made])


def iou(a: Box, b: Box) -> Column:
    """Intersection over union of two boxes, 0 if both are empty."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    shared = side(0, 2) * side(1, 3)
    whole = area(a) + area(b) - shared
    return F.when(whole > 0, shared / whole).otherwise(0.0)


