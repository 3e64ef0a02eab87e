"""Pitch, box and image geometry as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

PITCH_LENGTH, PITCH_WIDTH = 105.0, 68.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clip(x, low, high) -> Column:
    """x within the bounds; null stays null (greatest and least would skip it)."""
    return F.when(_c(x).isNotNull(), F.least(F.greatest(_c(x), _c(low)), _c(high)))


def distance(x1, y1, x2, y2) -> Column:
    dx, dy = _c(x1) - _c(x2), _c(y1) - _c(y2)
    return F.sqrt(dx * dx + dy * dy)


def foot_point(x1="x1", x2="x2", y2="y2") -> tuple[Column, Column]:
    """Bottom centre of a box."""
    return (_c(x1) + _c(x2)) / 2.0, _c(y2)


def clamp_box(width, height, box: Sequence[str] = ("x1", "y1", "x2", "y2")) -> list[Column]:
    """The box inside a frame of width x height pixels."""
    return [clip(c, 0.0, _c(m) - 1.0).alias(c) for c, m in zip(box, (width, height, width, height), strict=True)]


def project(u, v, h: Sequence) -> tuple[Column, Column]:
    """A point under a homography of nine coefficients (row by row)."""
    u, v, h = _c(u), _c(v), [_c(k) for k in h]
    w = h[6] * u + h[7] * v + h[8]
    return (h[0] * u + h[1] * v + h[2]) / w, (h[3] * u + h[4] * v + h[5]) / w


def warp(x, y, a: Sequence) -> tuple[Column, Column]:
    """A point under an affine map of six coefficients (row by row)."""
    x, y, a = _c(x), _c(y), [_c(k) for k in a]
    return a[0] * x + a[1] * y + a[2], a[3] * x + a[4] * y + a[5]


def warp_box(box: Sequence, a: Sequence) -> list[Column]:
    """The bounding box of a box's four warped corners."""
    x1, y1, x2, y2 = box
    corners = [warp(x, y, a) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]


def iou(a: Sequence, b: Sequence) -> Column:
    """Intersection over union of two boxes, 0 where the union is empty."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = ([_c(x) for x in box] for box in (a, b))
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(zero, F.least(ay2, by2) - F.greatest(ay1, by1))
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter
    return F.when(union > 0, inter / union).otherwise(zero)


def canvas_pixel(x, y, width: int, height: int, padding: int, header: int = 0) -> tuple[Column, Column]:
    """Metres to a drawn pitch: clipped, y up, truncated.  ``header`` pixels stay free on top."""
    sx, sy = (width - 2 * padding) / PITCH_LENGTH, (height - 2 * padding - header) / PITCH_WIDTH
    px = padding + clip(x, 0.0, PITCH_LENGTH) * sx
    py = padding + header + (PITCH_WIDTH - clip(y, 0.0, PITCH_WIDTH)) * sy
    return px.cast("int"), py.cast("int")


def heat_cell(x, y, width: int = 1050, height: int = 680) -> tuple[Column, Column]:
    """Metres to a cell of the heat map, y flipped."""
    px = clip(_c(x) * width / PITCH_LENGTH, 0.0, width - 1.0)
    py = clip((PITCH_WIDTH - _c(y)) * height / PITCH_WIDTH, 0.0, height - 1.0)
    return px.cast("int"), py.cast("int")


def minimap_pixel(u, v, frame_width, frame_height, width: int = 200, height: int = 130, edge: int = 4) -> tuple[Column, Column]:
    """A foot point to the small map of the frame."""
    px, py = (_c(u) / _c(frame_width) * width).cast("int"), (_c(v) / _c(frame_height) * height).cast("int")
    fit = lambda p, n: F.least(F.greatest(p, F.lit(edge)), F.lit(n - 1 - edge))
    return fit(px, width), fit(py, height)


def camera_labels(dx="dx", dy="dy", zoom="zoom") -> tuple[Column, Column, Column]:
    """(pan, tilt, zoom) labels of a frame's motion."""
    pan = F.when(_c(dx) < -1.5, "PAN RIGHT").when(_c(dx) > 1.5, "PAN LEFT").otherwise("STATIC")
    tilt = F.when(_c(dy) < -1.2, "TILT DOWN").when(_c(dy) > 1.2, "TILT UP").otherwise("STATIC")
    state = F.when(_c(zoom) > 1.006, "ZOOM IN").when(_c(zoom) < 0.994, "ZOOM OUT").otherwise("STEADY")
    return pan, tilt, state


def decompose_affine(a: Sequence) -> tuple[Column, Column, Column, Column]:
    """(dx, dy, scale, rotation in degrees) of a similarity."""
    a = [_c(k) for k in a]
    return a[2], a[5], F.sqrt(a[0] * a[0] + a[3] * a[3]), F.degrees(F.atan2(a[3], a[0]))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine of two arrays, 0 where one has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def normalized(a) -> Column:
    length = F.sqrt(dot(a, a))
    return F.transform(_c(a), lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0))


def palette_index(track, n: int) -> Column:
    """Colour number of a track; -1 for the ball."""
    return F.when(_c(track) < 0, -1).otherwise(F.pmod(_c(track), F.lit(n))).cast("int")
