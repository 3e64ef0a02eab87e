"""Pixel-level operators over frames and crops (BGR bytes), in numpy per row of an Arrow batch.

Frames are a source format; what leaves here is a few numbers or a short vector
a row.  Nothing needs an image library.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .evaluation import hsv

EMBEDDING = 128
#: Linear sRGB to XYZ (rows X, Y, Z; columns R, G, B) and the D65 white point.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def pixels(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


def grey(px: np.ndarray) -> np.ndarray:
    return px[..., 0] * 0.114 + px[..., 1] * 0.587 + px[..., 2] * 0.299


def gamma(px: np.ndarray, value: float) -> np.ndarray:
    """Gamma correction by a table of 256 entries."""
    return (((np.arange(256) / 255.0) ** (1.0 / value)) * 255).astype(np.uint8)[px]


def equalized(channel: np.ndarray, tiles: int = 8, limit: float = 2.0) -> np.ndarray:
    """Contrast-limited adaptive equalization of one channel: a clipped histogram per tile, blended between tile centres."""
    h, w = channel.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    wide = np.pad(channel, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric")
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            hist = np.bincount(wide[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256).astype(float)
            top = max(1.0, limit * th * tw / 256)
            hist = np.minimum(hist, top) + np.maximum(hist - top, 0).sum() / 256
            maps[i, j] = np.cumsum(hist) * 255 / (th * tw)

    def blend(n, size):
        at = np.clip((np.arange(n) + 0.5) / size - 0.5, 0, tiles - 1)
        low = np.minimum(at.astype(int), tiles - 2)
        return low, at - low

    (yi, ya), (xi, xa) = blend(h, th), blend(w, tw)
    y, x, a, b = yi[:, None], xi[None, :], ya[:, None], xa[None, :]
    v = channel
    out = (1 - a) * ((1 - b) * maps[y, x, v] + b * maps[y, x + 1, v]) + a * ((1 - b) * maps[y + 1, x, v] + b * maps[y + 1, x + 1, v])
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def _slide(mask: np.ndarray, size: int, grow: bool) -> np.ndarray:
    """Dilation or erosion by a square."""
    half = size // 2
    for axis in (0, 1):
        pad = [(half, half) if k == axis else (0, 0) for k in (0, 1)]
        view = np.lib.stride_tricks.sliding_window_view(np.pad(mask, pad, constant_values=not grow), size, axis=axis)
        mask = view.any(-1) if grow else view.all(-1)
    return mask


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The largest 8-connected part of a mask, by least labels that spread until they rest."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        wide = np.pad(np.where(label > 0, label, big), 1, constant_values=big)
        least = np.min([wide[1 + dy : wide.shape[0] - 1 + dy, 1 + dx : wide.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        least = np.where(mask, least, 0)
        flat = least.ravel()  # a label also takes over the label of the pixel it names
        jumped = np.where(flat > 0, np.minimum(flat, flat[np.maximum(flat, 1) - 1]), 0).reshape(mask.shape)
        if np.array_equal(jumped, label):
            break
        label = jumped
    if not mask.any():
        return mask
    return label == np.bincount(label[label > 0]).argmax()


def turf_mask(px: np.ndarray, low=(35, 40, 40), high=(85, 255, 255)) -> np.ndarray:
    """Turf by colour, closed and opened, largest part only."""
    parts = hsv(px.astype(float))
    mask = np.all([(c >= a) & (c <= b) for c, a, b in zip(parts, low, high, strict=True)], axis=0)
    mask = _slide(_slide(mask, 7, True), 7, False)
    mask = _slide(_slide(mask, 3, False), 3, True)
    return largest_component(mask)


def hue_saturation(px: np.ndarray, h_bins: int = 30, s_bins: int = 32) -> np.ndarray:
    """Joint histogram, stretched to 0..1."""
    h, s, _ = hsv(px.astype(float))
    out = np.histogram2d(h.ravel(), s.ravel(), bins=(h_bins, s_bins), range=((0, 180), (0, 256)))[0]
    span = out.max() - out.min()
    return (out - out.min()) / span if span > 0 else np.zeros_like(out)


def bhattacharyya(a: np.ndarray, b: np.ndarray) -> float:
    n = np.sqrt(a.sum() * b.sum())
    return float(np.sqrt(max(0.0, 1.0 - np.sqrt(a * b).sum() / n))) if n > 0 else 0.0


def edges(px: np.ndarray, threshold: float = 100.0) -> np.ndarray:
    """Strong gradients (Sobel) of the grey frame."""
    p = np.pad(grey(px), 1, mode="edge")
    dx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    dy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return np.abs(dx) + np.abs(dy) > threshold


def edge_change(a: np.ndarray, b: np.ndarray) -> float:
    """Edge pixels that only one frame has, by the edge pixels of both frames added up."""
    total = int(a.sum()) + int(b.sum())
    return float((a ^ b).sum() / total) if total else 0.0


def lab(px: np.ndarray) -> np.ndarray:
    """CIE L*a*b* of BGR pixels, each channel stretched to 0..255."""
    rgb = px[..., ::-1] / 255.0
    linear = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    t = linear @ _XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    y = t[..., 1]
    light = np.where(y > 0.008856, 116 * f[..., 1] - 16, 903.3 * y)
    return np.stack([light * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], -1)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 1e-6 else v


def zone_vector(px: np.ndarray) -> np.ndarray:
    """28 bins of hue, saturation and value and six L*a*b* statistics of a patch."""
    if min(px.shape[:2]) < 4:
        return np.zeros(34)
    parts = [np.histogram(c, n, (0, top))[0] for c, n, top in zip(hsv(px.astype(float)), (12, 8, 8), (180, 256, 256), strict=True)]
    tones = lab(px)
    return _unit(np.concatenate([*parts, tones.mean((0, 1)) / 255, tones.std((0, 1)) / 255]).astype(float))


def appearance(crop: np.ndarray, frame_height: int) -> np.ndarray:
    """Unit vector of jersey, shorts and socks zones and the box shape; too small a box gives the first axis."""
    h, w = crop.shape[:2]
    out = np.zeros(EMBEDDING)
    if w < 6 or h < 12:
        out[0] = 1.0
        return out
    m = int(0.15 * w)
    zones = [zone_vector(crop[int(a * h) : int(b * h), m : w - m]) for a, b in ((0.10, 0.45), (0.45, 0.70), (0.70, 0.95))]
    v = np.concatenate([*zones, [w / h, h / frame_height]])[:EMBEDDING]
    out[: len(v)] = v
    out = _unit(out)
    if not out.any():
        out[0] = 1.0
    return out


def jersey_colour(crop: np.ndarray) -> np.ndarray | None:
    """Mean colour of the upper half without turf; the centre pixel if all is turf."""
    half = crop[: crop.shape[0] // 2]
    if not half.size:
        return None
    h, s, v = hsv(half.astype(float))
    rest = half[~((h >= 35) & (h <= 85) & (s >= 40) & (v >= 40))]
    return rest.mean(0) if len(rest) else half[half.shape[0] // 2, half.shape[1] // 2].astype(float)


# --- as DataFrame operators -------------------------------------------------------


def _mapped(df: DataFrame, keys: list[str], make, schema: str, *extra: str) -> DataFrame:
    """One output row per image row: the keys and what ``make(pixels, *extra)`` gives."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        for pdf in batches:
            made = [make(pixels(d, w, h), *more) for d, w, h, *more in zip(pdf["image"], pdf["width"], pdf["height"], *(pdf[c] for c in extra), strict=True)]
            out = pdf[keys].reset_index(drop=True)
            yield out.assign(**{n: pd.Series([m[i] for m in made], dtype=object) for i, n in enumerate(names)})

    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*dict.fromkeys([*keys, "image", "width", "height", *extra])).mapInPandas(run, f"{types}, {schema}")


FRAME = ["match_id", "frame_idx"]


def turf_bands(frames: DataFrame) -> DataFrame:
    """Rows between which the turf of each frame lies, and its share."""

    def one(px):
        rows = np.flatnonzero(turf_mask(px).any(1))
        return (int(rows[0]) if len(rows) else None, int(rows[-1]) + 1 if len(rows) else None, float(turf_mask(px).mean()))

    return _mapped(frames, FRAME, one, "y_min int, y_max int, area_ratio double")


def frame_features(frames: DataFrame) -> DataFrame:
    """Histogram (flat) and edge rows of each frame, for distances between neighbours."""
    return _mapped(frames, FRAME, lambda px: (hue_saturation(px).ravel().tolist(), float(edges(px).mean())), "hist array<double>, edge_share double")


def neighbour_distances(features: DataFrame) -> DataFrame:
    """Distance of each frame's histogram to that of the frame before, by array functions."""
    prev = features.select("match_id", (F.col("frame_idx") + 1).alias("frame_idx"), F.col("hist").alias("before"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    shared = total(F.zip_with("hist", "before", lambda a, b: F.sqrt(a * b)))
    n = F.sqrt(total("hist") * total("before"))
    d = F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), 1.0 - shared / n))).otherwise(0.0)
    return features.join(prev, FRAME).select(*FRAME, d.alias("hist_distance"))


def appearances(crops: DataFrame) -> DataFrame:
    """Appearance vector of each person crop (image, width, height, frame_height)."""
    return _mapped(crops, [*FRAME, "det_idx"], lambda px, h: (appearance(px, h).tolist(),), "emb array<double>", "frame_height")


def jersey_colours(crops: DataFrame) -> DataFrame:
    def one(px):
        c = jersey_colour(px)
        return (None,) * 3 if c is None else tuple(float(x) for x in c)

    return _mapped(crops, [*FRAME, "det_idx"], one, "b double, g double, r double")


def enhanced(frames: DataFrame, value: float = 1.0) -> DataFrame:
    """Frames with equalized brightness and gamma correction, as BGR bytes."""

    def one(px):
        y = grey(px)
        gain = (equalized(np.round(y).astype(np.uint8)) / np.maximum(y, 1))[..., None]
        return (gamma(np.clip(np.round(px * gain), 0, 255).astype(np.uint8), value).tobytes(),)

    return _mapped(frames, [*FRAME, "width", "height"], one, "enhanced binary")


def line_bounds(lines: DataFrame, height: int) -> DataFrame:
    """Top and bottom row of the pitch of each frame from line segments (x1, y1, x2, y2): medians of the flat lines near the borders."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    mid = (F.col("y1") + F.col("y2")) / 2.0
    flat = (F.degrees(F.atan2(dy.cast("double"), dx.cast("double"))) < 18) & (F.sqrt(dx * dx + dy * dy) >= 30)
    ok = lines.withColumn("mid", F.when(flat, mid))
    return ok.groupBy(*FRAME).agg(F.coalesce(F.median(F.when(F.col("mid") < 0.35 * height, F.col("mid"))), F.lit(0.20 * height)).alias("top_y"), F.coalesce(F.median(F.when(F.col("mid") > 0.65 * height, F.col("mid"))), F.lit(0.795 * height)).alias("bottom_y"))
