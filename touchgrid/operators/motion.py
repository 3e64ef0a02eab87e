"""Camera motion and pitch lines from pixels.

Frames shrink to half-size grey where they are read, each goes to its own
number and the next, and the two that meet give six numbers: corners of the
background are followed by pyramidal least squares, and the similarity that
most of them agree on is the camera's.  Lines are straight runs of white
marking on turf.  All random choices have a fixed seed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .images import FRAME, grey, pixels, turf_mask

#: Fixed values of the published scheme.
SCALE, TOP_SHARE, MARGIN = 0.5, 0.08, 15
CORNERS, QUALITY, SPACING, REACH = 400, 0.015, 16, 7
LEVELS, STEPS, REST = 3, 15, 0.03
AGREE_PX, ROUNDS, LEAST_CORNERS, LEAST_FOLLOWED = 2.5, 500, 10, 8
CONTRAST, LINE_LENGTH, LINE_GAP, LINE_VOTES = 18, 60, 40, 40


def halved(px: np.ndarray) -> np.ndarray:
    """Grey frame at half size (means of 2 x 2 pixels)."""
    g = grey(px.astype(float))
    g = g[: g.shape[0] // 2 * 2, : g.shape[1] // 2 * 2]
    return (g[::2, ::2] + g[1::2, ::2] + g[::2, 1::2] + g[1::2, 1::2]) / 4


def background(shape: tuple[int, int], boxes, margin: float = MARGIN, scale: float = SCALE) -> np.ndarray:
    """Pixels outside the score bar and the (widened) boxes of persons; boxes are in full-size pixels."""
    h, w = shape
    out = np.ones(shape, bool)
    out[: int(h * TOP_SHARE)] = False
    for x1, y1, x2, y2 in boxes:
        left, top, right, bottom = (int(v * scale) for v in (x1 - margin, y1 - margin, x2 + margin, y2 + margin))
        out[max(0, top) : max(0, min(h, bottom)), max(0, left) : max(0, min(w, right))] = False
    return out


def _box_sum(x: np.ndarray, half: int) -> np.ndarray:
    """Sum over the square around each pixel."""
    p = np.pad(x, half + 1)[:-1, :-1].cumsum(0).cumsum(1)
    n = 2 * half + 1
    return p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n]


def corners(g: np.ndarray, mask: np.ndarray, most: int = CORNERS, quality: float = QUALITY, spacing: int = SPACING) -> np.ndarray:
    """(n, 2) x, y of the strongest corners (lesser eigenvalue of the structure matrix), the best of each cell of a grid."""
    dy, dx = np.gradient(g)
    a, b, c = (_box_sum(v, 3) for v in (dx * dx, dx * dy, dy * dy))
    score = np.where(mask, (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b), 0.0)
    y, x = np.nonzero(score > max(1e-6, quality * score.max(initial=0.0)))
    if not len(x):
        return np.zeros((0, 2))
    order = np.argsort(-score[y, x], kind="stable")
    y, x = y[order], x[order]
    _, first = np.unique(y // spacing * (g.shape[1] // spacing + 1) + x // spacing, return_index=True)
    best = np.sort(first)[:most]
    return np.stack([x[best], y[best]], 1).astype(float)


def _sampled(g: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values between pixels, bilinear; the border goes on outside."""
    x, y = np.clip(x, 0, g.shape[1] - 1.001), np.clip(y, 0, g.shape[0] - 1.001)
    i, j = y.astype(int), x.astype(int)
    p, q = y - i, x - j
    return (1 - p) * ((1 - q) * g[i, j] + q * g[i, j + 1]) + p * ((1 - q) * g[i + 1, j] + q * g[i + 1, j + 1])


def followed(before: np.ndarray, after: np.ndarray, points: np.ndarray, reach: int = REACH, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """(places of the points in the next frame, whether they were found): least squares on patches, coarse to fine, all points at once."""
    pyramid = [(before, after)]
    while len(pyramid) < levels and min(pyramid[-1][0].shape) >= 4 * reach:
        pyramid.append(tuple(halved(np.repeat(g[..., None], 3, 2)) for g in pyramid[-1]))
    oy, ox = (v.ravel() for v in np.mgrid[-reach : reach + 1, -reach : reach + 1])
    shift, found = np.zeros_like(points), np.ones(len(points), bool)
    for level in range(len(pyramid) - 1, -1, -1):
        a, b = pyramid[level]
        at = (points + 0.5) / 2**level - 0.5
        x, y = at[:, :1] + ox, at[:, 1:] + oy
        patch = _sampled(a, x, y)
        dy, dx = (_sampled(v, x, y) for v in np.gradient(a))
        xx, xy, yy = (dx * dx).sum(1), (dx * dy).sum(1), (dy * dy).sum(1)
        det = xx * yy - xy * xy
        found &= det > 1e-6
        safe = np.where(det > 1e-6, det, 1.0)
        shift *= 2 if level < len(pyramid) - 1 else 1
        for _ in range(STEPS):
            left = patch - _sampled(b, x + shift[:, :1], y + shift[:, 1:])
            u, v = (left * dx).sum(1), (left * dy).sum(1)
            step = np.stack([yy * u - xy * v, xx * v - xy * u], 1) / safe[:, None]
            shift += np.where(found[:, None], step, 0.0)
            if np.abs(step[found]).max(initial=0.0) < REST:
                break
    to = points + shift
    inside = (to >= 0).all(1) & (to[:, 0] < before.shape[1]) & (to[:, 1] < before.shape[0])
    return to, found & inside


def similarity(src: np.ndarray, dst: np.ndarray, threshold: float = AGREE_PX, rounds: int = ROUNDS) -> tuple[np.ndarray | None, float]:
    """(2 x 3 matrix of turn, scale and shift, share that agrees).

    As complex numbers a similarity is ``a z + b``: each of ``rounds`` pairs of
    points gives one, the one most points agree with is fitted to all of those.
    """
    z, t = src[:, 0] + 1j * src[:, 1], dst[:, 0] + 1j * dst[:, 1]
    rng = np.random.default_rng(0)
    i = rng.integers(0, len(z), rounds)
    j = (i + rng.integers(1, len(z), rounds)) % len(z)
    ok = np.abs(z[j] - z[i]) > 1e-9
    if not ok.any():
        return None, 0.0
    i, j = i[ok], j[ok]
    a = (t[j] - t[i]) / (z[j] - z[i])
    b = t[i] - a * z[i]
    agree = np.abs(a[:, None] * z + b[:, None] - t) <= threshold
    inside = agree[agree.sum(1).argmax()]
    zc, tc = z[inside].mean(), t[inside].mean()
    spread = (np.abs(z[inside] - zc) ** 2).sum()
    if spread < 1e-9:
        return None, 0.0
    a = (np.conj(z[inside] - zc) * (t[inside] - tc)).sum() / spread
    b = tc - a * zc
    return np.array([[a.real, -a.imag, b.real], [a.imag, a.real, b.imag]]), float(inside.mean())


def motion(before: np.ndarray, after: np.ndarray, mask: np.ndarray, scale: float = SCALE) -> tuple[np.ndarray, float, bool]:
    """(affine in full-size pixels, share of corners that agree, valid) between two half-size grey frames."""
    still = np.eye(3)[:2]
    at = corners(before, mask)
    if len(at) < LEAST_CORNERS:
        return still, 1.0, True  # nothing to follow: as the first frame
    to, ok = followed(before, after, at)
    if ok.sum() < LEAST_FOLLOWED:
        return still, 0.0, False
    found, share = similarity(at[ok], to[ok])
    if found is None or not np.isfinite(found).all():
        return still, 0.0, False
    found[:, 2] /= scale
    return found, share, True


def camera_motion(frames: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """(match_id, frame_idx, affine, confidence, is_valid) of each frame against the one before it.

    ``frames``: match_id, frame_idx, width, height, image (BGR bytes); ``boxes``:
    match_id, frame_idx, x1, y1, x2, y2 of persons to leave out.  A frame without
    the one before it has the identity; of repeated frames one counts.
    """

    def shrink(batches):
        for pdf in batches:
            small = [halved(pixels(d, w, h)) for d, w, h in zip(pdf["image"], pdf["width"], pdf["height"], strict=True)]
            made = pdf[FRAME].reset_index(drop=True).assign(w=[g.shape[1] for g in small], grey=[np.round(g).astype(np.uint8).tobytes() for g in small])
            yield made.assign(ahead=0)
            yield made.assign(ahead=1, frame_idx=made["frame_idx"] + 1)

    def run(batches):
        for pdf in batches:
            rows = []
            for before, after, w, w0, persons in zip(pdf["before"], pdf["grey"], pdf["w"], pdf["w0"], pdf["boxes"], strict=True):
                if before is None or w0 != w or len(before) != len(after):
                    rows.append((np.eye(3)[:2].ravel().tolist(), 1.0, True))
                    continue
                a, b = (np.frombuffer(x, np.uint8).reshape(-1, int(w)).astype(float) for x in (before, after))
                found, share, ok = motion(a, b, background(a.shape, [] if persons is None else list(persons)))
                rows.append((found.ravel().tolist(), share, ok))
            yield pdf[FRAME].reset_index(drop=True).assign(**{n: [r[i] for r in rows] for i, n in enumerate(("affine", "confidence", "is_valid"))})

    small = frames.select(*FRAME, "width", "height", "image").mapInPandas(shrink, "match_id long, frame_idx long, w int, grey binary, ahead int")
    one = lambda c, ahead: F.first(F.when(F.col("ahead") == ahead, F.col(c)), ignorenulls=True)
    pairs = small.groupBy(*FRAME).agg(one("w", 0).alias("w"), one("grey", 0).alias("grey"), one("w", 1).alias("w0"), one("grey", 1).alias("before")).filter("grey is not null")
    if boxes is not None:  # of the frame before, whose corners are followed
        held = boxes.groupBy("match_id", (F.col("frame_idx") + 1).alias("frame_idx")).agg(F.collect_list(F.array(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")))).alias("boxes"))
        pairs = pairs.join(held, FRAME, "left")
    else:
        pairs = pairs.withColumn("boxes", F.lit(None).cast("array<array<double>>"))
    return pairs.mapInPandas(run, "match_id long, frame_idx long, affine array<double>, confidence double, is_valid boolean")


# --- lines ---------------------------------------------------------------------------


def _extreme(g: np.ndarray, size: int, pick) -> np.ndarray:
    half = size // 2
    for axis in (0, 1):
        wide = np.pad(g, [(half, half) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        g = pick(np.lib.stride_tricks.sliding_window_view(wide, size, axis=axis), -1)
    return g


def markings(px: np.ndarray, contrast: float = CONTRAST) -> np.ndarray:
    """Thin bright marks on turf: what an opening by 5 x 5 takes away."""
    g = grey(px.astype(float))
    g = _extreme(g, 3, lambda v, a: v.mean(a))
    thin = g - _extreme(_extreme(g, 5, np.min), 5, np.max)
    return (thin > contrast) & turf_mask(px)


def straight_runs(mask: np.ndarray, least: float, gap: float, votes: int = LINE_VOTES) -> list[tuple[int, int, int, int]]:
    """Segments (x1, y1, x2, y2) of marks: the line with most marks first, whose marks then leave, until none has ``votes``."""
    y, x = (v.astype(float) for v in np.nonzero(mask))
    turn = np.deg2rad(np.arange(180))
    cos, sin = np.cos(turn), np.sin(turn)
    far = int(np.hypot(*mask.shape)) + 1
    out = []
    while len(x) >= votes:
        place = np.round(x[:, None] * cos + y[:, None] * sin).astype(int) + far
        count = np.bincount((place + np.arange(180) * (2 * far + 1)).ravel(), minlength=180 * (2 * far + 1))
        best = int(count.argmax())
        if count[best] < votes:
            break
        k, rho = best // (2 * far + 1), best % (2 * far + 1) - far
        near = np.flatnonzero(np.abs(x * cos[k] + y * sin[k] - rho) <= 1.5)
        along = y[near] * cos[k] - x[near] * sin[k]
        order = np.argsort(along, kind="stable")
        near, along = near[order], along[order]
        for part in np.split(np.arange(len(near)), np.flatnonzero(np.diff(along) > gap) + 1):
            if along[part[-1]] - along[part[0]] >= least:
                a, b = near[part[0]], near[part[-1]]
                out.append((int(x[a]), int(y[a]), int(x[b]), int(y[b])))
        rest = np.ones(len(x), bool)
        rest[near] = False
        x, y = x[rest], y[rest]
    return out


def pitch_lines(frames: DataFrame) -> DataFrame:
    """(match_id, frame_idx, x1, y1, x2, y2): flat and steep line segments of each frame, as ``images.line_bounds`` takes them."""

    def lines(px):
        share = min(1.0, 800.0 / px.shape[1])
        rows, cols = (np.minimum((np.arange(int(round(n * share))) / share).astype(int), n - 1) for n in px.shape[:2])
        found = straight_runs(markings(px[rows][:, cols]), max(20, round(LINE_LENGTH * share)), round(LINE_GAP * share))
        for seg in found:
            x1, y1, x2, y2 = (int(round(v / share)) for v in seg)
            angle = np.degrees(np.arctan2(abs(y2 - y1), abs(x2 - x1)))
            if (angle < 25 or angle > 65) and np.hypot(x2 - x1, y2 - y1) >= 30:
                yield x1, y1, x2, y2

    def run(batches):
        for pdf in batches:
            rows = [(m, f, *s) for m, f, d, w, h in zip(pdf["match_id"], pdf["frame_idx"], pdf["image"], pdf["width"], pdf["height"], strict=True) for s in lines(pixels(d, w, h))]
            yield pd.DataFrame(rows, columns=[*FRAME, "x1", "y1", "x2", "y2"])

    return frames.select(*FRAME, "image", "width", "height").mapInPandas(run, "match_id long, frame_idx long, x1 int, y1 int, x2 int, y2 int")
