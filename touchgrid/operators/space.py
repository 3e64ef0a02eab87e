"""Space control, hulls, centroids and heat maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import geometry as G, models as M
from .detections import heat_points

FRAME = ["match_id", "frame_idx"]
COLS, ROWS = 105, 68


def with_side(positions: DataFrame) -> DataFrame:
    return positions.withColumn("side", M.team_side("role_id"))


def centroids(positions: DataFrame) -> DataFrame:
    """Mean place of each side of a frame, to the nearest tenth of a metre: a mean that is half-way but for its last bit goes up."""
    tenth = lambda c: F.round(F.avg(c) * 10) / 10
    return with_side(positions).filter("side is not null").groupBy(*FRAME, "side").agg(tenth("x_m").alias("cx"), tenth("y_m").alias("cy"), F.count("*").alias("n"))


def control_sql(positions: DataFrame) -> DataFrame:
    """Share of pitch cells nearer to side A (ties to A), as a join with the grid.  For few frames: see ``control``."""
    spark = positions.sparkSession
    grid = spark.range(COLS * ROWS).select((F.col("id") % COLS).cast("double").alias("gx"), F.floor(F.col("id") / COLS).cast("double").alias("gy"))
    p = with_side(positions).filter("side is not null")
    d = (F.col("x_m") - F.col("gx")) * (F.col("x_m") - F.col("gx")) + (F.col("y_m") - F.col("gy")) * (F.col("y_m") - F.col("gy"))
    cells = p.crossJoin(F.broadcast(grid)).groupBy(*FRAME, "gx", "gy").agg(F.min(F.when(F.col("side") == 0, d)).alias("da"), F.min(F.when(F.col("side") == 1, d)).alias("db"))
    return _shares(cells.groupBy(*FRAME).agg(F.count_if(F.col("da") <= F.col("db")).alias("a_cells"), F.count("da").alias("na"), F.count("db").alias("nb")))


def _shares(counts: DataFrame) -> DataFrame:
    both, only_a, only_b = (F.col("na") > 0) & (F.col("nb") > 0), (F.col("na") > 0) & (F.col("nb") == 0), (F.col("na") == 0) & (F.col("nb") > 0)
    a = F.when(both, F.col("a_cells") / (COLS * ROWS) * 100.0).when(only_a, 100.0).when(only_b, 0.0).otherwise(50.0)
    return counts.select(*FRAME, F.round(a, 1).alias("a_pct"), F.round(100.0 - a, 1).alias("b_pct"))


_GX, _GY = (x.ravel().astype(float) for x in np.meshgrid(np.arange(COLS), np.arange(ROWS)))


def nearest_side(ax, ay, bx, by) -> np.ndarray:
    """Whether each cell of the grid is A's (True on ties)."""
    least = lambda xs, ys: ((xs[:, None] - _GX) ** 2 + (ys[:, None] - _GY) ** 2).min(0)
    return least(ax, ay) <= least(bx, by)


def control(positions: DataFrame) -> DataFrame:
    """``control_sql`` by numpy, a frame at a time: rows of a frame come as two arrays a side, and no cell is ever a row."""
    p = with_side(positions).filter("side is not null")
    per = p.groupBy(*FRAME).agg(*(F.collect_list(F.when(F.col("side") == s, F.col(c))).alias(f"{c[0]}{s}") for s in (0, 1) for c in ("x_m", "y_m")))

    def run(batches):
        for pdf in batches:
            rows = [(len(a), len(b), int(nearest_side(*(np.asarray(v, float) for v in (a, c, b, d))).sum()) if len(a) and len(b) else 0) for a, c, b, d in zip(pdf["x0"], pdf["y0"], pdf["x1"], pdf["y1"], strict=True)]
            yield pd.DataFrame({"match_id": pdf["match_id"], "frame_idx": pdf["frame_idx"], "na": [r[0] for r in rows], "nb": [r[1] for r in rows], "a_cells": [r[2] for r in rows]})

    counts = per.mapInPandas(run, "match_id long, frame_idx long, na long, nb long, a_cells long")
    return _shares(counts)


def voronoi_cells(positions: DataFrame) -> DataFrame:
    """Long form of the control grid: match_id, frame_idx, gx, gy, owner (0 or 1); frames with both sides only."""
    p = with_side(positions).filter("side is not null")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if a.empty or b.empty:
            return pd.DataFrame(columns=["match_id", "frame_idx", "gx", "gy", "owner"])
        mine = nearest_side(*(v.to_numpy(float) for v in (a["x_m"], a["y_m"], b["x_m"], b["y_m"])))
        return pd.DataFrame({"match_id": pdf["match_id"].iloc[0], "frame_idx": pdf["frame_idx"].iloc[0], "gx": _GX.astype(int), "gy": _GY.astype(int), "owner": np.where(mine, 0, 1)})

    return p.groupBy(*FRAME).applyInPandas(run, "match_id long, frame_idx long, gx int, gy int, owner int")


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of (n, 2) points, counter-clockwise (monotone chain)."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(order):
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def area(polygon: np.ndarray) -> float:
    if len(polygon) < 3:
        return 0.0
    x, y = polygon[:, 0], polygon[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2.0)


def hulls(positions: DataFrame) -> DataFrame:
    """Hull area and vertices of each side of a frame; degenerate hulls have area 0 and no vertices."""
    per = with_side(positions).filter("side is not null").groupBy(*FRAME, "side").agg(F.collect_list("x_m").alias("xs"), F.collect_list("y_m").alias("ys"))

    def run(batches):
        for pdf in batches:
            polygons = [hull(np.stack([np.asarray(x, float), np.asarray(y, float)], 1)) for x, y in zip(pdf["xs"], pdf["ys"], strict=True)]
            areas = [area(p) for p in polygons]
            vertices = [[{"x": float(x), "y": float(y)} for x, y in p] if a > 0 else None for p, a in zip(polygons, areas, strict=True)]
            yield pd.DataFrame({"match_id": pdf["match_id"], "frame_idx": pdf["frame_idx"], "side": pdf["side"], "area_m2": [round(a, 1) for a in areas], "hull": vertices})

    return per.mapInPandas(run, "match_id long, frame_idx long, side int, area_m2 double, hull array<struct<x:double,y:double>>")


def territories(positions: DataFrame, key: str = "track_id", held: int = 4096) -> DataFrame:
    """(match_id, key, area_m2, n_vertices, n): the hull of all places of each key in a match, and their number.

    A task keeps at most ``held`` open points a key and shrinks them to their
    hull; the hulls of the tasks meet in a hull of hulls.  What moves are
    vertices, whatever the number of frames.
    """
    types = f"match_id long, {key} long, xs array<double>, ys array<double>, n long"

    def shrink(points: list) -> list:
        return [hull(np.concatenate(points))]

    def part(batches):
        groups: dict[tuple, list] = {}
        for pdf in batches:
            for k, g in pdf.groupby(["match_id", key], sort=False):
                state = groups.setdefault(k, [[], 0, 0])
                state[0].append(g[["x_m", "y_m"]].to_numpy(float))
                state[1], state[2] = state[1] + len(g), state[2] + len(g)
                if state[1] > held:
                    state[0] = shrink(state[0])
                    state[1] = len(state[0][0])
        rows = [(*k, shrink(points)[0].T, n) for k, (points, _, n) in groups.items()]
        yield pd.DataFrame([(m, t, x.tolist(), y.tolist(), n) for m, t, (x, y), n in rows], columns=["match_id", key, "xs", "ys", "n"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        points: list = []
        for x, y in zip(pdf["xs"], pdf["ys"], strict=True):
            points.append(np.stack([np.asarray(x, float), np.asarray(y, float)], 1))
            if len(points) >= 64:
                points = shrink(points)
        last = shrink(points)[0]
        return pd.DataFrame([(pdf["match_id"].iloc[0], pdf[key].iloc[0], area(last), len(last) if area(last) > 0 else 0, int(pdf["n"].sum()))], columns=["match_id", key, "area_m2", "n_vertices", "n"])

    known = positions.where(f"x_m is not null and y_m is not null and match_id is not null and {key} is not null")
    parts = known.select("match_id", F.col(key).cast("long").alias(key), F.col("x_m").cast("double").alias("x_m"), F.col("y_m").cast("double").alias("y_m")).mapInPandas(part, types)
    return parts.groupBy("match_id", key).applyInPandas(whole, f"match_id long, {key} long, area_m2 double, n_vertices long, n long")


def frame_summary(positions: DataFrame) -> DataFrame:
    """Control, centroids and hull areas of each frame in one row."""
    per = hulls(positions).join(centroids(positions), [*FRAME, "side"], "left")
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    wide = per.groupBy(*FRAME).agg(*(F.coalesce(pick(s, c), F.lit(d)).alias(f"{'ab'[s]}_{c}") for s in (0, 1) for c, d in (("area_m2", 0.0), ("cx", 52.5), ("cy", 34.0))))
    return control(positions).join(wide, FRAME, "left")


def mean_control(shares: DataFrame) -> DataFrame:
    """Per match; 50 : 50 without frames."""
    return shares.groupBy("match_id").agg(*(F.round(F.coalesce(F.avg(c), F.lit(50.0)), 1).alias(c) for c in ("a_pct", "b_pct")))


# --- heat maps ---------------------------------------------------------------


def heat_counts(positions: DataFrame, key: str = "track_id") -> DataFrame:
    """Visits per cell and key: the sparse table behind a heat map."""
    px, py = G.heat_cell("x_m", "y_m")
    return heat_points(positions).groupBy("match_id", key, px.alias("px"), py.alias("py")).agg(F.count("*").alias("n"))


def gaussian(size: int = 141, sigma: float = 35.0) -> np.ndarray:
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def blur(grid: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Separable blur; borders are mirrored without repeating the edge."""
    half = len(kernel) // 2
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (half, half)
        wide = np.pad(grid, pad, mode="reflect")
        size = grid.shape[axis]
        spectrum = np.fft.rfft(wide, axis=axis, n=wide.shape[axis] + len(kernel))
        taps = np.fft.rfft(kernel, n=wide.shape[axis] + len(kernel))
        full = np.fft.irfft(spectrum * (taps[:, None] if axis == 0 else taps[None, :]), axis=axis, n=wide.shape[axis] + len(kernel))
        grid = np.take(full, np.arange(2 * half, 2 * half + size), axis=axis)
    return grid


def density(counts: DataFrame, key: str = "track_id", step: int = 1, width: int = 1050, height: int = 680) -> DataFrame:
    """Blurred heat of each key in every cell, 0 to 255 of the 98.5th percentile; a ``step`` over 1 thins the cells."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((height, width))
        np.add.at(grid, (pdf["py"].to_numpy(int), pdf["px"].to_numpy(int)), pdf["n"].to_numpy(float))
        heat = np.maximum(blur(grid, gaussian()), 0.0)
        heat[heat < 1e-12] = 0.0
        top = np.percentile(heat[heat > 0], 98.5) if (heat > 0).any() else 0.0
        level = (np.clip(heat / top, 0, 1) * 255).astype(int) if top > 0 else np.zeros_like(heat, int)
        ys, xs = np.mgrid[0:height:step, 0:width:step]
        return pd.DataFrame({"match_id": pdf["match_id"].iloc[0], key: pdf[key].iloc[0], "px": xs.ravel(), "py": ys.ravel(), "level": level[::step, ::step].ravel()})

    return counts.groupBy("match_id", key).applyInPandas(run, f"match_id long, {key} long, px int, py int, level int")


def busiest(positions: DataFrame, k: int = 4) -> DataFrame:
    """The k tracks of each match with most samples."""
    per = heat_points(positions).groupBy("match_id", "track_id").agg(F.count("*").alias("n"))
    w = W.partitionBy("match_id").orderBy(F.desc("n"), "track_id")
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
