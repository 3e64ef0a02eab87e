"""Distance, speed, activity and trails of tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import geometry as G, models as M
from .detections import kinematic_points
from .folds import smoothed

KEYS = ["match_id", "track_id"]


def _track():
    return W.partitionBy(*KEYS).orderBy("frame_idx")


def steps(positions: DataFrame, fps: float = 25.0, most_kmh: float = 38.0) -> DataFrame:
    """Each valid point with its step from the one before and the running distance.

    A step counts if time goes on, it is not faster than a sprint and not
    shorter than a centimetre.  One exchange by track serves all windows.
    """
    w = _track()
    df = kinematic_points(positions).withColumns({"px": F.lag("x_m").over(w), "py": F.lag("y_m").over(w), "pf": F.lag("frame_idx").over(w)})
    df = df.withColumn("step_m", G.distance("x_m", "y_m", "px", "py")).withColumn("dt", (F.col("frame_idx") - F.col("pf")) / fps)
    ok = (F.col("dt") > 0) & (F.col("step_m") / F.col("dt") <= most_kmh / 3.6) & (F.col("step_m") >= 0.01)
    df = df.withColumn("counted_m", F.when(ok, F.col("step_m")).otherwise(0.0))
    return df.withColumn("distance_m", F.sum("counted_m").over(w)).drop("px", "py", "pf")


def distances(positions: DataFrame, fps: float = 25.0, most_kmh: float = 38.0) -> DataFrame:
    """Per track: points, counted steps, distance, fastest counted step, and its activity."""
    df = steps(positions, fps, most_kmh)
    speed = F.when(F.col("counted_m") > 0, F.col("counted_m") / F.col("dt") * 3.6)
    out = df.groupBy(*KEYS).agg(F.count("*").alias("n_points"), F.count(speed).alias("n_steps"), F.sum("counted_m").alias("distance_m"), F.coalesce(F.max(speed), F.lit(0.0)).alias("top_kmh"))
    return out.withColumn("activity", M.activity("top_kmh"))


def _slopes(t, x, y, use):
    """Slopes per row of windows (rows x width) over the marked points; t is not centred again."""
    n = np.maximum(use.sum(1), 1)
    mean = lambda v: (np.where(use, v, 0.0).sum(1) / n)[:, None]
    tt = np.where(use, t, 0.0)
    denom = (tt * tt).sum(1)
    safe = np.where(denom > 1e-6, denom, 1.0)
    vx, vy = ((tt * np.where(use, v - mean(v), 0.0)).sum(1) / safe for v in (x, y))
    return vx, vy, denom


def regression_speed(t: np.ndarray, x: np.ndarray, y: np.ndarray, window: int = 18, least: int = 4) -> np.ndarray:
    """Speed in m/s at each point: robust least squares over the last ``window`` points."""
    n = len(t)
    if n == 0:
        return np.zeros(0)
    pad = lambda v: np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(window - 1, np.nan), v]), window)
    t, x, y = pad(t), pad(x), pad(y)
    have = ~np.isnan(t)
    count = have.sum(1)
    t = t - (np.where(have, t, 0.0).sum(1) / count)[:, None]
    vx, vy, denom = _slopes(t, x, y, have)
    mean = lambda v: (np.where(have, v, 0.0).sum(1) / count)[:, None]
    rest = np.hypot(x - vx[:, None] * t - mean(x), y - vy[:, None] * t - mean(y))
    rest = np.where(have, rest, np.nan)
    inlier = have & (np.nan_to_num(rest, nan=np.inf) <= np.maximum(1.5, 3.0 * np.nanmedian(rest, axis=1))[:, None])
    wx, wy, denom_in = _slopes(t, x, y, inlier)
    again = (inlier.sum(1) >= 4) & (denom_in > 1e-6)
    vx, vy = np.where(again, wx, vx), np.where(again, wy, vy)
    return np.where((count >= least) & (denom >= 1e-6), np.hypot(vx, vy), 0.0)


_METRICS = "match_id long, track_id long, frame_idx long, speed_kmh double, smoothed_kmh double, top_kmh double"


def player_metrics(positions: DataFrame, fps: float = 25.0, window: int = 18, least: int = 4, least_kmh: float = 2.0, most_kmh: float = 38.0, alpha: float = 0.75) -> DataFrame:
    """Per point: clamped regression speed, its rounded moving average (rounding feeds back), and the top speed so far.

    The windows of a track are one numpy array; only the moving average loops.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx", kind="stable")
        kmh = 3.6 * regression_speed(pdf["frame_idx"].to_numpy(float) / fps, pdf["x_m"].to_numpy(float), pdf["y_m"].to_numpy(float), window, least)
        kmh = np.round(np.where(kmh < least_kmh, 0.0, np.minimum(kmh, most_kmh)), 9)  # noise of the last bits must not decide a rounding below
        smooth, now = np.empty(len(kmh)), 0.0
        for i, v in enumerate(kmh.tolist()):
            now = smoothed(now, v, alpha)
            smooth[i] = now
        return pd.DataFrame({"match_id": pdf["match_id"], "track_id": pdf["track_id"], "frame_idx": pdf["frame_idx"], "speed_kmh": kmh, "smoothed_kmh": smooth, "top_kmh": np.maximum.accumulate(kmh)})

    points = kinematic_points(positions).select("match_id", "track_id", "frame_idx", "x_m", "y_m")
    return points.groupBy(*KEYS).applyInPandas(run, _METRICS).withColumn("activity", M.activity("smoothed_kmh"))


def squad_summary(metrics: DataFrame, dist: DataFrame) -> DataFrame:
    """Per match: top speed, total kilometres, mean of the latest smoothed speeds over zero, tracks."""
    latest = metrics.groupBy(*KEYS).agg(F.max("top_kmh").alias("top_kmh"), F.max_by("smoothed_kmh", "frame_idx").alias("smoothed_kmh"))
    both = latest.join(dist.select(*KEYS, "distance_m"), KEYS)
    return both.groupBy("match_id").agg(
        F.round(F.max("top_kmh"), 1).alias("max_speed_kmh"),
        F.round(F.sum("distance_m") / 1000.0, 3).alias("total_distance_km"),
        F.round(F.coalesce(F.avg(F.when(F.col("smoothed_kmh") > 0, F.col("smoothed_kmh"))), F.lit(0.0)), 1).alias("avg_speed_kmh"),
        F.count("*").alias("n_tracks"),
    )


def trails(points: DataFrame, x: str, y: str, length: int = 20) -> DataFrame:
    """The last ``length`` points of each track at each frame."""
    w = _track().rowsBetween(1 - length, 0)
    return points.withColumn("trail", F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).over(w))


def drawn_trail_steps(points: DataFrame, x: str, y: str, length: int = 10, least_net: float = 8.0, low: float = 1.0, high: float = 120.0) -> DataFrame:
    """Per point: how many steps of the last ``length`` points would be drawn."""
    df = trails(points, x, y, length)
    t = F.col("trail")
    net = F.sqrt(F.pow(t[F.size(t) - 1]["x"] - t[0]["x"], 2) + F.pow(t[F.size(t) - 1]["y"] - t[0]["y"], 2))
    pairs = F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))
    drawn = F.size(F.filter(pairs, lambda d: (d >= low) & (d <= high)))
    return df.withColumn("n_drawn", F.when((F.size(t) > 1) & (net >= least_net), drawn).otherwise(0)).drop("trail")


def comet(points: DataFrame, x: str, y: str, keep: int = 25, shown: int = 14, jump: float = 200.0) -> DataFrame:
    """Per point: how many of the last ``shown`` points of the ball's trail there are, and how many of their steps are drawn (no jumps, no absurd places)."""
    w = W.partitionBy("match_id").orderBy("frame_idx").rowsBetween(1 - min(keep, shown), 0)
    df = points.withColumn("trail", F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).over(w))
    t = F.col("trail")
    sane_at = lambda p: (F.abs(p["x"]) <= 10_000) & (F.abs(p["y"]) <= 10_000)
    pairs = F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: sane_at(a) & sane_at(b) & (F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])) <= jump))
    return df.withColumns({"n_trail": F.size(t), "n_drawn": F.size(F.filter(pairs, lambda ok: ok))}).drop("trail")


def box_velocity(dets: DataFrame) -> DataFrame:
    """Shift of the box centre since the track's last box."""
    w = _track()
    cx, cy = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    return dets.withColumns({"vx": cx - F.lag(cx).over(w), "vy": cy - F.lag(cy).over(w)})
