"""Camera motion, cuts, pitch boundaries and homographies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import geometry as G
from . import folds


def labelled(motion: DataFrame) -> DataFrame:
    pan, tilt, zoom = G.camera_labels()
    return motion.withColumns({"pan": pan, "tilt": tilt, "zoom_state": zoom})


def pan_histogram(motion: DataFrame) -> DataFrame:
    """Frames by pan direction; all three directions are there, with 0 if need be."""
    spark = motion.sparkSession
    keys = motion.select("match_id").distinct().crossJoin(F.broadcast(spark.createDataFrame([("STATIC",), ("PAN LEFT",), ("PAN RIGHT",)], "pan string")))
    counts = labelled(motion).groupBy("match_id", "pan").agg(F.count("*").alias("n"))
    return keys.join(counts, ["match_id", "pan"], "left").select("match_id", "pan", F.coalesce("n", F.lit(0)).alias("n"))


def bhattacharyya(histograms: DataFrame) -> DataFrame:
    """Distance of each frame's histogram (match_id, frame_idx, bin, p) to that of the frame before."""
    total = histograms.withColumn("p", F.col("p") / F.sum("p").over(W.partitionBy("match_id", "frame_idx")))
    prev = total.select("match_id", (F.col("frame_idx") + 1).alias("frame_idx"), "bin", F.col("p").alias("q"))
    per = total.join(prev, ["match_id", "frame_idx", "bin"]).groupBy("match_id", "frame_idx").agg(F.sum(F.sqrt(F.col("p") * F.col("q"))).alias("bc"))
    return per.select("match_id", "frame_idx", F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.col("bc"))).alias("hist_distance"))


def cut_scores(distances: DataFrame) -> DataFrame:
    score = 0.6 * F.col("hist_distance") + 0.4 * F.col("edge_diff") + F.when(F.col("flow_inlier") < 0.10, 0.15).otherwise(0.0)
    return distances.withColumn("score", G.clip(score, 0.0, 1.0))


def cuts(distances: DataFrame) -> DataFrame:
    """Debounced cuts of frames (hist_distance, edge_diff, flow_inlier)."""
    return folds.fold(cut_scores(distances).select("match_id", "frame_idx", "score", "hist_distance", "edge_diff"), ["match_id"], ["frame_idx"], folds.cut_step, lambda: {"last": None, "n": 0}, "match_id long, frame_idx long, is_cut boolean, cut_count long")


def smoothed_boundaries(pitch: DataFrame, keep: float = 0.8) -> DataFrame:
    """Moving average of the pitch's top and bottom row; frames without lines keep the last values."""

    def step(state, row):
        if folds.missing(row["top_y"]):
            return state, {"frame_idx": row["frame_idx"], "top": state[0], "bottom": state[1]}
        now = tuple(v if s is None else keep * s + (1 - keep) * v for s, v in zip(state, (row["top_y"], row["bottom_y"]), strict=True))
        return now, {"frame_idx": row["frame_idx"], "top": now[0], "bottom": now[1]}

    return folds.fold(pitch, ["match_id"], ["frame_idx"], step, lambda: (None, None), "match_id long, frame_idx long, top double, bottom double")


def last_known(frames: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """As-of join: each frame with the latest facts at or before it (union and a running last value; no range join)."""
    value = F.struct(*columns)
    both = frames.select("match_id", "frame_idx", F.lit(1).alias("part"), F.lit(None).cast(facts.select(value.alias("v")).schema["v"].dataType).alias("v"))
    both = both.unionByName(facts.select("match_id", "frame_idx", F.lit(0).alias("part"), value.alias("v")))
    w = W.partitionBy("match_id").orderBy("frame_idx", "part").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("v", F.last("v", ignorenulls=True).over(w)).filter("part = 1")
    return out.select("match_id", "frame_idx", *(F.col(f"v.{c}").alias(c) for c in columns))


def _homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Least squares by normalised direct linear transform; nothing if the points do not fix one."""

    def scaled(p):
        c = p.mean(0)
        s = np.sqrt(2) / max(1e-12, np.linalg.norm(p - c, axis=1).mean())
        t = np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])
        return (p - c) * s, t

    (a, ta), (b, tb) = scaled(src), scaled(dst)
    rows = [r for (x, y), (u, v) in zip(a, b, strict=True) for r in ([-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v])]
    h = np.linalg.inv(tb) @ np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3) @ ta
    return None if abs(h[2, 2]) < 1e-12 or np.linalg.cond(h) > 1e12 else h / h[2, 2]


def _errors(h: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    p = np.c_[src, np.ones(len(src))] @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        e = np.linalg.norm(p[:, :2] / p[:, 2:] - dst, axis=1)
    return np.where(np.isfinite(e), e, np.inf)


def fit_homography(src, dst, threshold: float = 5.0, rounds: int = 300) -> tuple[np.ndarray, float, bool]:
    """(H, mean reprojection error of all points, valid); the identity and 999 if none fits.

    If some pair is off by more than ``threshold``, maps of four random pairs
    (fixed seed) are tried, and the pairs within it under the best are fitted.
    """
    src, dst = np.asarray(src, float), np.asarray(dst, float)
    if len(src) < 4:
        raise ValueError("a homography needs four point pairs")
    h = _homography(src, dst)
    if len(src) > 4 and (h is None or _errors(h, src, dst).max() > threshold):
        rng, most = np.random.default_rng(0), 3
        for _ in range(rounds):
            four = rng.choice(len(src), 4, replace=False)
            tried = _homography(src[four], dst[four])
            near = _errors(tried, src, dst) <= threshold if tried is not None else np.zeros(len(src), bool)
            if near.sum() > most and (fitted := _homography(src[near], dst[near])) is not None:
                most, h = int(near.sum()), fitted
    if h is None:
        return np.eye(3), 999.0, False
    return h, float(_errors(h, src, dst).mean()), True


def broadcast_homography(top: float = 245.0, bottom: float = 745.0, x: float = 960.0, y: float = 500.0, rx: float = 280.0, ry: float = 130.0) -> np.ndarray:
    """The fixed view of a half-way broadcast camera, from seven points of the halfway line and centre circle."""
    src = [(x - 30, top), (x + 10, bottom), (x, y), (x, y - ry), (x, y + ry), (x - rx, y), (x + rx, y)]
    dst = [(52.5, 68), (52.5, 0), (52.5, 34), (52.5, 43.15), (52.5, 24.85), (43.35, 34), (61.65, 34)]
    return fit_homography(src, dst)[0]


def homographies(points: DataFrame) -> DataFrame:
    """A homography per frame of point pairs (match_id, frame_idx, u, v, x_m, y_m)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 4:
            h, err, ok = np.eye(3), 999.0, False
        else:
            h, err, ok = fit_homography(pdf[["u", "v"]].to_numpy(), pdf[["x_m", "y_m"]].to_numpy())
        return pd.DataFrame([{"match_id": pdf["match_id"].iloc[0], "frame_idx": pdf["frame_idx"].iloc[0], "h": h.ravel().tolist(), "h_inv": np.linalg.inv(h).ravel().tolist(), "err": err, "is_valid": ok}])

    return points.groupBy("match_id", "frame_idx").applyInPandas(run, "match_id long, frame_idx long, h array<double>, h_inv array<double>, err double, is_valid boolean")


def projected(points: DataFrame, h: str = "h", u: str = "u", v: str = "v") -> DataFrame:
    """Metres of image points under the row's homography, as plain arithmetic."""
    x, y = G.project(u, v, [F.col(h)[i] for i in range(9)])
    return points.withColumns({"x_m": x, "y_m": y})


def propagated(h, affine) -> np.ndarray:
    """H after the camera moved by an affine map: H T^-1, scaled to 1 in the corner."""
    t = np.vstack([np.asarray(affine, float).reshape(2, 3), [0, 0, 1]])
    out = np.asarray(h, float).reshape(3, 3) @ np.linalg.inv(t)
    return out / out[2, 2] if abs(out[2, 2]) > 1e-12 else out


def running_homography(frames: DataFrame) -> DataFrame:
    """Homography of each frame: the calibrated one where there is one, else the last moved on by the camera's affine."""

    def step(state, row):
        h = row["h"]
        if h is not None and len(h) == 9:
            state = np.asarray(h, float).reshape(3, 3)
        elif state is not None and row["affine"] is not None:
            state = propagated(state, row["affine"])
        return state, {"frame_idx": row["frame_idx"], "h": None if state is None else state.ravel().tolist()}

    return folds.fold(frames, ["match_id"], ["frame_idx"], step, lambda: None, "match_id long, frame_idx long, h array<double>")
