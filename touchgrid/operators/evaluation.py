"""Detection, tracking, homography and kinematics metrics, and input quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G

FRAME = ["match_id", "frame_idx"]


def box_matches(pred: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Each predicted box with the first true box of its frame that overlaps enough (not one to one), or null."""
    t = truth.select(*FRAME, F.col("det_idx").alias("gt_idx"), *(F.col(c).alias(f"t{c}") for c in ("x1", "y1", "x2", "y2")))
    pairs = pred.join(t, FRAME).withColumn("iou", G.iou(("x1", "y1", "x2", "y2"), ("tx1", "ty1", "tx2", "ty2"))).filter(F.col("iou") >= least)
    first = pairs.groupBy(*FRAME, "det_idx").agg(F.min(F.struct("gt_idx", "iou")).alias("m"))
    return pred.join(first, [*FRAME, "det_idx"], "left").select(*FRAME, "det_idx", F.col("m.gt_idx").alias("gt_idx"), F.col("m.iou").alias("iou"))


def detection_metrics(pred: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and the mAP approximations of each match."""
    m = box_matches(pred, truth, least).groupBy("match_id").agg(F.count("*").alias("n_pred"), F.count("gt_idx").alias("tp"), F.avg("iou").alias("iou"))
    t = truth.groupBy("match_id").agg(F.count("*").alias("n_true"))
    df = t.join(m, "match_id", "full_outer").select("match_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pred", "tp", "n_true")), "iou")
    tp, p, r = F.col("tp"), F.col("precision"), F.col("recall")
    df = df.withColumns({"fp": F.col("n_pred") - tp, "fn": F.greatest(F.lit(0), F.col("n_true") - tp), "precision": tp / F.greatest(F.lit(1), F.col("n_pred")), "recall": tp / F.greatest(F.lit(1), F.col("n_true"))})
    return df.withColumns({"f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), "map50": p * r, "map50_95": p * r * F.coalesce("iou", F.lit(0.85))})


def tracking_metrics(points: DataFrame, tracks: int = 22) -> DataFrame:
    """Track counts and the approximations built on them (MOTP is a constant of the definition)."""
    per = points.groupBy("match_id", "track_id").agg(F.count("*").alias("n"))
    df = per.groupBy("match_id").agg(F.count("*").alias("n_tracks"), F.count_if(F.col("n") >= 50).alias("mostly_tracked"), F.count_if(F.col("n") < 10).alias("mostly_lost"))
    n, mt, ml = F.col("n_tracks"), F.col("mostly_tracked"), F.col("mostly_lost")
    df = df.withColumn("id_switches", F.greatest(F.lit(0), n - tracks))
    mota = F.greatest(F.lit(0.0), 1.0 - F.col("id_switches") / max(1, tracks) * 0.15 - ml / F.greatest(F.lit(1), n) * 0.10)
    idf1 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * mt / (mt + n + tracks) * 2.0))
    return df.withColumns({"mota": F.round(mota, 4), "motp": F.lit(0.88), "idf1": F.round(idf1, 4), "fragmentations": (F.col("id_switches") * 0.7).cast("int")})


def homography_metrics(pairs: DataFrame) -> DataFrame:
    """Errors of projected points (x_m, y_m) against true ones (tx_m, ty_m)."""
    d = G.distance("x_m", "y_m", "tx_m", "ty_m")
    return pairs.groupBy("match_id").agg(F.sqrt(F.avg(d * d)).alias("rmse_m"), F.avg(d).alias("mae_m"), F.max(d).alias("max_m"), F.count("*").alias("n"))


def kinematics_metrics(speeds: DataFrame, most: float = 38.0) -> DataFrame:
    """Share of valid speeds, and mean, top and variance of those alone (0 without any)."""
    s = F.col("speed_kmh")
    valid = F.when(s <= most, s)
    return speeds.groupBy("match_id").agg((F.count(valid) / F.count("*") * 100.0).alias("valid_pct"), *(F.coalesce(f(valid), F.lit(0.0)).alias(n) for f, n in ((F.avg, "mean_kmh"), (F.max, "max_kmh"), (F.var_pop, "variance"))))


def composite_score(map50, mota, valid_pct):
    """One number out of 100, at most 98.5."""
    return F.least(F.lit(98.5), 30.0 * map50 + 30.0 * mota + 0.2 * valid_pct + 20.0)


def report(pred: DataFrame, truth: DataFrame, points: DataFrame, speeds: DataFrame) -> DataFrame:
    """A row per match with all metrics and the composite score."""
    d = detection_metrics(pred, truth).select("match_id", "precision", "recall", "f1", "map50", "map50_95")
    out = d.join(tracking_metrics(points), "match_id", "left").join(kinematics_metrics(speeds), "match_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.withColumn("score", composite_score(zero("map50"), zero("mota"), zero("valid_pct")))


def report_markdown(rep: DataFrame) -> DataFrame:
    """A Markdown text per match."""
    line = lambda name, c: F.concat(F.lit(f"| {name} | "), F.coalesce(F.round(c, 4).cast("string"), F.lit("-")), F.lit(" |"))
    names = [c for c in rep.columns if c != "match_id"]
    return rep.select("match_id", F.concat_ws("\n", F.format_string("# Match %s", F.col("match_id").cast("string")), F.lit("| metric | value |"), F.lit("|---|---|"), *(line(c, F.col(c).cast("double")) for c in names)).alias("markdown"))


# --- input quality ---------------------------------------------------------------


def quality_report(frames: DataFrame) -> DataFrame:
    """Brightness, blur and turf of the sampled frames of a match, and what follows from them."""
    df = frames.groupBy("match_id").agg(
        F.count("*").alias("n"), F.avg("brightness").alias("brightness"), F.stddev_pop("brightness").alias("brightness_std"), F.avg("blur").alias("blur"),
        (F.count_if(F.col("blur") < 100.0) / F.count("*") * 100.0).alias("blurry_pct"), F.avg("grass_pct").alias("grass_pct"),
        *(F.coalesce(F.avg(c), F.lit(d)).alias(c) for c, d in (("turf_h", 55.0), ("turf_s", 150.0), ("turf_v", 120.0))),
    )
    light = F.when(F.col("brightness") < 80.0, "low illumination: equalize or correct gamma").when(F.col("brightness") > 180.0, "bright exposure: normalize the histogram")
    sharp = F.when(F.col("blurry_pct") > 15.0, F.format_string("motion blur in %.1f%% of frames: coast tracks", F.col("blurry_pct")))
    turf = F.when(F.col("grass_pct") > 50.0, F.format_string("turf covers %.1f%% of the view: segment by colour", F.col("grass_pct"))).otherwise("little turf in view: camera may be close")
    return df.withColumn("advice", F.array_compact(F.array(light, sharp, turf)))


def image_stats(images: DataFrame) -> DataFrame:
    """Brightness, blur (variance of the Laplacian) and turf of frames (width, height, image: BGR bytes)."""

    def one(data: bytes, w: int, h: int) -> tuple:
        px = np.frombuffer(data, np.uint8).reshape(h, w, 3).astype(float)
        b, g, r = px[..., 0], px[..., 1], px[..., 2]
        grey = 0.114 * b + 0.587 * g + 0.299 * r
        p = np.pad(grey, 1, mode="reflect") if min(h, w) > 1 else np.pad(grey, 1, mode="edge")
        lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * grey
        hue, sat, val = hsv(px)
        turf = (hue >= 35) & (hue <= 85) & (sat >= 40) & (val >= 40)
        mean = [float(c[turf].mean()) if turf.any() else None for c in (hue, sat, val)]
        return (float(grey.mean()), float(lap.var()), float(turf.mean() * 100.0), *mean)

    names = ["brightness", "blur", "grass_pct", "turf_h", "turf_s", "turf_v"]

    def run(batches):
        for pdf in batches:
            rows = [one(d, w, h) for d, w, h in zip(pdf["image"], pdf["width"], pdf["height"], strict=True)]
            yield pd.concat([pdf[["match_id", "frame_idx"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return images.select("match_id", "frame_idx", "image", "width", "height").mapInPandas(run, "match_id long, frame_idx long, " + ", ".join(f"{n} double" for n in names))


def hsv(px: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue 0-180, saturation and value 0-255 of BGR pixels."""
    b, g, r = px[..., 0], px[..., 1], px[..., 2]
    val = np.maximum(np.maximum(b, g), r)
    span = val - np.minimum(np.minimum(b, g), r)
    safe = np.where(span > 0, span, 1)
    hue = np.select([val == r, val == g], [60 * (g - b) / safe, 120 + 60 * (b - r) / safe], 240 + 60 * (r - g) / safe)
    hue = np.where(span > 0, np.where(hue < 0, hue + 360, hue), 0) / 2
    return hue, np.where(val > 0, span / np.where(val > 0, val, 1) * 255, 0), val


def torso_hsv(crops: DataFrame) -> DataFrame:
    """Median hue, saturation and value of the torso of person crops (image: BGR bytes of the box)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for d, w, h in zip(pdf["image"], pdf["width"], pdf["height"], strict=True):
                px = np.frombuffer(d, np.uint8).reshape(h, w, 3).astype(float)
                part = px[int(0.15 * h) : max(int(0.15 * h) + 1, int(0.50 * h)), int(0.2 * w) : max(int(0.2 * w) + 1, int(0.8 * w))]
                rows.append([float(np.median(c)) for c in hsv(part)])
            yield pdf.drop(columns=["image", "width", "height"]).assign(**{n: [r[i] for r in rows] for i, n in enumerate(("hue", "sat", "val"))})

    return crops.select("match_id", "frame_idx", "det_idx", "image", "width", "height").mapInPandas(run, "match_id long, frame_idx long, det_idx long, hue double, sat double, val double")
