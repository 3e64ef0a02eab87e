"""Filters, projections and unions over boxes and positions.

Tables: detections (match_id, frame_idx, det_idx, x1, y1, x2, y2, conf, class_id, track_id) and positions
(match_id, frame_idx, det_idx, track_id, x_m, y_m, role_id).  All are narrow
expressions, so they push down to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import geometry as G

PERSON, REFEREE, BALL = 0, 1, 32


def confident(dets: DataFrame, person: float = 0.30, ball: float = 0.18) -> DataFrame:
    """Boxes over the threshold of their class; the lower threshold goes to the scan as well."""
    return dets.filter(F.col("conf") >= min(person, ball)).filter(F.col("conf") >= F.when(F.col("class_id") == BALL, ball).otherwise(person))


def of_class(dets: DataFrame, class_id: int) -> DataFrame:
    return dets.filter(F.col("class_id") == class_id)


def clamped(dets: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes cut to the frame."""
    x1, y1, x2, y2 = G.clamp_box(width, height)
    return dets.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2})


def with_feet(dets: DataFrame) -> DataFrame:
    u, v = G.foot_point()
    return dets.withColumns({"foot_x": u, "foot_y": v})


def on_pitch(dets: DataFrame, pitch: DataFrame, least_area: float = 0.20) -> DataFrame:
    """Semi join with the pitch of each frame: the ball stays, others if the foot pixel is between y_min and y_max.

    ``pitch`` has match_id, frame_idx, y_min, y_max, area_ratio; a frame whose
    pitch covers less than ``least_area`` filters nothing.
    """
    joined = with_feet(dets).join(pitch, ["match_id", "frame_idx"], "left")
    row = F.col("foot_y").cast("int")
    keep = (F.col("class_id") == BALL) | F.col("y_min").isNull() | (F.col("area_ratio") < least_area) | ((row >= F.col("y_min")) & (row < F.col("y_max")))
    return joined.filter(keep).select(*dets.columns)


def on_mask(dets: DataFrame, mask: DataFrame) -> DataFrame:
    """Semi join of foot pixels with a raster in long form (match_id, frame_idx, px, py)."""
    feet = with_feet(dets).withColumns({"px": F.col("foot_x").cast("int"), "py": F.col("foot_y").cast("int")})
    ball = feet.filter(F.col("class_id") == BALL)
    rest = feet.filter(F.col("class_id") != BALL).join(mask, ["match_id", "frame_idx", "px", "py"], "left_semi")
    return ball.unionByName(rest).select(*dets.columns)


def within(x_low: float, x_high: float, y_low: float, y_high: float) -> Column:
    return F.col("x_m").between(x_low, x_high) & F.col("y_m").between(y_low, y_high)


def kinematic_points(positions: DataFrame) -> DataFrame:
    return positions.filter((F.col("track_id") >= 0) & within(-5.0, 110.0, -5.0, 73.0))


def heat_points(positions: DataFrame) -> DataFrame:
    return positions.filter((F.col("track_id") >= 0) & within(-2.0, 107.0, -2.0, 70.0))


def network_points(positions: DataFrame) -> DataFrame:
    return positions.filter((F.col("track_id") >= 0) & F.col("team_id").isin(0, 1))


def keeper_candidates(positions: DataFrame) -> DataFrame:
    return positions.filter((F.col("class_id") == PERSON) & within(-2.0, 107.0, -2.0, 70.0))


def radar_points(positions: DataFrame) -> DataFrame:
    return positions.filter(within(-5.0, 110.0, -5.0, 73.0))


def sane(df: DataFrame, *columns: str, most: float = 10_000.0) -> DataFrame:
    """Rows whose coordinates are finite and not absurd."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) <= most)
    return df.filter(ok)


def keyframe(interval: int, frame="frame_idx", is_cut=None) -> Column:
    """Whether the detector runs on a frame."""
    if interval <= 1:
        return F.lit(True)
    hit = F.col(frame) % interval == 0
    return hit if is_cut is None else hit | F.coalesce(F.col(is_cut), F.lit(False))


def recalibration(interval: int, first: int = 0, frame="frame_idx", is_cut=None) -> Column:
    """Whether the pitch is looked at anew on a frame."""
    return keyframe(interval, frame, is_cut) | (F.col(frame) == first)


def sampled_frames(frames: DataFrame, most: int) -> DataFrame:
    """An even sample of at most ``most`` frames of each match, whatever its length."""
    length = frames.groupBy("match_id").agg((F.max("frame_idx") + 1).alias("length"))
    step = F.greatest(F.lit(1), F.floor(F.col("length") / most))
    df = frames.join(length.select("match_id", step.alias("step")), "match_id")
    return df.filter((F.col("frame_idx") % F.col("step") == 0) & (F.col("frame_idx") < F.col("step") * most)).drop("step")


def first_frames(frames: DataFrame, n: int) -> DataFrame:
    return frames.filter(F.col("frame_idx") < n)


def persons_by_order(dets: DataFrame, positions: DataFrame) -> DataFrame:
    """The k-th person of a frame gets the k-th metric position of the frame."""
    order = W.partitionBy("match_id", "frame_idx").orderBy("det_idx")
    people = of_class(dets, PERSON).withColumn("k", F.row_number().over(order))
    places = positions.withColumn("k", F.row_number().over(order)).select("match_id", "frame_idx", "k", "x_m", "y_m")
    return people.join(places, ["match_id", "frame_idx", "k"], "left").drop("k")


def union_boxes(tracked: DataFrame, coasted: DataFrame, ball: DataFrame) -> DataFrame:
    """UNION ALL in the order tracked, coasted, ball; det_idx is numbered anew."""
    parts = [df.withColumn("part", F.lit(i)) for i, df in enumerate((tracked, coasted, ball.withColumn("track_id", F.lit(-1).cast("long"))))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    order = W.partitionBy("match_id", "frame_idx").orderBy("part", "det_idx")
    return out.withColumn("det_idx", F.row_number().over(order) - 1).drop("part")
