"""Who has the ball: nearest players, contest, hysteresis, accounting."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import geometry as G
from . import folds

FRAME = ["match_id", "frame_idx"]


def nearest_players(ball: DataFrame, positions: DataFrame, k: int = 2) -> DataFrame:
    """The k players nearest to the ball of their frame.

    An equi join on the frame, then a ranked limit: Spark cuts each frame's rows
    before the exchange (WindowGroupLimit), so no frame is ever gathered.
    """
    pairs = positions.join(ball.select(*FRAME, F.col("x_m").alias("ball_x"), F.col("y_m").alias("ball_y")), FRAME)
    pairs = pairs.withColumn("dist_m", G.distance("x_m", "y_m", "ball_x", "ball_y"))
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy(*FRAME).orderBy("dist_m", "det_idx"))).filter(F.col("rank") <= k)


def candidates(ball: DataFrame, positions: DataFrame, radius: float = 1.8, contest: float = 0.40) -> DataFrame:
    """A row per ball frame: candidate, its team, distance (999 without a player) and whether it is contested."""
    near = nearest_players(ball, positions, 2)
    pick = lambda rank, c: F.max(F.when(F.col("rank") == rank, F.col(c)))
    per = near.groupBy(*FRAME).agg(pick(1, "track_id").alias("t1"), pick(1, "team_id").alias("g1"), pick(1, "dist_m").alias("d1"), pick(2, "team_id").alias("g2"), pick(2, "dist_m").alias("d2"))
    out = ball.select(*FRAME).join(per, FRAME, "left")
    dist = F.coalesce("d1", F.lit(999.0))
    close = dist <= radius
    return out.select(*FRAME, F.when(close, F.col("t1")).alias("candidate"), F.when(close, F.col("g1")).alias("candidate_team"), dist.alias("dist_m"), F.coalesce(close & (F.col("g1") != F.col("g2")) & (F.col("d2") <= radius + contest), F.lit(False)).alias("contested"))


_SCHEMA = "match_id long, frame_idx long, holder_id long, holder_team long, contested boolean, turnovers long"


def assign(cands: DataFrame) -> DataFrame:
    """Hysteresis over the frames of a match; only the thin candidate rows enter the fold."""
    return folds.fold(cands, ["match_id"], ["frame_idx"], folds.possession_step, folds.possession_start, _SCHEMA)


def account(poss: DataFrame) -> DataFrame:
    """Running shares of possession at each frame."""
    w = W.partitionBy("match_id").orderBy("frame_idx")
    run = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(w)
    a, b = run(~F.col("contested") & (F.col("holder_team") == 0)), run(~F.col("contested") & (F.col("holder_team") == 1))
    df = poss.withColumns({"a_frames": a, "b_frames": b, "contested_frames": run(F.col("contested")), "frames": F.count("*").over(w)})
    total = F.col("a_frames") + F.col("b_frames")
    share = lambda c: F.when(total > 0, F.round(F.col(c) / total * 100.0, 1)).otherwise(50.0)
    return df.withColumns({"a_pct": share("a_frames"), "b_pct": share("b_frames"), "contested_pct": F.round(F.col("contested_frames") / F.col("frames") * 100.0, 1)})


def summary(poss: DataFrame) -> DataFrame:
    """Per match: shares, turnovers and the top carrier (of equals the one who held first)."""
    clean = ~F.col("contested")
    team = lambda t: F.count_if(clean & (F.col("holder_team") == t))
    per = poss.groupBy("match_id").agg(team(0).alias("a"), team(1).alias("b"), F.count_if("contested").alias("c"), F.count("*").alias("n"), F.max("turnovers").alias("turnovers"))
    carriers = poss.filter("holder_id is not null").groupBy("match_id", "holder_id").agg(F.count("*").alias("frames"), F.min("frame_idx").alias("since"))
    top = carriers.groupBy("match_id").agg(F.max_by("holder_id", F.struct("frames", -F.col("since"))).alias("top_carrier"), F.max("frames").alias("top_frames"))
    both = F.col("a") + F.col("b")
    share = lambda c: F.when(both > 0, F.round(F.col(c) / both * 100.0, 1)).otherwise(50.0)
    return per.join(top, "match_id", "left").select("match_id", share("a").alias("a_pct"), share("b").alias("b_pct"), F.round(F.col("c") / F.col("n") * 100.0, 1).alias("contested_pct"), "turnovers", "top_carrier", "top_frames")


def frames_per_player(poss: DataFrame) -> DataFrame:
    """Per match a map of holder to frames."""
    per = poss.filter("holder_id is not null").groupBy("match_id", "holder_id").agg(F.count("*").alias("n"))
    return per.groupBy("match_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("holder_id", "n")))).alias("frames"))


def carrier_boxes(poss: DataFrame, dets: DataFrame) -> DataFrame:
    """The box of the holder on each frame where it is tracked."""
    held = poss.filter("holder_id is not null").select(*FRAME, F.col("holder_id").alias("track_id"))
    return dets.join(held, [*FRAME, "track_id"])


def ball_states(detections: DataFrame, fps: float = 25.0) -> DataFrame:
    """Kalman-filtered ball of each frame of ``detections`` (frame_idx, cx, cy, mx, my, w, h, conf; null: not seen)."""
    schema = "match_id long, frame_idx long, cx double, cy double, x_m double, y_m double, speed_kmh double, w double, h double, interpolated boolean, conf double"
    return folds.fold(detections, ["match_id"], ["frame_idx"], partial(folds.ball_step, fps=fps), partial(folds.ball_start, fps), schema)
