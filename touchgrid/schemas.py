"""Schemas of the engine's tables and its small dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MATCH = "match_id string, fps double, frame_count int, width int, height int, duration_s double"
DETECTIONS = "match_id long, frame_idx long, det_idx long, x1 double, y1 double, x2 double, y2 double, conf double, class_id int, class_name string, track_id long"
POSITIONS = "match_id long, frame_idx long, det_idx long, track_id long, x_m double, y_m double, role_id int"
BALL = "match_id long, frame_idx long, cx double, cy double, x_m double, y_m double, speed_kmh double, interpolated boolean, conf double"
POSSESSION = "match_id long, frame_idx long, holder_id long, holder_team long, ball_x double, ball_y double, ball_kmh double"
PASSES = "match_id long, action_id long, frame_idx long, passer_id long, receiver_id long, team_id long, sx double, sy double, ex double, ey double, speed_kmh double"
SHOTS = "match_id long, shot_id long, frame_idx long, shooter_id long, team_id long, x_m double, y_m double, speed_kmh double"

LENGTH, WIDTH, CIRCLE, AREA_LENGTH, AREA_WIDTH, SPOT = 105.0, 68.0, 9.15, 16.5, 40.32, 11.0


def pitch_keypoints(spark: SparkSession) -> DataFrame:
    """(name, x_m, y_m) of the 21 named points of a pitch."""
    mid, low, high = LENGTH / 2, (WIDTH - AREA_WIDTH) / 2, (WIDTH + AREA_WIDTH) / 2
    rows = [(f"corner_{v}_{h}", x, y) for h, x in (("left", 0.0), ("right", LENGTH)) for v, y in (("bottom", 0.0), ("top", WIDTH))]
    rows += [("halfway_bottom", mid, 0.0), ("halfway_top", mid, WIDTH), ("center_spot", mid, WIDTH / 2)]
    rows += [(f"center_circle_{n}", mid + dx, WIDTH / 2 + dy) for n, dx, dy in (("bottom", 0.0, -CIRCLE), ("top", 0.0, CIRCLE), ("left", -CIRCLE, 0.0), ("right", CIRCLE, 0.0))]
    for side, near, far, spot in (("left", 0.0, AREA_LENGTH, SPOT), ("right", LENGTH - AREA_LENGTH, LENGTH, LENGTH - SPOT)):
        rows += [(f"{side}_penalty_{v}_{h}", x, y) for h, x in (("left", near), ("right", far)) for v, y in (("bottom", low), ("top", high))]
        rows.append((f"{side}_penalty_spot", spot, WIDTH / 2))
    return spark.createDataFrame(rows, "name string, x_m double, y_m double")


def role_dim(spark: SparkSession) -> DataFrame:
    """(role_id, name, side) of all roles."""
    from .functions.labels import ROLE_NAMES

    side = {0: 0, 3: 0, 1: 1, 4: 1}
    return spark.createDataFrame([(i, n, side.get(i)) for i, n in ROLE_NAMES.items()], "role_id int, name string, side int")
