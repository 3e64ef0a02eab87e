"""Football models: expected goals, expected threat, roles, activity.  All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .geometry import PITCH_LENGTH, PITCH_WIDTH, _c, clip, distance

GOAL_Y, POST = 34.0, 3.66
XT_COLS, XT_ROWS = 16, 12


def goal_x(direction) -> Column:
    """105 where the team attacks to the right (direction 1), else 0."""
    return F.when(_c(direction) > 0, PITCH_LENGTH).otherwise(0.0)


def goal_distance(x, y, gx) -> Column:
    return F.greatest(F.lit(0.5), distance(x, y, gx, GOAL_Y))


def goal_angle(x, y, gx) -> Column:
    """Degrees between the lines to the two posts."""
    ax, ay, by = _c(gx) - _c(x), GOAL_Y - POST - _c(y), GOAL_Y + POST - _c(y)
    cos = (ax * ax + ay * by) / F.greatest(F.lit(1e-9), F.sqrt(ax * ax + ay * ay) * F.sqrt(ax * ax + by * by))
    return F.degrees(F.acos(clip(cos, -1.0, 1.0)))


def in_cone(px, py, x, gx) -> Column:
    """Whether a player stands between the shooter and the goal mouth."""
    px, py, x, gx = _c(px), _c(py), _c(x), _c(gx)
    t = F.abs(px - x) / F.greatest(F.lit(0.1), F.abs(gx - x))
    half = (POST + 1.5) * t + 0.5 * (1.0 - t)
    return px.between(F.least(x, gx), F.greatest(x, gx)) & (F.abs(py - GOAL_Y) <= half + 1.2)


def expected_goals(dist, angle, defenders, speed) -> Column:
    """Logistic model of distance, angle, congestion and shot speed, within [0.01, 0.96]."""
    z = 0.85 - 0.115 * _c(dist) + 0.042 * _c(angle) - 0.28 * F.least(F.lit(4.0), _c(defenders)) + 0.012 * (clip(speed, 20.0, 120.0) - 60.0) / 10.0
    return clip(1.0 / (1.0 + F.exp(-z)), 0.01, 0.96)


def threat_surface(spark: SparkSession) -> DataFrame:
    """(row, col, xt): the expected-threat grid of 12 x 16 zones; a fixed small dimension."""
    grid = spark.range(XT_ROWS * XT_COLS).select((F.col("id") / XT_COLS).cast("int").alias("row"), (F.col("id") % XT_COLS).cast("int").alias("col"))
    return grid.select("row", "col", zone_threat("row", "col").alias("xt"))


def zone_threat(row, col) -> Column:
    """Expected threat of a zone: more near the goal, most in the box."""
    r, c = _c(row).cast("double"), _c(col).cast("double")
    base = 0.28 * F.exp(-F.sqrt((15.0 - c) * (15.0 - c) + 1.8 * (5.5 - r) * (5.5 - r)) / 4.8) + 0.006 * F.pow(c / 15.0, F.lit(1.5)) + 0.003
    base = base * F.when(r.between(3, 8) & c.between(11, 14), 1.35).otherwise(1.0)
    base = base * F.when(r.between(4, 7) & c.between(13, 15), 1.45).otherwise(1.0)
    return clip(base, 0.003, 0.35)


def threat_zone(x, y, direction) -> tuple[Column, Column]:
    """(row, col) of a point; x is mirrored for a team that attacks to the left, y is not."""
    px, py = clip(x, 0.0, 104.9), clip(y, 0.0, 67.9)
    px = F.when(_c(direction) > 0, px).otherwise(F.greatest(F.lit(0.0), PITCH_LENGTH - px))
    col = F.least(F.floor(px / (PITCH_LENGTH / XT_COLS)), F.lit(XT_COLS - 1))
    row = F.least(F.floor(py / (PITCH_WIDTH / XT_ROWS)), F.lit(XT_ROWS - 1))
    return row.cast("int"), col.cast("int")


def progressive(delta, sx, ex, direction) -> Column:
    """Whether an action brings the ball clearly nearer; only x counts for the gain."""
    gx = goal_x(direction)
    start, end = F.abs(gx - _c(sx)), F.abs(gx - _c(ex))
    gain = start - end
    return (_c(delta) >= 0.012) | (gain >= 8.0) & ((start <= 55.0) | (gain >= 12.0))


def node_role(x, y) -> Column:
    """Role label of a mean position."""
    x, y = _c(x), _c(y)
    keeper = y.between(26.0, 42.0) & ((x < 14.0) | (x > 91.0))
    return F.when((x < 22.0) | (x > 83.0), F.when(keeper, "GK").otherwise("DF")).when((x < 42.0) | (x > 63.0), "DF").otherwise("MF")


def kit_role(hue, sat, val, x=None, y=None, box_bottom=None, deepest_a=None, deepest_b=None) -> Column:
    """Role of a person by kit colour and place: 0 A, 1 B, 2 referee, 3 A keeper, 4 B keeper, 5 coach."""
    hue, sat, val = _c(hue), _c(sat), _c(val)
    x, y = (F.lit(52.5) if x is None else F.coalesce(_c(x), F.lit(52.5))), (F.lit(34.0) if y is None else F.coalesce(_c(y), F.lit(34.0)))
    no = F.lit(False)
    deep_a, deep_b = (no if d is None else F.coalesce(_c(d), no) for d in (deepest_a, deepest_b))
    low = no if box_bottom is None else F.coalesce(_c(box_bottom) > 880.0, no)
    box = y.between(10.0, 58.0)
    return (
        F.when(low, 5)
        .when(hue.isNull(), 0)
        .when(deep_a & (x < 32.0) & box, 3)
        .when(deep_b & (x > 73.0) & box, 4)
        .when(val < 110, 2)
        .when(hue.between(40, 72) & (sat >= 68), 1)
        .when((sat < 70) & (val >= 120), 0)
        .when(hue.between(35, 75) & (sat >= 55), 1)
        .otherwise(0)
    )


def activity(speed) -> Column:
    """Activity category of a smoothed speed in km/h."""
    s = _c(speed)
    return F.when(s < 2.0, "Standing").when(s < 7.2, "Walking").when(s < 14.4, "Jogging").when(s < 19.8, "Running").otherwise("Sprinting")


def clamped_speed(speed, least=2.0, most=38.0) -> Column:
    """Zero below the dead band, at most ``most``."""
    s = _c(speed)
    return F.when(s < least, 0.0).when(s > most, float(most)).otherwise(s)


def shot_trajectory(peak, sx, ex, ey) -> Column:
    """Whether a flight looks like a shot: fast, ending before a goal, moving towards it."""
    peak, sx, ex, ey = (_c(v) for v in (peak, sx, ex, ey))
    return (peak >= 36.0) & ey.between(20.0, 48.0) & (((ex > 85.0) & (ex - sx > 5.0)) | ((ex < 20.0) & (sx - ex > 5.0)))


def team_side(role) -> Column:
    """0 for team A and its keeper, 1 for team B and its keeper, else null."""
    return F.when(_c(role).isin(0, 3), 0).when(_c(role).isin(1, 4), 1)
