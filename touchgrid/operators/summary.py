"""Match summaries, telemetry and the processed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import labels as L, models as M

FRAME = ["match_id", "frame_idx"]


def run_stats(dets: DataFrame) -> DataFrame:
    """Frames, players a frame, share of frames with a ball, distinct tracks of each match."""
    per = dets.groupBy(*FRAME).agg(F.count_if(F.col("class_id") != 32).alias("players"), F.max((F.col("class_id") == 32).cast("int")).alias("ball"))
    frames = per.groupBy("match_id").agg(F.count("*").alias("frames"), F.avg("players").alias("avg_players"), F.avg("ball").alias("ball_rate"))
    tracks = dets.filter(F.col("track_id") >= 0).groupBy("match_id").agg(F.countDistinct("track_id").alias("n_tracks"))
    return frames.join(tracks, "match_id", "left").withColumn("n_tracks", F.coalesce("n_tracks", F.lit(0)))


def telemetry(positions: DataFrame, metrics: DataFrame) -> DataFrame:
    """One nested row per frame: all players with speed and role (missing metrics: 0 and Standing)."""
    m = metrics.select("match_id", "frame_idx", "track_id", "speed_kmh", "activity")
    df = positions.join(m, [*FRAME, "track_id"], "left")
    player = F.struct("det_idx", "track_id", "role_id", L.role_name("role_id").alias("role"), F.round("x_m", 2).alias("x_m"), F.round("y_m", 2).alias("y_m"), F.round(F.coalesce("speed_kmh", F.lit(0.0)), 1).alias("speed_kmh"), F.coalesce("activity", F.lit("Standing")).alias("activity"))
    return df.groupBy(*FRAME).agg(F.array_sort(F.collect_list(player)).alias("players"))


def latest(packets: DataFrame) -> DataFrame:
    """The newest packet of each match."""
    w = W.partitionBy("match_id").orderBy(F.desc("frame_idx"))
    return packets.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def processed_rows(positions: DataFrame, boxes: DataFrame, metrics: DataFrame, shares: DataFrame, fps: float = 25.0) -> DataFrame:
    """The thirteen columns of the processed table, a row per frame; arrays and maps as JSON text."""
    role = F.when(F.col("role_id").isin(3, 4), "Goalkeeper").otherwise(L.role_name("role_id"))
    p = positions.groupBy(*FRAME).agg(F.count_if(F.col("role_id") >= 0).alias("num_players"), F.count_if(F.col("role_id") == 0).alias("team_a_count"), F.count_if(F.col("role_id") == 1).alias("team_b_count"), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("det_idx", role.alias("role")))), lambda s: s["role"])).alias("player_roles"))
    b = boxes.groupBy(*FRAME).agg((F.count_if(F.col("class_id") == 32) > 0).alias("ball_detected"), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("det_idx", F.array("x1", "y1", "x2", "y2").alias("box")))), lambda s: s["box"])).alias("bounding_boxes"))
    m = metrics.groupBy(*FRAME).agg(F.max("top_kmh").alias("top_speed_kmh"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("track_id").cast("string"), F.round("speed_kmh", 1)))))).alias("player_speeds"))
    s = shares.select(*FRAME, F.col("a_pct").alias("team_a_space_control_pct"), F.col("b_pct").alias("team_b_space_control_pct"))
    df = p.join(b, FRAME, "left").join(m, FRAME, "left").join(s, FRAME, "left")
    return df.select(
        "match_id", F.col("frame_idx").alias("frame_id"), F.format_string("frames/%06d.jpg", F.col("frame_idx").cast("long")).alias("image_path"), (F.col("frame_idx") / fps).alias("timestamp_s"),
        "num_players", F.coalesce("ball_detected", F.lit(False)).alias("ball_detected"), "team_a_count", "team_b_count", "top_speed_kmh",
        "team_a_space_control_pct", "team_b_space_control_pct", "bounding_boxes", "player_roles", "player_speeds",
    )


def flat(summaries: DataFrame) -> DataFrame:
    """The structs of ``match_summary`` as columns named part_field: the row of a dashboard."""
    parts = [c for c in summaries.columns if c != "match_id"]
    return summaries.select("match_id", *(F.col(f"{p}.{f}").alias(f"{p}_{f}") for p in parts for f in summaries.schema[p].dataType.names))


def match_summary(**parts: DataFrame) -> DataFrame:
    """One row per match with a struct for each part (nulls where a part has no row)."""
    out = None
    for name, df in parts.items():
        one = df.select("match_id", F.struct(*(c for c in df.columns if c != "match_id")).alias(name))
        out = one if out is None else out.join(one, "match_id", "full_outer")
    return out


def rollup(positions: DataFrame) -> DataFrame:
    """Extension: points by match, side and track with all subtotals."""
    return positions.withColumn("side", M.team_side("role_id")).rollup("match_id", "side", "track_id").agg(F.count("*").alias("n"), F.avg("x_m").alias("x_m"))


def pitch_locked(pitch: DataFrame, least: float = 0.20) -> DataFrame:
    """Per match the frames on which enough of the pitch was seen to hold on to."""
    return pitch.groupBy("match_id").agg(F.countDistinct(F.when(F.col("area_ratio") >= least, F.col("frame_idx"))).alias("pitch_locked_frames"))


def by_team(df: DataFrame, columns: list[str], teams: tuple[int, ...] = (0, 1)) -> DataFrame:
    """A row per match and team as one per match: column_a, column_b."""
    pick = lambda c, t: F.max(F.when(F.col("team_id") == t, F.col(c))).alias(f"{c}_{'ab'[t]}")
    return df.where(F.col("team_id").isin(*teams)).groupBy("match_id").agg(*(pick(c, t) for c in columns for t in teams))


def cut_list(cuts: DataFrame) -> DataFrame:
    """Per match the number of cuts and their frames in order."""
    frames = F.array_sort(F.collect_list(F.when(F.col("is_cut"), F.col("frame_idx"))))
    return cuts.groupBy("match_id").agg(F.count_if("is_cut").alias("cuts"), frames.alias("cut_frames"))


def match_report(parts: dict[str, DataFrame]) -> DataFrame:
    """The report of each match: a column part_field for every field of every part; a match that some part lacks has nulls there."""
    return flat(match_summary(**parts))


def packet(positions: DataFrame, metrics: DataFrame, events: DataFrame, last: int = 5) -> DataFrame:
    """What a live client asks for: the newest frame of each match with its players, and the match's last events, oldest first (an empty list without any)."""
    from .events import timeline

    recent = timeline(events, last).withColumnRenamed("events", "recent_events")
    none = F.array().cast(recent.schema["recent_events"].dataType)
    return latest(telemetry(positions, metrics)).join(recent, "match_id", "left").withColumn("recent_events", F.coalesce("recent_events", none))
