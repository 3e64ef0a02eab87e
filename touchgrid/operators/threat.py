"""Shots, pass values, passing networks and formations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import labels as L, models as M

FRAME = ["match_id", "frame_idx"]


def shots(raw: DataFrame, players: DataFrame | None = None) -> DataFrame:
    """xG of shots (match_id, shot_id, frame_idx, shooter_id, team_id, x_m, y_m, speed_kmh).

    Everyone in the cone counts, whichever team; the equi key is the frame, the
    cone is a residual condition, and players of frames without a shot leave early.
    """
    direction = F.when(F.col("team_id") == 0, 1).otherwise(-1)
    df = raw.withColumn("direction", direction).withColumn("goal_x", M.goal_x("direction"))
    if players is None:
        df = df.withColumn("defenders", F.lit(0).cast("long"))
    else:
        at = players.select(*FRAME, F.col("x_m").alias("px"), F.col("y_m").alias("py"))
        blocked = df.join(at, FRAME).filter(M.in_cone("px", "py", "x_m", "goal_x")).groupBy("match_id", "shot_id").agg(F.count("*").alias("defenders"))
        df = df.join(blocked, ["match_id", "shot_id"], "left").withColumn("defenders", F.coalesce("defenders", F.lit(0)).cast("long"))
    df = df.withColumn("dist_m", M.goal_distance("x_m", "y_m", "goal_x")).withColumn("angle_deg", M.goal_angle("x_m", "y_m", "goal_x"))
    return df.withColumn("xg", M.expected_goals("dist_m", "angle_deg", "defenders", "speed_kmh"))


def shots_of_events(events: DataFrame) -> DataFrame:
    """Shot facts of SHOT events, from where the ball left."""
    return events.filter(F.col("event_type") == "SHOT").select("match_id", F.col("event_id").alias("shot_id"), "frame_idx", F.col("primary_id").alias("shooter_id"), "team_id", F.col("start_x").alias("x_m"), F.col("start_y").alias("y_m"), "speed_kmh")


def passes_of_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "PASS").select("match_id", F.col("event_id").alias("action_id"), "frame_idx", F.col("primary_id").alias("passer_id"), F.col("secondary_id").alias("receiver_id"), "team_id", F.col("start_x").alias("sx"), F.col("start_y").alias("sy"), F.col("end_x").alias("ex"), F.col("end_y").alias("ey"), "speed_kmh")


def valued_passes(passes: DataFrame) -> DataFrame:
    """Passes with threat before and after; the grid is a fixed dimension of 192 rows, so it is broadcast."""
    grid = M.threat_surface(passes.sparkSession)
    df = passes.filter((F.col("passer_id") >= 0) & (F.col("receiver_id") >= 0) & (F.col("passer_id") != F.col("receiver_id")))
    df = df.withColumn("direction", F.when(F.col("team_id") == 0, 1).otherwise(-1))
    for end, x, y in (("start", "sx", "sy"), ("end", "ex", "ey")):
        row, col = M.threat_zone(x, y, "direction")
        g = F.broadcast(grid.select(F.col("row").alias(f"{end}_row"), F.col("col").alias(f"{end}_col"), F.col("xt").alias(f"xt_{end}")))
        df = df.withColumns({f"{end}_row": row, f"{end}_col": col}).join(g, [f"{end}_row", f"{end}_col"])
    df = df.withColumn("delta_xt", F.col("xt_end") - F.col("xt_start"))
    df = df.withColumn("progressive", M.progressive("delta_xt", "sx", "ex", "direction"))
    dx, dy = F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")
    return df.withColumn("length_m", F.sqrt(dx * dx + dy * dy)).drop("start_row", "start_col", "end_row", "end_col")


TEAM = ["match_id", "team_id"]


def links(valued: DataFrame, least: int = 1) -> DataFrame:
    """Edges of the passing network."""
    per = valued.groupBy(*TEAM, "passer_id", "receiver_id").agg(F.count("*").alias("n"), F.avg("length_m").alias("avg_length_m"), F.avg("speed_kmh").alias("avg_kmh"), F.sum("delta_xt").alias("delta_xt"))
    return per.filter(F.col("n") >= least)


def link_style(edges: DataFrame) -> DataFrame:
    """How links are drawn: thickness and opacity."""
    n = F.col("n")
    return edges.withColumns({"thickness": F.least(F.greatest((1 + 0.8 * n).cast("int"), F.lit(1)), F.lit(6)), "opacity": F.least(F.lit(0.85), 0.35 + 0.1 * n)})


def nodes(valued: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """Vertices: mean position (52.5, 34 if unknown), passes made and received, threat created, role label."""
    made = valued.groupBy(*TEAM, F.col("passer_id").alias("player_id")).agg(F.count("*").alias("made"), F.sum(F.greatest(F.lit(0.0), F.col("delta_xt"))).alias("xt_created"))
    got = valued.groupBy(*TEAM, F.col("receiver_id").alias("player_id")).agg(F.count("*").alias("received"))
    out = made.join(got, [*TEAM, "player_id"], "full_outer")
    if positions is not None:
        place = positions.filter((F.col("track_id") >= 0) & F.col("team_id").isin(0, 1)).groupBy(*TEAM, F.col("track_id").alias("player_id")).agg(F.avg("x_m").alias("x_m"), F.avg("y_m").alias("y_m"))
        out = out.join(place, [*TEAM, "player_id"], "full_outer")
    else:
        out = out.withColumns({"x_m": F.lit(None).cast("double"), "y_m": F.lit(None).cast("double")})
    out = out.select(*TEAM, "player_id", F.coalesce("x_m", F.lit(52.5)).alias("x_m"), F.coalesce("y_m", F.lit(34.0)).alias("y_m"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("made", "received")), F.coalesce("xt_created", F.lit(0.0)).alias("xt_created"))
    return out.withColumns({"involvements": F.col("made") + F.col("received"), "role": M.node_role("x_m", "y_m")})


def placed_links(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Links with the places of both ends; links to unknown nodes leave."""
    place = lambda end: vertices.select(*TEAM, F.col("player_id").alias(f"{end}_id"), F.col("x_m").alias(f"{end}_x"), F.col("y_m").alias(f"{end}_y"))
    return edges.join(place("passer"), [*TEAM, "passer_id"]).join(place("receiver"), [*TEAM, "receiver_id"])


def node_radius(n="involvements"):
    return F.least(F.greatest(10 + (0.8 * F.col(n)).cast("int"), F.lit(10)), F.lit(22))


def network_summary(vertices: DataFrame, edges: DataFrame, valued: DataFrame) -> DataFrame:
    """Per team: density, mean pass length (14.5 without passes), leader and top pair (ties: the smaller ids)."""
    v = vertices.groupBy(*TEAM).agg(F.count("*").alias("n_nodes"), F.max_by("player_id", F.struct("involvements", -F.col("player_id"))).alias("leader"))
    e = edges.groupBy(*TEAM).agg(F.count("*").alias("n_links"), F.max_by(F.struct("passer_id", "receiver_id", "n"), F.struct("n", -F.col("passer_id"), -F.col("receiver_id"))).alias("top"))
    p = valued.groupBy(*TEAM).agg(F.avg("length_m").alias("avg_length_m"))
    out = v.join(e, TEAM, "left").join(p, TEAM, "left")
    n, k = F.col("n_nodes"), F.coalesce("n_links", F.lit(0))
    return out.select(*TEAM, "n_nodes", k.alias("n_links"), F.when(n > 1, k / (n * (n - 1))).otherwise(0.0).alias("density"), F.coalesce("avg_length_m", F.lit(14.5)).alias("avg_length_m"), "leader", F.col("top.passer_id").alias("top_passer"), F.col("top.receiver_id").alias("top_receiver"), F.col("top.n").alias("top_count"))


def formations(vertices: DataFrame) -> DataFrame:
    """Formation of each team from the depth of its outfield nodes."""
    per = vertices.groupBy(*TEAM).agg(F.count("*").alias("n_nodes"), F.array_sort(F.collect_list(F.when(F.col("role") != "GK", F.col("x_m")))).alias("up"), F.avg(F.when(F.col("role") != "GK", F.col("x_m"))).alias("mean_x"))
    xs = F.when(F.coalesce(F.col("mean_x"), F.lit(0.0)) <= 55.0, F.col("up")).otherwise(F.reverse(F.transform("up", lambda x: 105.0 - x)))
    per = per.withColumn("xs", xs)
    n = F.size("xs")
    at = lambda i: F.get("xs", F.lit(i))
    shape = F.when(F.col("n_nodes") < 6, "4-3-3 (Standard)").when(n < 10, "4-3-3").when(at(3) - at(0) > 12.0, F.concat(F.lit("3-4-"), (n - 7).cast("string"))).when(at(4) - at(0) < 8.0, "5-3-2").otherwise("4-3-3")
    return per.select(*TEAM, "n_nodes", shape.alias("formation"))


def top_creators(vertices: DataFrame, k: int = 5) -> DataFrame:
    w = W.partitionBy(*TEAM).orderBy(F.desc("xt_created"), "player_id")
    return vertices.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def latest_actions(valued: DataFrame, k: int = 20) -> DataFrame:
    """The last k actions of each match."""
    w = W.partitionBy("match_id").orderBy(F.desc("action_id"))
    return valued.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")


def totals(shot_facts: DataFrame, valued: DataFrame) -> DataFrame:
    """Per match and team: shots, xG, positive threat, progressive passes."""
    s = shot_facts.filter(F.col("team_id").isin(0, 1)).groupBy(*TEAM).agg(F.count("*").alias("shots"), F.sum("xg").alias("xg"))
    t = valued.filter(F.col("team_id").isin(0, 1)).groupBy(*TEAM).agg(F.count("*").alias("passes"), F.sum(F.greatest(F.lit(0.0), F.col("delta_xt"))).alias("xt"), F.count_if("progressive").alias("progressive"))
    out = s.join(t, TEAM, "full_outer")
    return out.select(*TEAM, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("shots", "xg", "passes", "xt", "progressive")), L.threat_team_name("team_id").alias("team"))
