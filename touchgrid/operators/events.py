"""Passes, interceptions, shots and tackles from possession.

``detect`` is the relational form: acquisitions split a match into groups, a
flight is the first fast loose ball of a group.  ``detect_fold`` is the state
machine itself; both give the same events where a holder always has a ball.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import geometry as G, labels as L, models as M
from . import folds

RELEASE_KMH, LEAST_M, DUEL_FRAMES = 12.0, 3.0, 6
PART = 65_536  # frames


def _stretches(poss: DataFrame, part: int) -> DataFrame:
    """Rows with their ``stretch``: from a part's first held row to the next part's, which both have.

    A held row is all that later events ask of the rows before it, so stretches are on their own.
    """
    match = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    rows = poss.withColumn("part", F.floor(F.col("frame_idx") / part))
    parts = rows.groupBy(F.col("match_id").alias("of_match"), F.col("part").alias("of_part")).agg(F.min(F.when(F.col("holder_id").isNotNull(), F.col("frame_idx"))).alias("first_held"))
    earlier = W.partitionBy("of_match").orderBy("of_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.last(F.when(F.col("first_held").isNotNull(), F.col("of_part")), ignorenulls=True).over(earlier), F.lit(-1)))  # a row a part
    known = rows.join(parts, match("match_id", "of_match") & match("part", "of_part"))
    at = F.when(F.col("frame_idx") > F.col("first_held"), F.array("part")).when(F.col("frame_idx") == F.col("first_held"), F.array("before", "part")).otherwise(F.array("before"))
    return known.withColumn("stretch", F.explode(at)).drop("of_match", "of_part", "part", "first_held", "before")


def _numbered(events: DataFrame) -> DataFrame:
    """Events with ``event_id``: a stretch counts its own, and the stretches before are added."""
    counts = events.groupBy(F.col("match_id").alias("of_match"), F.col("stretch").alias("of_stretch")).agg(F.count("*").alias("n"))
    earlier = W.partitionBy("of_match").orderBy("of_stretch").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("of_match", "of_stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"))
    own = F.row_number().over(W.partitionBy("match_id", "stretch").orderBy("frame_idx"))
    out = events.withColumn("own", own).join(counts, F.col("match_id").eqNullSafe(F.col("of_match")) & (F.col("stretch") == F.col("of_stretch")))
    return out.withColumn("event_id", (F.col("own") + F.col("n")).cast("long")).drop("own", "n", "stretch", "of_match", "of_stretch")


def detect(poss: DataFrame, fps: float = 25.0, part: int = PART) -> DataFrame:
    """Events of possession rows (match_id, frame_idx, holder_id, holder_team, ball_x, ball_y, ball_kmh).

    Every window has the same partition and order, so a stretch of a match is exchanged and sorted once.
    """
    poss = _stretches(poss, part)
    w = W.partitionBy("match_id", "stretch").orderBy("frame_idx")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    held = F.col("holder_id").isNotNull()
    speed = F.least(F.lit(130.0), F.greatest(F.lit(0.0), F.coalesce("ball_kmh", F.lit(0.0))))
    df = poss.withColumn("speed", speed).withColumn("grp", F.count(F.when(held, 1)).over(before))
    last_row = F.last(F.when(held, F.struct("holder_id", "holder_team", "ball_x", "ball_y", "frame_idx")), ignorenulls=True).over(before)
    df = df.withColumn("prev", last_row)
    loose = ~held & F.col("ball_x").isNotNull() & (F.col("speed") >= RELEASE_KMH) & (F.col("grp") >= 1)
    group = W.partitionBy("match_id", "stretch", "grp").orderBy("frame_idx").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("released", F.min(F.when(loose, F.col("frame_idx"))).over(group))
    df = df.withColumn("peak", F.max(F.when(F.col("frame_idx") >= F.col("released"), F.col("speed"))).over(group))
    acq = df.filter(held & F.col("prev").isNotNull())
    p = F.col("prev")
    dist = G.distance("ball_x", "ball_y", p["ball_x"], p["ball_y"])
    flight, other = F.col("released").isNotNull(), F.col("holder_id") != p["holder_id"]
    same = F.col("holder_team").eqNullSafe(p["holder_team"])
    kind = (
        F.when(flight & other & M.shot_trajectory("peak", p["ball_x"], "ball_x", "ball_y"), "SHOT")
        .when(flight & same & other & (dist >= LEAST_M), "PASS")
        .when(flight & ~same & (dist >= LEAST_M), "INTERCEPTION")
        .when(~flight & (F.col("holder_team") != p["holder_team"]) & (F.col("frame_idx") - p["frame_idx"] <= DUEL_FRAMES), "TACKLE")
    )
    acq = acq.withColumn("event_type", kind).filter("event_type is not null")
    passer = F.col("event_type").isin("SHOT", "PASS")
    tackle = F.col("event_type") == "TACKLE"
    out = acq.select(
        "match_id", "stretch", "event_type", F.col("frame_idx").cast("long").alias("frame_idx"), (F.col("frame_idx") / max(1.0, fps)).alias("timestamp_s"),
        F.when(passer, p["holder_team"]).otherwise(F.col("holder_team")).cast("long").alias("team_id"),
        F.when(passer, p["holder_id"]).otherwise(F.col("holder_id")).cast("long").alias("primary_id"),
        F.when(passer, F.col("holder_id")).otherwise(p["holder_id"]).cast("long").alias("secondary_id"),
        F.when(tackle, F.col("speed")).otherwise(F.col("peak")).alias("speed_kmh"), F.when(tackle, 0.0).otherwise(dist).alias("distance_m"),
        p["ball_x"].alias("start_x"), p["ball_y"].alias("start_y"), F.col("ball_x").alias("end_x"), F.col("ball_y").alias("end_y"),
    )
    return _numbered(out)


def detect_fold(poss: DataFrame) -> DataFrame:
    return folds.fold(poss, ["match_id"], ["frame_idx"], folds.event_step, folds.event_start, folds.EVENT_SCHEMA)


def with_text(events: DataFrame) -> DataFrame:
    return events.withColumns({"clock": L.clock("timestamp_s"), "description": L.event_text("event_type", "team_id", "primary_id", "secondary_id", "speed_kmh", "distance_m")})


def summary(events: DataFrame) -> DataFrame:
    """Per match: counts by type and team, pass accuracy (100 without attempts) and turnovers."""
    n = lambda kind, team: F.count_if((F.col("event_type") == kind) & (F.col("team_id") == team))
    cols = [n(kind, t).alias(f"{name}_{'ab'[t]}") for kind, name in (("PASS", "passes"), ("INTERCEPTION", "interceptions"), ("SHOT", "shots"), ("TACKLE", "tackles")) for t in (0, 1)]
    per = events.groupBy("match_id").agg(*cols, F.count_if(F.col("event_type").isin("INTERCEPTION", "TACKLE")).alias("turnovers"), F.count("*").alias("n_events"))
    for own, other in ("ab", "ba"):
        tried = F.col(f"passes_{own}") + F.col(f"interceptions_{other}")
        per = per.withColumn(f"attempts_{own}", tried).withColumn(f"accuracy_{own}", F.when(tried > 0, F.round(F.col(f"passes_{own}") / tried * 100.0, 1)).otherwise(100.0))
    return per.withColumns({f"pass_text_{t}": L.pass_text(F.col(f"passes_{t}"), F.col(f"attempts_{t}"), F.col(f"accuracy_{t}")) for t in "ab"})


def active(frames: DataFrame, events: DataFrame, duration: int = 40) -> DataFrame:
    """The event that shows on each frame: the latest, while it is younger than ``duration`` frames (an as-of join)."""
    marks = events.select("match_id", "frame_idx", F.struct("event_id", "event_type", "frame_idx").alias("event"))
    both = frames.select("match_id", "frame_idx").join(marks, ["match_id", "frame_idx"], "left")
    w = W.partitionBy("match_id").orderBy("frame_idx").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("event", F.last("event", ignorenulls=True).over(w))
    fresh = F.col("frame_idx") < F.col("event.frame_idx") + duration
    return both.select("match_id", "frame_idx", F.when(fresh, F.col("event.event_id")).alias("event_id"), F.when(fresh, F.col("event.event_type")).alias("event_type"))


def timeline(events: DataFrame, last: int = 5) -> DataFrame:
    """Per match the last few events, oldest first."""
    w = W.partitionBy("match_id").orderBy(F.desc("event_id"))
    recent = events.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= last)
    return recent.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "frame_idx"))).alias("events"))
