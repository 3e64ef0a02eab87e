"""Roles of persons: deepest players, kit rules, majority votes, counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import models as M

FRAME = ["match_id", "frame_idx"]


def deepest(positions: DataFrame) -> DataFrame:
    """Per frame the players nearest to each goal line (first index on ties), where they are deep enough."""
    ok = positions.filter(F.col("x_m").between(-2.0, 107.0) & F.col("y_m").between(-2.0, 70.0))
    low = F.min(F.struct(F.col("x_m").alias("x"), F.col("det_idx").alias("i")))
    high = F.min(F.struct((-F.col("x_m")).alias("x"), F.col("det_idx").alias("i")))
    per = ok.groupBy(*FRAME).agg(low.alias("a"), high.alias("b"))
    return per.select(*FRAME, F.when(F.col("a.x") < 32.0, F.col("a.i")).alias("deepest_a"), F.when(-F.col("b.x") > 73.0, F.col("b.i")).alias("deepest_b"))


def raw_roles(people: DataFrame) -> DataFrame:
    """Kit rules on people (hue, sat, val, x_m, y_m, y2) of each frame."""
    df = people.join(deepest(people), FRAME, "left")
    a, b = F.col("deepest_a") == F.col("det_idx"), F.col("deepest_b") == F.col("det_idx")
    return df.withColumn("raw_role", M.kit_role("hue", "sat", "val", F.col("x_m"), F.col("y_m"), F.col("y2"), a, b)).drop("deepest_a", "deepest_b")


def voted_roles(raw: DataFrame, window: int = 15) -> DataFrame:
    """Majority of the last ``window`` votes of a track; of equals the one seen first; untracked rows keep theirs."""
    w = W.partitionBy("match_id", "track_id").orderBy("frame_idx", "det_idx").rowsBetween(1 - window, 0)
    votes = F.collect_list("raw_role").over(w)
    ranked = F.transform(F.array_distinct("votes"), lambda r: F.struct(F.size(F.filter("votes", lambda v: v == r)).alias("n"), (-F.array_position("votes", r)).alias("first"), r.alias("role")))
    return raw.withColumn("votes", votes).withColumn("role_id", F.when(F.col("track_id") < 0, F.col("raw_role")).otherwise(F.array_max(ranked)["role"])).drop("votes")


def role_counts(roles: DataFrame) -> DataFrame:
    """Per frame; keepers count for their team as well."""
    r = F.col("role_id")
    n = lambda *x: F.count_if(r.isin(*x))
    return roles.groupBy(*FRAME).agg(n(0, 3).alias("team_a"), n(1, 4).alias("team_b"), n(2).alias("referees"), n(3).alias("keepers_a"), n(4).alias("keepers_b"), n(5).alias("coaches"))


def centres_of(points: np.ndarray, weights: np.ndarray, k: int, seed: int, starts: int, rounds: int = 100) -> np.ndarray:
    """Centres of the best of ``starts`` runs of K-means (far-apart random starts), sorted by r, g, b."""
    best, least = None, np.inf
    for start in range(starts):
        rng = np.random.default_rng([seed, start])
        centres = points[rng.choice(len(points), p=weights / weights.sum())][None]
        while len(centres) < min(k, len(points)):
            away = ((points[:, None] - centres) ** 2).sum(2).min(1) * weights
            if not away.sum():
                break
            centres = np.vstack([centres, points[rng.choice(len(points), p=away / away.sum())]])
        for _ in range(rounds):
            own = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
            mass = np.bincount(own, weights, len(centres))
            sums = np.stack([np.bincount(own, weights * points[:, i], len(centres)) for i in range(points.shape[1])], 1)
            new = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centres)
            if np.array_equal(new, centres):
                break
            centres = new
        cost = float((((points[:, None] - centres) ** 2).sum(2).min(1) * weights).sum())
        if cost < least - 1e-9:
            best, least = centres, cost
    return best[np.lexsort(best.T[::-1])]


def kit_clusters(kits: DataFrame, k: int = 2, seed: int = 42, starts: int = 10) -> DataFrame:
    """K-means over the jersey colours (r, g, b) of each match by itself, the best of ``starts`` runs; a track gets its most frequent cluster.

    Colours are teams within a match only.  What is clustered are the distinct
    colours of a match with their numbers, counted first, so a group is as large
    as a match has colours and not as it has frames.  Clusters are numbered by
    their centres (r, then g, then b), so numbers do not hang on the run.
    ``votes``: how many of the track's n kits said so.
    """
    colours = ["r", "g", "b"]
    known = kits.where("r is not null and g is not null and b is not null")
    counted = known.groupBy("match_id", *colours).agg(F.count("*").alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(colours)
        points = pdf[colours].to_numpy(float)
        centres = centres_of(points, pdf["w"].to_numpy(float), k, seed, starts)
        return pdf[["match_id", *colours]].assign(cluster=((points[:, None] - centres) ** 2).sum(2).argmin(1))

    of = counted.groupBy("match_id").applyInPandas(run, "match_id long, r double, g double, b double, cluster int")
    found = known.join(of, ["match_id", *colours]).groupBy("match_id", "track_id", "cluster").agg(F.count("*").alias("votes"))
    return found.groupBy("match_id", "track_id").agg(F.max_by(F.struct("cluster", "votes"), F.struct("votes", -F.col("cluster"))).alias("top"), F.sum("votes").alias("n")).select("match_id", "track_id", "top.cluster", "top.votes", "n")
