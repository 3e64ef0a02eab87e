import random

import pytest
from pyspark.sql import functions as F

from touchgrid.operators import camera, native_folds as N, possession


def plain(df, *cols):
    return sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))


@pytest.mark.parametrize("stretch", [1, 7, 128])
def test_possession_equals_the_state_machine(spark, stretch):
    rng = random.Random(stretch)
    rows = [(m, f, *((None, None, 999.0 if rng.random() < 0.5 else rng.uniform(0, 4)) if rng.random() < 0.3 else ((w := rng.randrange(4)), rng.choice([w % 2, w % 2, w % 2, None]), rng.uniform(0, 1.9))), rng.random() < 0.2) for m in (1, 2) for f in range(0, 300, m)]
    df = spark.createDataFrame(rows, "match_id long, frame_idx long, candidate long, candidate_team long, dist_m double, contested boolean").repartition(5)
    cols = ["match_id", "frame_idx", "holder_id", "holder_team", "contested", "turnovers"]
    found = N.possession(df, stretch=stretch)
    assert plain(found, *cols) == plain(possession.assign(df), *cols)
    assert found.agg(F.max("turnovers")).first()[0] > 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan


@pytest.mark.parametrize("stretch", [1, 10, 128])
def test_cuts_and_boundaries_equal_the_state_machine(spark, stretch):
    rng = random.Random(stretch)
    rows = [(m, f, rng.random(), rng.random(), rng.random(), rng.choice([None, rng.uniform(50, 60)]), rng.uniform(700, 710)) for m in (1, 2) for f in range(260)]
    df = spark.createDataFrame(rows, "match_id long, frame_idx long, hist_distance double, edge_diff double, flow_inlier double, top_y double, bottom_y double").repartition(3)
    cols = ["match_id", "frame_idx", "is_cut", "cut_count"]
    assert plain(N.cuts(camera.cut_scores(df), stretch=stretch), *cols) == plain(camera.cuts(df), *cols)
    cols = ["match_id", "frame_idx", "top", "bottom"]
    assert plain(N.boundaries(df, stretch=stretch), *cols) == plain(camera.smoothed_boundaries(df), *cols)


def test_nothing_to_fold(spark):
    df = spark.createDataFrame([], "match_id long, frame_idx long, score double, hist_distance double, edge_diff double")
    assert N.cuts(df).count() == 0


@pytest.mark.parametrize("part", [1, 16, 50])
def test_parts_of_a_match_start_from_the_state_before_them(spark, part):
    rng = random.Random(part)
    rows = [(m, f, rng.random(), rng.random(), rng.random(), rng.choice([None, rng.uniform(50, 60)]), rng.choice([None, *[rng.uniform(700, 710)] * 9])) for m in (1, 2) for f in range(300) if not 100 < f < 180]
    df = spark.createDataFrame(rows, "match_id long, frame_idx long, hist_distance double, edge_diff double, flow_inlier double, top_y double, bottom_y double").repartition(3)
    cols = ["match_id", "frame_idx", "is_cut", "cut_count"]
    assert plain(N.cuts(camera.cut_scores(df), part=part), *cols) == plain(camera.cuts(df), *cols)
    cols = ["match_id", "frame_idx", *(F.round(c, 9).alias(c) for c in ("top", "bottom"))]
    assert plain(N.boundaries(df, part=part), *cols) == plain(N.boundaries(df), *cols)
