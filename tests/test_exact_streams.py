import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from touchgrid.operators import possession, space
from touchgrid.plans import catalog_queries
from touchgrid.plans.catalog_queries import QUERIES
from touchgrid.streaming import frames as S, live


def streamed(spark, df, at, files=1):
    for i in range(files):
        df.where(F.col("frame_idx") % files == i).coalesce(1).write.mode("append").parquet(str(at))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(at))


def test_centroids_half_way_but_for_the_last_bit_go_up(spark):
    places = [80.24, 15.27, 51.96, 52.0, 79.49, 14.97, 66.22]  # their mean is 51.45, as doubles 51.449999999999996
    df = spark.createDataFrame([(1, 1, i, x, x) for i, x in enumerate(places)], "match_id long, frame_idx long, role_id int, x_m double, y_m double").withColumn("role_id", F.lit(1))
    [r] = space.centroids(df.coalesce(1)).collect()
    assert (r.cx, r.cy, r.n) == (51.5, 51.5, 7)


def test_distances_reach_the_stream_to_the_last_bit(spark, tmp_path):
    near = 1.05 - 1e-12  # under 1.05: the holder takes the ball at once
    df = spark.createDataFrame([(1, f, 3, 0, near, False, 4) for f in range(4)], "match_id long, frame_idx long, candidate long, candidate_team long, dist_m double, contested boolean, n_rows long")
    got = live.drained(live.live_possession(streamed(spark, df, tmp_path / "in"), total="n_rows"), "exact").drop("batch")
    want = possession.assign(df.drop("n_rows"))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert [r.holder_id for r in got.orderBy("frame_idx").collect()] == [3] * 4


def test_boxes_off_the_keyframes_move_the_watermark(spark, tmp_path):
    box = "match_id long, frame_idx long, track_id long, x1 double, y1 double, x2 double, y2 double, conf double, last_frame long"
    boxes = spark.createDataFrame([(1, 0, 7, 1.0, 1.0, 5.0, 9.0, 0.9, 9), (-1, 16, -1, None, None, None, None, None, -1)], box)  # 16 is no keyframe
    motion = spark.createDataFrame([(1, f, [1.0, 0.0, 1.0, 0.0, 1.0, 0.0], 9) for f in range(10)] + [(-1, 16, None, -1)], "match_id long, frame_idx long, affine array<double>, last_frame long")
    timed = lambda df, name: streamed(spark, df.withColumn("ts", S.frame_time()), tmp_path / name).withWatermark("ts", "120 milliseconds")
    got = live.drained(S.live_carried(timed(boxes, "boxes"), timed(motion, "motion")), "carried-exact")
    assert sorted(r.frame_idx for r in got.where("match_id = 1").collect()) == list(range(10))


def test_track_counts_of_a_stream_are_exact(spark, tmp_path):
    spark.range(9000).select(F.col("id").alias("user_id"), F.col("id").alias("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.match_id: r.n_tracks for r in QUERIES["stream_track_counts"](spark, str(tmp_path)).collect()}
    assert got == {0: 3000, 1: 3000, 2: 3000}


def test_a_fold_holds_one_batch_of_a_match(spark):
    """The rows of a key come as batches, so the largest thing that a task holds does not grow with the key."""
    from touchgrid.operators import camera

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.range(2500).select(F.lit(1).cast("long").alias("match_id"), F.col("id").alias("frame_idx"), (F.col("id") % 10 / 10).alias("hist_distance"), F.lit(0.5).alias("edge_diff"), F.lit(1.0).alias("flow_inlier")).repartition(5)
        out = camera.cuts(df)
        assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
        last, want = None, 0
        for f in range(2500):
            if f % 10 / 10 >= 0.5 and (last is None or f - last >= 15):
                last, want = f, want + 1
        rows = out.orderBy("frame_idx").collect()
        assert [r.frame_idx for r in rows] == list(range(2500)) and rows[-1].cut_count == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_appearances_do_not_land(spark, sf, monkeypatch):
    def played(spark, rows, name):
        raise LookupError(*rows.columns)

    monkeypatch.setattr(catalog_queries, "_played", played)
    with pytest.raises(LookupError) as seen:
        QUERIES["stream_scenes"](spark, sf)
    assert "person" in seen.value.args and "emb" not in seen.value.args


def test_waiting_columns_pass_without_python_numbers(spark, monkeypatch):
    fold = S.FrameProcessor(S.FF.Carry(), ["match_id"])
    fold.arrow = to_arrow_schema(fold.kinds)
    monkeypatch.setattr(S.FF, "plain", lambda *a: pytest.fail("a column as Python numbers"))
    made = {f.name: f for f in fold.kinds}
    assert fold._column(pd.Series([1.0, None]), made["x1"]).to_pylist() == [1.0, None]
    assert fold._column(pd.Series([7.0, None]), made["track_id"]).to_pylist() == [7, None]
    assert fold._column(pd.Series([None, None], dtype=object), made["conf"]).to_pylist() == [None, None]
    assert fold._column(pd.Series([np.array([1.0, 0.5]), None]), made["affine"]).to_pylist() == [[1.0, 0.5], None]
