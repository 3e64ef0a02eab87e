import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchgrid.functions import session
from touchgrid.operators import space, summary
from touchgrid.streaming import jobs as J, live

# --- territories ---


def test_territory_is_the_hull_of_all_places(spark):
    rng = np.random.default_rng(4)
    rows = [(m, t, float(x), float(y)) for m in (1, 2) for t in range(3) for x, y in rng.normal(50, 10 + t, (700, 2))]
    rows += [(1, 8, 1.0, 1.0)] * 5 + [(1, 9, float(i), 2.0 * i) for i in range(9)] + [(1, None, 0.0, 0.0), (1, 5, None, 1.0)]
    df = spark.createDataFrame(rows, "match_id long, track_id long, x_m double, y_m double").repartition(7)
    got = {(r.match_id, r.track_id): r for r in space.territories(df, held=64).collect()}
    for (m, t), r in got.items():
        points = np.array([(x, y) for a, b, x, y in rows if (a, b) == (m, t)])
        assert r.n == len(points) and r.area_m2 == pytest.approx(space.area(space.hull(points)))
    assert len(got) == 8 and got[1, 8].area_m2 == got[1, 9].area_m2 == 0 and got[1, 9].n_vertices == 0
    assert space.territories(df.limit(0)).count() == 0


def test_what_moves_are_vertices(spark):
    def moved(frames):
        df = spark.range(frames, numPartitions=4).select(F.lit(1).cast("long").alias("match_id"), (F.col("id") % 2).alias("track_id"), (50 + 40 * F.sin(F.col("id") * 0.37) * F.rand(1)).alias("x_m"), (30 + 20 * F.cos(F.col("id") * 0.11) * F.rand(2)).alias("y_m"))
        return space.territories(df, held=128).agg(F.max("n_vertices")).first()[0]

    assert moved(40_000) < 4 * moved(4_000)  # ten times the frames, about the same hull


# --- sketches ---


def test_sketches_merge_in_any_order_within_their_error(spark):
    n = 20_000
    df = spark.range(3 * n).select((F.col("id") % 7).cast("long").alias("w"), F.lit(1).alias("match_id"), (F.col("id") % n).alias("track_id"), F.timestamp_seconds(F.col("id") % 600).alias("ts"))
    sketches = live.sketched(df, "track_id", "1 minute")
    assert sketches.count() == 10
    [a] = live.merged_counts(sketches).collect()
    [b] = live.merged_counts(sketches.orderBy(F.rand(3)).repartition(5)).collect()
    [halves] = live.merged_counts(sketches.withColumn("match_id", F.lit(1)).where("window.start is not null")).collect()
    assert a == b == halves and a.n_windows == 10
    assert abs(a.n_distinct - n) <= 4 * 0.83 / 2**6 * n


# --- SQL surface ---


def test_sql_functions_are_inlined_and_equal_the_columns(spark):
    from touchgrid.functions import geometry as G, models as M

    session.register(spark)
    df = spark.range(50).select((F.col("id") * 2.1).alias("x"), (F.col("id") * 1.3).alias("y"))
    df.createOrReplaceTempView("spots")
    got = spark.sql("select xg(x, y, 105, 1, 70) a, xt(x, y, -1) b, iou(x, y, x + 4, y + 4, x + 1, y, x + 5, y + 4) c, project(x, y, array(1, 0, 5, 0, 1, 6, 0, 0, 1)) d, activity(x) e from spots")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    row, col = M.threat_zone("x", "y", F.lit(-1))
    want = df.select(M.expected_goals(M.goal_distance("x", "y", F.lit(105.0)), M.goal_angle("x", "y", F.lit(105.0)), F.lit(1), F.lit(70)).alias("a"), M.zone_threat(row, col).alias("b"), G.iou(["x", "y", F.col("x") + 4, F.col("y") + 4], [F.col("x") + 1, "y", F.col("x") + 5, F.col("y") + 4]).alias("c"), F.struct((F.col("x") + 5).alias("x"), (F.col("y") + 6).alias("y")).alias("d"), M.activity("x").alias("e"))
    for g, w in zip(got.collect(), want.collect(), strict=True):
        assert g.e == w.e and (g.a, g.b, g.c, g.d.x, g.d.y) == pytest.approx((w.a, w.b, w.c, w.d.x, w.d.y))


def test_voronoi_table_function_equals_the_operator(spark):
    rng = random.Random(2)
    rows = [(1, f, rng.uniform(0, 105), rng.uniform(0, 68), rng.choice([0, 1, 2, 3, 4, None])) for f in range(4) for _ in range(8)] + [(1, 9, 5.0, 5.0, 0), (1, 9, None, 5.0, 1)]
    df = spark.createDataFrame(rows, "match_id long, frame_idx long, x_m double, y_m double, role_id int")
    df.createOrReplaceTempView("some_positions")
    session.register(spark)
    got = spark.sql("select * from voronoi_cells(table(some_positions) partition by (match_id, frame_idx))")
    want = space.voronoi_cells(df.where("x_m is not null"))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    per = {r.frame_idx: r["count"] for r in got.groupBy("frame_idx").count().collect()}
    assert set(per.values()) == {105 * 68} and 9 not in per


# --- reports ---


def test_report_keeps_a_match_that_a_part_lacks(spark):
    a, b = spark.createDataFrame([(1, 5)], "match_id long, frames long"), spark.createDataFrame([(2, 0, 1.5), (2, 1, 2.5), (2, 7, 9.0)], "match_id long, team_id long, xg double")
    got = sorted(map(tuple, summary.match_report({"run": a, "threat": summary.by_team(b, ["xg"])}).collect()))
    assert got == [(1, 5, None, None), (2, None, 1.5, 2.5)]


def test_packets_carry_the_last_events(spark):
    pos = spark.createDataFrame([(m, f, 0, 3, 1.0, 2.0, 0) for m in (1, 2) for f in range(4)], "match_id long, frame_idx long, det_idx int, track_id long, x_m double, y_m double, role_id int")
    metrics = spark.createDataFrame([(1, 3, 3, 7.25, "Jogging")], "match_id long, frame_idx long, track_id long, speed_kmh double, activity string")
    events = spark.createDataFrame([(1, i, "PASS", 10 * i) for i in range(1, 9)], "match_id long, event_id long, event_type string, frame_idx long")
    got = {r.match_id: r for r in summary.packet(pos, metrics, events).collect()}
    assert [e.event_id for e in got[1].recent_events] == [4, 5, 6, 7, 8] and got[2].recent_events == []
    assert (got[1].frame_idx, got[1].players[0].speed_kmh, got[2].players[0].activity) == (3, 7.3, "Standing")


def test_pitch_locked_frames_count_once(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.6), (1, 2, 0.1), (1, 3, None), (2, 1, 0.0)], "match_id long, frame_idx long, area_ratio double")
    assert sorted(map(tuple, summary.pitch_locked(df).collect())) == [(1, 1), (2, 0)]


# --- jobs ---


def source(spark, at, files=3, broken=False):
    for i in range(files):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    return stream.select(F.when(F.col("id") == 25, F.raise_error(F.lit("out of order"))).otherwise(F.col("id")).alias("id")) if broken else stream


def test_a_killed_and_restarted_stream_leaves_no_double_row(spark, tmp_path):
    at = str(tmp_path)
    stream = source(spark, at)
    job = J.Job(at, "copy")
    calls = []

    def dies_before_the_entry(batch, batch_id):
        calls.append(batch_id)
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={batch_id}")
        if batch_id == 1:
            raise RuntimeError("killed")
        job.write(batch, batch_id)

    assert job.run(stream, dies_before_the_entry) == "failed"
    assert sorted(r.id for r in job.rows(spark, "id long").collect()) == list(range(10))
    again = J.Job(at, "copy", job.id)

    def dies_after_the_entry(batch, batch_id):
        again.write(batch, batch_id)
        if batch_id == 1 and calls.count(1) == 1:
            calls.append(1)
            raise RuntimeError("killed")

    assert again.run(stream, dies_after_the_entry) == "failed"
    third = J.Job(at, "copy", job.id)
    assert third.run(stream) == "completed"
    assert sorted(r.id for r in third.rows(spark, "id long").collect()) == list(range(30))
    [row] = J.jobs(spark, at).collect()
    assert (row.id, row.name, row.status, row.error, row.batches, row.rows) == (job.id, "copy", "completed", None, 3, 30) and row.ended >= row.started


def test_a_failed_job_says_why(spark, tmp_path):
    job = J.Job(str(tmp_path), "fails")
    assert [r.status for r in J.jobs(spark, str(tmp_path)).collect()] == ["processing"]
    assert job.run(source(spark, str(tmp_path), broken=True)) == "failed"
    [row] = J.jobs(spark, str(tmp_path)).collect()
    assert row.status == "failed" and "out of order" in row.error and row.batches == 2
    assert J.jobs(spark, str(tmp_path / "none")).count() == 0


def test_listener_keeps_every_batch(spark, tmp_path):
    listener = J.StageLatency(str(tmp_path))
    spark.streams.addListener(listener)
    try:
        assert J.Job(str(tmp_path), "watched").run(source(spark, str(tmp_path))) == "completed"
        for _ in range(50):
            table = listener.table(spark)
            if table.where("rows > 0").select("batch_id").distinct().count() == 3:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    rows = table.collect()
    assert {r.batch_id for r in rows if r.rows} == {0, 1, 2} and {r.rows for r in rows if r.rows} == {10}
    assert {"addBatch", "triggerExecution"} <= {r.stage for r in rows}
    for r in J.latencies(table).where("stage = 'addBatch'").collect():
        earlier = sorted((x.batch_id, x.ms) for x in rows if x.stage == "addBatch" and x.batch_id <= r.batch_id)
        value = 0.0
        for _, ms in earlier:
            value = 0.9 * value + 0.1 * ms
        assert r.smoothed == pytest.approx(value)


def test_moving_average_of_long_tables(spark):
    rng = random.Random(1)
    rows = [("q", i, "s", rng.uniform(1, 1000)) for i in range(1500)]
    got = {r.batch_id: r.smoothed for r in J.latencies(spark.createDataFrame(rows, "id string, batch_id long, stage string, ms double")).collect()}
    value = 0.0
    for _, i, _, ms in rows:
        value = 0.9 * value + 0.1 * ms
        assert got[i] == pytest.approx(value)
