import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchgrid import config, schemas
from touchgrid.functions import geometry as G, labels as L
from touchgrid.operators import camera as C, detections as D, evaluation as V, identity as I, roles as R


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_homography_fit_and_round_trip():
    h, err, ok = C.fit_homography([(100, 200), (900, 200), (1100, 800), (0, 800)], [(0, 68), (105, 68), (105, 0), (0, 0)])
    assert ok and err < 0.1
    p = h @ [500, 500, 1]
    q = np.linalg.inv(h) @ (p / p[2])
    assert q[:2] / q[2] == pytest.approx([500, 500], abs=0.01)
    with pytest.raises(ValueError):
        C.fit_homography([(0, 0)], [(0, 0)])


def test_propagated_homography():
    h = C.broadcast_homography()
    moved = C.propagated(h, [1, 0, 30, 0, 1, 10])
    at = lambda m, u, v: (m @ [u, v, 1])[:2] / (m @ [u, v, 1])[2]
    assert at(h, 500, 400) == pytest.approx(at(moved, 530, 410), abs=0.05)


def test_projection_is_arithmetic(spark):
    h = C.broadcast_homography()
    x, y = G.project(960.0, 500.0, h.ravel().tolist())
    assert tuple(one(spark, x, y)) == pytest.approx((52.5, 34.0), abs=1.5)


def test_warp(spark):
    a = (1, 0, 10, 0, 1, -5)
    assert tuple(one(spark, *G.warp(100.0, 200.0, a))) == (110, 195)
    assert tuple(one(spark, *G.warp_box((100.0, 100.0, 150.0, 200.0), a))) == (110, 95, 160, 195)


def test_labels(spark):
    pan, tilt, zoom = G.camera_labels(15.0, 0.0, 1.03)
    assert tuple(one(spark, pan, tilt, zoom)) == ("PAN LEFT", "STATIC", "ZOOM IN")
    assert one(spark, L.clock(F.lit(75.9)))[0] == "01:15"
    assert one(spark, L.aspect_ratio(F.lit(1920), F.lit(1080)))[0] == "16:9"
    assert one(spark, L.safe_filename(F.lit("a b/c.mp4")))[0] == "a_b_c.mp4"


def test_iou(spark):
    assert one(spark, G.iou((0.0, 0.0, 10.0, 10.0), (0.0, 0.0, 10.0, 10.0)))[0] == 1.0
    assert one(spark, G.iou((100.0, 100.0, 200.0, 200.0), (150.0, 100.0, 250.0, 200.0)))[0] == pytest.approx(1 / 3)
    assert one(spark, G.iou((0.0, 0.0, 1.0, 1.0), (5.0, 5.0, 6.0, 6.0)))[0] == 0.0


def test_cuts_are_debounced(spark):
    df = spark.createDataFrame([(0, f, 0.9 if f in (1, 2, 20) else 0.0, 0.9 if f in (1, 2, 20) else 0.0, 0.5) for f in range(25)], "match_id long, frame_idx long, hist_distance double, edge_diff double, flow_inlier double")
    assert [r["frame_idx"] for r in C.cuts(df).filter("is_cut").orderBy("frame_idx").collect()] == [1, 20]


def test_last_known(spark):
    frames = spark.createDataFrame([(0, f) for f in range(6)], "match_id long, frame_idx long")
    facts = spark.createDataFrame([(0, 2, "a"), (0, 4, "b")], "match_id long, frame_idx long, v string")
    got = [r["v"] for r in C.last_known(frames, facts, ["v"]).orderBy("frame_idx").collect()]
    assert got == [None, None, "a", "a", "b", "b"]


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in ((3, 3), (2, 5), (5, 3), (1, 1)):
        c = rng.random((n, m))
        got = sum(c[i, j] for i, j in I.assignment(c))
        small, wide = (c, c.T)[n > m], max(n, m)
        best = min(sum(small[i, p[i]] for i in range(min(n, m))) for p in itertools.permutations(range(wide), min(n, m)))
        assert got == pytest.approx(best)
    assert I.assignment(np.zeros((0, 3))) == []


def test_reid_keeps_teams_apart(spark):
    e = lambda *v: list(map(float, v))
    cand = spark.createDataFrame([(0, 0, e(1, 0), 0, None, None), (0, 1, e(0.9, 0.1), 1, None, None)], "match_id long, det_idx long, emb array<double>, team_id long, x_m double, y_m double")
    tracks = spark.createDataFrame([(0, 10, e(1, 0.05), 0, None, None), (0, 20, e(1, 0), 1, None, None)], "match_id long, track_id long, emb array<double>, team_id long, x_m double, y_m double")
    pairs = I.matched(I.pair_costs(cand, tracks))
    assert {(r["det_idx"], r["track_id"]) for r in pairs.collect()} == {(0, 10), (1, 20)}
    assert I.unmatched(cand, pairs).count() == 0


def test_coasting_and_association():
    t = I.Tracker()
    box = lambda x: np.array([[x, 10.0, x + 20, 50.0], [300 - x, 10, 320 - x, 50]])
    ids = [t.frame(box(10 + 2 * k), np.array([0.9, 0.8])) for k in range(5)]
    assert all(i == ids[0] for i in ids)
    from touchgrid.operators import folds

    state = {}
    rows = [{"track_id": 1, "x1": 0.0, "y1": 0.0, "x2": 10.0, "y2": 20.0, "conf": 0.9}]
    state, _ = folds.coast_frame(state, 0, rows)
    state, _ = folds.coast_frame(state, 1, [rows[0] | {"x1": 2.0, "x2": 12.0}])
    seen = []
    for f in range(2, 8):
        state, out = folds.coast_frame(state, f, [])
        seen.append(len(out))
    assert seen == [1, 1, 1, 1, 0, 0]


def test_roles(spark):
    rows = [(80, 30, 200, 50, None, False), (52, 130, 220, 50, None, False), (80, 30, 50, 15, None, True), (80, 30, 50, 45, None, False), (80, 30, 200, 50, 890, False)]
    df = spark.createDataFrame([(i, *map(float, r[:4]), None if r[4] is None else float(r[4]), r[5]) for i, r in enumerate(rows)], "i int, h double, s double, v double, x double, y2 double, deep boolean")
    from touchgrid.functions.models import kit_role

    got = [r[0] for r in df.orderBy("i").select(kit_role("h", "s", "v", F.col("x"), F.lit(34.0), F.col("y2"), F.col("deep"))).collect()]
    assert got == [0, 1, 3, 2, 5]


def test_vote(spark):
    df = spark.createDataFrame([(0, 1, f, 0, 0 if f < 7 else 1) for f in range(9)], "match_id long, track_id long, frame_idx long, det_idx long, raw_role int")
    assert R.voted_roles(df, 10).orderBy("frame_idx").collect()[-1]["role_id"] == 0


DET = "match_id long, frame_idx long, det_idx long, x1 double, y1 double, x2 double, y2 double, conf double, class_id int, track_id long"


def dets(spark, rows):
    return spark.createDataFrame([(0, 0, i, *map(float, r[:4]), r[4], r[5], -1) for i, r in enumerate(rows)], DET)


def test_dual_threshold_and_crowd_filter(spark):
    d = dets(spark, [(0, 0, 1, 1, 0.15, 0), (0, 0, 1, 1, 0.85, 0), (0, 0, 1, 1, 0.14, 32), (0, 0, 1, 1, 0.08, 32)])
    assert sorted(r["conf"] for r in D.confident(d, 0.18, 0.12).collect()) == [0.14, 0.85]
    d = dets(spark, [(0, 0, 10, 100, 0.9, 0), (0, 0, 10, 450, 0.9, 0), (0, 0, 10, 690, 0.9, 0), (0, 0, 10, 20, 0.9, 32)])
    pitch = spark.createDataFrame([(0, 0, 200, 600, 0.5)], "match_id long, frame_idx long, y_min int, y_max int, area_ratio double")
    assert sorted(r["y2"] for r in D.on_pitch(d, pitch).collect()) == [20, 450]
    low = pitch.withColumn("area_ratio", F.lit(0.1))
    assert D.on_pitch(d, low).count() == 4


def test_clamp(spark):
    r = D.clamped(dets(spark, [(-5, -10, 1300, 750, 0.9, 0)]), 1280, 720).first()
    assert (r["x1"], r["y1"], r["x2"], r["y2"]) == (0, 0, 1279, 719)


def test_detection_metrics(spark):
    p = dets(spark, [(0, 0, 10, 10, 0.9, 0), (20, 20, 30, 30, 0.9, 0), (50, 50, 60, 60, 0.9, 0)])
    t = dets(spark, [(0, 0, 10, 10, 0.9, 0), (21, 20, 31, 30, 0.9, 0), (80, 80, 90, 90, 0.9, 0)])
    r = V.detection_metrics(p, t).first()
    assert (r["tp"], r["fp"], r["fn"]) == (2, 1, 1) and r["precision"] == r["recall"] == pytest.approx(2 / 3)


def test_image_stats(spark):
    px = np.zeros((8, 8, 3), np.uint8)
    px[...] = (40, 160, 60)
    df = spark.createDataFrame(pd.DataFrame([{"match_id": 0, "frame_idx": 0, "image": px.tobytes(), "width": 8, "height": 8}]))
    r = V.image_stats(df).first()
    assert r["blur"] == pytest.approx(0) and r["grass_pct"] == 100.0


def test_config():
    assert config.engine({"detection": {"conf_threshold": 0.4}}).detection.conf_threshold == 0.4
    with pytest.raises(ValueError):
        config.engine({"detection": {"conf_threshold": 1.4}})
    with pytest.raises(ValueError):
        config.validate({"detection": {}})
    config.validate({"detection": {"conf_threshold": 0.3}, "system": {}, "visualization": {}})


def test_keypoints(spark):
    assert schemas.pitch_keypoints(spark).count() == 21
