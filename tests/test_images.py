import numpy as np
import pandas as pd
import pytest

from touchgrid.operators import images as I, roles


def frame(spark, *arrays, **extra):
    rows = [{"match_id": 0, "frame_idx": i, "det_idx": 0, "image": a.tobytes(), "width": a.shape[1], "height": a.shape[0], **extra} for i, a in enumerate(arrays)]
    return spark.createDataFrame(pd.DataFrame(rows))


GREEN, WHITE = np.array([40, 160, 60], np.uint8), np.array([250, 250, 250], np.uint8)


def field(h=60, w=80):
    px = np.full((h, w, 3), 20, np.uint8)
    px[20:50] = GREEN
    return px


def test_turf(spark):
    r = I.turf_bands(frame(spark, field(), np.zeros((30, 30, 3), np.uint8))).orderBy("frame_idx").collect()
    assert (r[0]["y_min"], r[0]["y_max"]) == (20, 50) and r[0]["area_ratio"] == pytest.approx(0.5)
    assert r[1]["y_min"] is None and r[1]["area_ratio"] == 0


def test_largest_component():
    m = np.zeros((20, 20), bool)
    m[2:5, 2:5] = True
    m[8:18, 3] = m[17, 3:15] = m[8, 3:12] = True
    got = I.largest_component(m)
    assert got.sum() == m.sum() - 9 and not got[3, 3] and got[8, 11]
    assert not I.largest_component(np.zeros((3, 3), bool)).any()


def test_equal_frames_have_no_distance(spark):
    rng = np.random.default_rng(0)
    a, b = field(), rng.integers(0, 255, (60, 80, 3)).astype(np.uint8)
    got = [r["hist_distance"] for r in I.neighbour_distances(I.frame_features(frame(spark, a, a, b))).orderBy("frame_idx").collect()]
    assert got[0] == pytest.approx(0, abs=1e-7) and got[1] > 0.5
    assert got[1] == pytest.approx(I.bhattacharyya(I.hue_saturation(a), I.hue_saturation(b)))
    assert I.edge_change(I.edges(a), I.edges(a)) == 0


def test_appearance(spark):
    rng = np.random.default_rng(1)
    a, tiny = rng.integers(0, 255, (60, 30, 3)).astype(np.uint8), np.zeros((5, 5, 3), np.uint8)
    got = [np.array(r["emb"]) for r in I.appearances(frame(spark, a, tiny, frame_height=720)).orderBy("frame_idx").collect()]
    assert len(got[0]) == 128 and np.linalg.norm(got[0]) == pytest.approx(1)
    assert got[1][0] == 1 and got[1].sum() == 1


def test_jersey_and_clusters(spark):
    shirts = [np.full((40, 20, 3), c, np.uint8) for c in (WHITE, np.array([10, 10, 200], np.uint8))]
    for s in shirts:
        s[:, :5] = GREEN
    df = I.jersey_colours(frame(spark, *shirts, *shirts))
    assert df.orderBy("frame_idx").first()["b"] == pytest.approx(250)
    got = roles.kit_clusters(df.withColumn("track_id", df["frame_idx"]))
    c = {r["track_id"]: r["cluster"] for r in got.collect()}
    assert c[0] == c[2] != c[1] == c[3]


def test_enhanced_keeps_shape_and_range(spark):
    a = field()
    r = I.enhanced(frame(spark, a), 1.2).first()
    assert len(r["enhanced"]) == a.size
    assert (I.gamma(a, 1.0) == a).mean() > 0.9


def test_lab_of_known_colours():
    got = I.lab(np.array([[[255, 255, 255], [0, 0, 0]]], np.uint8))
    assert got[0, 0] == pytest.approx([255, 128, 128], abs=1) and got[0, 1] == pytest.approx([0, 128, 128], abs=1)


def test_line_bounds(spark):
    df = spark.createDataFrame([(0, 0, 0, 100, 500, 104), (0, 0, 0, 110, 500, 112), (0, 0, 0, 600, 500, 600), (0, 0, 10, 0, 12, 400), (0, 1, 0, 5, 3, 5)], "match_id long, frame_idx long, x1 int, y1 int, x2 int, y2 int")
    got = {r["frame_idx"]: (r["top_y"], r["bottom_y"]) for r in I.line_bounds(df, 720).collect()}
    assert got[0] == (106.5, 600.0) and got[1] == pytest.approx((144.0, 572.4))
