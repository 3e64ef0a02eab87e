import numpy as np
import pytest

from touchgrid.operators import folds, kinematics as K

POS = "match_id long, track_id long, frame_idx long, x_m double, y_m double"


def track(spark, rows):
    return spark.createDataFrame([(0, t, f, float(x), float(y)) for t, f, x, y in rows], POS)


def test_constant_velocity(spark):
    df = track(spark, [(10, f, 20 + 0.2 * f, 34) for f in range(25)])
    last = K.player_metrics(df, window=15, least=6).orderBy("frame_idx").collect()[-1]
    assert last["speed_kmh"] == pytest.approx(18.0, rel=0.05)
    assert last["activity"] == "Running"


def test_distance(spark):
    df = track(spark, [(7, f, 10 + 0.2 * f, 20) for f in range(250)])
    assert K.distances(df).first()["distance_m"] == pytest.approx(49.8, rel=0.05)


def test_teleport_is_no_distance(spark):
    df = track(spark, [(9, 0, 20.0, 34), (9, 1, 20.2, 34), (9, 2, 80.0, 34)])
    got = [r["distance_m"] for r in K.steps(df).orderBy("frame_idx").collect()]
    assert got == pytest.approx([0.0, 0.2, 0.2])


def test_points_off_the_pitch_do_not_count(spark):
    df = track(spark, [(1, 0, 20, 30), (1, 1, 120, 30), (1, 2, 20.2, 30), (-1, 3, 20, 30)])
    assert K.steps(df).count() == 2


def test_squad_summary(spark):
    df = track(spark, [(t, f, 20 + 0.2 * f, 10 * t) for t in (1, 2) for f in range(30)])
    row = K.squad_summary(K.player_metrics(df), K.distances(df)).first()
    assert row["n_tracks"] == 2 and row["max_speed_kmh"] == pytest.approx(18.0, abs=0.2) and row["total_distance_km"] == pytest.approx(0.012, abs=0.001)


def test_windowed_regression_equals_a_plain_loop():
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.integers(1, 3, 120)) / 25.0
    x, y = np.cumsum(rng.normal(0, 0.2, 120)), np.cumsum(rng.normal(0, 0.2, 120))
    x[::17] += 30
    got = K.regression_speed(t, x, y)
    for i in range(120):
        lo = max(0, i - 17)
        a, b, c = t[lo : i + 1], x[lo : i + 1], y[lo : i + 1]
        if len(a) < 4:
            assert got[i] == 0
            continue
        z = a - a.mean()
        den = (z**2).sum()
        vx, vy = (z * (b - b.mean())).sum() / den, (z * (c - c.mean())).sum() / den
        rest = np.hypot(b - vx * z - b.mean(), c - vy * z - c.mean())
        ok = rest <= max(1.5, 3 * np.median(rest))
        if ok.sum() >= 4 and (z[ok] ** 2).sum() > 1e-6:
            den = (z[ok] ** 2).sum()
            vx, vy = (z[ok] * (b[ok] - b[ok].mean())).sum() / den, (z[ok] * (c[ok] - c[ok].mean())).sum() / den
        assert got[i] == pytest.approx(np.hypot(vx, vy), abs=1e-9)


def test_distance_never_falls(spark):
    df = track(spark, [(1, f, 20 + np.sin(f / 5), 30 + np.cos(f / 3)) for f in range(60)])
    got = [r["distance_m"] for r in K.steps(df).orderBy("frame_idx").collect()]
    assert got == sorted(got)


def test_smoothing_feeds_its_rounding_back():
    state, seen = 0.0, []
    for v in (18.0, 18.0, 18.0):
        state, out = folds.smooth_speed(state, {"frame_idx": 0, "speed_kmh": v})
        seen.append(out["smoothed_kmh"])
    assert seen == [4.5, 7.9, 10.4]


def test_empty(spark):
    df = track(spark, [])
    assert K.distances(df).count() == 0 and K.player_metrics(df).count() == 0
