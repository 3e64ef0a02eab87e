"""The composed tracker, re-identification, and answers that hang on fixed numbers."""

import random

import numpy as np
import pytest

from touchgrid.operators import evaluation, folds, identity, images, kinematics, roles


def box(x, y=100.0, conf=0.9, **more):
    return {"class_id": 0, "x1": x, "y1": y, "x2": x + 40.0, "y2": y + 90.0, "conf": conf} | more


def test_a_cut_keeps_numbers_by_appearance():
    e = np.eye(4)
    t = identity.MatchTracker()
    for f in range(5):
        out = t.step(f, [box(100 + 2 * f, emb=e[0], team_id=0), box(400 - 2 * f, emb=e[1], team_id=1)])
    first = {round(r["x1"]): r["track_id"] for r in out}
    a, b = first[108], first[392]
    out = t.step(5, [box(700, emb=e[1], team_id=1), box(50, emb=e[0], team_id=0)], is_cut=True)
    assert [r["track_id"] for r in out] == [b, a] and t.reassigned == 2
    out = t.step(6, [box(702, emb=e[1], team_id=1), box(52, emb=e[0], team_id=0)])
    assert [r["track_id"] for r in out] == [b, a]  # and keeps them after the cut frame


@pytest.mark.parametrize("other", [{"team_id": 1, "role_id": 0}, {"team_id": 0, "role_id": 3}])
def test_known_teams_and_roles_never_mix(other):
    e = np.eye(2)
    t = identity.MatchTracker()
    (old,) = t.step(0, [box(100, emb=e[0], team_id=0, role_id=0)])
    (new,) = t.step(1, [box(500, emb=e[0], **other)], is_cut=True)
    assert new["track_id"] != old["track_id"] and t.reassigned == 0


def test_gallery_entries_expire():
    e = np.eye(2)
    t = identity.MatchTracker(age=300)
    (old,) = t.step(0, [box(100, emb=e[0])])
    (new,) = t.step(301, [box(500, emb=e[0])], is_cut=True)
    assert new["track_id"] != old["track_id"]


def test_coasting_and_the_ball():
    t = identity.MatchTracker()
    for f in range(3):
        t.step(f, [box(100 + 10 * f)])
    ball = {"class_id": 32, "x1": 1.0, "y1": 2.0, "x2": 9.0, "y2": 10.0, "conf": 0.3}
    at, v = 120.0, 10.0
    for lost in range(1, 5):
        at += v * 0.85**lost
        out = t.step(2 + lost, [ball])
        assert out[0]["coasted"] and out[0]["conf"] == 0.5 and out[0]["x1"] == pytest.approx(at)
        assert out[1]["track_id"] == -1 and out[1]["x1"] == 1.0
    assert [r["track_id"] for r in t.step(7, [ball])] == [-1]
    assert t.step(8, [], is_cut=True) == [] and not t.last


def test_camera_motion_moves_boxes():
    t = identity.MatchTracker()
    (r,) = t.step(0, [box(100)])
    (moved,) = t.step(1, [], affine=(1, 0, 30, 0, 1, 0))
    assert moved["track_id"] == r["track_id"] and moved["x1"] == pytest.approx(130)
    (back,) = t.step(2, [box(160)], affine=(1, 0, 30, 0, 1, 0))
    assert back["track_id"] == r["track_id"]
    t._warp((1, 0, 20_000, 0, 1, 0))
    assert not t.last  # absurd places are dropped


def test_tracked_table(spark):
    rows = [(0, f, 0, 0, 100.0 + f, 100.0, 140.0 + f, 190.0, 0.9) for f in range(10) if f != 5] + [(0, f, 1, 32, 1.0, 1.0, 5.0, 5.0, 0.5) for f in range(10)]
    df = spark.createDataFrame(rows, "match_id long, frame_idx long, det_idx long, class_id long, x1 double, y1 double, x2 double, y2 double, conf double")
    got = identity.tracked(df).collect()
    assert {r["track_id"] for r in got if r["class_id"] == 0} == {1} and [r["frame_idx"] for r in got if r["coasted"]] == [5]
    cut = spark.createDataFrame([(0, 7)], "match_id long, frame_idx long")
    assert len({r["track_id"] for r in identity.tracked(df, cut).collect() if r["class_id"] == 0}) == 2
    assert identity.tracked(df.limit(0)).count() == 0


def test_gallery_keeps_known_teams_and_costs_know_roles(spark):
    obs = spark.createDataFrame([(0, 1, 0, [1.0, 0.0], 1, 2, None, None), (0, 1, 1, [1.0, 0.0], -1, -1, None, None)], "match_id long, track_id long, frame_idx long, emb array<double>, team_id long, role_id long, x_m double, y_m double")
    track = identity.gallery(obs)
    r = track.first()
    assert (r["team_id"], r["role_id"], r["n"]) == (1, 2, 2)
    cand = spark.createDataFrame([(0, i, [1.0, 0.0], team, role, None, None) for i, (team, role) in enumerate([(1, 2), (-1, 2), (1, -1), (0, 2), (1, 3), (None, None)])], "match_id long, det_idx long, emb array<double>, team_id long, role_id long, x_m double, y_m double")
    cost = {r["det_idx"]: r["cost"] for r in identity.pair_costs(cand, track).collect()}
    assert [cost[i] for i in range(6)] == pytest.approx([0, 0, 0, 99, 99, 0])


def test_long_gaps_are_not_walked_through():
    import pandas as pd

    frames = [f for f, _ in folds.frames_of(pd.DataFrame({"frame_idx": [3, 10_000_000], "det_idx": [0, 0]}))]
    assert frames == [3, *range(4, 50), 10_000_000]


def test_ball_filters_have_their_own_noise():
    state = folds.ball_start()
    assert state["pixel"].r[0, 0] == pytest.approx(0.64) and state["metric"].r[0, 0] == pytest.approx(0.16)
    assert state["pixel"].q[0, 0] / state["metric"].q[0, 0] == pytest.approx(64 / 9)
    assert folds.ball_start(50.0)["metric"].f[0, 2] == pytest.approx(0.02)


def test_edge_change_is_relative_to_both_frames():
    a, b = np.zeros((4, 4), bool), np.zeros((4, 4), bool)
    a[0], b[1] = True, True
    assert images.edge_change(a, b) == 1.0 and images.edge_change(a, a) == 0.0 and images.edge_change(a & b, a & b) == 0.0
    b[0, :2] = True
    assert images.edge_change(a, b) == pytest.approx(6 / 10)


def test_kinematics_metrics_are_of_valid_speeds(spark):
    df = spark.createDataFrame([(0, 10.0), (0, 20.0), (0, 90.0), (1, 50.0)], "match_id long, speed_kmh double")
    got = {r["match_id"]: tuple(r)[1:] for r in evaluation.kinematics_metrics(df).collect()}
    assert got[0] == pytest.approx((200 / 3, 15, 20, 25)) and got[1] == (0, 0, 0, 0)


def test_kit_clusters_are_numbered_by_colour(spark):
    rng = np.random.default_rng(0)
    rows = [(0, t, *(float(x) for x in rng.normal(30 if t % 2 else 200, 5, 3))) for t in range(10) for _ in range(6)]
    got = {r["track_id"]: (r["cluster"], r["votes"], r["n"]) for r in roles.kit_clusters(spark.createDataFrame(rows, "match_id long, track_id long, r double, g double, b double"), starts=3).collect()}
    assert got == {t: (0 if t % 2 else 1, 6, 6) for t in range(10)}


def test_comet(spark):
    df = spark.createDataFrame([(0, i, 10.0 * i if i != 7 else 900.0, 0.0) for i in range(20)], "match_id long, frame_idx long, x double, y double")
    got = {r["frame_idx"]: (r["n_trail"], r["n_drawn"]) for r in kinematics.comet(df, "x", "y").collect()}
    assert got[0] == (1, 0) and got[6] == (7, 6) and got[8] == (9, 6) and got[19] == (14, 11)


def crowd(seed, n=60, most=9):
    """Frames of boxes that often overlap, some of them no box at all."""
    rng = random.Random(seed)
    frames = []
    for f in range(n):
        at = [(rng.uniform(0, 120), rng.uniform(0, 80)) for _ in range(rng.randrange(most))]
        rows = [{"class_id": 0, "x1": x, "y1": y, "x2": x + rng.choice([40.0, 40.0, -5.0]), "y2": y + 60, "conf": rng.choice([0.9, 0.6, 0.3, None])} for x, y in at]
        if rows and f % 11 == 5:
            rows[0]["x1"] = None
        frames.append((f, rows, f % 25 == 24, (1.0, 0.01, rng.uniform(-2, 2), -0.01, 1.0, 0.5)))
    return frames


@pytest.mark.parametrize("seed", range(5))
def test_floats_and_arrays_give_the_same_tracks(seed, monkeypatch):
    def run():
        t = identity.MatchTracker()
        return [repr(t.step(*frame)) for frame in crowd(seed)], identity.marked(t.tracker, t.last)

    plain = run()
    monkeypatch.setattr(identity, "_MANY", -1)
    assert plain == run()


def test_few_boxes_need_no_arrays(monkeypatch):
    monkeypatch.setattr(identity.Tracker, "_iou", staticmethod(lambda a, b: pytest.fail("an array for a few boxes")))
    t = identity.Tracker()
    assert t.frame([(0.0, 0.0, 9.0, 9.0), (50.0, 0.0, 59.0, 9.0)], [0.9, 0.9]) == [1, 2]
    assert t.frame([(51.0, 0.0, 60.0, 9.0), (1.0, 0.0, 10.0, 9.0)], [0.9, 0.9]) == [2, 1]
