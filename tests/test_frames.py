import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchgrid.operators import frame_folds as FF, folds
from touchgrid.streaming import frames as S


def box(x, y=0.0, w=10.0, h=20.0):
    return {"x1": x, "y1": y, "x2": x + w, "y2": y + h, "conf": 0.9}


def run(fold, rows, until=None, piece=None, rng=None):
    """All frames at once, or in pieces with the state written out and read again between them."""
    rows, state, out = sorted(rows, key=FF.row_order), None, []
    last = until if until is not None else max(r["frame_idx"] for r in rows)
    clocks = [math.inf] if piece is None else [*range(piece, last, piece), math.inf]
    for clock in clocks:
        due = [r for r in rows if r["frame_idx"] <= clock]
        rows = rows[len(due) :]
        state, made, _ = FF.advance(fold, state, due, clock, last)
        out += made
        if state is not None:
            state = fold.load(tuple(fold.dump(state)))
    return out


def sights(seed, n=400):
    rng = random.Random(seed)
    frames, f = [], 0
    while f < n:
        frames.append(f)
        f += rng.choice([1, 1, 1, 2, 3, 5, 6, 44, 45, 46, 47, 60])
    return [{"frame_idx": f, "det_idx": 0, **box(f * 2.0 + rng.random())} for f in frames]


@pytest.mark.parametrize("seed", range(6))
def test_one_track_coasts_as_a_match_does(seed):
    rows, until = sights(seed), 420
    state, want = {}, []
    for f in range(until + 1):
        state, made = folds.coast_frame(state, f, [r | {"track_id": 1} for r in rows if r["frame_idx"] == f])
        want += [{k: v for k, v in m.items() if k != "track_id"} for m in made]
    for piece in (None, 7):
        got = run(FF.Coast(), rows, until, piece)
        assert [(g["frame_idx"], g["coasted"]) for g in got] == [(w["frame_idx"], w["coasted"]) for w in want]
        assert np.allclose([[g[c] for c in ("x1", "y1", "x2", "y2")] for g in got], [[w[c] for c in ("x1", "y1", "x2", "y2")] for w in want])


def test_what_is_lost_or_over_leaves_the_state():
    fold = FF.Coast()
    state, _, due = FF.advance(fold, None, [{"frame_idx": 3, "det_idx": 0, **box(1.0)}], 3, 1000)
    assert due == 4
    state, made, due = FF.advance(fold, state, [], 20, 1000)
    assert (len(made), due) == (4, 49)
    assert FF.advance(fold, state, [], 49, 1000)[0] is None
    assert FF.advance(fold, state, [], 30, 30) == (None, [], None)


def test_gallery_entries_expire_and_start_anew():
    rows = [{"frame_idx": f, "det_idx": 0, "emb": [3.0, float(f % 2)], "team_id": -1 if f else 1, "role_id": None, "x_m": None, "y_m": None} for f in (0, 1, 300, 601, 905)]
    out = run(FF.Gallery(), rows, 1300)
    assert [(o["frame_idx"], o["n"], o["live"]) for o in out] == [(0, 1, True), (1, 2, True), (300, 3, True), (601, 3, False), (601, 1, True), (902, 1, False), (905, 1, True), (1206, 1, False)]
    assert [o["team_id"] for o in out][:3] == [1, 1, 1] and out[4]["team_id"] is None
    v = 0.85 * np.array([1.0, 0.0]) + 0.15 * np.array([3.0, 1.0])
    assert np.allclose(out[1]["emb"], v / np.linalg.norm(v))


def keyframe_rows(seed, n=90, every=3):
    rng = random.Random(seed)
    rows = []
    for f in range(n):
        affine = [1 + rng.uniform(-0.01, 0.01), rng.uniform(-0.01, 0.01), rng.uniform(-3, 3), rng.uniform(-0.01, 0.01), 1.0, rng.uniform(-3, 3)]
        found = [t for t in range(4) if f % every == 0 and rng.random() < 0.6]
        rows += [{"frame_idx": f, "det_idx": None, "track_id": t, **box(100.0 * t + f), "affine": affine} for t in found] or [{"frame_idx": f, "det_idx": None, "track_id": None, "x1": None, "affine": affine}]
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_carried_boxes_against_a_plain_loop(seed):
    rows, want, held = keyframe_rows(seed), {}, {}
    for f in range(90):
        here = [r for r in rows if r["frame_idx"] == f]
        m, c = np.array(here[0]["affine"]).reshape(2, 3)[:, :2], np.array(here[0]["affine"]).reshape(2, 3)[:, 2]
        for h in held.values():
            x1, y1, x2, y2 = h["box"]
            corners = np.array([[x1, y1], [x2, y1], [x2, y2], [x1, y2]]) @ m.T + c
            h["box"] = np.concatenate([corners.min(0), corners.max(0)])
        held = {t: h for t, h in held.items() if np.abs(h["box"]).max() <= 10_000}
        for r in here:
            if r["x1"] is not None:
                b, old = np.array([r["x1"], r["y1"], r["x2"], r["y2"]]), held.get(r["track_id"])
                v = np.zeros(2) if old is None else (b[:2] + b[2:]) / 2 - (old["box"][:2] + old["box"][2:]) / 2
                held[r["track_id"]] = {"box": b, "v": v, "lost": -1 if f % 3 == 0 else 0, "conf": 0.9}
                want[f, r["track_id"]] = (b, 0.9)
        for t, h in list(held.items()):
            if f % 3 == 0:
                h["lost"] += 1
            if (f, t) in want or h["lost"] > 4:
                continue
            shift = h["v"] * (0.85 ** h["lost"] if f % 3 == 0 else 0.9)
            h["box"] = h["box"] + np.concatenate([shift, shift])
            if f % 3 and np.abs(h["box"]).max() > 10_000:
                del held[t]
                continue
            want[f, t] = (h["box"], 0.5 if f % 3 == 0 else 0.9 * 0.98)
    for piece in (None, 5):
        got = {(g["frame_idx"], g["track_id"]): g for g in run(FF.Carry(3), rows, piece=piece)}
        assert got.keys() == want.keys()
        for k, (b, conf) in want.items():
            assert np.allclose([got[k][c] for c in ("x1", "y1", "x2", "y2")], b) and got[k]["conf"] == pytest.approx(conf)


def test_a_box_out_of_all_bounds_is_gone_until_found_again():
    far = [1.0, 0.0, 20_000.0, 0.0, 1.0, 0.0]
    rows = [{"frame_idx": 0, "det_idx": None, "track_id": 1, **box(5.0), "affine": None}, {"frame_idx": 1, "det_idx": None, "track_id": None, "x1": None, "affine": far}, {"frame_idx": 2, "det_idx": None, "track_id": None, "x1": None, "affine": None}]
    rows.append({"frame_idx": 3, "det_idx": None, "track_id": 1, **box(50.0), "affine": None})
    assert [(g["frame_idx"], g["x1"]) for g in run(FF.Carry(3), rows)] == [(0, 5.0), (3, 50.0)]


def scene(cuts=(10, 20), n=30):
    """Four persons and a ball; each cut moves everybody, a person keeps its appearance."""
    rows = []
    for f in range(n):
        jump = 700.0 * sum(f >= c for c in cuts)
        if f in cuts:
            rows.append({"frame_idx": f, "det_idx": None, "x1": None, "emb": None, "affine": None, "cut": True})
        for p in range(4):
            order = (p + sum(f >= c for c in cuts)) % 4  # others come first after a cut
            emb = [0.0] * 8
            emb[p] = 1.0
            rows.append({"frame_idx": f, "det_idx": order, "class_id": 0, **box(150.0 * p + f + jump), "emb": emb, "team_id": p % 2, "role_id": None, "affine": None, "cut": None})
        rows.append({"frame_idx": f, "det_idx": 9, "class_id": 32, **box(150.0 * 2 + f + jump, w=4.0, h=4.0), "emb": None, "affine": None, "cut": None})
    return rows


def test_a_cut_resets_the_motion_and_keeps_the_rest():
    whole = run(FF.Tracking(), scene())
    assert {m["track_id"] for m in whole} == {-1, 1, 2, 3, 4}
    assert max(m["reassigned"] for m in whole) == 8
    last = {m["track_id"]: m for m in whole if m["frame_idx"] == 29}
    assert {t: m["x1"] for t, m in last.items() if t > 0} == {p + 1: 150.0 * p + 29 + 1400 for p in range(4)}
    assert {m["holder_id"] for m in whole if m["frame_idx"] > 1} == {3}
    # the way to a place after a cut is no way, what was walked before stays
    assert last[1]["walked_px"] > 25 and last[1]["walked_px"] < 1500
    assert run(FF.Tracking(), scene(), piece=1) == whole and run(FF.Tracking(), scene(), piece=4) == whole


def feed(spark, rows, tmp_path, parts, lag=3):
    """A stream of rows with event time, in ``parts`` files; a row of no match lets the watermark pass the last."""
    schema = "match_id long, track_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double, conf double, last_frame long"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    files = [*parts, [{"match_id": -1, "track_id": -1, "frame_idx": max(r["frame_idx"] for r in rows) + 2 * lag + 1, "last_frame": -1}]]
    for part in files:
        spark.createDataFrame([tuple(r.get(n) for n in names) for r in part], schema).withColumn("ts", S.frame_time()).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return stream.withWatermark("ts", f"{lag * S.FRAME_MS} milliseconds")


def drain(out, tmp_path):
    got = []
    q = out.writeStream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).foreachBatch(lambda b, _: got.extend(b.collect())).start()
    q.awaitTermination()
    return got, q.recentProgress


def test_stream_of_tracks_orders_rows_counts_late_ones_and_forgets_the_lost(spark, tmp_path):
    rng = random.Random(5)
    rows = [{"match_id": 1, "track_id": t, "frame_idx": f, **box(10.0 * t + f), "last_frame": 160} for t in range(6) for f in range(160 if t < 2 else 40) if (f + t) % 7]
    by_frame = sorted(rows, key=lambda r: r["frame_idx"] + rng.choice([0, 0, 1, 2]))  # late by two frames at most
    cuts = [len(by_frame) * i // 4 for i in range(5)]
    parts = [by_frame[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    late = rows[3] | {"x1": 9999.0}
    got, progress = drain(S.live_coasted(feed(spark, rows, tmp_path, [*parts, [late]])), tmp_path)
    want = FF.coasted(spark.createDataFrame([tuple(r[c] for c in ("match_id", "track_id", "frame_idx", "x1", "y1", "x2", "y2", "conf")) for r in rows], "match_id long, track_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double, conf double")).collect()
    key = lambda r: (r.track_id, r.frame_idx, round(r.x1, 6), r.coasted)
    last = max(r["frame_idx"] for r in rows)
    assert sorted(key(r) for r in got if r.frame_idx <= last) == sorted(map(key, want))
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in progress) == 1
    held = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "check"))
    assert {r.key.track_id for r in held.collect()} <= {0, 1}  # four tracks were lost 45 frames ago
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "check"))
    assert {r.key.match_id for r in waiting.collect()} <= {-1}


def test_a_key_without_a_value_is_left_out(spark, tmp_path):
    rows = [{"match_id": 1, "track_id": t, "frame_idx": f, **box(1.0), "last_frame": 3} for f in range(4) for t in (1, None)]
    got, _ = drain(S.live_coasted(feed(spark, rows, tmp_path, [rows])), tmp_path)
    assert sorted((r.track_id, r.frame_idx) for r in got) == [(1, f) for f in range(4)]


def test_batch_and_streams_give_the_same_scenes(spark, sf):
    from touchgrid.plans.catalog_queries import QUERIES

    batch = sorted(map(str, QUERIES["scene_tracks"](spark, sf).collect()))
    assert batch and batch == sorted(map(str, QUERIES["stream_scenes"](spark, sf).collect()))


def test_carried_batch_by_track_equals_a_match_at_once(spark):
    rows = [r for r in keyframe_rows(11) if True]
    kf = [(1, r["track_id"], r["frame_idx"], r["x1"], r["y1"], r["x2"], r["y2"], r["conf"]) for r in rows if r["x1"] is not None]
    motion = sorted({(1, r["frame_idx"], tuple(r["affine"])) for r in rows})
    got = FF.carried(spark.createDataFrame(kf, "match_id long, track_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double, conf double"), spark.createDataFrame([(m, f, list(a)) for m, f, a in motion], "match_id long, frame_idx long, affine array<double>"))
    key = lambda r: (r["frame_idx"], r["track_id"], round(r["x1"], 6), r["kind"])
    assert sorted(map(key, got.collect())) == sorted(map(key, run(FF.Carry(3), rows)))
    assert got.where(F.col("frame_idx") % 3 != 0).count() > 100


def test_long_losses_and_holes_in_the_camera_rows_equal_a_match_at_once(spark, monkeypatch):
    monkeypatch.setattr(FF, "BLOCK", 16)
    rng = random.Random(5)
    seen = {t: set() for t in range(4)}
    for t in seen:
        f = 0
        while f < 1500:
            seen[t].add(f)
            f += 3 * rng.choice([1, 1, 2, 4, 5, 6, 44, 45, 46, 47, 48, 60])
    rows = []
    for f in range(1500):
        if rng.random() < 0.15 or 600 <= f < 640:
            continue  # no camera row; a keyframe may be among them
        here = [t for t in seen if f in seen[t]]
        affine = [1.0, rng.uniform(-0.01, 0.01), rng.uniform(-3, 3), rng.uniform(-0.01, 0.01), 1.0, rng.uniform(-3, 3)] if rng.random() < 0.9 else None
        rows += [{"frame_idx": f, "det_idx": None, "track_id": t, **box(100.0 * t + f % 90), "affine": affine} for t in here] or [{"frame_idx": f, "det_idx": None, "track_id": None, "x1": None, "affine": affine}]
    kf = [(1, t, f, *box(100.0 * t + f % 90).values()) for t in seen for f in sorted(seen[t])] + [(1, None, 0, 1.0, 1.0, 2.0, 2.0, 0.9)]
    motion = {r["frame_idx"]: r["affine"] for r in rows}
    got = FF.carried(spark.createDataFrame(kf, "match_id long, track_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double, conf double"), spark.createDataFrame([(1, f, a) for f, a in motion.items()], "match_id long, frame_idx long, affine array<double>")).collect()
    key = lambda r: tuple(r[c] for c in ("frame_idx", "track_id", "x1", "y1", "x2", "y2", "conf", "kind"))
    assert sorted(map(key, got)) == sorted(map(key, run(FF.Carry(3), rows)))


