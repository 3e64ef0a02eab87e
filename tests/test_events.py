import random

import pytest

from touchgrid.operators import events as E, possession as P
from touchgrid import schemas


def poss(spark, rows):
    return spark.createDataFrame([(0, f, h, t, float(x), float(y), float(s)) for f, h, t, x, y, s in rows], schemas.POSSESSION)


N = None
CASES = {
    "pass": ([(0, 10, 0, 40, 30, 2), (1, N, N, 45, 30, 25), (10, 7, 0, 55, 30, 8)], ("PASS", 0, 10, 7, 25.0, 15.0)),
    "interception": ([(0, 10, 0, 40, 30, 1), (1, N, N, 45, 30, 22), (8, 24, 1, 52, 30, 6)], ("INTERCEPTION", 1, 24, 10, 22.0, 12.0)),
    "shot": ([(0, 9, 0, 75, 34, 5), (1, N, N, 82, 34, 55), (6, 1, 1, 96, 34, 12)], ("SHOT", 0, 9, 1, 55.0, 21.0)),
    "tackle": ([(0, 11, 0, 50, 30, 4), (2, 4, 1, 50.2, 30.1, 5)], ("TACKLE", 1, 4, 11, 5.0, 0.0)),
    "dribble": ([(0, 10, 0, 40, 30, 3), (1, N, N, 43, 30, 14), (5, 10, 0, 45, 30, 5)], None),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("form", [E.detect, E.detect_fold])
def test_single_events(spark, name, form):
    rows, want = CASES[name]
    got = form(poss(spark, rows)).collect()
    if want is None:
        assert got == []
        return
    (r,) = got
    assert (r["event_type"], r["team_id"], r["primary_id"], r["secondary_id"]) == want[:4]
    assert (r["speed_kmh"], r["distance_m"]) == pytest.approx(want[4:])


MATCH = [(0, 10, 0, 40, 30, 2), (1, N, N, 45, 30, 20), (5, 7, 0, 55, 30, 5), (10, N, N, 58, 30, 22), (15, 24, 1, 68, 30, 5), (17, 11, 0, 68.2, 30.1, 4), (20, N, N, 75, 34, 48), (25, 1, 1, 92, 34, 5)]


def test_summary(spark):
    ev = E.detect(poss(spark, MATCH))
    assert [r["event_type"] for r in ev.orderBy("event_id").collect()] == ["PASS", "INTERCEPTION", "TACKLE", "SHOT"]
    r = E.summary(ev).first()
    assert (r["passes_a"], r["attempts_a"], r["accuracy_a"], r["tackles_a"], r["shots_a"], r["interceptions_b"], r["turnovers"]) == (1, 2, 50.0, 1, 1, 1, 2)
    assert r["pass_text_a"] == "1/2 (50.0%)" and r["accuracy_b"] == 100.0


def test_texts(spark):
    got = {r["event_type"]: r["description"] for r in E.with_text(E.detect(poss(spark, MATCH))).collect()}
    assert got["PASS"] == "Team A Pass: #10 -> #7 (15.0m)"
    assert got["TACKLE"] == "Team A Tackle: #11 won duel against #24"


def test_active_event_expires(spark):
    p = poss(spark, [(f, 10 if f == 0 else 7 if f >= 5 else N, 0 if f == 0 or f >= 5 else N, 40 + 2 * f, 30, 25) for f in range(0, 16)])
    shown = {r["frame_idx"]: r["event_type"] for r in E.active(p, E.detect(p), duration=10).collect()}
    assert shown[4] is None and shown[10] == "PASS" and shown[14] == "PASS" and shown[15] is None


def test_relational_and_fold_forms_agree(spark):
    rng, rows = random.Random(5), []
    for m in range(6):
        for f in range(300):
            h = None if rng.random() < 0.6 else rng.randrange(22)
            rows.append((m, f, h, None if h is None else h % 3, rng.uniform(0, 105), rng.uniform(0, 68), rng.uniform(0, 60)))
    df = spark.createDataFrame(rows, schemas.POSSESSION)
    cols = ["match_id", "event_id", "event_type", "frame_idx", "team_id", "primary_id", "secondary_id"]
    a, b = (sorted(map(tuple, f(df).select(*cols).collect())) for f in (E.detect, E.detect_fold))
    assert a == b and len(a) > 200


def test_stream_equals_batch(spark, tmp_path):
    from touchgrid.streaming import live

    rng, rows = random.Random(2), []
    for f in range(200):
        h = None if rng.random() < 0.6 else rng.randrange(22)
        rows.append((0, f, h, None if h is None else h % 2, rng.uniform(0, 105), rng.uniform(0, 68), rng.uniform(0, 60)))
    df = spark.createDataFrame(rows, schemas.POSSESSION)
    df.repartitionByRange(5, "frame_idx").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    got = live.drained(live.live_events(stream, lag=500, last_frame=199), "test-events")
    cols = ["event_id", "event_type", "frame_idx", "primary_id", "secondary_id"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, E.detect_fold(df).select(*cols).collect()))


def test_stream_gives_the_events_of_a_match_that_ends_early(spark, tmp_path):
    import datetime

    from touchgrid import catalog

    kinds, rng = ["click", "purchase", "signup"], random.Random(3)
    rows = [(i, datetime.datetime(2024, 1, 1), rng.randrange(40), rng.choice(kinds), rng.random() * 100) for i in range(1500) if i % 3 != 2 or i < 900]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    cols = ["match_id", "event_id", "event_type", "frame_idx", "primary_id", "secondary_id"]
    got, want = (sorted(map(tuple, catalog.queries()[q](spark, str(tmp_path)).select(*cols).collect())) for q in ("stream_events", "match_events"))
    assert got == want and any(r[0] == 2 for r in got)


def test_stream_flushes_only_when_all_rows_are_in(spark, tmp_path):
    from pyspark.sql import functions as F
    from touchgrid.streaming import live

    rng, at = random.Random(4), str(tmp_path / "in")
    rows = [(0, f, rng.choice([None, 1, 2, 12, 13]), rng.randrange(2), rng.random() * 105, rng.random() * 68, rng.random() * 90) for f in range(120)]
    names = "match_id long, frame_idx long, holder_id long, holder_team long, ball_x double, ball_y double, ball_kmh double"
    df = spark.createDataFrame(rows, names)
    counted = df.withColumn("n_rows", F.lit(len(rows)))
    for lo in (80, 40, 0):  # the last frames come first
        counted.filter(f"frame_idx >= {lo} and frame_idx < {lo + 40}").coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(counted.schema).option("maxFilesPerTrigger", 1).parquet(at)
    got = live.drained(live.live_events(stream, lag=10**9, total="n_rows"), "test-late")
    cols = ["event_id", "event_type", "frame_idx", "primary_id", "secondary_id"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, E.detect_fold(df).select(*cols).collect()))


# --- possession ---

POS = "match_id long, frame_idx long, det_idx long, track_id long, team_id long, x_m double, y_m double"
BALL = "match_id long, frame_idx long, x_m double, y_m double"


def play(spark, players, balls):
    pos = spark.createDataFrame([(0, f, i, t, g, x, y) for f in range(len(balls)) for i, (t, g, x, y) in enumerate(players)], POS)
    ball = spark.createDataFrame([(0, f, x, y) for f, (x, y) in enumerate(balls)], BALL)
    return P.candidates(ball, pos)


def test_take_over_counts_a_turnover(spark):
    c = play(spark, [(10, 0, 50.0, 30.0), (19, 1, 65.0, 40.0), (5, 0, 20.0, 15.0)], [(50.5, 30.2), (64.8, 39.9)])
    got = P.assign(c).orderBy("frame_idx").collect()
    assert [(r["holder_id"], r["holder_team"]) for r in got] == [(10, 0), (19, 1)] and got[-1]["turnovers"] == 1


def test_contested(spark):
    c = play(spark, [(7, 0, 49.5, 30.0), (14, 1, 50.6, 30.0)], [(50.0, 30.0)])
    assert c.first()["contested"]


def test_a_ball_without_players(spark):
    c = play(spark, [], [(50.0, 30.0)])
    r = c.first()
    assert r["candidate"] is None and r["dist_m"] == 999.0 and not r["contested"]


def test_shares_add_up(spark):
    c = play(spark, [(10, 0, 50.0, 30.0), (19, 1, 65.0, 40.0)], [(50.5, 30.2), (50.2, 30.0), (64.8, 39.9), (64.9, 40.0)])
    r = P.summary(P.assign(c)).first()
    assert r["a_pct"] + r["b_pct"] == pytest.approx(100.0) and r["top_carrier"] == 10


def test_ball_gap_is_filled_then_lost(spark):
    rows = [(0, f, x, 100.0, None, None, 18.0, 18.0, 0.9) for f, x in enumerate((200.0, 220.0, 240.0))]
    rows += [(0, f, None, None, None, None, None, None, None) for f in range(3, 10)]
    df = spark.createDataFrame(rows, "match_id long, frame_idx long, cx double, cy double, mx double, my double, w double, h double, conf double")
    got = P.ball_states(df).orderBy("frame_idx").collect()
    assert all(r["interpolated"] and r["cx"] > 230 for r in got[3:9]) and got[9]["cx"] is None


def test_ball_outlier_is_predicted_over(spark):
    rows = [(0, 0, 500.0, 500.0, None, None, 18.0, 18.0, 0.9), (0, 1, 1500.0, 1500.0, None, None, 18.0, 18.0, 0.9)]
    df = spark.createDataFrame(rows, "match_id long, frame_idx long, cx double, cy double, mx double, my double, w double, h double, conf double")
    got = P.ball_states(df).orderBy("frame_idx").collect()
    assert got[1]["interpolated"] and abs(got[1]["cx"] - 500) < 50


def test_kalman():
    from touchgrid.operators.folds import Kalman

    k = Kalman(dt=0.04)
    k.start(100, 200, 50, 0)
    assert k.predict()[0] > 100
    x, y = k.update(103, 201)
    assert abs(x - 103) < 2 and abs(y - 201) < 2


def test_stretches_of_a_match_find_the_events_of_the_whole(spark):
    """A task has the rows of some frames, wherever holders and loose balls fall; before, it had a match's."""
    rng = random.Random(8)
    rows = []
    for m in (1, 2):
        for f in range(400):
            who = None if 120 < f < 190 or rng.random() < 0.5 else rng.randrange(8)
            rows.append((m, f, who, None if who is None else who % 2, rng.uniform(0, 105), rng.uniform(0, 68), rng.uniform(0, 60)))
    df = spark.createDataFrame(rows, "match_id long, frame_idx long, holder_id long, holder_team long, ball_x double, ball_y double, ball_kmh double").repartition(5)
    want = sorted(map(str, E.detect_fold(df).select("match_id", "event_id", "event_type", "frame_idx", "primary_id", "speed_kmh").collect()))
    for part in (1, 7, 64, 1000):
        got = E.detect(df, part=part)
        assert sorted(map(str, got.select("match_id", "event_id", "event_type", "frame_idx", "primary_id", "speed_kmh").collect())) == want
    assert len(want) > 50
