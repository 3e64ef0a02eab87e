"""Small functions at the edges: readers, sinks, texts and crops."""

import json

import numpy as np
import pytest

from touchgrid.functions import models
from touchgrid.operators import evaluation
from touchgrid.schemas import role_dim
from touchgrid.sources import readers, writers


def test_match_properties_fall_back_to_25_frames_a_second(spark):
    raw = spark.createDataFrame([("a", 50.0, 100), ("b", 0.0, 100), ("c", None, 50)], "match_id string, fps double, frame_count int")
    got = {r["match_id"]: (r["fps"], r["duration_s"]) for r in readers.match_properties(raw).collect()}
    assert got == {"a": (50.0, 2.0), "b": (25.0, 4.0), "c": (25.0, 2.0)}


def test_frame_files_are_numbered_by_name(spark, tmp_path):
    for i in (3, 12):
        (tmp_path / f"match2_frame_{i:04d}.jpg").write_bytes(bytes([i] * i))
    got = {r["frame_idx"]: (r["length"], bytes(r["image"])) for r in readers.frame_files(spark, str(tmp_path)).collect()}
    assert got == {3: (3, b"\x03" * 3), 12: (12, b"\x0c" * 12)}


def test_detect_runs_the_model_where_the_frames_are(spark):
    frames = spark.createDataFrame([(0, i) for i in range(5)], "match_id long, frame_idx long")

    def model(batches):
        for pdf in batches:
            yield pdf.assign(det_idx=0, conf=0.5)

    got = readers.detect(frames, model, "match_id long, frame_idx long, det_idx long, conf double").collect()
    assert sorted((r["frame_idx"], r["conf"]) for r in got) == [(i, 0.5) for i in range(5)]


def test_synthetic_ball_stays_on_the_pitch(spark):
    rows = readers.synthetic_ball(spark, 750).orderBy("frame_idx").collect()
    assert len(rows) == 750 and all(0 <= r["x_m"] <= 105 and 0 <= r["y_m"] <= 68 for r in rows)
    assert max(np.hypot(b["x_m"] - a["x_m"], b["y_m"] - a["y_m"]) * 25 * 3.6 for a, b in zip(rows, rows[1:], strict=False)) == pytest.approx(rows[0]["ball_kmh"])


def test_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, [1.5])], "a long, b string, c array<double>")
    assert json.loads(writers.json_text(df).first()["json"]) == {"a": 1, "b": None, "c": [1.5]}
    writers.json_rows(df, str(tmp_path / "j"))
    assert [r["c"] for r in spark.read.json(str(tmp_path / "j")).collect()] == [[1.5]]


def test_report_text(spark, tmp_path):
    rep = spark.createDataFrame([(7, 0.123456, None)], "match_id long, f1 double, mota double")
    text = evaluation.report_markdown(rep)
    assert text.first()["markdown"].split("\n") == ["# Match 7", "| metric | value |", "|---|---|", "| f1 | 0.1235 |", "| mota | - |"]
    writers.markdown(text, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()[0] == "# Match 7"


def test_clamped_speed_and_roles(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.9, 2.0, 38.0, 50.0, None)], "v double").select(models.clamped_speed("v").alias("s"))
    assert [r["s"] for r in df.collect()] == [0.0, 0.0, 2.0, 38.0, 38.0, None]
    roles = {r["role_id"]: r["side"] for r in role_dim(spark).collect()}
    assert roles[0] == roles[3] == 0 and roles[1] == roles[4] == 1 and roles[2] is None


def test_torso_colour_leaves_head_and_legs_out(spark):
    px = np.zeros((40, 20, 3), np.uint8)
    px[6:20] = (0, 0, 200)  # a red shirt, BGR
    px[20:] = (200, 0, 0)
    crops = spark.createDataFrame([(0, 0, 0, px.tobytes(), 20, 40)], "match_id long, frame_idx long, det_idx long, image binary, width int, height int")
    got = evaluation.torso_hsv(crops).first()
    assert (got["hue"], got["sat"], got["val"]) == (0.0, 255.0, 200.0)


@pytest.mark.parametrize("name", ["stream_possession", "stream_sessions", "stream_roles", "stream_trails"])
def test_streams_equal_their_sql(spark, sf, name):
    import duckdb

    import __spark_entry__ as entry

    got = entry.queries()[name](spark, sf)  # roles have the SQL of the batch query
    names = sorted(got.columns)
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "customer", "nation", "supplier", "part", "region"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    order = [d[0] for d in con.description]
    assert sorted(order) == names
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=key) == sorted((tuple(r[order.index(c)] for c in names) for r in want), key=key)
