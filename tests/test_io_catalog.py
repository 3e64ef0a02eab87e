import json

import duckdb
import pytest
from pyspark.sql import functions as F

from touchgrid import catalog
from touchgrid.operators import kinematics, space, summary
from touchgrid.sources import readers, writers

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_synthetic_match_end_to_end(spark, tmp_path):
    pos = readers.synthetic_match(spark, 40)
    assert pos.count() == 800
    boxes = pos.select("match_id", "frame_idx", "det_idx", F.lit(0).alias("class_id"), *(F.lit(float(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))))
    rows = summary.processed_rows(pos, boxes, kinematics.player_metrics(pos), space.control(pos))
    writers.processed_tsv(rows, str(tmp_path / "t"))
    back = writers.read_processed_tsv(spark, str(tmp_path / "t"))
    r = back.orderBy("frame_id").collect()[-1]
    assert back.count() == 40 and len(r["player_roles"]) == 20 and len(r["player_speeds"]) == 20 and len(r["bounding_boxes"][0]) == 4
    assert r["team_a_space_control_pct"] + r["team_b_space_control_pct"] == pytest.approx(100, abs=0.1)


def test_annotations_and_labels(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"image": "i.jpg", "dimensions": {"width": 10, "height": 10}, "categories": [{"id": 1, "name": "player"}], "annotations": [{"id": 5, "category_id": 1, "bbox": [1, 2, 3, 4]}]}, indent=1))
    r = readers.annotations(spark, str(tmp_path / "a.json")).first()
    assert (r["category"], r["x2"], r["y2"]) == ("player", 4.0, 6.0)
    (tmp_path / "l.txt").write_text("0 0.5 0.5 0.2 0.4\n\n")
    r = readers.yolo_labels(spark, str(tmp_path / "l.txt"), 100, 50).collect()
    assert len(r) == 1 and (r[0]["x1"], r[0]["y2"]) == pytest.approx((40.0, 35.0))


def test_latest_sink(spark, tmp_path):
    write = writers.upsert_latest(str(tmp_path / "p"))
    for b in (0, 1):
        write(spark.createDataFrame([(0, 10 * b + i, b) for i in range(3)], "match_id long, frame_idx long, v int"), b)
    assert writers.read_latest(spark, str(tmp_path / "p")).first()["frame_idx"] == 12


def test_entry_has_a_query_for_each_statement():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def _rows(cols, rows):
    def norm(v):
        v = v.item() if hasattr(v, "item") else v
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return v
        return None if v != v else round(float(v), 5) + 0.0

    return sorted((tuple(norm(x) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", ["player_kinematics", "match_events", "shot_xg", "pass_values", "space_control", "voted_roles", "camera_cuts", "regression_speed", "network_summaries", "stream_windows"])
def test_queries_agree_with_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [[r[names.index(c)] for c in cols] for r in cur.fetchall()]
    assert _rows(cols, ([r[c] for c in cols] for r in df.collect())) == _rows(cols, want)
