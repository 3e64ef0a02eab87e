import numpy as np
import pyarrow as pa
import pytest

from touchgrid.operators import inference
from touchgrid.sources import frame_source as S
from touchgrid.streaming import live


def film(spark, matches=(1, 2), frames=range(0, 120, 2), width=4, height=3):
    rows = [(m, f, width, height, bytes([(m * 7 + f + k) % 256 for k in range(width * height)])) for m in matches for f in frames]
    return rows, spark.createDataFrame(rows, S.SCHEMA).repartition(3)


@pytest.fixture
def folder(spark, tmp_path):
    rows, df = film(spark)
    made = S.write_frames(df, str(tmp_path / "film"), per_segment=50).collect()
    assert sum(r.n for r in made) == len(rows) and sorted(r.name for r in made) == S.segments(str(tmp_path / "film"))
    return str(tmp_path / "film"), rows


def key(rows):
    return sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in rows)


def test_batch_and_stream_read_the_same_frames(spark, folder):
    at, rows = folder
    assert key(S.frames(spark, at, framesPerPartition=7).collect()) == key(rows)
    assert key(live.drained(S.frame_stream(spark, at, framesPerPartition=7), "film").drop("batch").collect()) == key(rows)


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    at = str(tmp_path / "film")
    _, first = film(spark, frames=range(0, 40))
    _, later = film(spark, frames=range(50, 70))
    got = []
    for part in (first, later, later.limit(0)):
        S.write_frames(part, at, per_segment=10).collect()
        n = len(got)
        q = S.frame_stream(spark, at).writeStream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).foreachBatch(lambda b, _: got.extend(b.collect())).start()
        q.awaitTermination()
        assert len(got) - n == part.count()
    assert key(got) == key([*first.collect(), *later.collect()])


def planned(at, **bounds):
    reader = S.FrameReader({"path": at, "framesPerPartition": "10"})
    for k, v in bounds.items():
        setattr(reader.bounds, k, v)
    return [(p.name[:15], p.start, p.stop) for p in reader.partitions()]


def test_filters_reach_the_planner(spark, folder):
    at, rows = folder
    S.register(spark)
    some = S.frames(spark, at).where("frame_idx >= 30 and frame_idx < 64 and match_id = 2")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan frames" in plan and "Filter (" not in plan  # nothing is left to filter
    assert key(some.collect()) == key([r for r in rows if r[0] == 2 and 30 <= r[1] < 64])
    assert key(S.frames(spark, at).where("frame_idx in (8, 10, 90)").collect()) == key([r for r in rows if r[1] in (8, 10, 90)])
    assert key(S.frames(spark, at).where("frame_idx = 8 and width > 3").collect()) == key([r for r in rows if r[1] == 8])
    whole = planned(at)
    assert len(whole) == 2 * (3 + 3 + 1)
    assert planned(at, low=30, high=63, matches={2}) == [("0" * 15, 15, 25), ("0" * 13 + "50", 0, 7)]
    assert planned(at, matches=set()) == []


def test_planning_reads_no_images(folder, monkeypatch):
    at, _ = folder
    read = []
    fs, root = S._fs(at)

    class Counting:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            read.append(n)
            return self.f.read(n)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

    class Watched:
        def get_file_info(self, x):
            return fs.get_file_info(x)

        def open_input_file(self, path):
            return Counting(fs.open_input_file(path))

    monkeypatch.setattr(S, "_fs", lambda uri: (Watched(), root))
    S.FrameReader({"path": at}).partitions()
    assert sum(read) == 6 * S._HEAD_SIZE + 120 * S._ENTRY_SIZE  # the headers and indexes of six segments


def test_odd_frames(spark, tmp_path):
    rows = [(1, 5, 2, 2, b"abcd"), (1, 5, 2, 2, b"efgh"), (1, 6, 2, 2, None), (None, 1, 2, 2, b"none"), (2, -1, 2, 2, b"neg")]
    at = str(tmp_path / "film")
    S.write_frames(spark.createDataFrame(rows, S.SCHEMA), at).collect()
    assert sorted((r.match_id, r.frame_idx, bytes(r.image)) for r in S.frames(spark, at).collect()) == [(1, 5, b"abcd"), (1, 5, b"efgh"), (1, 6, b"")]
    assert S.frames(spark, str(tmp_path / "nothing")).count() == 0
    (tmp_path / "film" / "000000000000000-1-x.frames").write_bytes(b"????" + bytes(40))
    with pytest.raises(Exception, match="no segment"):
        S.frames(spark, at).count()


def test_batches_of_any_size_find_the_same_boxes(spark):
    rng = np.random.default_rng(3)
    rows = [(1, f, 6, 5, (rng.random(30) < 0.2).astype(np.uint8).tobytes().replace(b"\x01", b"\xff")) for f in range(3, 100)]
    frames = spark.createDataFrame([*rows, (1, 500, 6, 5, b"short")], S.SCHEMA).repartition(4)
    want = sorted((f, float(x), float(y)) for _, f, _, _, image in rows for y, x in zip(*np.nonzero(np.frombuffer(image, np.uint8).reshape(5, 6) > 127), strict=True))
    for size in (1, 4, 64):
        got = inference.detected(frames, inference.spots, size).collect()
        assert sorted((r.frame_idx, r.x1, r.y1) for r in got) == want
        assert all(r.x2 - r.x1 == 1 and r.conf == 1.0 and r.class_id == 0 for r in got)
    per = {f: sorted(r.det_idx for r in got if r.frame_idx == f) for f in {r.frame_idx for r in got}}
    assert all(ids == list(range(len(ids))) for ids in per.values())


def test_a_model_is_made_once_a_worker(spark, tmp_path):
    rows, frames = film(spark, frames=range(200))
    at = str(tmp_path)

    def load():
        open(f"{at}/made-{np.random.default_rng().integers(1 << 60)}", "w").close()
        return lambda images: [np.zeros((1, 6)) for _ in images]

    assert inference.detected(frames.coalesce(1), load, 8).count() == len(rows)
    assert len(list(tmp_path.iterdir())) == 1


def test_frames_of_two_sizes_are_refused(spark):
    a, b = film(spark, frames=[1])[1], film(spark, frames=[2], width=9)[1]
    with pytest.raises(ValueError, match="one size"):
        inference.detected(a.union(b), inference.spots)
    assert inference.detected(a.limit(0), inference.spots).count() == 0


def test_drawn_frames_show_each_person_on_the_pitch(spark):
    rows = [(1, 0, 3.9, 2.1), (1, 0, 104.99, 67.5), (1, 0, 105.0, 3.0), (1, 0, -1.0, 3.0), (1, 0, 3.1, 2.9), (2, 0, None, None)]
    got = {r.match_id: np.frombuffer(r.image, np.uint8).reshape(r.height, r.width) for r in inference.drawn(spark.createDataFrame(rows, "match_id long, frame_idx long, x_m double, y_m double")).collect()}
    assert sorted(zip(*(v.tolist() for v in np.nonzero(got[1])), strict=True)) == [(2, 3), (67, 104)] and not got[2].any()


def test_many_segments_share_tasks(spark, tmp_path, monkeypatch):
    rows, df = film(spark, frames=range(250))
    at = str(tmp_path / "film")
    S.write_frames(df, at, per_segment=1).collect()
    assert len(S.segments(at)) == 500
    assert S.frames(spark, at).rdd.getNumPartitions() <= 200
    assert key(S.frames(spark, at).collect()) == key(rows)
    assert key(S.frames(spark, at).where("frame_idx >= 5 and match_id = 2").collect()) == key([r for r in rows if r[0] == 2 and r[1] >= 5])
    stream = S.FrameStreamReader({"path": at})
    parts = stream.partitions({"after": ""}, stream.latestOffset())
    assert len(parts) == 200 and sum(b.num_rows for p in parts for b in stream.read(p)) == len(rows)
    monkeypatch.setattr(S, "TASK_BYTES", 20)  # an image has 12 bytes
    assert len(S.FrameReader({"path": at}).partitions()) == 300


def test_a_batch_of_many_frames_is_drawn_in_small_ones():
    n = 10_000
    batch = pa.RecordBatch.from_pydict({"match_id": pa.array([1] * n), "frame_idx": pa.array(range(n)), "cells": pa.array([[f % 7140] for f in range(n)], pa.list_(pa.int32()))})
    seen = 0
    for made in inference.images(iter([batch, batch.slice(0, 0)]), 105, 68):
        assert made.nbytes < 2 << 20  # 71 MB in all
        for r in (made.slice(0, 1).to_pylist()[0], made.slice(made.num_rows - 1).to_pylist()[0]):
            assert r["image"].index(b"\xff") == r["frame_idx"] % 7140 and r["image"].count(b"\xff") == 1
        assert made["frame_idx"].to_pylist() == list(range(seen, seen + made.num_rows))
        seen += made.num_rows
    assert seen == n
