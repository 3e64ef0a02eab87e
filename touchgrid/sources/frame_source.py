"""Frames of matches as a data source: segments of frames in a shared folder, read in ranges or as a stream.

A segment holds consecutive frames of one match: a header with their number and
size, an index (frame, offset, length), then the images.  Planning reads names,
headers and indexes only; a read task gets ranges of segments and fetches, one
after the other, the bytes between first and last frame of each.  A task gets one
range where there are few; of many, neighbours share a task, as starting one
costs more than a range.  Filters on frame_idx and match_id reach the planner,
which leaves out segments and ranges by name and index.

    spark.dataSource.register(Frames)
    spark.read.format("frames").option("path", folder).load()
    spark.readStream.format("frames").option("path", folder).load()

A stream takes segments in the order of their names, which begin with their
first frame; its offset is the last name taken.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

_HEAD = "<4sqiii"  # mark, match, width, height, number of frames
_HEAD_SIZE, _ENTRY_SIZE = struct.calcsize(_HEAD), 24
_MARK = b"FRM1"
SCHEMA = "match_id long, frame_idx long, width int, height int, image binary"
_ARROW = pa.schema([("match_id", pa.int64()), ("frame_idx", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("image", pa.binary())])
TASKS, TASK_BYTES = 200, 16 << 20  # a scan has a task a range up to the one; beyond, as many tasks as that or as one for each so many bytes, if more
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return (pafs.LocalFileSystem(), uri) if "://" not in uri else pafs.FileSystem.from_uri(uri)


def segments(folder: str) -> list[str]:
    """Names of the finished segments, in the order of a stream."""
    fs, root = _fs(folder)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.endswith(".frames"))


def segment_index(folder: str, name: str) -> tuple[int, int, int, np.ndarray]:
    """(match, width, height, rows of frame, offset, length) of a segment, without its images."""
    fs, root = _fs(folder)
    with fs.open_input_file(f"{root}/{name}") as f:
        mark, match, width, height, n = struct.unpack(_HEAD, f.read(_HEAD_SIZE))
        if mark != _MARK:
            raise ValueError(f"{name} is no segment of frames")
        return match, width, height, np.frombuffer(f.read(n * _ENTRY_SIZE), "<i8").reshape(n, 3)


def write_frames(frames: DataFrame, folder: str, per_segment: int = 500) -> DataFrame:
    """Writes ``frames`` (``SCHEMA``) as segments of up to ``per_segment`` frames of a match; a row a segment: name, match_id, first, n.

    Frames are dealt by match and stretch.  A name appears when its segment is
    whole, and is new in each attempt; only the names of the returned rows count,
    and they are what the attempts that succeed hand on.
    """
    from pyspark.sql import types as T

    def run(key: tuple, table: pa.Table) -> pa.Table:
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        order = np.argsort(table["frame_idx"].to_numpy(), kind="stable")
        images = [table["image"][i].as_py() or b"" for i in order.tolist()]
        index = np.zeros((len(order), 3), "<i8")
        index[:, 0], index[:, 2] = table["frame_idx"].to_numpy()[order], [len(x) for x in images]
        index[:, 1] = _HEAD_SIZE + len(order) * _ENTRY_SIZE + np.cumsum(index[:, 2]) - index[:, 2]
        match, first = table["match_id"][0].as_py(), int(index[0, 0])
        name = f"{first:015d}-{match}-{uuid.uuid4().hex}.frames"
        with fs.open_output_stream(f"{root}/.{name}") as f:
            f.write(struct.pack(_HEAD, _MARK, match, table["width"][0].as_py(), table["height"][0].as_py(), len(order)) + index.tobytes())
            for x in images:
                f.write(x)
        fs.move(f"{root}/.{name}", f"{root}/{name}")
        return pa.table({"name": [name], "match_id": pa.array([match], pa.int64()), "first": pa.array([first], pa.int64()), "n": pa.array([len(order)], pa.int64())})

    dealt = frames.select(*T.StructType.fromDDL(SCHEMA).names).where("match_id is not null and frame_idx >= 0").withColumn("stretch", F.floor(F.col("frame_idx") / per_segment))
    return dealt.groupBy("match_id", "stretch").applyInArrow(lambda key, t: run(key, t), "name string, match_id long, first long, n long")


@dataclass
class Range(InputPartition):
    """Some consecutive frames of a segment: rows ``start`` to ``stop`` of its index."""

    folder: str
    name: str
    start: int
    stop: int
    n_bytes: int = 0

    def __post_init__(self):
        super().__init__((self.name, self.start))


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads in turn."""

    ranges: list[Range]

    def __post_init__(self):
        super().__init__((self.ranges[0].name, self.ranges[0].start))


def dealt(ranges: list[Range]) -> list[InputPartition]:
    """Ranges as partitions: neighbours share one where there are more than ``TASKS``."""
    tasks = max(TASKS, -(-sum(r.n_bytes for r in ranges) // TASK_BYTES))
    if len(ranges) <= tasks:
        return ranges
    ends = [len(ranges) * i // tasks for i in range(tasks + 1)]
    return [Ranges(ranges[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def read_partition(part: InputPartition) -> Iterator[pa.RecordBatch]:
    for one in part.ranges if isinstance(part, Ranges) else [part]:
        yield from read_range(one)


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    """The frames of a range, by one read of the bytes that they span."""
    match, width, height, index = segment_index(part.folder, part.name)
    index = index[part.start : part.stop]
    if not len(index):
        return
    begin = int(index[0, 1])
    fs, root = _fs(part.folder)
    with fs.open_input_file(f"{root}/{part.name}") as f:
        f.seek(begin)
        data = f.read(int(index[-1, 1] + index[-1, 2]) - begin)
    n = len(index)
    images = [data[a - begin : a - begin + k] for a, k in index[:, 1:].tolist()]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, match)), pa.array(index[:, 0]), pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, height, np.int32)), pa.array(images, pa.binary())], schema=_ARROW)


class _Bounds:
    """The frames and matches that pushed filters leave."""

    def __init__(self):
        self.low, self.high, self.frames, self.matches = 0, (1 << 63) - 1, None, None

    def take(self, f) -> bool:
        """Whether the filter is wholly taken care of here."""
        column = f.attribute[0] if getattr(f, "attribute", None) else None
        if column in ("frame_idx", "match_id") and isinstance(f, IsNotNull):
            return True
        if column == "frame_idx":
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                return True
            if isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
                return True
            if isinstance(f, (EqualTo, In)):
                self.frames = self._both(self.frames, f)
                return True
        if column == "match_id" and isinstance(f, (EqualTo, In)):
            self.matches = self._both(self.matches, f)
            return True
        return False

    @staticmethod
    def _both(held, f):
        new = set(f.value) if isinstance(f, In) else {f.value}
        return new if held is None else held & new

    def rows(self, match: int, frames: np.ndarray) -> np.ndarray:
        """Rows of an index that may be read."""
        if self.matches is not None and match not in self.matches:
            return np.zeros(0, np.int64)
        ok = (frames >= self.low) & (frames <= self.high)
        if self.frames is not None:
            ok &= np.isin(frames, list(self.frames))
        return np.flatnonzero(ok)


def _ranges(folder: str, name: str, index: np.ndarray, rows: np.ndarray, per_range: int) -> list[Range]:
    """Runs of consecutive rows, of ``per_range`` at most."""
    out = []
    for run in np.split(rows, np.flatnonzero(np.diff(rows) > 1) + 1) if len(rows) else []:
        for a in range(int(run[0]), int(run[-1]) + 1, per_range):
            b = int(min(a + per_range, run[-1] + 1))
            out.append(Range(folder, name, a, b, int(index[a:b, 2].sum())))
    return out


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.per_range, self.bounds = options["path"], int(options.get("framesPerPartition", 100)), _Bounds()

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if not self.bounds.take(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for name in segments(self.folder):
            first, match = name.split("-")[:2]
            if int(first) > self.bounds.high or self.bounds.matches is not None and int(match) not in self.bounds.matches:
                continue  # by its name
            match, _, _, index = segment_index(self.folder, name)
            out += _ranges(self.folder, name, index, self.bounds.rows(match, index[:, 0]), self.per_range)
        return dealt(out)

    def read(self, partition):
        if isinstance(partition, (Range, Ranges)):
            yield from read_partition(partition)


class FrameStreamReader(DataSourceStreamReader):
    """Offsets are names of segments; a batch takes all that have come after the last."""

    def __init__(self, options: dict):
        self.folder, self.per_range = options["path"], int(options.get("framesPerPartition", 100))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"after": max(segments(self.folder), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for name in segments(self.folder):
            if start["after"] < name <= end["after"]:
                index = segment_index(self.folder, name)[3]
                out += _ranges(self.folder, name, index, np.arange(len(index)), self.per_range)
        return dealt(out)

    def read(self, partition):
        yield from read_partition(partition)

    def commit(self, end: dict) -> None:
        pass


class Frames(DataSource):
    """``frames``: options path, framesPerPartition (frames of a range, which is read at once)."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)

    def streamReader(self, schema) -> FrameStreamReader:  # noqa: N802
        return FrameStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed to it."""
    spark.dataSource.register(Frames)
    spark.conf.set(_PUSHDOWN, "true")


def frames(spark: SparkSession, folder: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("frames").options(path=folder, **{k: str(v) for k, v in options.items()}).load()


def frame_stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    register(spark)
    return spark.readStream.format("frames").options(path=folder, **{k: str(v) for k, v in options.items()}).load()
