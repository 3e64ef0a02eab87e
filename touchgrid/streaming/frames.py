"""Frame folds on streams: state by key in the state store, ordered by the watermark, with timers for what is due without rows.

Event time is the frame (``frame_time``).  Rows wait in a list until the
watermark has passed their frame, so they may come in any order within its
delay; what comes later is dropped and counted by the query's progress
(``numRowsDroppedByWatermark``).  A timer fires when the watermark reaches the
next frame with a row or with work of its own: a coasted box, an expiry.  What
has expired leaves the store, so state is bounded by what is live.

Needs the RocksDB state store (``rocksdb``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor

from ..operators import folds, frame_folds as FF

FRAME_MS = 40
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb(spark: SparkSession) -> None:
    """Has the session keep the state of its streams in RocksDB."""
    if spark.conf.get(_STORE, "") != _ROCKSDB:
        spark.conf.set(_STORE, _ROCKSDB)


def frame_time(frame: str | Column = "frame_idx") -> Column:
    """Event time of a frame; the first is after zero, where a watermark starts."""
    frame = F.col(frame) if isinstance(frame, str) else frame
    return F.timestamp_millis((frame + 1) * FRAME_MS)


class FrameProcessor(StatefulProcessor):
    """Runs a fold of ``frame_folds`` for each key."""

    def __init__(self, fold, keys: Sequence[str]):
        self.fold, self.keys = fold, list(keys)
        self.kinds, self.names = T.StructType.fromDDL(fold.fields), T.StructType.fromDDL(fold.out).names

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.held = handle.getValueState("held", f"until long, {self.fold.schema}")
        self.arrow = to_arrow_schema(self.kinds)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        first = None
        for pdf in rows:
            if len(pdf):
                self._wait(pa.RecordBatch.from_arrays([self._column(pdf[f.name], f) for f in self.kinds], schema=self.arrow))
                least = int(pdf["frame_idx"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer((first + 1) * FRAME_MS)
        return iter(())

    def _column(self, values: pd.Series, field: T.StructField) -> pa.Array:
        """A column in its type; arrays of doubles as they are, one by one they would be Python numbers."""
        kind, lost = self.arrow.field(field.name).type, values.isna()
        if lost.all():
            return pa.nulls(len(values), kind)
        if isinstance(field.dataType, T.ArrayType) and all(v is None or isinstance(v, np.ndarray) and v.dtype == np.float64 for v in values):
            return pa.array(values.tolist(), kind, from_pandas=False)
        if values.dtype == object:
            return pa.array(FF.plain(values.tolist(), field.dataType), kind)
        return pa.array(values.to_numpy(), mask=lost.to_numpy()).cast(kind)

    def _wait(self, batch: pa.RecordBatch) -> None:
        """Rows wait as one Arrow batch, not one by one: the store is asked once for thousands."""
        self.waiting.appendValue((batch.serialize().to_pybytes(),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        clock = timerValues.getCurrentWatermarkInMs() // FRAME_MS - 1
        found = [pa.ipc.read_record_batch(pa.py_buffer(r[0]), self.arrow) for r in self.waiting.get()]
        waiting = pa.Table.from_batches(found, self.arrow)
        now = pc.less_equal(waiting["frame_idx"], clock)
        ready, rest = waiting.filter(now), waiting.filter(pc.invert(now))
        held = self.held.get()
        until, state = (None, None) if held is None else (held[0], self.fold.load(tuple(held[1:])))
        if len(ready):
            until = next((v for v in ready["last_frame"].to_pylist() if v is not None), until)
            self.waiting.clear()
            for batch in rest.combine_chunks().to_batches():
                self._wait(batch)
        end, out, due = math.inf if until is None else until, [], None
        for frame, rows in self._frames(ready):
            state, made, _ = FF.advance(self.fold, state, rows, frame, end)
            out += made
            if len(out) >= folds.SLICE:
                yield self._made(key, out)
                out = []
        state, made, due = FF.advance(self.fold, state, [], clock, end)
        out += made
        if state is not None:
            self.held.update((until, *self.fold.dump(state)))
        elif held is not None:
            self.held.clear()
        following = min(([pc.min(rest["frame_idx"]).as_py()] if len(rest) else []) + ([due] if due is not None else []), default=None)
        if following is not None:
            self.handle.registerTimer((following + 1) * FRAME_MS)
        if out:
            yield self._made(key, out)

    def _frames(self, ready: pa.Table) -> Iterator[tuple[int, list[dict]]]:
        """Rows of each frame in order, a slice of Python objects at a time."""
        by = pa.table({"frame_idx": ready["frame_idx"], "det_idx": pc.fill_null(ready["det_idx"], -1), "at": pa.array(range(len(ready)))})
        order = by.sort_by([(c, "ascending") for c in by.column_names])["at"].combine_chunks()
        slices = (ready.take(order[i : i + folds.SLICE]).combine_chunks().to_batches() for i in range(0, len(order), folds.SLICE))
        rows = (r for s in slices for _, r in folds.sorted_rows(iter(s), []))
        yield from ((f, list(g)) for f, g in groupby(rows, lambda r: r["frame_idx"]))

    def _made(self, key, out: list[dict]) -> pd.DataFrame:
        fixed = dict(zip(self.keys, key, strict=True))
        return pd.DataFrame({n: [fixed[n]] * len(out) if n in fixed else [m.get(n) for m in out] for n in self.names}, columns=self.names)

    def close(self) -> None:
        pass


def folded(stream: DataFrame, fold, keys: Sequence[str]) -> DataFrame:
    """A stream with event time ``ts`` and a watermark, folded by key; the rows are those of ``frame_folds.folded``.

    Rows with a null in their key are left out: the state store has no key for them.
    """
    rocksdb(stream.sparkSession)
    rows = FF.row_columns(stream, keys, fold.fields, "ts").dropna(subset=list(keys))
    return rows.groupBy(*keys).transformWithStateInPandas(FrameProcessor(fold, keys), T.StructType.fromDDL(fold.out), "Append", "EventTime")


def live_coasted(boxes: DataFrame, **options) -> DataFrame:
    """Tracked boxes of a stream with coasting; a track without rows for 45 frames leaves the state."""
    return folded(boxes, FF.Coast(**options), ["match_id", "track_id"])


def live_gallery(observations: DataFrame, **options) -> DataFrame:
    """Appearance of each track of a stream after each sight; an entry leaves 300 frames after its last."""
    return folded(observations, FF.Gallery(**options), ["match_id", "track_id"])


def live_tracked(rows: DataFrame, **options) -> DataFrame:
    """Tracking of a stream of boxes and control rows of cuts."""
    return folded(rows, FF.Tracking(**options), ["match_id"])


def live_carried(keyframes: DataFrame, motion: DataFrame, every: int = 3, **options) -> DataFrame:
    """Boxes on every frame from two streams with watermarks on ``ts``: boxes on keyframes, camera motion on every frame.

    Each camera row meets the boxes of its frame, if any (a left join bounded by
    event time, so the store drops what can meet nothing more), and the chain of
    each match takes them up in order.  Keyframes are told by event time: such
    a filter stays above the watermark, which boxes off the keyframes move too.
    """
    frame = F.floor(F.unix_millis("ts") / FRAME_MS) - 1
    boxes = keyframes.where(frame % every == 0).select(F.col("match_id").alias("of_match"), F.col("ts").alias("of_ts"), "track_id", "x1", "y1", "x2", "y2", "conf")
    met = motion.join(boxes, (F.col("match_id") == F.col("of_match")) & (F.col("ts") == F.col("of_ts")), "left").drop("of_match", "of_ts")
    return folded(met, FF.Carry(every, **options), ["match_id"])
