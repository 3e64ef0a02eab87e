"""Tracking of a match in stretches of frames that run side by side and are joined again.

A tracker forgets: what it does on a frame hangs on the tracks of the last
frames only, but for the numbers it gives.  So each stretch begins some frames
early (``warm``) with nothing, and what it holds at its first own frame is
compared, to the last bit, with what the stretch before holds at its end.  If
they are equal the boxes are those of one pass, and only numbers differ: new
tracks go on counting, tracks that live on take the number they had.  A match
with any stretch that is not equal goes through in one pass, so the result
never hangs on the lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.storagelevel import StorageLevel

from . import folds

_NOTE = "_entry binary, _exit binary, _entry_live array<long>, _exit_live array<long>, _entry_next long, _exit_next long"


def tracks(df: DataFrame, make: Callable, order: list[str], schema: str, stretch: int, warm: int) -> DataFrame:
    """Rows of ``schema`` (match_id, frame_idx, track_id first) of all matches.

    ``make()`` is a run over frames: ``step(frame, rows) -> rows``, ``until(frame)
    -> rows`` for frames without rows before that one, and ``mark() -> (state,
    live numbers, next number)``, where equal states behave alike.
    """
    kinds = to_arrow_schema(T.StructType.fromDDL(f"{schema}, _part long, {_NOTE}"))
    names = T.StructType.fromDDL(schema).names
    last = df.groupBy(F.col("match_id").alias("of_match")).agg(F.max("frame_idx").alias("_last"))
    known = df.join(last, F.col("match_id").eqNullSafe(F.col("of_match"))).drop("of_match")
    own = F.floor(F.col("frame_idx") / stretch)
    both = F.when(F.col("frame_idx") - own * stretch >= stretch - warm, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = known.withColumn("_part", F.explode(both)).where(F.col("_part") * stretch <= F.col("_last"))

    note = [f.name for f in kinds if f.name not in (*names, "match_id", "_part")]

    def rows_of(part: _Part, out: list[dict]) -> pa.RecordBatch:
        """Boxes of one stretch, column by column."""
        fixed = {"match_id": part.match, "_part": part.part}
        columns = [pa.array([fixed[f.name]] * len(out) if f.name in fixed else [m[f.name] for m in out], f.type) if f.name not in note else pa.nulls(len(out), f.type) for f in kinds]
        return pa.RecordBatch.from_arrays(columns, schema=kinds)

    def closed(part: _Part, out: list[dict]) -> Iterator[pa.RecordBatch]:
        rest, last = part.close()
        if out or rest:
            yield rows_of(part, out + rest)
        yield pa.RecordBatch.from_pylist([last], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one, out = None, None, []
        for key, frame, rows in _frames(batches):
            if key != now:
                if one is not None:
                    yield from closed(one, out)
                now, one, out = key, _Part(make(), *key, stretch, rows[0]["_last"]), []
            out += one.take(frame, rows)
            if len(out) >= folds.SLICE:
                yield rows_of(one, out)
                out = []
        if one is not None:
            yield from closed(one, out)

    made = folds.ordered(dealt, ["match_id", "_part"], ["frame_idx", *order]).mapInArrow(run, T.StructType.fromDDL(f"{schema}, _part long, {_NOTE}")).persist(StorageLevel.DISK_ONLY)
    notes = made.where("_exit_next is not null").select("match_id", "_part", *(c.split(" ")[0] for c in _NOTE.split(", ")))
    numbers = notes.groupBy("match_id").applyInPandas(_numbers, "match_id long, _part long, _least long, _shift long, _old array<long>, _new array<long>, _whole boolean").persist(StorageLevel.DISK_ONLY)
    rows = made.where("_exit_next is null").select(*names, "_part").join(numbers.where("_whole").withColumnsRenamed({"match_id": "of_match", "_part": "of_part"}), F.col("match_id").eqNullSafe(F.col("of_match")) & (F.col("_part") == F.col("of_part")))
    kept = F.when(F.col("track_id") >= F.col("_least"), F.col("track_id") + F.col("_shift")).when(F.col("track_id") < 0, F.col("track_id")).otherwise(F.get("_new", F.array_position("_old", F.col("track_id")) - 1))
    out = rows.withColumn("track_id", kept).select(*names)
    apart = numbers.where("not _whole").select(F.col("match_id").alias("of_match")).distinct()
    if apart.isEmpty():
        return out
    return out.unionByName(one_pass(df.join(apart, F.col("match_id").eqNullSafe(F.col("of_match")), "left_semi"), make, order, schema))


class _Part:
    """One stretch of a match."""

    def __init__(self, tracker, match: int, part: int, stretch: int, last: int):
        self.tracker, self.match, self.part, self.begin, self.end, self.entry = tracker, match, part, part * stretch, min((part + 1) * stretch, last + 1), None

    def _enter(self) -> list[dict]:
        """What is due on frames before the first own one; it is the stretch before that has them."""
        self.tracker.until(self.begin)
        self.entry = self.tracker.mark()
        return []

    def take(self, frame: int, rows: list[dict]) -> list[dict]:
        if self.entry is None and frame >= self.begin:
            self._enter()
        made = self.tracker.until(frame) + self.tracker.step(frame, rows)
        return made if self.entry is not None else []

    def close(self) -> tuple[list[dict], dict]:
        """(the last boxes, what joins the stretch to its neighbours)."""
        if self.entry is None:
            self._enter()
        out = self.tracker.until(self.end)
        (entry, alive, first), (end, left, following) = self.entry, self.tracker.mark()
        return out, {"match_id": self.match, "_part": self.part, "_entry": entry, "_exit": end, "_entry_live": alive, "_exit_live": left, "_entry_next": first, "_exit_next": following}


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, list[dict]]]:
    """(match and part, frame, its rows) of sorted batches."""
    at, rows = None, []
    for key, row in folds.sorted_rows(batches, ["match_id", "_part"]):
        if (key, row["frame_idx"]) != at:
            if rows:
                yield *at, rows
            at, rows = (key, row["frame_idx"]), []
        rows.append(row)
    if rows:
        yield *at, rows


def _numbers(notes: pd.DataFrame) -> pd.DataFrame:
    """How the numbers of each stretch of a match become those of the match; some dozens of live tracks a stretch."""
    out, known, given, state, whole = [], {}, 0, None, True
    for r in notes.sort_values("_part").itertuples(index=False, name=None):
        n = dict(zip(notes.columns, r, strict=True))
        alive, left = list(n["_entry_live"]), list(n["_exit_live"])
        whole &= state is None or bytes(n["_entry"]) == state[0] and len(alive) == len(state[1])
        old = dict(zip(alive, state[1], strict=True)) if whole and state is not None else {}
        shift = given + 1 - n["_entry_next"]
        out.append((n["match_id"], n["_part"], n["_entry_next"], shift, [int(k) for k in old], [int(v) for v in old.values()]))
        given += n["_exit_next"] - n["_entry_next"]
        state = bytes(n["_exit"]), [t + shift if t >= n["_entry_next"] else old.get(t, -1) for t in left]
    return pd.DataFrame(out, columns=["match_id", "_part", "_least", "_shift", "_old", "_new"]).assign(_whole=whole)


def one_pass(df: DataFrame, make: Callable, order: list[str], schema: str) -> DataFrame:
    """All frames of a match in order, in one task with one frame's rows."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tracker, out = None, None, []
        for key, frame, rows in _frames(b.append_column("_part", pa.array(np.zeros(len(b), np.int64))) for b in batches):
            if key != now:
                now, tracker = key, make()
            out += [m | {"match_id": key[0]} for m in tracker.until(frame) + tracker.step(frame, rows)]
            if len(out) >= folds.SLICE:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return folds.ordered(df, ["match_id"], ["frame_idx", *order]).mapInArrow(run, schema)
