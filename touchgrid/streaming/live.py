"""Live events, possession and windows on streams.

A stream has no row frames and its rows may come late, so each match keeps a
buffer in its state: rows wait until the newest frame is ``lag`` frames ahead,
then go through the same step functions as the batch folds, in frame order.
"""

from __future__ import annotations

import heapq
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import folds


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one that ``spark.checkpoint.dir`` names; a local one only for a local session without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: streams need a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="touchgrid-stream-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_SLICE = 10_000  # rows that are Python objects at a time


def _order(row: dict) -> tuple:
    return row["frame_idx"], row.get("det_idx") or 0


def _in_order(parts: list[pd.DataFrame]) -> Iterator[dict]:
    """Rows of ``parts`` by frame and ``det_idx`` as plain values, exact to the last bit, with None for what is missing; a slice at a time."""
    if not any(len(p) for p in parts):
        return
    pdf = pd.concat([p for p in parts if len(p)], ignore_index=True)
    by = pdf[["frame_idx"]].assign(det_idx=pdf["det_idx"].fillna(0) if "det_idx" in pdf else 0)
    pdf = pdf.loc[by.sort_values(["frame_idx", "det_idx"], kind="stable").index]
    for at in range(0, len(pdf), _SLICE):
        part = pdf.iloc[at : at + _SLICE]
        columns = [[v.tolist() if isinstance(v, np.ndarray) else None if folds.missing(v) else v for v in part[c].tolist()] for c in part]
        for values in zip(*columns, strict=True):
            yield dict(zip(part.columns, values, strict=True))


def ordered_fold(stream: DataFrame, step: Callable, start: Callable, schema: str, lag: int = 25, last_frame: int | None = None, total: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """Runs ``step`` over the frames of each match in order.

    State holds the rows of the last ``lag`` frames and the step's own state,
    whatever the length of the match.  A row that comes after its frame was
    passed is dropped, as a watermark would.  ``last_frame`` flushes the buffer
    once it is seen; ``total`` names a column with the number of rows of the
    match, and flushes once all are in, in whatever order they come.  With
    ``idle_ms`` a match without rows for that long is flushed and its state
    removed.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"state": start(), "rows": [], "done": -1, "seen": 0}
        whole = over = state.hasTimedOut
        new = []
        for pdf in frames:
            held["seen"] += len(pdf)
            whole = whole or total is not None and len(pdf) > 0 and held["seen"] >= pdf[total].iloc[0]
            new.append(pdf[pdf["frame_idx"] > held["done"]])
        old = held["rows"]
        newest = max([int(pdf["frame_idx"].max()) for pdf in new if len(pdf)] + [r["frame_idx"] for r in old[-1:]], default=held["done"])
        limit = newest if whole or last_frame is not None and newest >= last_frame else newest - lag
        held["rows"], out = [], []
        for row in heapq.merge(old, _in_order(new), key=_order):
            if row["frame_idx"] > limit:
                held["rows"].append(row)
                continue
            held["done"] = row["frame_idx"]
            held["state"], made = step(held["state"], row)
            if made is not None:
                out.append({"match_id": key[0]} | made)
            if len(out) >= _SLICE:
                yield pd.DataFrame(out, columns=names)
                out = []
        if over:
            state.remove()
        else:
            state.update((json.dumps(held),))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy("match_id").applyInPandasWithState(run, schema, "held string", "append", timeout)


def live_events(possession: DataFrame, **options) -> DataFrame:
    """Passes, interceptions, shots and tackles of a possession stream."""
    return ordered_fold(possession, folds.event_step, folds.event_start, folds.EVENT_SCHEMA, **options)


def live_possession(candidates: DataFrame, **options) -> DataFrame:
    """Holders of a candidate stream."""
    return ordered_fold(candidates, folds.possession_step, folds.possession_start, "match_id long, frame_idx long, holder_id long, holder_team long, contested boolean, turnovers long", **options)


def live_roles(raw: DataFrame, window: int = 15, **options) -> DataFrame:
    """Roles by majority of the last ``window`` votes (raw_role) of each track of a stream; untracked rows keep theirs."""
    step = folds.counted(window, "raw_role", lambda votes, row: {"role_id": row["raw_role"] if row["track_id"] < 0 else folds.majority(votes)})
    return ordered_fold(raw, step, dict, "match_id long, frame_idx long, track_id long, role_id int", **options)


def live_trails(points: DataFrame, x: str, y: str, length: int = 20, **options) -> DataFrame:
    """Size of the trail (the last ``length`` points) of each track of a stream, and its net shift."""
    place = points.withColumn("_at", F.array(F.col(x).cast("double"), F.col(y).cast("double")))

    def make(trail, row):
        (x0, y0), (x1, y1) = trail[0], trail[-1]
        return {"n_trail": len(trail), "net": ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5}

    return ordered_fold(place, folds.counted(length, "_at", make), dict, "match_id long, frame_idx long, track_id long, n_trail int, net double", **options)


def windows(stream: DataFrame, time: str = "ts", width: str = "5 minutes", late: str = "10 minutes", by: str = "event_type", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and kind, with a watermark for late rows."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return timed.groupBy(span, by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sketched(stream: DataFrame, value: str, width: str = "1 minute", by: str = "match_id", time: str = "ts", bits: int = 12) -> DataFrame:
    """A sketch of the distinct values of each window and key: (window, by, sketch).  Needs event time and a watermark.

    Sketches of any windows merge, in any order (``merged_counts``).
    """
    return stream.groupBy(F.window(time, width), by).agg(F.hll_sketch_agg(value, F.lit(bits)).alias("sketch"))


def merged_counts(sketches: DataFrame, by: str = "match_id") -> DataFrame:
    """(by, n_windows, n_distinct) of sketches: the relative standard error is 0.83 / 2^(bits / 2), 1.3 % for 12 bits."""
    return sketches.groupBy(by).agg(F.count("*").alias("n_windows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def sighted(stream: DataFrame, value: str, width: str = "1 minute", by: str = "match_id", time: str = "ts") -> DataFrame:
    """The distinct values of each window and key, with their rows: (window, by, value, n).  Needs event time and a watermark.

    For exact counts over any windows: a window's values leave the state with it.
    """
    return stream.groupBy(F.window(time, width), by, value).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, time: str = "ts", gap: str = "2 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    """Phases of play: rows of a key that follow each other within ``gap``."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote.

    In update mode a key's newest row counts; each micro-batch writes its own
    folder, so a repeated batch replaces itself.
    """
    spark = stream.sparkSession
    at = folder(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out")


def event_windows(spark: SparkSession, path: str, width: str = "1 hour") -> DataFrame:
    """Tumbling windows over an event table read as a stream: window_start, event_type, n, total."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name a file or a folder
    out = drained(windows(stream, width=width, late="0 seconds"), "event-windows", "update")
    newest = out.groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return newest.select(F.col("window.start").alias("window_start"), "event_type", "v.n", F.round("v.total", 3).alias("total"))


def event_sessions(spark: SparkSession, path: str, gap: str = "2 minutes") -> DataFrame:
    """Sessions over an event table read as a stream: user_id, session_start, session_end (last row and gap), n.

    Append mode: a session comes once, when the watermark has passed its end,
    and leaves the state.  A last row far behind the others, whose own session
    never ends, lets the watermark pass them all.
    """
    table = spark.read.parquet(path).select("user_id", "ts")
    at = folder(spark, "last-row")
    table.agg((F.max("ts") + F.expr(f"2 * interval {gap}")).alias("ts")).select(F.lit(None).cast(table.schema["user_id"].dataType).alias("user_id"), "ts").write.parquet(at)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name a file or a folder
    whole = stream.select("user_id", "ts").unionByName(spark.readStream.schema(table.schema).parquet(at))
    out = drained(sessions(whole, gap=gap, late="0 seconds"), "event-sessions")
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
