"""Ordered folds: state machines whose next state depends on rounded or branching former states.

Each step is a plain function ``(state, row) -> (state, out)``; the batch
adapter runs it over the sorted rows of a key, the streaming adapter in
``streaming`` over the rows of a micro-batch.  Only thin rows enter a fold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema


SLICE = 10_000  # made rows that a task holds


def fold(df: DataFrame, keys: list[str], order: list[str], step: Callable, start: Callable, schema: str) -> DataFrame:
    """Fold the rows of each key in order; ``step`` gets dicts and returns a dict per row (or None).

    Spark sorts, and spills as it must; a task has the rows of one Arrow batch
    and one state in Python, however long a key is.
    """
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for key, row in sorted_rows(batches, keys):
            if key != now:
                now, state = key, start()
            state, made = step(state, row)
            if made is not None:
                out.append(dict(zip(keys, key, strict=True)) | made)
            if len(out) >= SLICE:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return ordered(df, keys, [F.asc_nulls_last(c) for c in order]).mapInArrow(run, schema)


def ordered(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The rows of a key in one task, in order."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def values(column: pa.Array) -> list:
    """A column as Python values with None for what is missing; arrays of numbers as numpy views."""
    if pa.types.is_list(column.type) and column.type.value_type == pa.float64() and not column.values.null_count:
        data, at = column.values.to_numpy(), column.offsets.to_numpy()
        return [None if empty else data[a:b] for a, b, empty in zip(at[:-1], at[1:], column.is_null().to_numpy(False), strict=True)]
    return column.to_pylist()


def sorted_rows(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict]]:
    """(key, row) of sorted batches."""
    for batch in batches:
        names, columns = batch.schema.names, [values(c) for c in batch.columns]
        at = [names.index(k) for k in keys]
        for row in zip(*columns, strict=True):
            yield tuple(row[i] for i in at), dict(zip(names, row, strict=True))


def missing(x) -> bool:
    return x is None or x != x


# --- the last rows of each track, where a stream has no row frames ------------------


def counted(window: int, value: str, make: Callable) -> Callable:
    """A step that keeps the last ``window`` values of each track (nulls left out) and gives what ``make`` makes of them and the row."""

    def step(state: dict, row: dict) -> tuple[dict, dict]:
        track = str(row["track_id"])
        held = state.get(track, [])
        if not missing(row[value]):
            held = [*held, row[value]][-window:]
        return state | {track: held}, {"frame_idx": row["frame_idx"], "track_id": row["track_id"]} | make(held, row)

    return step


def majority(votes: list):
    """The most frequent vote; of equals the one seen first."""
    return max(dict.fromkeys(votes), key=votes.count) if votes else None


# --- smoothed speed: rounding feeds back ----------------------------------------


def smoothed(state: float, kmh: float, alpha: float = 0.75) -> float:
    return round(alpha * state + (1.0 - alpha) * kmh, 1)


def smooth_speed(state: float, row: dict, alpha: float = 0.75) -> tuple[float, dict]:
    now = smoothed(state, row["speed_kmh"], alpha)
    return now, {"frame_idx": row["frame_idx"], "smoothed_kmh": now}


# --- possession hysteresis ----------------------------------------------------------


def possession_start() -> dict:
    return {"holder": None, "team": None, "candidate": None, "frames": 0, "turnovers": 0}


def possession_step(state: dict, row: dict, radius: float = 1.8, hold: int = 2, close: float = 1.05) -> tuple[dict, dict]:
    """row: frame_idx, candidate, candidate_team, dist_m (999 without ball), contested."""
    s = dict(state)
    who = None if missing(row["candidate"]) else int(row["candidate"])
    team = None if missing(row["candidate_team"]) else int(row["candidate_team"])
    if who is None:
        s["candidate"], s["frames"] = None, 0
        if row["dist_m"] > 1.5 * radius:
            s["holder"] = s["team"] = None
    elif who == s["holder"]:
        s["frames"] = 0
    else:
        s["frames"] = s["frames"] + 1 if who == s["candidate"] else 1
        s["candidate"] = who
        if row["dist_m"] < close or s["frames"] >= hold:
            if s["team"] is not None and team is not None and team != s["team"]:
                s["turnovers"] += 1
            s |= {"holder": who, "team": team, "frames": 0}
    return s, {"frame_idx": row["frame_idx"], "holder_id": s["holder"], "holder_team": s["team"], "contested": bool(row["contested"]), "turnovers": s["turnovers"]}


# --- debounced cuts ----------------------------------------------------------------


def cut_step(state: dict, row: dict, gap: int = 15, least: float = 0.52) -> tuple[dict, dict]:
    """row: frame_idx, score, hist_distance, edge_diff; a cut needs ``gap`` frames since the last."""
    hit = row["score"] >= least or (row["hist_distance"] >= 0.50 and row["edge_diff"] >= 0.45)
    cut = hit and (state["last"] is None or row["frame_idx"] - state["last"] >= gap)
    now = {"last": row["frame_idx"], "n": state["n"] + 1} if cut else state
    return now, {"frame_idx": row["frame_idx"], "is_cut": cut, "cut_count": now["n"]}


# --- constant-velocity Kalman filter and the ball -------------------------------------


class Kalman:
    """State x, y, vx, vy; measurements x, y; Joseph-form update."""

    def __init__(self, dt: float = 1.0 / 25.0, process: float = 8.0, noise: float = 0.8):
        self.f = np.eye(4)
        self.f[0, 2] = self.f[1, 3] = dt
        q = process**2 * np.array([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2]])
        self.q = np.kron(q, np.eye(2))
        self.r = np.eye(2) * noise**2
        self.x: np.ndarray | None = None

    def start(self, x: float, y: float, vx: float = 0.0, vy: float = 0.0) -> None:
        self.x, self.p = np.array([x, y, vx, vy]), np.diag([10.0, 10.0, 1000.0, 1000.0])

    def predict(self) -> tuple[float, float]:
        if self.x is None:
            return 0.0, 0.0
        self.x, self.p = self.f @ self.x, self.f @ self.p @ self.f.T + self.q
        return float(self.x[0]), float(self.x[1])

    def update(self, x: float, y: float) -> tuple[float, float]:
        if self.x is None:
            self.start(x, y)
            return x, y
        gain = self.p[:, :2] @ np.linalg.inv(self.p[:2, :2] + self.r)
        self.x = self.x + gain @ (np.array([x, y]) - self.x[:2])
        rest = np.eye(4)
        rest[:, :2] -= gain
        self.p = rest @ self.p @ rest.T + gain @ self.r @ gain.T
        return float(self.x[0]), float(self.x[1])

    @property
    def speed(self) -> float:
        return 0.0 if self.x is None else float(math.hypot(self.x[2], self.x[3]))


def ball_start(fps: float = 25.0) -> dict:
    """Pixels move with more noise than metres: the two filters have their own."""
    return {"pixel": Kalman(1.0 / fps), "metric": Kalman(1.0 / fps, process=3.0, noise=0.4), "last": None, "lost": 0, "seen": None}


def ball_step(state: dict, row: dict, fps: float = 25.0, most_kmh: float = 140.0, gap: int = 6, jump_px: float = 380.0) -> tuple[dict, dict]:
    """row: frame_idx, cx, cy (null without a detection), mx, my (null without a homography), w, h, conf.

    Detections that imply an impossible speed count as missing; gaps of up to
    ``gap`` frames are filled by prediction, after that the ball is lost.
    """
    s, frame = state, row["frame_idx"]
    last = s["last"]
    found = not missing(row["cx"])
    metric = found and not missing(row["mx"])
    if found and last is not None:
        since = frame - s["seen"] if s["seen"] is not None else 1
        if metric and last["x_m"] is not None:
            found &= math.hypot(row["mx"] - last["x_m"], row["my"] - last["y_m"]) / max(1e-3, since / fps) <= 1.15 * most_kmh / 3.6
        found &= math.hypot(row["cx"] - last["cx"], row["cy"] - last["cy"]) <= jump_px * max(1, since)
    out = {"frame_idx": frame, "cx": None, "cy": None, "x_m": None, "y_m": None, "speed_kmh": 0.0, "w": None, "h": None, "interpolated": False, "conf": None}
    if found:
        if s["pixel"].x is not None:
            s["pixel"].predict()
        out["cx"], out["cy"] = s["pixel"].update(row["cx"], row["cy"])
        if metric:
            if s["metric"].x is not None:
                s["metric"].predict()
            out["x_m"], out["y_m"] = s["metric"].update(row["mx"], row["my"])
            out["speed_kmh"] = round(s["metric"].speed * 3.6, 1)
        out |= {"w": row["w"], "h": row["h"], "conf": row["conf"]}
        s |= {"last": out, "lost": 0, "seen": frame}
        return s, out
    s["lost"] += 1
    if last is None or s["lost"] > gap:
        return s, out
    out["cx"], out["cy"] = s["pixel"].predict()
    if s["metric"].x is not None:
        out["x_m"], out["y_m"] = s["metric"].predict()
        out["speed_kmh"] = round(s["metric"].speed * 3.6, 1)
    out |= {"w": last["w"], "h": last["h"], "interpolated": True, "conf": max(0.20, last["conf"] * 0.85 ** s["lost"])}
    s["last"] = out
    return s, out


# --- events ---------------------------------------------------------------------------


def event_start() -> dict:
    return {"holder": None, "flight": None, "n": 0}


def event_step(state: dict, row: dict, fps: float = 25.0, release: float = 12.0, shot: float = 36.0, least_m: float = 3.0, duel: int = 6) -> tuple[dict, dict | None]:
    """row: frame_idx, holder_id, holder_team, ball_x, ball_y, ball_kmh.  At most one event a frame."""
    s, frame = dict(state), row["frame_idx"]
    speed = min(130.0, max(0.0, 0.0 if missing(row["ball_kmh"]) else row["ball_kmh"]))
    ball = None if missing(row["ball_x"]) else (row["ball_x"], row["ball_y"])
    if s["flight"]:
        s["flight"] = s["flight"] | {"peak": max(s["flight"]["peak"], speed)}
    if missing(row["holder_id"]):
        if s["holder"] and not s["flight"] and ball and speed >= release:
            s["flight"] = {"peak": speed}
        return s, None
    who, team = int(row["holder_id"]), None if missing(row["holder_team"]) else int(row["holder_team"])
    was, made = s["holder"], None
    if s["flight"]:
        start, dist, peak = was["ball"], math.dist(ball, was["ball"]), s["flight"]["peak"]
        towards = (ball[0] > 85.0 and ball[0] - start[0] > 5.0) or (ball[0] < 20.0 and start[0] - ball[0] > 5.0)
        if peak >= shot and 20.0 <= ball[1] <= 48.0 and towards and who != was["id"]:
            made = ("SHOT", was["team"], was["id"], who, peak, dist)
        elif team == was["team"] and who != was["id"] and dist >= least_m:
            made = ("PASS", was["team"], was["id"], who, peak, dist)
        elif team != was["team"] and dist >= least_m:
            made = ("INTERCEPTION", team, who, was["id"], peak, dist)
    elif was and team is not None and was["team"] is not None and team != was["team"] and frame - was["frame"] <= duel:
        made = ("TACKLE", team, who, was["id"], speed, 0.0)
    s |= {"holder": {"id": who, "team": team, "ball": ball, "frame": frame}, "flight": None}
    if made is None:
        return s, None
    s["n"] += 1
    kind, of, first, second, peak, dist = made
    return s, {"event_id": s["n"], "event_type": kind, "frame_idx": frame, "timestamp_s": frame / max(1.0, fps), "team_id": of, "primary_id": first, "secondary_id": second, "speed_kmh": peak, "distance_m": dist}


EVENT_SCHEMA = "match_id long, event_id long, event_type string, frame_idx long, timestamp_s double, team_id long, primary_id long, secondary_id long, speed_kmh double, distance_m double"


# --- coasting and propagation of tracks -------------------------------------------------


def coast_start() -> dict:
    return {}


def coast_frame(state: dict, frame: int, rows: list[dict], most: int = 4, forget: int = 45, damping: float = 0.85) -> tuple[dict, list[dict]]:
    """One frame of boxes by track; tracks that are missing coast for ``most`` frames and are forgotten after ``forget``."""
    out, seen = [], set()
    for r in rows:
        t, c = r["track_id"], ((r["x1"] + r["x2"]) / 2, (r["y1"] + r["y2"]) / 2)
        old = state.get(t)
        v = (c[0] - old["c"][0], c[1] - old["c"][1]) if old else (0.0, 0.0)
        state[t] = {"c": c, "v": v, "size": (r["x2"] - r["x1"], r["y2"] - r["y1"]), "lost": 0}
        seen.add(t)
        out.append({"frame_idx": frame, "track_id": t, "x1": r["x1"], "y1": r["y1"], "x2": r["x2"], "y2": r["y2"], "conf": r["conf"], "coasted": False})
    for t in [t for t in state if t not in seen]:
        s = state[t]
        s["lost"] += 1
        if s["lost"] > forget:
            del state[t]
        elif s["lost"] <= most:
            k = damping ** s["lost"]
            s["c"] = (s["c"][0] + s["v"][0] * k, s["c"][1] + s["v"][1] * k)
            (cx, cy), (w, h) = s["c"], s["size"]
            out.append({"frame_idx": frame, "track_id": t, "x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w / 2, "y2": cy + h / 2, "conf": 0.5, "coasted": True})
    return state, out


def frames_of(pdf: pd.DataFrame, forget: int = 45) -> Iterator[tuple[int, list[dict]]]:
    """Frames of a match in order; of a run of frames without boxes the first ``forget`` + 1, after which no track is left."""
    last = None
    for f, g in pdf.sort_values(["frame_idx", "det_idx"], kind="stable").groupby("frame_idx", sort=True):
        if last is not None:
            for empty in range(last + 1, min(f, last + forget + 2)):
                yield empty, []
        yield f, g.to_dict("records")
        last = f

