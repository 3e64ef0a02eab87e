"""Folds over frames that know when they next have work without rows, with a state that is a typed row.

A fold has ``start()``, ``step(state, frame, rows) -> (state, out)``, and
``due(state)``: the next frame at which something happens though no row comes
(a coasted box, an expiry), or None.  ``dump`` and ``load`` turn a state into the
columns of ``schema`` and back; a state of None holds nothing and is removed.
``advance`` runs a fold up to a frame; batch and stream run nothing else, so
they give the same rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators import folds, identity
from ..operators.detections import BALL

MATCH_KEY = "match_id"
BLOCK = 4096  # stretches whose keyframes are counted together


def advance(fold, state, rows: list[dict], clock: float, until: float = math.inf) -> tuple[object, list[dict], int | None]:
    """(state, made rows, next frame with work) after all frames up to ``clock``; past ``until`` nothing happens and nothing is kept."""
    out, i = [], 0
    while True:
        due = None if state is None else fold.due(state)
        frame = min((f for f in (due, rows[i]["frame_idx"] if i < len(rows) else None) if f is not None), default=None)
        if frame is None or frame > min(clock, until):
            if clock >= until:
                return None, out, None
            if frame is not None and frame <= until:
                return state, out, frame
            return state, out, (None if state is None or until == math.inf else until)
        begin = i
        while i < len(rows) and rows[i]["frame_idx"] == frame:
            i += 1
        state, made = fold.step(fold.start() if state is None else state, frame, rows[begin:i])
        out += made


def plain(values, kind: T.DataType) -> list:
    """A pandas column as Python values of a type, with None for what is missing."""
    if isinstance(kind, T.ArrayType):
        return [None if v is None else [None if x is None else float(x) for x in v] for v in values]
    make = {T.LongType: int, T.IntegerType: int, T.DoubleType: float, T.BooleanType: bool}.get(type(kind), lambda x: x)
    return [None if folds.missing(v) else make(v) for v in values]


def records(pdf: pd.DataFrame, fields: T.StructType) -> list[tuple]:
    return list(zip(*(plain(pdf[f.name].tolist(), f.dataType) for f in fields), strict=True))


def row_columns(df: DataFrame, keys: Sequence[str], fields: str, *more: str) -> DataFrame:
    """The keys, ``more`` and the fields of a fold in their types; a field that ``df`` lacks is null."""
    kinds, present = T.StructType.fromDDL(fields), {c.lower() for c in df.columns}
    return df.select(*keys, *more, *((F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds if f.name not in keys))


def row_order(row: dict) -> tuple:
    return row["frame_idx"], -1 if row.get("det_idx") is None else row["det_idx"]


def folded(df: DataFrame, fold, keys: Sequence[str], fields: str, schema: str) -> DataFrame:
    """Batch: the rows (``fields``: frame_idx first, then det_idx and so on) of each key in order of frames, up to ``last_frame`` where they have one, else the key's last."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    keys = list(keys)

    def match(rows: Iterator[tuple[tuple, dict]]) -> Iterator[list[dict]]:
        """What one key makes, as its frames are whole; rows of one frame are held."""
        state, until, frame, held = None, None, None, []
        for _, row in rows:
            if until is None and row.get("last_frame") is not None:
                until = row["last_frame"]
            if held and row["frame_idx"] != frame:
                state, made, _ = advance(fold, state, held, frame, math.inf if until is None else until)
                held = []
                yield made
            frame = row["frame_idx"]
            held.append(row)
        yield advance(fold, state, held, math.inf, frame if until is None else until)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, rows in groupby(folds.sorted_rows(batches, keys), lambda r: r[0]):
            for made in match(rows):
                out += [dict(zip(keys, key, strict=True)) | m for m in made]
                if len(out) >= folds.SLICE:
                    yield pa.RecordBatch.from_pylist(out, kinds)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    rows = row_columns(df, keys, fields)
    by = ["frame_idx", *(F.coalesce(c, F.lit(-1)) for c in ("det_idx",) if c in rows.columns)]
    return folds.ordered(rows, keys, by).mapInArrow(run, schema)


warped, _sane = identity.warped, identity.bounded


class Coast:
    """One track: boxes as they come, up to ``most`` coasted ones after a loss, gone after ``forget`` frames without a row."""

    schema = "seen long, cx double, cy double, vx double, vy double, w double, h double, at long"
    fields = "frame_idx long, det_idx long, x1 double, y1 double, x2 double, y2 double, conf double, last_frame long"
    out = "match_id long, track_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double, conf double, coasted boolean"

    def __init__(self, most: int = 4, forget: int = 45, damping: float = 0.85):
        self.most, self.forget, self.damping = most, forget, damping

    def start(self):
        return None

    def dump(self, state):
        return state

    load = dump

    def due(self, state) -> int:
        seen, at = state[0], state[-1]
        return at + 1 if at - seen < self.most else seen + self.forget + 1

    def step(self, state, frame: int, rows: list[dict]):
        out = []
        for r in rows:
            c = (r["x1"] + r["x2"]) / 2, (r["y1"] + r["y2"]) / 2
            v = (0.0, 0.0) if state is None else (c[0] - state[1], c[1] - state[2])
            state = (frame, *c, *v, r["x2"] - r["x1"], r["y2"] - r["y1"], frame)
            out.append({n: r[n] for n in ("frame_idx", "x1", "y1", "x2", "y2", "conf")} | {"coasted": False})
        if rows or state is None:
            return state, out
        seen, cx, cy, vx, vy, w, h, _ = state
        lost = frame - seen
        if lost > self.forget:
            return None, []
        k = self.damping**lost
        cx, cy = cx + vx * k, cy + vy * k
        return (seen, cx, cy, vx, vy, w, h, frame), [{"frame_idx": frame, "x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w / 2, "y2": cy + h / 2, "conf": 0.5, "coasted": True}]


class Gallery:
    """Appearance of one track: a normalised moving average, with the latest place and known team and role; expires ``age`` frames after its last sight.

    Each sight gives the entry as it is then, the expiry the entry with ``live`` false.
    """

    schema = "emb array<double>, team_id long, role_id long, x_m double, y_m double, last_seen long, n long"
    fields = "frame_idx long, det_idx long, emb array<double>, team_id long, role_id long, x_m double, y_m double, last_frame long"
    out = f"match_id long, track_id long, frame_idx long, {schema}, live boolean"

    def __init__(self, keep: float = 0.85, age: int = 300):
        self.keep, self.age = keep, age

    def start(self):
        return {"emb": None, "team_id": None, "role_id": None, "x_m": None, "y_m": None, "last_seen": None, "n": 0}

    def dump(self, state):
        return tuple(state.values())

    def load(self, row):
        return dict(zip(self.start(), row, strict=True))

    def due(self, state) -> int:
        return state["last_seen"] + self.age + 1

    def step(self, state, frame: int, rows: list[dict]):
        out = []
        if state["last_seen"] is not None and frame - state["last_seen"] > self.age:
            out.append({"frame_idx": frame, **state, "live": False})
            state = self.start()
        for r in rows:
            v = np.asarray(r["emb"], float)
            if state["emb"] is not None:
                v = self.keep * np.asarray(state["emb"], float) + (1 - self.keep) * v
            n = np.linalg.norm(v)
            state = state | {"emb": (v / n if n > 0 else v).tolist(), "last_seen": frame, "n": state["n"] + 1}
            for c in ("team_id", "role_id"):
                if r[c] is not None and r[c] >= 0:
                    state[c] = r[c]
            if r["x_m"] is not None:
                state |= {"x_m": r["x_m"], "y_m": r["y_m"]}
            out.append({"frame_idx": frame, **state, "live": True})
        return (state if state["n"] else None), out


class Carry:
    """Boxes on every frame while the detector runs on every ``every``-th only.

    Each frame has a row with the camera's map, or one for each box found on a
    keyframe.  A frame first moves the boxes by the map.  Off the keyframes a
    box then goes on by nine tenths of its velocity; on a keyframe without its
    track it is lost once more and coasts.  Beyond ``most`` losses it is not
    shown, beyond ``forget`` it is gone.
    """

    schema = "tracks array<double>, boxes array<double>, vs array<double>, confs array<double>, losses array<double>"
    fields = "frame_idx long, det_idx long, track_id long, x1 double, y1 double, x2 double, y2 double, conf double, affine array<double>, last_frame long"
    out = "match_id long, frame_idx long, track_id long, x1 double, y1 double, x2 double, y2 double, conf double, kind string"

    def __init__(self, every: int = 3, most: int = 4, forget: int = 45, damping: float = 0.85):
        self.every, self.most, self.forget, self.damping = every, most, forget, damping

    def start(self):
        return {}

    def dump(self, state):
        flat = lambda i: [float(x) for s in state.values() for x in s[i]]
        return [float(t) for t in state], flat(0), flat(1), [float(s[2]) for s in state.values()], [float(s[3]) for s in state.values()]

    def load(self, row):
        tracks, boxes, vs, confs, losses = ([float(x) for x in c] for c in row)
        return {int(t): (tuple(boxes[4 * i : 4 * i + 4]), tuple(vs[2 * i : 2 * i + 2]), confs[i], int(losses[i])) for i, t in enumerate(tracks)}

    def due(self, state) -> None:
        return None

    def step(self, state, frame: int, rows: list[dict]):
        found = {r["track_id"]: tuple(r[c] for c in ("x1", "y1", "x2", "y2", "conf")) for r in rows if r["x1"] is not None and r["track_id"] is not None}
        if not state and not found:
            return None, []
        affine = next((tuple(map(float, r["affine"])) for r in rows if r["affine"] is not None), None)
        affine = affine if affine is not None and all(map(math.isfinite, affine)) else None
        state, out = dict(state), []
        for track in [*state, *(t for t in found if t not in state)]:
            state[track], shown = self.one(state.get(track), frame, affine, found.get(track))
            if state[track] is None:
                del state[track]
            if shown is not None:
                box, conf, kind = shown
                out.append({"frame_idx": frame, "track_id": track, **dict(zip(("x1", "y1", "x2", "y2"), box, strict=True)), "conf": conf, "kind": kind})
        return state or None, out

    def one(self, state, frame: int, affine, found):
        """(state, what is shown) of one track after a frame; ``affine`` is finite or None, ``found`` its box and confidence."""
        if state is not None and affine is not None:
            box = warped(state[0], affine)
            state = None if box is None else (box, *state[1:])
        if found is not None:
            x1, y1, x2, y2, conf = found
            box, v = (x1, y1, x2, y2), (0.0, 0.0)
            if state is not None:
                sx1, sy1, sx2, sy2 = state[0]
                v = (x1 + x2 - sx1 - sx2) / 2, (y1 + y2 - sy1 - sy2) / 2
            return (box, v, conf, 0), (box, conf, "found")
        if state is None:
            return None, None
        (x1, y1, x2, y2), (vx, vy), conf, lost = state
        key = frame % self.every == 0
        lost += key
        if lost > self.forget:
            return None, None
        if lost > self.most:
            return (state[0], state[1], conf, lost), None
        k = self.damping**lost if key else 0.9
        box = x1 + vx * k, y1 + vy * k, x2 + vx * k, y2 + vy * k
        if not key and _sane(box) is None:
            return None, None
        return (box, (vx, vy), conf, lost), (box, 0.5 if key else conf * 0.98, "coasted" if key else "carried")


class Tracking:
    """A match with control rows: tracker, possession and distances in one state, of which a cut resets the motion of the tracker alone.

    A row with ``cut`` true and no box is the control event.  A row of a frame
    may carry the camera's map.  Possession goes by the nearest box to the ball
    (metres by ``px_per_m``) and distances by track are kept through cuts; a
    track that is recognised after a cut goes on with its own distance.
    """

    schema = "tracker string, holder string, walked string, at long"
    fields = "frame_idx long, det_idx long, class_id int, x1 double, y1 double, x2 double, y2 double, conf double, emb array<double>, team_id long, role_id long, affine array<double>, cut boolean, last_frame long"
    out = "match_id long, frame_idx long, track_id long, class_id int, x1 double, y1 double, x2 double, y2 double, conf double, coasted boolean, walked_px double, holder_id long, reassigned long"

    def __init__(self, px_per_m: float = 20.0, **tracker):
        self.px_per_m, self.options = px_per_m, tracker

    def start(self):
        return {"tracker": identity.MatchTracker(**self.options), "holder": folds.possession_start(), "walked": {}, "at": -1}

    def dump(self, state):
        return json.dumps(state["tracker"].dump()), json.dumps(state["holder"]), json.dumps(state["walked"]), state["at"]

    def load(self, row):
        state = self.start()
        state["tracker"].load(json.loads(row[0]))
        return state | {"holder": json.loads(row[1]), "walked": {int(t): v for t, v in json.loads(row[2]).items()}, "at": row[3]}

    def due(self, state) -> int | None:
        return state["at"] + 1 if state["tracker"].last else None

    def step(self, state, frame: int, rows: list[dict]):
        boxes = [r for r in rows if r["x1"] is not None]
        affine = next((r["affine"] for r in rows if r["affine"] is not None), None)
        made = state["tracker"].step(frame, boxes, any(r["cut"] for r in rows), affine)
        people, balls = [], []
        for m in made:
            if m["class_id"] != BALL:
                people.append((m["track_id"], ((m["x1"] + m["x2"]) / 2, (m["y1"] + m["y2"]) / 2)))
            else:
                balls.append(((m["x1"] + m["x2"]) / 2, (m["y1"] + m["y2"]) / 2))
        near = min(((math.dist(c, balls[0]) / self.px_per_m, t) for t, c in people), default=None) if balls else None
        row = {"frame_idx": frame, "candidate": near[1] if near and near[0] <= 1.8 else None, "candidate_team": None, "dist_m": near[0] if near else 999.0, "contested": False}
        holder, held = folds.possession_step(state["holder"], row)
        walked = state["walked"]
        for t, (x, y) in people:
            old = walked.get(t)
            walked[t] = [x, y, frame, (old[3] + math.dist((x, y), old[:2]) if frame - old[2] == 1 else old[3]) if old else 0.0]
        known = state["tracker"].gallery.keys() | {state["tracker"].alias.get(t, t) for t in state["tracker"].last}
        state = state | {"holder": holder, "walked": {t: v for t, v in walked.items() if t in known}, "at": frame}
        extra = {"holder_id": held["holder_id"], "reassigned": state["tracker"].reassigned}
        return state, [m | extra | {"walked_px": walked[m["track_id"]][3] if m["class_id"] != BALL else None} for m in made]


def coasted(dets: DataFrame) -> DataFrame:
    """Tracked boxes with coasting over short losses, up to the match's last frame with boxes; one group a track."""
    ends = F.max("frame_idx").over(W.partitionBy("match_id"))
    return folded(dets.withColumn("last_frame", ends), Coast(), ["match_id", "track_id"], Coast.fields, Coast.out)


def _stretches(motion: DataFrame, every: int) -> DataFrame:
    """A row (match_id, part) for each ``every`` frames with a camera row: the frames in order, their maps end to end, whether the keyframe is among them, and ``n``, the number of keyframes up to there.

    Keyframes are counted in blocks of a match side by side; what went before a
    block is added.
    """
    part = F.floor(F.col("frame_idx") / every).cast("long")
    of = motion.select("match_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("affine").cast("array<double>").alias("affine"), part.alias("part"), F.floor(part / BLOCK).alias("block")).where("match_id is not null and frame_idx is not null")
    at_key = F.col("frame_idx") == F.col("part") * every
    blocks = of.groupBy("match_id", "block").agg(F.count_distinct(F.when(at_key, F.col("part"))).alias("here"))
    before = blocks.select("match_id", "block", (F.sum("here").over(W.partitionBy("match_id").orderBy("block")) - F.col("here")).alias("before"))
    rows = of.repartition("match_id", "block").groupBy("match_id", "block", "part").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "affine"))).alias("rows"), F.max(at_key).alias("key"))
    count = F.sum(F.col("key").cast("long")).over(W.partitionBy("match_id", "block").orderBy("part"))
    affine = lambda m: F.when(F.size(m["affine"]) == 6, m["affine"]).otherwise(F.array_repeat(F.lit(float("nan")), 6))
    known = rows.select("match_id", "block", "part", "key", count.alias("count"), F.transform("rows", lambda m: m["frame_idx"]).alias("frames"), F.flatten(F.transform("rows", affine)).alias("maps"))
    return known.join(before, ["match_id", "block"]).select("match_id", "part", "key", (F.col("before") + F.col("count")).alias("n"), "frames", "maps")


def carried(keyframes: DataFrame, motion: DataFrame, every: int = 3, **options) -> DataFrame:
    """Boxes on every frame of ``motion(match_id, frame_idx, affine)`` from ``keyframes(match_id, frame_idx, track_id, x1, y1, x2, y2, conf)``.

    A track meets the camera rows of the stretches in which it is shown or goes
    on to its next box (equi join on match and number of keyframes), so its
    chain is a group of its own, with a row a stretch; boxes off the keyframes
    are left out.  A box that comes when its track is forgotten starts afresh.
    """
    fold = Carry(every, **options)
    parts = _stretches(motion, every)
    found = keyframes.where((F.col("frame_idx") % every == 0) & F.col("track_id").isNotNull() & F.col("x1").isNotNull())
    own = found.withColumn("part", F.floor(F.col("frame_idx") / every).cast("long")).join(parts.where("key").select("match_id", "part", "n"), ["match_id", "part"])
    of_track = W.partitionBy("match_id", "track_id").orderBy("n")
    previous, following = F.max("n").over(of_track.rangeBetween(W.unboundedPreceding, -1)), F.lead("n").over(of_track)
    known = own.withColumns({"fresh": F.coalesce(F.col("n") - previous > fold.forget + 1, F.lit(True)), "following": following}).where("following is null or following > n")
    last = F.when(F.col("following") - F.col("n") <= fold.forget + 1, F.col("following") - 1).otherwise(F.col("n") + fold.most)
    boxes = (F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "conf"))
    lives = known.select("match_id", "track_id", F.col("frame_idx").alias("at"), "fresh", *boxes, F.explode(F.sequence("n", last)).alias("n"))
    rows = lives.join(parts.select("match_id", "n", "part", "frames", "maps"), ["match_id", "n"]).select("match_id", "track_id", "part", "at", "fresh", "x1", "y1", "x2", "y2", "conf", "frames", "maps")
    kinds = to_arrow_schema(T.StructType.fromDDL(fold.out))

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            ends, frames, maps = batch["frames"].offsets.to_pylist(), batch["frames"].values.to_pylist(), batch["maps"].values.to_numpy(zero_copy_only=False).reshape(-1, 6)
            finite, maps = np.isfinite(maps).all(1).tolist(), maps.tolist()
            columns = [batch[c].to_pylist() for c in ("match_id", "track_id", "at", "fresh", "x1", "y1", "x2", "y2", "conf")]
            for i, (match, track, at, fresh, *box) in enumerate(zip(*columns, strict=True)):
                if (match, track) != now:
                    now, state = (match, track), None
                end = ends[i + 1]
                for j in range(ends[i], end):
                    frame = frames[j]
                    if j + 1 < end and frames[j + 1] == frame:
                        continue  # of rows of one frame the last has a map, if any has
                    if frame == at and fresh:
                        state = None
                    state, shown = fold.one(state, frame, maps[j] if finite[j] else None, box if frame == at else None)
                    if shown is not None:
                        out.append((match, frame, track, *shown[0], shown[1], shown[2]))
                if len(out) >= folds.SLICE:
                    yield made(out)
                    out = []
        if out:
            yield made(out)

    return folds.ordered(rows, ["match_id", "track_id"], ["part"]).mapInArrow(run, fold.out)


def tracked_with_cuts(rows: DataFrame, **options) -> DataFrame:
    """``Tracking`` over each match: boxes with appearance, and control rows of cuts among them."""
    return folded(rows, Tracking(**options), ["match_id"], Tracking.fields, Tracking.out)
