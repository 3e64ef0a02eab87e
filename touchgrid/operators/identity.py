"""Re-identification across cuts and the association of boxes to tracks."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G
from . import folds, spliced
from .detections import BALL, sane
from .kinematics import box_velocity

CONFLICT = 99.0
_MANY = 4096  # pairs of tracks and boxes up to which plain floats are faster than arrays


def gallery(observations: DataFrame, keep: float = 0.85) -> DataFrame:
    """Appearance of each track: a normalised moving average of unit vectors; the latest place, and the latest known team and role (0 or more), stay."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx", kind="stable")
        v = None
        for e in pdf["emb"]:
            e = np.asarray(e, float)
            v = e if v is None else keep * v + (1 - keep) * e
            n = np.linalg.norm(v)
            v = v / n if n > 0 else v

        def known(c, least=None):
            found = pdf[c].dropna()
            found = found if least is None else found[found >= least]
            return None if found.empty else found.iloc[-1]

        return pd.DataFrame([{"match_id": pdf["match_id"].iloc[0], "track_id": pdf["track_id"].iloc[0], "emb": v.tolist(), "team_id": known("team_id", 0), "role_id": known("role_id", 0), "x_m": known("x_m"), "y_m": known("y_m"), "last_seen": pdf["frame_idx"].iloc[-1], "n": len(pdf)}])

    return _with_role(observations).groupBy("match_id", "track_id").applyInPandas(run, "match_id long, track_id long, emb array<double>, team_id long, role_id long, x_m double, y_m double, last_seen long, n long")


def _with_role(df: DataFrame) -> DataFrame:
    return df if "role_id" in df.columns else df.withColumn("role_id", F.lit(None).cast("long"))


def active(tracks: DataFrame, now: int, age: int = 300) -> DataFrame:
    return tracks.filter(now - F.col("last_seen") <= age)


def pair_costs(candidates: DataFrame, tracks: DataFrame) -> DataFrame:
    """Cost of each candidate and track of a match: 1 - cosine and a distance prior; known teams or roles that differ cost ``CONFLICT``.

    Both sides of a cut are a few dozen rows; the equi key is the match.
    """
    t = _with_role(tracks).select("match_id", "track_id", F.col("emb").alias("t_emb"), F.col("team_id").alias("t_team"), F.col("role_id").alias("t_role"), F.col("x_m").alias("t_x"), F.col("y_m").alias("t_y"))
    pairs = _with_role(candidates).join(t, "match_id")
    differ = lambda a, b: F.coalesce((F.col(a) >= 0) & (F.col(b) >= 0) & (F.col(a) != F.col(b)), F.lit(False))
    conflict = differ("team_id", "t_team") | differ("role_id", "t_role")
    away = G.distance("x_m", "y_m", "t_x", "t_y")
    prior = F.when(away.isNull(), 0.0).otherwise(0.20 * F.least(F.lit(1.0), away / 40.0))
    return pairs.select("match_id", "det_idx", "track_id", F.when(conflict, CONFLICT).otherwise(1.0 - G.cosine("emb", "t_emb") + prior).alias("cost"))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Cheapest one-to-one pairs (shortest augmenting paths with potentials, O(n^3))."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    turn = cost.shape[0] > cost.shape[1]
    c = cost.T if turn else cost
    n, m = c.shape
    least = c.argmin(1)
    if len(set(least.tolist())) == n:  # every row can have its cheapest column
        return sorted((j, i) if turn else (i, j) for i, j in enumerate(least.tolist()))
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            free = ~used[1:]
            now = c[i0 - 1] - u[i0] - v[1:]
            better = free & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((j, i) if turn else (i, j) for i, j in pairs)


def matched(costs: DataFrame, most: float = 0.42) -> DataFrame:
    """Assigned pairs of each match under the threshold; score is 1 - cost."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot(index="det_idx", columns="track_id", values="cost").fillna(CONFLICT)
        rows = [(pdf["match_id"].iloc[0], table.index[i], table.columns[j], 1.0 - table.iat[i, j]) for i, j in assignment(table.to_numpy()) if table.iat[i, j] <= most]
        return pd.DataFrame(rows, columns=["match_id", "det_idx", "track_id", "score"])

    return costs.groupBy("match_id").applyInPandas(run, "match_id long, det_idx long, track_id long, score double")


def unmatched(candidates: DataFrame, pairs: DataFrame, key: str = "det_idx") -> DataFrame:
    return candidates.join(pairs, ["match_id", key], "left_anti")


def propagated_boxes(dets: DataFrame) -> DataFrame:
    """Boxes on a skipped frame: moved by nine tenths of their velocity, a little less sure; what leaves all bounds is gone."""
    df = box_velocity(dets)
    dx, dy = (0.9 * F.coalesce(c, F.lit(0.0)) for c in ("vx", "vy"))
    moved = df.withColumns({"x1": F.col("x1") + dx, "x2": F.col("x2") + dx, "y1": F.col("y1") + dy, "y2": F.col("y2") + dy, "conf": F.col("conf") * 0.98, "frame_idx": F.col("frame_idx") + 1})
    return sane(moved.drop("vx", "vy"), "x1", "y1", "x2", "y2")


class Tracker:
    """Two-stage association: sure boxes meet all tracks by IoU of predicted boxes, unsure ones the tracks left over."""

    def __init__(self, high: float = 0.5, low: float = 0.1, iou: float = 0.2, second: float = 0.5, forget: int = 30):
        self.high, self.low, self.iou, self.second, self.forget = high, low, iou, second, forget
        self.tracks: dict[int, dict] = {}
        self.next = 1

    @staticmethod
    def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
        inter = np.clip(hi - lo, 0, None).prod(2)
        area = lambda x: (x[:, 2:] - x[:, :2]).prod(1)
        union = area(a)[:, None] + area(b)[None] - inter
        return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)

    def _meet(self, ids: list[int], boxes: list[tuple], which: list[int], least: float) -> list[tuple[int, int]]:
        if not ids or not which:
            return []
        if len(ids) * len(which) > _MANY or not all(map(_plain, boxes)) or not all(_plain(self.tracks[t]["box"]) for t in ids):
            v = np.array([self.tracks[t]["v"] for t in ids])
            ahead = np.array([self.tracks[t]["box"] for t in ids]) + np.concatenate([v, v], 1)
            got = self._iou(ahead, np.array(boxes)[which])
            rows, cols = np.flatnonzero(got.max(1) >= least), np.flatnonzero(got.max(0) >= least)  # the rest has no partner
            return [(ids[rows[i]], which[cols[j]]) for i, j in assignment(1.0 - got[np.ix_(rows, cols)]) if got[rows[i], cols[j]] >= least]
        over = self._overlaps(ids, [boxes[i] for i in which])
        hits = [p for p, g in over.items() if g >= least]
        if not hits:
            return []
        rows, cols = sorted({a for a, _ in hits}), sorted({b for _, b in hits})
        side = 0 if len(rows) <= len(cols) else 1
        best: dict[int, tuple] = {}  # the cheapest partner of each member of the smaller side; it is a hit, as each has one
        for p in sorted(hits):
            cost = 1.0 - over[p]
            if p[side] not in best or cost < best[p[side]][0]:
                best[p[side]] = cost, p
        pairs = sorted(p for _, p in best.values())
        if len({p[1 - side] for p in pairs}) < len(pairs):
            cost = np.array([[1.0 - over.get((a, b), 0.0) for b in cols] for a in rows])
            pairs = [(rows[i], cols[j]) for i, j in assignment(cost)]
        return [(ids[a], which[b]) for a, b in pairs if over.get((a, b), 0.0) >= least]

    def _overlaps(self, ids: list[int], boxes: list[tuple]) -> dict[tuple[int, int], float]:
        """IoU of the predicted boxes of tracks with boxes, for the pairs that overlap; ``_iou`` in plain floats, which for some dozens are faster than arrays."""
        out = {}
        for a, t in enumerate(ids):
            s = self.tracks[t]
            x1, y1, x2, y2 = s["box"]
            vx, vy = s["v"]
            x1, y1, x2, y2 = x1 + vx, y1 + vy, x2 + vx, y2 + vy
            for b, (bx1, by1, bx2, by2) in enumerate(boxes):
                if bx1 < x2 and x1 < bx2 and by1 < y2 and y1 < by2:
                    w, h = (x2 if x2 < bx2 else bx2) - (x1 if x1 > bx1 else bx1), (y2 if y2 < by2 else by2) - (y1 if y1 > by1 else by1)
                    if w > 0 and h > 0:
                        inter = w * h
                        union = (x2 - x1) * (y2 - y1) + (bx2 - bx1) * (by2 - by1) - inter
                        if union > 0:
                            out[a, b] = inter / union
        return out

    def frame(self, boxes: list[tuple], conf: list[float]) -> list[int]:
        """Track ids of the boxes of the next frame (-1: too unsure to start a track)."""
        out = [-1] * len(boxes)
        met = set()
        if len(boxes):
            boxes = [tuple(map(float, b)) for b in boxes]
            sure, unsure = [i for i, c in enumerate(conf) if c >= self.high], [i for i, c in enumerate(conf) if self.low <= c < self.high]
            pairs = self._meet(list(self.tracks), boxes, sure, self.iou)
            met = {p[0] for p in pairs}
            if unsure:
                pairs += self._meet([t for t in self.tracks if t not in met], boxes, unsure, self.second)
                met = {p[0] for p in pairs}
            for t, i in pairs:
                (x, y), (ox, oy) = centre(boxes[i]), centre(self.tracks[t]["box"])
                out[i] = t
                self.tracks[t] = {"box": boxes[i], "v": (x - ox, y - oy), "lost": 0}
        gone = []
        for t, s in self.tracks.items():
            if t not in met:
                s["lost"] += 1
                if s["lost"] > self.forget:
                    gone.append(t)
        for t in gone:
            del self.tracks[t]
        if len(boxes):
            for i in sure:
                if out[i] < 0:
                    out[i] = self.next
                    self.tracks[self.next] = {"box": boxes[i], "v": (0.0, 0.0), "lost": 0}
                    self.next += 1
        return out


def centre(b: tuple) -> tuple[float, float]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def _plain(b: tuple) -> bool:
    """Whether a box has numbers only that no sum or product of two takes out of bounds."""
    x1, y1, x2, y2 = b
    return -1e100 < x1 < 1e100 and -1e100 < y1 < 1e100 and -1e100 < x2 < 1e100 and -1e100 < y2 < 1e100


def warped(box: tuple, affine) -> tuple | None:
    """The box round the moved corners of a box (x1, y1, x2, y2), in plain floats, which for one box are faster than arrays; None where it is out of all bounds."""
    (x1, y1, x2, y2), (a, b, c, d, e, f) = box, affine
    ax, bx, ay, by = a * x1, a * x2, b * y1, b * y2
    dx, ex, ey, fy = d * x1, d * x2, e * y1, e * y2
    # sums of the least and of the greatest terms are the least and the greatest of the corners, to the last bit
    low = (ax if ax < bx else bx) + (ay if ay < by else by) + c, (dx if dx < ex else ex) + (ey if ey < fy else fy) + f
    high = (bx if ax < bx else ax) + (by if ay < by else ay) + c, (ex if dx < ex else dx) + (fy if ey < fy else ey) + f
    return bounded((*low, *high))


def bounded(box: tuple, most: float = 10_000.0) -> tuple | None:
    x1, y1, x2, y2 = box
    return box if -most <= x1 <= most and -most <= y1 <= most and -most <= x2 <= most and -most <= y2 <= most else None


def associated(dets: DataFrame, cut_frames: DataFrame | None = None, stretch: int = 30_000, warm: int = 3_000) -> DataFrame:
    """Track ids of person boxes (the ball keeps -1); cuts forget all tracks.  Stretches of a match run side by side (``spliced``)."""
    df = dets if cut_frames is None else dets.join(cut_frames.select("match_id", "frame_idx", F.lit(True).alias("cut")), ["match_id", "frame_idx"], "left")
    if cut_frames is None:
        df = df.withColumn("cut", F.lit(False))

    cols = ["match_id", "frame_idx", "det_idx", "class_id", "x1", "y1", "x2", "y2", "conf", "cut"]
    return spliced.tracks(df.select(*cols), _Association, ["det_idx"], "match_id long, frame_idx long, det_idx long, track_id long", stretch, warm)


class _Association:
    """``Tracker`` over the frames that have boxes."""

    def __init__(self):
        self.tracker = Tracker()

    def step(self, frame: int, rows: list[dict]) -> list[dict]:
        if any(r["cut"] for r in rows):
            self.tracker.tracks.clear()
        people = [r for r in rows if r["class_id"] != BALL]
        found = iter(self.tracker.frame([_box(r) for r in people], [_conf(r) for r in people]))
        return [{"frame_idx": frame, "det_idx": r["det_idx"], "track_id": -1 if r["class_id"] == BALL else next(found)} for r in rows]

    def until(self, frame: int) -> list[dict]:
        return []

    def mark(self) -> tuple[bytes, list[int], int]:
        return marked(self.tracker, {})


def marked(tracker: Tracker, last: dict) -> tuple[bytes, list[int], int]:
    """(state with tracks by their place among the live ones, their numbers, the next number)."""
    alive = sorted(tracker.tracks.keys() | last.keys())
    at = {t: i for i, t in enumerate(alive)}
    plain = lambda d: [(at[t], s["box"], s["v"], s["lost"]) for t, s in d.items()]
    return json.dumps([plain(tracker.tracks), plain(last)]).encode(), alive, tracker.next


class MatchTracker:
    """One step a frame of the whole tracking: cuts, camera motion, association, re-identification, coasting.

    A cut forgets boxes and velocities; boxes of the cut frame are held against
    the gallery, and a track that is recognised keeps its old number from then
    on.  Tracks that are missing coast for ``coast`` frames and are forgotten
    after ``forget``; gallery entries expire after ``age`` frames.  The state
    is this object: batch and stream run the same ``step``.
    """

    def __init__(self, most: float = 0.42, keep: float = 0.85, coast: int = 4, forget: int = 45, age: int = 300):
        self.most, self.keep, self.coast, self.forget, self.age = most, keep, coast, forget, age
        self.tracker = Tracker()
        self.alias: dict[int, int] = {}
        self.gallery: dict[int, dict] = {}
        self.last: dict[int, dict] = {}
        self.reassigned = 0

    def dump(self) -> dict:
        """The state as plain values."""
        plain = lambda d: {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in d.items()}
        parts = {"tracks": self.tracker.tracks, "gallery": self.gallery, "last": self.last}
        return {n: [[int(t), plain(x)] for t, x in p.items()] for n, p in parts.items()} | {"alias": [[int(t), int(n)] for t, n in self.alias.items()], "next": self.tracker.next, "reassigned": self.reassigned}

    def load(self, state: dict) -> None:
        """Takes up a state of ``dump``."""
        arrays = lambda d: {k: np.array(v, float) if k == "emb" else tuple(v) if k in ("box", "v") else v for k, v in d.items()}
        self.tracker.tracks, self.gallery, self.last = ({t: arrays(x) for t, x in state[n]} for n in ("tracks", "gallery", "last"))
        self.alias, self.tracker.next, self.reassigned = {t: n for t, n in state["alias"]}, state["next"], state["reassigned"]

    def _warp(self, affine) -> None:
        affine = tuple(map(float, affine))
        for t, s in list(self.last.items()):
            box = warped(s["box"], affine)
            if box is None:
                del self.last[t]
                continue
            s["box"] = box
            if t in self.tracker.tracks:
                self.tracker.tracks[t]["box"] = box

    def _recognise(self, frame: int, rows: list[dict], ids: list[int]) -> None:
        known = [t for t, g in self.gallery.items() if frame - g["seen"] <= self.age]
        which = [i for i, t in enumerate(ids) if t >= 0 and rows[i].get("emb") is not None]
        if not known or not which:
            return
        cost = np.full((len(which), len(known)), CONFLICT)
        for a, i in enumerate(which):
            r, e = rows[i], unit(rows[i]["emb"])
            kinds = [(c, r[c]) for c in ("team_id", "role_id") if not folds.missing(r.get(c)) and r[c] >= 0]
            placed = not folds.missing(r.get("x_m"))
            for b, t in enumerate(known):
                g = self.gallery[t]
                if kinds and any(g[c] is not None and k != g[c] for c, k in kinds):
                    continue
                now = 1.0 - min(max(float(e @ g["emb"]), -1.0), 1.0)
                if placed and g["at"] is not None:
                    now += 0.20 * min(1.0, float(np.hypot(r["x_m"] - g["at"][0], r["y_m"] - g["at"][1])) / 40.0)
                cost[a, b] = now
        for a, b in assignment(cost):
            if cost[a, b] <= self.most:
                self.alias[ids[which[a]]] = known[b]
                self.reassigned += 1

    def _remember(self, frame: int, sights: list[tuple[dict, int]]) -> None:
        """Takes up what a frame shows of each track; sums and quotients of all at once are those of one by one."""
        sights = [(r, t) for r, t in sights if r.get("emb") is not None]
        if len({t for _, t in sights}) < len(sights) or len({len(r["emb"]) for r, _ in sights}) > 1:
            for one in sights:
                self._remember(frame, [one])
            return
        if not sights:
            return
        e = units(np.array([r["emb"] for r, _ in sights], float))
        old = [i for i, (_, t) in enumerate(sights) if t in self.gallery]
        now = dict(zip(old, units(self.keep * np.array([self.gallery[sights[i][1]]["emb"] for i in old]) + (1 - self.keep) * e[old]), strict=True)) if old else {}
        for i, (r, t) in enumerate(sights):
            team, role, x = r.get("team_id"), r.get("role_id"), r.get("x_m")
            team, role = (None if folds.missing(k) or k < 0 else int(k) for k in (team, role))
            at = None if folds.missing(x) else (x, r["y_m"])
            if i not in now:
                self.gallery[t] = {"emb": e[i], "team_id": team, "role_id": role, "at": at, "seen": frame}
                continue
            g = self.gallery[t]
            g["emb"], g["seen"], g["at"] = now[i], frame, at or g["at"]
            g["team_id"], g["role_id"] = g["team_id"] if team is None else team, g["role_id"] if role is None else role

    def step(self, frame: int, rows: list[dict], is_cut: bool = False, affine=None) -> list[dict]:
        """Boxes of a frame with their tracks, coasted boxes after them, the ball (track -1) last."""
        people, balls = [r for r in rows if r["class_id"] != BALL], [r for r in rows if r["class_id"] == BALL]
        if is_cut:
            self.tracker.tracks.clear()
            self.last.clear()
        elif affine is not None:
            self._warp(affine)
        boxes = [_box(r) for r in people]
        ids = self.tracker.frame(boxes, [_conf(r) for r in people])
        if is_cut:
            self._recognise(frame, people, ids)
        out, last, alias = [], self.last, self.alias
        seen, sights = set(), []
        for r, t, b in zip(people, ids, boxes, strict=True):
            if t < 0:
                continue
            old, v = last.get(t), (0.0, 0.0)
            if old:
                (x, y), (ox, oy) = centre(b), centre(old["box"])
                v = x - ox, y - oy
            last[t] = {"box": b, "v": v, "lost": 0}
            seen.add(t)
            name = alias.get(t, t)
            sights.append((r, name))
            out.append({"frame_idx": frame, "track_id": name, "class_id": int(r["class_id"]), "x1": b[0], "y1": b[1], "x2": b[2], "y2": b[3], "conf": float(r["conf"]), "coasted": False})
        self._remember(frame, sights)
        gone = []
        for t, s in last.items():
            if t in seen:
                continue
            s["lost"] = lost = s["lost"] + 1
            if lost > self.forget:
                gone.append(t)
            elif lost <= self.coast and not is_cut:
                k, (vx, vy), (x1, y1, x2, y2) = 0.85**lost, s["v"], s["box"]
                vx, vy = vx * k, vy * k
                s["box"] = x1, y1, x2, y2 = x1 + vx, y1 + vy, x2 + vx, y2 + vy
                out.append({"frame_idx": frame, "track_id": alias.get(t, t), "class_id": 0, "x1": x1, "y1": y1, "x2": x2, "y2": y2, "conf": 0.5, "coasted": True})
        for t in gone:
            del last[t]
        if self.gallery:
            self.gallery = {t: g for t, g in self.gallery.items() if frame - g["seen"] <= self.age}
        if alias:
            self.alias = {t: n for t, n in alias.items() if t in last or t in self.tracker.tracks}
        for r in balls:
            x1, y1, x2, y2 = _box(r)
            out.append({"frame_idx": frame, "track_id": -1, "class_id": BALL, "x1": x1, "y1": y1, "x2": x2, "y2": y2, "conf": float(r["conf"]), "coasted": False})
        return out


def _box(r: dict) -> tuple[float, float, float, float]:
    """A row's box; what is missing is no number."""
    box = r["x1"], r["y1"], r["x2"], r["y2"]
    return tuple(math.nan if x is None else float(x) for x in box) if None in box else tuple(map(float, box))


def units(m: np.ndarray) -> np.ndarray:
    """``unit`` of each row."""
    n = np.array([math.sqrt(v.dot(v)) for v in m])
    return m / np.where(n > 1e-6, n, 1.0)[:, None]


def _conf(r: dict) -> float:
    return math.nan if r["conf"] is None else float(r["conf"])


def unit(e) -> np.ndarray:
    v = np.asarray(e, float)
    n = math.sqrt(v.dot(v))
    return v / n if n > 1e-6 else v


def tracked(dets: DataFrame, cut_frames: DataFrame | None = None, stretch: int = 20_000, warm: int = 1_000) -> DataFrame:
    """``MatchTracker`` over the frames of each match; without appearances stretches of a match run side by side (``spliced``).

    ``dets`` (match_id, frame_idx, det_idx, class_id, x1, y1, x2, y2, conf) may
    carry emb, team_id, role_id, x_m, y_m for re-identification at cuts.
    """
    cut = F.lit(False) if cut_frames is None else F.coalesce("cut", F.lit(False))
    df = dets if cut_frames is None else dets.join(cut_frames.select("match_id", "frame_idx", F.lit(True).alias("cut")).distinct(), ["match_id", "frame_idx"], "left")
    extra = [c for c in ("emb", "team_id", "role_id", "x_m", "y_m") if c in dets.columns]
    df = df.select("match_id", "frame_idx", "det_idx", "class_id", "x1", "y1", "x2", "y2", "conf", *extra, cut.alias("cut"))
    schema = "match_id long, frame_idx long, track_id long, class_id long, x1 double, y1 double, x2 double, y2 double, conf double, coasted boolean"
    if extra:  # a gallery outlives its tracks
        return spliced.one_pass(df, _Tracked, ["det_idx"], schema)
    return spliced.tracks(df, _Tracked, ["det_idx"], schema, stretch, warm)


class _Tracked:
    """``MatchTracker`` over all frames; of a run of frames without boxes the first ``forget`` + 1, after which no track is left."""

    def __init__(self):
        self.tracker, self.at = MatchTracker(), None

    def step(self, frame: int, rows: list[dict]) -> list[dict]:
        self.at, self.rest = frame, frame + self.tracker.forget + 1
        return self.tracker.step(frame, rows, any(r["cut"] for r in rows))

    def until(self, frame: int) -> list[dict]:
        out = []
        while self.at is not None and self.at < min(frame - 1, self.rest):
            self.at += 1
            out += self.tracker.step(self.at, [])
        return out

    def mark(self) -> tuple[bytes, list[int], int]:
        return marked(self.tracker.tracker, self.tracker.last)
