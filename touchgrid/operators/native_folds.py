"""Order-dependent folds without Python: state machines as ``aggregate`` over the sorted rows of a key.

The rows of a key become an array of stretches; a fold over a stretch appends
one state a row to an array, and the fold over the stretches hands the last
state on.  Arrays are copied as they grow, so short stretches keep the cost of a
row constant whatever the length of a match.  A step is a Column expression of
the state before and the row, and is evaluated once a row.

Cuts and boundaries go on in parts of a match side by side: what a part makes of
every state that it may start from is a short array, and a fold over the parts
of a match picks the state each really starts from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

STRETCH = 128
PART = 8192  # frames


def fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Column, step: Callable[[Column, Column], Column], stretch: int = STRETCH, entries: DataFrame | None = None) -> DataFrame:
    """``columns`` of the rows of each key in order, with ``state``: the state after each row.

    ``start`` and what ``step(state, row)`` returns are structs of one type.
    Windows and groups share one exchange by the keys.  ``entries`` has the
    state (``entry``) at the begin of each part that the last key numbers.
    """
    number = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    carried = [c for c in columns if c not in keys]
    rows = df.select(*keys, F.floor(number / stretch).alias("stretch"), F.struct(number.alias("at"), *carried).alias("row"))
    parts = rows.groupBy(*keys, "stretch").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    whole = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "rows"))), lambda s: s["rows"]).alias("stretches"))

    def through(states: Column, part: Column) -> Column:
        """States of a stretch, the one it starts from first."""
        first = F.array(F.element_at(F.element_at(states, -1), -1))
        return F.aggregate(part, first, lambda held, row: F.concat(held, F.array(step(F.element_at(held, -1), row))))

    if entries is not None:
        same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
        whole = whole.join(entries.withColumnsRenamed({k: f"of_{k}" for k in keys}), same).drop(*(f"of_{k}" for k in keys))
        start = F.col("entry")
    states = F.aggregate("stretches", F.array(F.array(start)), lambda held, part: F.concat(held, F.array(through(held, part))))
    # each stretch's first state is that of the row before it; the first entry is the start alone
    pairs = F.arrays_zip(F.col("stretches").alias("rows"), F.slice(states, 2, F.size("stretches")).alias("states"))
    each = whole.select(*keys, F.explode(pairs).alias("s")).select(*keys, F.explode(F.arrays_zip(F.col("s.rows").alias("row"), F.slice("s.states", 2, F.size("s.rows")).alias("state"))).alias("r"))
    return each.select(*keys, *(F.col(f"r.row.{c}").alias(c) for c in carried), F.col("r.state").alias("state"))


def possession(cands: DataFrame, radius: float = 1.8, hold: int = 2, close: float = 1.05, stretch: int = STRETCH) -> DataFrame:
    """Holders by hysteresis of candidates (candidate, candidate_team, dist_m, contested): close or long enough near the ball takes it, far from it loses it."""
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    fields = ("holder", "team", "candidate", "frames", "turnovers")
    start = F.struct(none.alias("holder"), none.alias("team"), none.alias("candidate"), zero.alias("frames"), zero.alias("turnovers"))

    def step(s: Column, r: Column) -> Column:
        who, team, dist = r["candidate"], r["candidate_team"], r["dist_m"]
        nobody, same = who.isNull(), F.coalesce(who == s["holder"], F.lit(False))
        frames = F.when(who == s["candidate"], s["frames"] + 1).otherwise(F.lit(1).cast("long"))
        takes = (dist < close) | (frames >= hold)
        far = dist > 1.5 * radius
        new = {
            "holder": F.when(nobody, F.when(~far, s["holder"])).when(same | ~takes, s["holder"]).otherwise(who),
            "team": F.when(nobody, F.when(~far, s["team"])).when(same | ~takes, s["team"]).otherwise(team),
            "candidate": F.when(nobody, none).when(same, s["candidate"]).otherwise(who),
            "frames": F.when(nobody | same | takes, zero).otherwise(frames),
            "turnovers": s["turnovers"] + F.when(~nobody & ~same & takes & F.coalesce(team != s["team"], F.lit(False)), 1).otherwise(0),
        }
        return F.struct(*(new[f].cast("long").alias(f) for f in fields))

    rows = cands.select("match_id", "frame_idx", F.col("candidate").cast("long").alias("candidate"), F.col("candidate_team").cast("long").alias("candidate_team"), "dist_m", "contested")
    out = fold(rows, ["match_id"], ["frame_idx"], ["match_id", "frame_idx", "candidate", "candidate_team", "dist_m", "contested"], start, step, stretch)
    return out.select("match_id", "frame_idx", F.col("state.holder").alias("holder_id"), F.col("state.team").alias("holder_team"), "contested", F.col("state.turnovers").alias("turnovers"))


def cuts(scored: DataFrame, gap: int = 15, least: float = 0.52, stretch: int = STRETCH, part: int = PART) -> DataFrame:
    """Debounced cuts of scored frames (score, hist_distance, edge_diff): a hit counts if the last cut is ``gap`` frames ago."""
    hit = (F.col("score") >= least) | ((F.col("hist_distance") >= 0.50) & (F.col("edge_diff") >= 0.45))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("cut"))

    def step(s: Column, r: Column) -> Column:
        cut = r["hit"] & F.coalesce(r["frame_idx"] - s["last"] >= gap, F.lit(True))
        return F.struct(F.when(cut, r["frame_idx"]).otherwise(s["last"]).alias("last"), (s["n"] + cut.cast("long")).alias("n"), cut.alias("cut"))

    rows = scored.select("match_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.coalesce(hit, F.lit(False)).alias("hit"))
    rows = rows.withColumn("part", F.floor(F.col("frame_idx") / part))
    # a part starts 1 to gap - 1 frames after the last cut, or free
    begin = F.col("part") * part
    free = F.lit(None).cast("long")
    maybe = F.array(*(F.struct(last.alias("last"), F.lit(0).cast("long").alias("n")) for last in (*(begin - i for i in range(1, gap)), free)))

    def passed(held: Column, at: Column) -> Column:
        cut = F.coalesce(at - held["last"] >= gap, F.lit(True))
        return F.struct(F.when(cut, at).otherwise(held["last"]).alias("last"), (held["n"] + cut.cast("long")).alias("n"))

    hits = rows.groupBy("match_id", "part").agg(F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("frame_idx")))).alias("hits"))
    ends = hits.select("match_id", "part", begin.alias("begin"), F.aggregate("hits", maybe, lambda held, at: F.transform(held, lambda h: passed(h, at))).alias("ends"))

    def over(s: Column, p: Column) -> Column:
        since = p["begin"] - s["last"]
        end = F.element_at(p["ends"], F.when(since < gap, since).otherwise(gap).cast("int"))
        return F.struct(end["last"].alias("last"), (s["n"] + end["n"]).alias("n"), F.lit(False).alias("cut"))

    out = fold(rows, ["match_id", "part"], ["frame_idx"], ["frame_idx", "hit"], start, step, stretch, _entries(ends, ["begin", "ends"], start, over))
    return out.select("match_id", "frame_idx", F.col("state.cut").alias("is_cut"), F.col("state.n").alias("cut_count"))


def _entries(parts: DataFrame, columns: list[str], start: Column, over: Callable[[Column, Column], Column]) -> DataFrame:
    """(match_id, part, entry): the state at the begin of each part, from ``over(state, part)``; a match's parts are one short row."""
    whole = parts.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("part", *columns))).alias("parts"))
    states = F.aggregate("parts", F.array(start), lambda held, p: F.concat(held, F.array(over(F.element_at(held, -1), p))))
    pairs = F.arrays_zip(F.transform("parts", lambda p: p["part"]).alias("part"), F.slice(states, 1, F.size("parts")).alias("entry"))
    return whole.select("match_id", F.explode(pairs).alias("e")).select("match_id", "e.part", "e.entry")


def boundaries(pitch: DataFrame, keep: float = 0.8, stretch: int = STRETCH, part: int = PART) -> DataFrame:
    """Moving average of the pitch's top and bottom row; frames without lines keep the last values."""
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("top"), none.alias("bottom"))

    def step(s: Column, r: Column) -> Column:
        value = lambda name, c: F.when(r["top_y"].isNull(), s[name]).when(s[name].isNull(), r[c]).otherwise(keep * s[name] + (1 - keep) * r[c]).alias(name)
        return F.struct(value("top", "top_y"), value("bottom", "bottom_y"))

    rows = pitch.select("match_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("top_y").cast("double").alias("top_y"), F.col("bottom_y").cast("double").alias("bottom_y"))
    rows = rows.withColumn("part", F.floor(F.col("frame_idx") / part))
    # a moving average is linear in the state it starts from: what a part makes of none and of zero tells the rest
    zero = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("bottom"))
    lines = rows.groupBy("match_id", "part").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "top_y", "bottom_y"))).alias("lines"))
    through = lambda s: F.aggregate("lines", s, step)
    seen = F.filter("lines", lambda x: x["top_y"].isNotNull())
    ends = lines.select("match_id", "part", F.size(seen).alias("n"), F.exists(seen, lambda x: x["bottom_y"].isNull()).alias("lost"), through(start).alias("fresh"), through(zero).alias("onward"))

    def over(s: Column, p: Column) -> Column:
        fade = F.pow(F.lit(keep), p["n"])
        value = lambda c: F.when(p["n"] == 0, s[c]).when(s[c].isNull(), p["fresh"][c]).otherwise(fade * s[c] + p["onward"][c])
        return F.struct(value("top").alias("top"), F.when(p["lost"], p["fresh"]["bottom"]).otherwise(value("bottom")).alias("bottom"))

    out = fold(rows, ["match_id", "part"], ["frame_idx"], ["frame_idx", "top_y", "bottom_y"], start, step, stretch, _entries(ends, ["n", "lost", "fresh", "onward"], start, over))
    return out.select("match_id", "frame_idx", F.col("state.top").alias("top"), F.col("state.bottom").alias("bottom"))
