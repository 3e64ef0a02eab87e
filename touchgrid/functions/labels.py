"""Labels and texts of reports and overlays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .geometry import _c

#: Role names and overlay prefixes by role id.
ROLE_NAMES = {-1: "Ball", 0: "Team A", 1: "Team B", 2: "Referee", 3: "Team A GK", 4: "Team B GK", 5: "Coach"}
ROLE_PREFIXES = {0: "A ", 1: "B ", 2: "REF ", 3: "A-GK ", 4: "B-GK ", 5: "COACH "}


def _lookup(key, table: dict, default=None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(_c(key) == k, v) if out is None else out.when(_c(key) == k, v)
    return out.otherwise(default) if default is not None else out


def role_name(role) -> Column:
    return _lookup(role, ROLE_NAMES, "Coach")


def role_prefix(role) -> Column:
    return _lookup(role, ROLE_PREFIXES, "REF ")


def team_name(team) -> Column:
    return F.when(_c(team) == 0, "Team A").when(_c(team) == 1, "Team B").otherwise("Neutral")


def threat_team_name(team) -> Column:
    """Shots, threat and networks know two teams only."""
    return F.when(_c(team) == 0, "Team A").otherwise("Team B")


def clock(seconds) -> Column:
    """MM:SS."""
    s = F.floor(_c(seconds)).cast("int")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), s % 60)


def pass_text(done, tried, accuracy) -> Column:
    return F.format_string("%d/%d (%.1f%%)", _c(done).cast("int"), _c(tried).cast("int"), _c(accuracy))


def event_text(kind, team, primary, secondary, speed, dist) -> Column:
    """The description of an event by its type."""
    kind, who = _c(kind), team_name(team)
    a, b = _c(primary).cast("int"), _c(secondary).cast("int")
    return (
        F.when(kind == "SHOT", F.format_string("%s Shot: #%d (%.1f km/h)", who, a, _c(speed)))
        .when(kind == "PASS", F.format_string("%s Pass: #%d -> #%d (%.1fm)", who, a, b, _c(dist)))
        .when(kind == "INTERCEPTION", F.format_string("%s Interception: #%d intercepted #%d", who, a, b))
        .when(kind == "TACKLE", F.format_string("%s Tackle: #%d won duel against #%d", who, a, b))
    )


def possession_text(pct_a, pct_b) -> Column:
    return F.format_string("POSS: A %.0f%% | B %.0f%%", _c(pct_a), _c(pct_b))


def carrier_text(holder, contested) -> Column:
    return F.when(_c(holder).isNotNull(), F.concat(F.lit("CARRIER: #"), _c(holder).cast("string"))).when(_c(contested), "BALL: 50-50 DUEL").otherwise("BALL: FREE")


def camera_text(pan, zoom_state, zoom, dx, is_cut=None, cuts=None, relinked=None) -> Column:
    cut = F.lit(False) if is_cut is None else F.coalesce(_c(is_cut), F.lit(False))
    n = F.lit(0) if cuts is None else F.coalesce(_c(cuts), F.lit(0)).cast("int")
    links = F.lit(0) if relinked is None else F.coalesce(_c(relinked), F.lit(0)).cast("int")
    return (
        F.when(cut, F.format_string("SCENE: CUT #%d (Re-ID)", n))
        .when(n > 0, F.format_string("CUTS: %d | RE-ID: %d", n, links))
        .when(_c(pan) != "STATIC", F.format_string("CAM: %s (%+.0fpx)", _c(pan), _c(dx)))
        .when(_c(zoom_state) != "STEADY", F.format_string("CAM: %s (%.2fx)", _c(zoom_state), _c(zoom)))
        .otherwise(F.format_string("CAM: STABLE (%.2fx)", _c(zoom)))
    )


def speed_badge(speed) -> Column:
    """The speed beside a player, from 2.5 km/h on."""
    return F.when(_c(speed) >= 2.5, F.format_string(" %.1fkm/h", _c(speed))).otherwise("")


def safe_filename(name) -> Column:
    """Only letters, digits, dot, dash and underscore stay."""
    return F.regexp_replace(_c(name), r"[^A-Za-z0-9._-]", "_")


def aspect_ratio(width, height, most: int = 16) -> Column:
    """``w:h`` in lowest terms, by the largest common divisor (Euclid, folded over enough steps)."""
    steps = F.sequence(F.lit(1), F.lit(3 * most))
    start = F.struct(_c(width).cast("long").alias("a"), _c(height).cast("long").alias("b"))
    gcd = F.aggregate(steps, start, lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0)).otherwise(s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).cast("long").alias("b")), lambda s: s["a"])
    w, h = _c(width).cast("long"), _c(height).cast("long")
    return F.concat_ws(":", (w / gcd).cast("long").cast("string"), (h / gcd).cast("long").cast("string"))
