import numpy as np
import pytest
from pyspark.sql import functions as F

from touchgrid import schemas
from touchgrid.functions import models as M
from touchgrid.operators import space as S, threat as T


def shots(spark, rows, crowd=None):
    raw = spark.createDataFrame([(0, i, i, 9, t, float(x), float(y), float(v)) for i, (t, x, y, v) in enumerate(rows)], schemas.SHOTS)
    at = spark.createDataFrame([(0, f, float(x), float(y)) for f, x, y in crowd], "match_id long, frame_idx long, x_m double, y_m double") if crowd else None
    return [(r["xg"], r["dist_m"], r["angle_deg"], r["defenders"]) for r in T.shots(raw, at).orderBy("shot_id").collect()]


def test_xg_decays_with_distance(spark):
    got = shots(spark, [(0, 99, 34, 65), (0, 89, 34, 65), (0, 75, 34, 65)])
    for g, w in zip(got, [(0.943, 6.0, 62.8), (0.525, 16.0, 25.8), (0.118, 30.0, 13.9)], strict=True):
        assert g[:3] == pytest.approx(w, abs=0.06)


def test_xg_angle_and_congestion(spark):
    got = shots(spark, [(0, 93, 34, 65), (0, 93, 10, 65)])
    assert got[0][0] == pytest.approx(0.711, abs=1e-3) and got[1][0] == pytest.approx(0.127, abs=1e-3)
    blocked = shots(spark, [(0, 90, 34, 65)], [(0, 95, 33.5), (0, 96, 34.5)])[0]
    assert blocked[3] == 2 and blocked[0] == pytest.approx(0.431, abs=1e-3)


def test_surface(spark):
    g = {(r["row"], r["col"]): r["xt"] for r in M.threat_surface(spark).collect()}
    assert len(g) == 192 and max(g.values()) == pytest.approx(0.35) and sum(v == 0.35 for v in g.values()) == 8
    assert min(g.values()) == pytest.approx(0.0116, abs=1e-4)
    assert [round(g[6, c], 4) for c in (3, 8, 12, 15)] == [0.0264, 0.07, 0.2091, 0.35]


PASSES = [(10, 7, 60, 34, 85, 34), (10, 7, 80, 34, 45, 34)]


def passes(spark, rows, team=0):
    return spark.createDataFrame([(0, i, i, a, b, team, float(sx), float(sy), float(ex), float(ey), 40.0) for i, (a, b, sx, sy, ex, ey) in enumerate(rows)], schemas.PASSES)


def test_progressive_and_backward(spark):
    got = T.valued_passes(passes(spark, PASSES)).orderBy("action_id").collect()
    assert got[0]["progressive"] and got[0]["xt_start"] == pytest.approx(0.0854, abs=1e-4) and got[0]["xt_end"] == pytest.approx(0.2091, abs=1e-4)
    assert not got[1]["progressive"] and got[1]["delta_xt"] < 0


def test_network(spark):
    v = T.valued_passes(passes(spark, [(10, 7, 50, 30, 70, 25), (10, 7, 50, 30, 70, 25), (7, 9, 70, 20, 85, 34), (3, 3, 1, 1, 2, 2)]))
    pos = spark.createDataFrame([(0, 10, 0, 50.0, 30.0), (0, 10, 0, 52.0, 32.0), (0, 7, 0, 70.0, 20.0), (0, 9, 0, 85.0, 34.0)], "match_id long, track_id long, team_id long, x_m double, y_m double")
    nodes, links = T.nodes(v, pos), T.links(v)
    r = T.network_summary(nodes, links, v).first()
    assert (r["n_nodes"], r["n_links"], r["leader"], r["top_passer"], r["top_receiver"], r["top_count"]) == (3, 2, 7, 10, 7, 2)
    assert r["density"] == pytest.approx(1 / 3)


def test_formation(spark):
    xs = [5, 20, 22, 24, 26, 45, 48, 50, 60, 62, 64]
    nodes = spark.createDataFrame([(0, 0, i, float(x), 34.0, "GK" if i == 0 else "DF") for i, x in enumerate(xs)], "match_id long, team_id long, player_id long, x_m double, y_m double, role string")
    assert T.formations(nodes).first()["formation"] == "4-3-3"
    assert T.formations(nodes.limit(4)).first()["formation"] == "4-3-3 (Standard)"


POS = "match_id long, frame_idx long, role_id long, x_m double, y_m double"


def at(spark, rows):
    return spark.createDataFrame([(0, 0, r, float(x), float(y)) for r, x, y in rows], POS)


def test_hull(spark):
    r = S.hulls(at(spark, [(0, 20, 20), (0, 40, 20), (0, 40, 40), (0, 20, 40), (0, 30, 30)])).first()
    assert r["area_m2"] == 400.0 and len(r["hull"]) == 4
    r = S.hulls(at(spark, [(0, 20, 20), (0, 40, 20)])).first()
    assert r["area_m2"] == 0.0 and r["hull"] is None


def test_control_forms_agree_and_split_evenly(spark):
    df = at(spark, [(0, 25, 20), (0, 25, 48), (1, 80, 20), (1, 80, 48), (2, 50, 30)])
    a, b = S.control(df).first(), S.control_sql(df).first()
    assert a == b and a["a_pct"] == pytest.approx(50, abs=2) and a["a_pct"] + a["b_pct"] == pytest.approx(100, abs=0.1)
    assert S.control(at(spark, [(1, 5, 5)])).first()["b_pct"] == 100.0
    assert S.voronoi_cells(df).count() == 7140


def test_heat_blur_keeps_mass():
    g = np.zeros((60, 80))
    g[30, 40] = 5
    k = S.gaussian(21, 4.0)
    out = S.blur(g, k)
    assert out.sum() == pytest.approx(5) and out[30, 40] == pytest.approx(5 * k.max() ** 2)


def test_density_levels(spark):
    df = spark.createDataFrame([(0, 1, 0, f, 52.0, 34.0) for f in range(5)], "match_id long, track_id long, role_id long, frame_idx long, x_m double, y_m double")
    got = S.density(S.heat_counts(df), step=20).agg(F.min("level"), F.max("level")).first()
    assert got[0] == 0 and got[1] == 255


def test_heat_density_gives_the_whole_raster(spark, sf):
    from touchgrid import catalog

    got = catalog.queries()["heat_density"](spark, sf).groupBy("match_id", "team_id").agg(F.count("*").alias("n"), F.countDistinct("px", "py").alias("cells")).collect()
    assert got and all(r["n"] == r["cells"] == 1050 * 680 for r in got)


def test_every_track_is_a_node(spark, sf):
    from touchgrid import catalog
    from touchgrid.plans.views import view

    seen = view(spark, sf, "pos").filter("track_id >= 0 and team_id in (0, 1)").select("match_id", "team_id", F.col("track_id").alias("p"))
    passes = view(spark, sf, "pass").filter("passer_id >= 0 and receiver_id >= 0 and passer_id <> receiver_id")
    for end in ("passer_id", "receiver_id"):
        seen = seen.unionByName(passes.select("match_id", F.col("team_id").cast("long").alias("team_id"), F.col(end).alias("p")))
    want = {(r["match_id"], r["team_id"]): r["n"] for r in seen.groupBy("match_id", "team_id").agg(F.countDistinct("p").alias("n")).collect()}
    for name in ("network_summaries", "team_formations"):
        got = {(r["match_id"], r["team_id"]): r["n_nodes"] for r in catalog.queries()[name](spark, sf).collect()}
        assert got == want and max(got.values()) > 11, name
