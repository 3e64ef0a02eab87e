"""Tracking-shaped views of the driver tables, in SQL that Spark and DuckDB read alike.

The tables are no match data; integer arithmetic turns them into positions,
boxes, passes and so on, the same in both engines.  ``{name}`` is a driver table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "smooth": """
        select user_id % 3 as match_id, user_id as track_id, seq as frame_idx,
               abs(((seq * 20 + user_id * 37) % 21000) - 10500) / 1e2 + case when seq % 17 = 16 then 30 else 0 end as x_m,
               ((user_id * 53) % 6800) / 1e2 as y_m
        from (select user_id, row_number() over (partition by user_id order by event_id) - 1 as seq from {events}) s""",
    "pos": """
        select f % 3 as match_id, cast(floor(f / 3) as bigint) as frame_idx, det_idx, det_idx as track_id, 0 as class_id,
               ((event_id * 37 + user_id * 11) % 10500) / 1e2 as x_m, ((event_id * 53 + user_id * 29) % 6800) / 1e2 as y_m,
               user_id % 2 as team_id, user_id % 6 as role_id, (event_id * 7) % 180 as hue, (event_id * 11) % 256 as sat,
               (event_id * 13) % 256 as val, (event_id * 17) % 1000 as y2
        from (select *, cast(floor(event_id / 20) as bigint) as f, event_id % 20 as det_idx from {events}) s""",
    "ball": """
        select f % 3 as match_id, cast(floor(f / 3) as bigint) as frame_idx,
               ((event_id * 37 + user_id * 11) % 10500) / 1e2 + (f % 7) * 0.5e0 as x_m, ((event_id * 53 + user_id * 29) % 6800) / 1e2 as y_m,
               least(value, 130e0) as ball_kmh
        from (select *, cast(floor(event_id / 20) as bigint) as f from {events} where event_id % 20 = 0) s""",
    "poss": """
        select match_id, frame_idx, holder_id, holder_id % 2 as holder_team, ball_x, ball_y, ball_kmh
        from (select event_id % 3 as match_id, cast(floor(event_id / 3) as bigint) as frame_idx,
                     case when event_type in ('error', 'view') then null else user_id % 22 end as holder_id,
                     ((event_id * 37) % 10500) / 1e2 as ball_x, ((event_id * 53) % 6800) / 1e2 as ball_y, value as ball_kmh from {events}) s""",
    "pass": """
        select l_orderkey % 3 as match_id, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey as action_id, l_orderkey as frame_idx,
               l_suppkey % 11 as passer_id, l_partkey % 11 as receiver_id, l_linenumber % 2 as team_id,
               ((l_orderkey * 37) % 10500) / 1e2 as sx, ((l_partkey * 13) % 6800) / 1e2 as sy,
               ((l_partkey * 29 + l_orderkey) % 10500) / 1e2 as ex, ((l_suppkey * 31 + l_orderkey * 7) % 6800) / 1e2 as ey, l_quantity + 10e0 as speed_kmh
        from {lineitem}""",
    "shot": """
        select o_orderkey % 3 as match_id, o_orderkey as shot_id, o_orderkey as frame_idx, o_custkey % 22 as shooter_id, o_custkey % 2 as team_id,
               ((o_orderkey * 37) % 10500) / 1e2 as x_m, ((o_orderkey * 53) % 6800) / 1e2 as y_m, 20e0 + o_custkey % 100 as speed_kmh
        from {orders}""",
    "crowd": """
        select l_orderkey % 3 as match_id, l_orderkey as frame_idx, ((l_partkey * 29) % 10500) / 1e2 as x_m, ((l_suppkey * 31 + l_linenumber * 400) % 6800) / 1e2 as y_m
        from {lineitem}""",
    "box": """
        select l_orderkey % 3 as match_id, l_orderkey as frame_idx, l_linenumber + 10 * (l_partkey * 1000 + l_suppkey % 1000) as det_idx, (l_partkey % 2000) - 50e0 as x1, (l_suppkey % 1100) - 20e0 as y1,
               (l_partkey % 2000) - 30e0 + l_quantity as x2, (l_suppkey % 1100) + 20e0 + 2 * l_quantity as y2, l_discount * 10 as conf,
               case when l_linenumber = 1 then 32 else 0 end as class_id, case when l_linenumber = 1 then -1 else l_suppkey % 30 end as track_id
        from {lineitem}""",
    "truth": """
        select match_id, frame_idx, det_idx, x1 + 3 * (det_idx % 10) as x1, y1 + det_idx % 10 as y1, x2 + 3 * (det_idx % 10) as x2, y2 + det_idx % 10 as y2 from v_box""",
    "pitch": """
        select o_orderkey % 3 as match_id, o_orderkey as frame_idx, 100 + o_custkey % 200 as y_min, 700 + o_custkey % 300 as y_max, (o_orderkey % 10) / 1e1 as area_ratio
        from {orders}""",
    "motion": """
        select event_id % 3 as match_id, cast(floor(event_id / 3) as bigint) as frame_idx, (event_id % 101 - 50) / 1e1 as dx, (event_id % 61 - 30) / 1e1 as dy,
               1 + (event_id % 7 - 3) / 2e2 as zoom, (event_id * 13) % 100 / 1e2 as hist_distance, (event_id * 29) % 100 / 1e2 as edge_diff, (event_id % 11) / 1e1 as flow_inlier
        from {events}""",
    "emb": """
        select vec_id, embedding as emb, label % 2 as team_id, vec_id % 5 = 0 as candidate from {embeddings}""",
    "frames": """
        select event_id % 3 as match_id, cast(floor(event_id / 3) as bigint) as frame_idx, (event_id * 3) % 256 as brightness, (event_id * 7) % 300 as blur,
               (event_id * 5) % 101 as grass_pct, 40e0 + event_id % 30 as turf_h, 100e0 + event_id % 90 as turf_s, 90e0 + event_id % 60 as turf_v
        from {events}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; the scan reads only the columns that the query uses."""
    sql = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in re.findall(r"\{(\w+)\}", sql)}
    if "v_box" in sql:
        used["v_box"] = view(spark, sf_dir, "box")
        sql = sql.replace("v_box", "{v_box}")
    return spark.sql(sql, **used)


def oracle(sql: str) -> str:
    """SQL over views (``v_name``) as one statement over the driver tables."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bv_(\w+)\b", text):
            if name in VIEWS and name not in needed:
                need(VIEWS[name])
                needed.append(name)

    need(sql)
    parts = [f"v_{n} as ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in needed]
    text = sql.strip()
    for head in ("with recursive ", "with "):
        if text.startswith(head):
            return head + ", ".join(parts + [text[len(head) :]])
    return ("with " + ", ".join(parts) + " " if parts else "") + text
