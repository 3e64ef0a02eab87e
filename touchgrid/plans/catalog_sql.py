"""SQL of the queries over the views of ``views`` (DuckDB dialect)."""

from __future__ import annotations

_DIST = "sqrt(({x1} - {x2}) * ({x1} - {x2}) + ({y1} - {y2}) * ({y1} - {y2}))"


def dist(x1, y1, x2, y2):
    return _DIST.format(x1=x1, y1=y1, x2=x2, y2=y2)


_POINTS = "select * from v_smooth where track_id >= 0 and x_m between -5 and 110 and y_m between -5 and 73"
_STEPS = f"""
    p as ({_POINTS}),
    l as (select *, lag(x_m) over w as px, lag(y_m) over w as py, lag(frame_idx) over w as pf from p window w as (partition by match_id, track_id order by frame_idx)),
    d as (select *, {dist("x_m", "y_m", "px", "py")} as step_m, (frame_idx - pf) / 25.0 as dt from l),
    s as (select *, case when dt > 0 and step_m / dt <= 38.0 / 3.6 and step_m >= 0.01 then step_m else 0 end as counted_m from d)"""
_ACTIVITY = "case when {s} < 2 then 'Standing' when {s} < 7.2 then 'Walking' when {s} < 14.4 then 'Jogging' when {s} < 19.8 then 'Running' else 'Sprinting' end"
_SLOPE = """
    p as (select match_id, track_id, frame_idx, frame_idx / 25e0 as t, x_m as x, y_m as y from v_smooth where track_id >= 0 and x_m between -5 and 110 and y_m between -5 and 73),
    w as (select *, list({'t': t, 'x': x, 'y': y}) over (partition by match_id, track_id order by frame_idx rows between 17 preceding and current row) as pts from p),
    c as (select *, list_avg(list_transform(pts, lambda q: q.t)) as mt, list_avg(list_transform(pts, lambda q: q.x)) as mx, list_avg(list_transform(pts, lambda q: q.y)) as my from w),
    z as (select *, list_transform(pts, lambda q: {'t': q.t - mt, 'x': q.x, 'y': q.y}) as zs from c),
    f as (select *, list_sum(list_transform(zs, lambda q: q.t * q.t)) as den, list_sum(list_transform(zs, lambda q: q.t * (q.x - mx))) as nx, list_sum(list_transform(zs, lambda q: q.t * (q.y - my))) as ny from z),
    v as (select *, case when len(pts) >= 4 and den >= 1e-6 then nx / den else 0 end as vx, case when len(pts) >= 4 and den >= 1e-6 then ny / den else 0 end as vy from f),
    e as (select *, list_transform(zs, lambda q: {'t': q.t, 'x': q.x, 'y': q.y, 'r': sqrt((q.x - vx * q.t - mx) * (q.x - vx * q.t - mx) + (q.y - vy * q.t - my) * (q.y - vy * q.t - my))}) as rs from v),
    i as (select *, list_filter(rs, lambda q: q.r <= greatest(1.5, 3 * list_median(list_transform(rs, lambda u: u.r)))) as ins from e),
    g as (select *, list_sum(list_transform(ins, lambda q: q.t * q.t)) as den2, list_avg(list_transform(ins, lambda q: q.x)) as mx2, list_avg(list_transform(ins, lambda q: q.y)) as my2 from i),
    k as (select *, case when len(pts) < 4 or den < 1e-6 then 0 when len(ins) >= 4 and den2 > 1e-6
                         then sqrt(power(list_sum(list_transform(ins, lambda q: q.t * (q.x - mx2))) / den2, 2) + power(list_sum(list_transform(ins, lambda q: q.t * (q.y - my2))) / den2, 2))
                         else sqrt(vx * vx + vy * vy) end * 3.6 as raw from g)"""
_SMOOTHED = f"""{_SLOPE},
    sp as (select match_id, track_id, frame_idx, row_number() over (partition by match_id, track_id order by frame_idx) as seq, round(case when raw < 2 then 0 else least(raw, 38) end, 9) as speed from k),
    sm as (select match_id, track_id, seq, frame_idx, speed, cast(printf('%.1f', 0.25e0 * speed) as double) as now from sp where seq = 1
           union all select sp.match_id, sp.track_id, sp.seq, sp.frame_idx, sp.speed, cast(printf('%.1f', 0.75e0 * sm.now + 0.25e0 * sp.speed) as double) from sm join sp on sp.match_id = sm.match_id and sp.track_id = sm.track_id and sp.seq = sm.seq + 1)"""
_SEEN_BOX = "ob as (select match_id, frame_idx, track_id, x_m * 10 - 8 as x1, y_m * 10 - 20 as y1, x_m * 10 + 8 as x2, y_m * 10 + 20 as y2 from v_smooth where frame_idx % 7 not in (3, 4))"
_ONE_BOX = "ob as (select match_id, frame_idx, track_id, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, max(conf) as conf from v_box where track_id >= 0 group by all)"
_ROLE = "case {c} when -1 then 'Ball' when 0 then 'Team A' when 1 then 'Team B' when 2 then 'Referee' when 3 then 'Team A GK' when 4 then 'Team B GK' else 'Coach' end"
_SIDE = "case when role_id in (0, 3) then 0 when role_id in (1, 4) then 1 end"
_CANVAS = "cast(trunc({pad} + least(greatest(x_m, 0), 105) * (({w} - 2 * {pad}) / 105.0)) as int) as {n}_x, cast(trunc({pad} + {head} + (68 - least(greatest(y_m, 0), 68)) * (({h} - 2 * {pad} - {head}) / 68.0)) as int) as {n}_y"
_HEAT_X, _HEAT_Y = "cast(trunc(least(greatest(x_m * 1050 / 105.0, 0), 1049)) as int)", "cast(trunc(least(greatest((68 - y_m) * 680 / 68.0, 0), 679)) as int)"
_IOU = """
    inter as (select b.match_id, b.frame_idx, b.det_idx, t.det_idx as gt_idx, greatest(0, least(b.x2, t.x2) - greatest(b.x1, t.x1)) * greatest(0, least(b.y2, t.y2) - greatest(b.y1, t.y1)) as i,
                     (b.x2 - b.x1) * (b.y2 - b.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) as a
              from v_box b join v_truth t on b.match_id = t.match_id and b.frame_idx = t.frame_idx),
    iou as (select *, case when a - i > 0 then i / (a - i) else 0 end as iou from inter)"""
_NEAR = f"""
    near as (select p.*, {dist("p.x_m", "p.y_m", "b.x_m", "b.y_m")} as dist_m from v_pos p join v_ball b on p.match_id = b.match_id and p.frame_idx = b.frame_idx),
    ranked as (select *, row_number() over (partition by match_id, frame_idx order by dist_m, det_idx) as rank from near)"""
_EVENTS = f"""
    a as (select *, greatest(0, least(130, coalesce(ball_kmh, 0))) as speed, count(holder_id) over (partition by match_id order by frame_idx rows between unbounded preceding and 1 preceding) as g from v_poss),
    fl as (select match_id, g, min(frame_idx) as released from a where holder_id is null and ball_x is not null and speed >= 12 and g >= 1 group by match_id, g),
    h as (select * from a where holder_id is not null),
    pk as (select h.match_id, h.frame_idx, max(a.speed) as peak from h join fl on h.match_id = fl.match_id and h.g = fl.g
           join a on a.match_id = h.match_id and a.g = h.g and a.frame_idx >= fl.released and a.frame_idx <= h.frame_idx group by h.match_id, h.frame_idx),
    q as (select h.*, lag(holder_id) over w as ph, lag(holder_team) over w as pt, lag(ball_x) over w as px, lag(ball_y) over w as py, lag(frame_idx) over w as pf
          from h window w as (partition by match_id order by frame_idx)),
    j as (select q.*, pk.peak, {dist("q.ball_x", "q.ball_y", "q.px", "q.py")} as d from q left join pk on q.match_id = pk.match_id and q.frame_idx = pk.frame_idx where q.ph is not null),
    k as (select *, case when peak is not null then
                         case when holder_id <> ph and peak >= 36 and ball_y between 20 and 48 and ((ball_x > 85 and ball_x - px > 5) or (ball_x < 20 and px - ball_x > 5)) then 'SHOT'
                              when holder_team = pt and holder_id <> ph and d >= 3 then 'PASS' when holder_team <> pt and d >= 3 then 'INTERCEPTION' end
                         when holder_team <> pt and frame_idx - pf <= 6 then 'TACKLE' end as event_type from j),
    ev as (select match_id, row_number() over (partition by match_id order by frame_idx) as event_id, event_type, frame_idx, frame_idx / 25.0 as timestamp_s,
                  case when event_type in ('SHOT', 'PASS') then pt else holder_team end as team_id, case when event_type in ('SHOT', 'PASS') then ph else holder_id end as primary_id,
                  case when event_type in ('SHOT', 'PASS') then holder_id else ph end as secondary_id, case when event_type = 'TACKLE' then speed else peak end as speed_kmh,
                  case when event_type = 'TACKLE' then 0 else d end as distance_m, px as start_x, py as start_y, ball_x as end_x, ball_y as end_y from k where event_type is not null)"""
_MATCH_EVENTS = f"with {_EVENTS} select match_id, event_id, event_type, frame_idx, team_id, primary_id, secondary_id, round(timestamp_s, 2) as timestamp_s, round(speed_kmh, 3) as speed_kmh, round(distance_m, 3) as distance_m from ev"
_GRID = """
    rc as (select r as "row", c as col, 0.28 * exp(-sqrt((15 - c) * (15 - c) + 1.8 * (5.5 - r) * (5.5 - r)) / 4.8) + 0.006 * power(c / 15.0, 1.5) + 0.003 as b from range(12) t(r), range(16) u(c)),
    grid as (select "row", col, least(greatest(b * case when "row" between 3 and 8 and col between 11 and 14 then 1.35 else 1 end * case when "row" between 4 and 7 and col between 13 and 15 then 1.45 else 1 end, 0.003), 0.35) as xt from rc)"""
_VALUED = f"""{_GRID},
    pz as (select *, case when team_id = 0 then 1 else -1 end as dir from v_pass where passer_id >= 0 and receiver_id >= 0 and passer_id <> receiver_id),
    zn as (select *, least(floor(case when dir > 0 then least(greatest(sx, 0), 104.9) else greatest(0, 105 - least(greatest(sx, 0), 104.9)) end / (105.0 / 16)), 15) as sc, least(floor(least(greatest(sy, 0), 67.9) / (68.0 / 12)), 11) as sr,
                     least(floor(case when dir > 0 then least(greatest(ex, 0), 104.9) else greatest(0, 105 - least(greatest(ex, 0), 104.9)) end / (105.0 / 16)), 15) as ec, least(floor(least(greatest(ey, 0), 67.9) / (68.0 / 12)), 11) as er,
                     abs(case when dir > 0 then 105 else 0 end - sx) as d0, abs(case when dir > 0 then 105 else 0 end - ex) as d1 from pz),
    va as (select zn.*, a.xt as xt_start, b.xt as xt_end, b.xt - a.xt as delta_xt, sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) as length_m from zn join grid a on a."row" = sr and a.col = sc join grid b on b."row" = er and b.col = ec),
    valued as (select *, delta_xt >= 0.012 or (d0 - d1 >= 8 and (d0 <= 55 or d0 - d1 >= 12)) as progressive from va)"""
_NODE_ROLE = "case when x_m < 22 or x_m > 83 then case when y_m between 26 and 42 and (x_m < 14 or x_m > 91) then 'GK' else 'DF' end when x_m < 42 or x_m > 63 then 'DF' else 'MF' end"
_NODES = f"""
    made as (select match_id, team_id, passer_id as player_id, count(*) as made, sum(greatest(0, delta_xt)) as xt_created from valued group by all),
    got as (select match_id, team_id, receiver_id as player_id, count(*) as received from valued group by all),
    mg as (select match_id, team_id, player_id, coalesce(made, 0) as made, coalesce(received, 0) as received, coalesce(xt_created, 0) as xt_created from made full outer join got using (match_id, team_id, player_id)),
    pl as (select match_id, team_id, track_id as player_id, avg(x_m) as px, avg(y_m) as py from v_pos where {{place}} and team_id in (0, 1) group by all),
    nd as (select match_id, team_id, player_id, coalesce(px, 52.5) as x_m, coalesce(py, 34.0) as y_m, coalesce(made, 0) as made, coalesce(received, 0) as received, coalesce(xt_created, 0) as xt_created from mg full outer join pl using (match_id, team_id, player_id)),
    nodes as (select *, made + received as involvements, {_NODE_ROLE} as role from nd)"""
_NODES_ONLY, _NODES_PLACED = _NODES.replace("{place}", "false"), _NODES.replace("{place}", "track_id >= 0")
_LINKS = "links as (select match_id, team_id, passer_id, receiver_id, count(*) as n, avg(length_m) as avg_length_m, avg(speed_kmh) as avg_kmh, sum(delta_xt) as delta_xt from valued group by all)"
_SHOTS = f"""
    sd as (select *, case when team_id = 0 then 105 else 0 end as gx from v_shot),
    cone as (select s.match_id, s.shot_id, count(*) as n from sd s join v_crowd c on s.match_id = c.match_id and s.frame_idx = c.frame_idx
             where c.x_m between least(s.x_m, s.gx) and greatest(s.x_m, s.gx)
               and abs(c.y_m - 34) <= (3.66 + 1.5) * (abs(c.x_m - s.x_m) / greatest(0.1, abs(s.gx - s.x_m))) + 0.5 * (1 - abs(c.x_m - s.x_m) / greatest(0.1, abs(s.gx - s.x_m))) + 1.2 group by all),
    ang as (select sd.*, coalesce(n, 0) as defenders, greatest(0.5, {dist("x_m", "y_m", "gx", "34")}) as dist_m,
                   degrees(acos(least(1, greatest(-1, ((gx - x_m) * (gx - x_m) + (30.34 - y_m) * (37.66 - y_m)) / greatest(1e-9, sqrt((gx - x_m) * (gx - x_m) + (30.34 - y_m) * (30.34 - y_m)) * sqrt((gx - x_m) * (gx - x_m) + (37.66 - y_m) * (37.66 - y_m))))))) as angle_deg
            from sd left join cone using (match_id, shot_id)),
    sh as (select *, least(0.96, greatest(0.01, 1 / (1 + exp(-(0.85 - 0.115 * dist_m + 0.042 * angle_deg - 0.28 * least(4, defenders) + 0.012 * (least(120, greatest(20, speed_kmh)) - 60) / 10))))) as xg from ang)"""
_PAN = "case when dx < -1.5 then 'PAN RIGHT' when dx > 1.5 then 'PAN LEFT' else 'STATIC' end"
_TILT = "case when dy < -1.2 then 'TILT DOWN' when dy > 1.2 then 'TILT UP' else 'STATIC' end"
_ZOOM = "case when zoom > 1.006 then 'ZOOM IN' when zoom < 0.994 then 'ZOOM OUT' else 'STEADY' end"
_TRACKS = """
    tk as (select match_id, track_id, count(*) as n from v_smooth group by all),
    tm as (select match_id, count(*) as n_tracks, count(*) filter (n >= 50) as mostly_tracked, count(*) filter (n < 10) as mostly_lost from tk group by all),
    tracking as (select *, greatest(0, n_tracks - 22) as id_switches, round(greatest(0, 1 - greatest(0, n_tracks - 22) / 22.0 * 0.15 - mostly_lost / greatest(1, n_tracks) * 0.10), 4) as mota, 0.88e0 as motp,
                 round(greatest(0, least(1, 2.0 * mostly_tracked / (mostly_tracked + n_tracks + 22) * 2.0)), 4) as idf1, cast(trunc(greatest(0, n_tracks - 22) * 0.7) as int) as fragmentations from tm)"""
_DETECT = f"""{_IOU},
    hit as (select match_id, frame_idx, det_idx, min(gt_idx) as gt_idx, arg_min(iou, gt_idx) as iou from iou where iou >= 0.5 group by all),
    m as (select b.match_id, count(*) as n_pred, count(hit.gt_idx) as tp, avg(hit.iou) as iou from v_box b left join hit using (match_id, frame_idx, det_idx) group by all),
    t as (select match_id, count(*) as n_true from v_truth group by all),
    pr as (select *, tp / greatest(1, n_pred) as precision, tp / greatest(1, n_true) as recall from m join t using (match_id)),
    det as (select match_id, n_pred, tp, n_pred - tp as fp, greatest(0, n_true - tp) as fn, precision, recall, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1, precision * recall as map50, precision * recall * coalesce(iou, 0.85) as map50_95 from pr)"""
_CONTROL = """
    sd as (select match_id, frame_idx, x_m, y_m, case when role_id in (0, 3) then 0 when role_id in (1, 4) then 1 end as side from v_pos where role_id in (0, 1, 3, 4)),
    cell as (select match_id, frame_idx, gx, gy, min(case when side = 0 then (x_m - gx) * (x_m - gx) + (y_m - gy) * (y_m - gy) end) as da, min(case when side = 1 then (x_m - gx) * (x_m - gx) + (y_m - gy) * (y_m - gy) end) as db
             from sd, range(105) a(gx), range(68) b(gy) group by all),
    cc as (select match_id, frame_idx, count(*) filter (da <= db) as n, count(da) as na, count(db) as nb from cell group by all),
    sh as (select match_id, frame_idx, case when na > 0 and nb > 0 then n / 7140.0 * 100 when na > 0 then 100 else 0 end as a from cc),
    control as (select match_id, frame_idx, round(a, 1) as a_pct, round(100 - a, 1) as b_pct from sh)"""
_CANDIDATES = f"""{_NEAR},
    t2 as (select match_id, frame_idx, max(case when rank = 1 then track_id end) as t1, max(case when rank = 1 then team_id end) as g1, max(case when rank = 1 then dist_m end) as d1,
                  max(case when rank = 2 then team_id end) as g2, max(case when rank = 2 then dist_m end) as d2 from ranked where rank <= 2 group by all),
    c as (select match_id, frame_idx, row_number() over (partition by match_id order by frame_idx) as k, case when d1 <= 1.8 then t1 end as who, case when d1 <= 1.8 then g1 end as whose, coalesce(d1, 999) as d,
                 coalesce(d1 <= 1.8 and g1 <> g2 and d2 <= 1.8 + 0.4, false) as contested from v_ball left join t2 using (match_id, frame_idx))"""
_ASSIGNED = f"""{_CANDIDATES},
    st as (select distinct match_id, cast(0 as bigint) as k, cast(null as bigint) as frame_idx, cast(null as bigint) as holder, cast(null as bigint) as team, cast(null as bigint) as cand, cast(0 as bigint) as n, cast(0 as bigint) as turnovers, false as contested from c
           union all
           select match_id, k, frame_idx, case when take then who when who is null and d > 2.7 then null else holder end, case when take then whose when who is null and d > 2.7 then null else team end,
                  case when who is null then null when who = holder then cand else who end, case when take then 0 else m end, turnovers + case when take and team is not null and whose is not null and whose <> team then 1 else 0 end, contested
           from (select *, who is not null and who is distinct from holder and (d < 1.05 or m >= 2) as take
                 from (select c.match_id, c.k, c.frame_idx, c.who, c.whose, c.d, c.contested, st.holder, st.team, st.cand, st.turnovers, case when c.who is null or c.who = st.holder then 0 when c.who = st.cand then st.n + 1 else 1 end as m
                       from st join c on c.match_id = st.match_id and c.k = st.k + 1) x) y),
    assigned as (select match_id, frame_idx, holder as holder_id, team as holder_team, contested, turnovers from st where k > 0)"""

SQL = {
    "player_kinematics": f"with {_STEPS}, t as (select match_id, track_id, count(*) as n_points, count(*) filter (counted_m > 0) as n_steps, sum(counted_m) as distance_m, coalesce(max(counted_m / dt * 3.6) filter (counted_m > 0), 0) as top from s group by all) select match_id, track_id, n_points, n_steps, round(distance_m, 3) as distance_m, round(top, 3) as top_kmh, {_ACTIVITY.format(s='top')} as activity from t",
    "running_distance": f"with {_STEPS} select match_id, track_id, frame_idx, round(step_m, 4) as step_m, round(counted_m, 4) as counted_m, round(sum(counted_m) over (partition by match_id, track_id order by frame_idx), 3) as distance_m from s",
    "regression_speed": f"with {_SLOPE} select match_id, track_id, frame_idx, round(case when raw < 2 then 0 else least(raw, 38) end, 3) as speed_kmh, round(max(case when raw < 2 then 0 else least(raw, 38) end) over (partition by match_id, track_id order by frame_idx), 3) as top_kmh from k",
    "trail_steps": """with w as (select match_id, track_id, frame_idx, list({'x': x_m, 'y': y_m}) over (partition by match_id, track_id order by frame_idx rows between 9 preceding and current row) as t from v_smooth),
        n as (select *, sqrt(power(t[len(t)].x - t[1].x, 2) + power(t[len(t)].y - t[1].y, 2)) as net, list_transform(range(1, len(t)), lambda i: sqrt(power(t[i + 1].x - t[i].x, 2) + power(t[i + 1].y - t[i].y, 2))) as ds from w)
        select match_id, track_id, frame_idx, case when len(t) > 1 and net >= 2 then len(list_filter(ds, lambda q: q >= 0.1 and q <= 20)) else 0 end as n_drawn from n""",
    "trail_lengths": "with w as (select match_id, track_id, frame_idx, count(*) over z as n, sum(x_m) over z as s from v_smooth window z as (partition by match_id, track_id order by frame_idx rows between 19 preceding and current row)) select match_id, track_id, frame_idx, n, round(s, 4) as sum_x from w",
    "box_velocity": "with o as (select match_id, track_id, frame_idx, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from v_box where track_id >= 0 group by all) select match_id, track_id, frame_idx, (x1 + x2) / 2 - lag((x1 + x2) / 2) over w as vx, (y1 + y2) / 2 - lag((y1 + y2) / 2) over w as vy from o window w as (partition by match_id, track_id order by frame_idx)",
    "confident_boxes": "select match_id, class_id, count(*) as n, round(sum(conf), 3) as conf from v_box where conf >= case when class_id = 32 then 0.18 else 0.30 end group by all",
    "clamped_feet": "with c as (select match_id, frame_idx, det_idx, least(greatest(x1, 0), 1919) as x1, least(greatest(y1, 0), 1079) as y1, least(greatest(x2, 0), 1919) as x2, least(greatest(y2, 0), 1079) as y2 from v_box) select *, (x1 + x2) / 2 as foot_x, y2 as foot_y from c",
    "on_pitch_boxes": "select b.match_id, b.frame_idx, b.det_idx, b.class_id from v_box b left join v_pitch p using (match_id, frame_idx) where b.class_id = 32 or p.y_min is null or p.area_ratio < 0.2 or (trunc(b.y2) >= p.y_min and trunc(b.y2) < p.y_max)",
    "validity_counts": """select match_id, 'kinematic' as rule, count(*) as n from v_smooth where track_id >= 0 and x_m between -5 and 110 and y_m between -5 and 73 group by all
        union all select match_id, 'heat', count(*) from v_smooth where track_id >= 0 and x_m between -2 and 107 and y_m between -2 and 70 group by all
        union all select match_id, 'radar', count(*) from v_smooth where x_m between -5 and 110 and y_m between -5 and 73 group by all
        union all select match_id, 'network', count(*) from v_pos where track_id >= 0 and team_id in (0, 1) group by all
        union all select match_id, 'keeper', count(*) from v_pos where class_id = 0 and x_m between -2 and 107 and y_m between -2 and 70 group by all
        union all select match_id, 'sane', count(*) from v_smooth where abs(x_m) <= 100 and abs(y_m) <= 100 group by all""",
    "keyframes": "select match_id, count(*) as n, count(*) filter (frame_idx % 25 = 0 or frame_idx = 0 or hist_distance > 0.9) as recalibrated from v_motion where frame_idx % 5 = 0 or hist_distance > 0.9 group by all",
    "sampled_frames": "with t as (select match_id, greatest(1, (max(frame_idx) + 1) // 100) as step from v_motion group by all) select match_id, frame_idx from v_motion join t using (match_id) where frame_idx % step = 0 and frame_idx < step * 100",
    "mask_boxes": "with f as (select *, cast(trunc((x1 + x2) / 2) as int) as px, cast(trunc(y2) as int) as py from v_box), m as (select distinct match_id, frame_idx, px, py from f where det_idx % 3 = 0) select match_id, frame_idx, det_idx, class_id from f where class_id = 32 or exists (select 1 from m where m.match_id = f.match_id and m.frame_idx = f.frame_idx and m.px = f.px and m.py = f.py)",
    "ball_comet": "with s as (select match_id, frame_idx, row_number() over (partition by match_id order by frame_idx) as i, sqrt(power(x_m * 10 - lag(x_m * 10) over (partition by match_id order by frame_idx), 2) + power(y_m * 10 - lag(y_m * 10) over (partition by match_id order by frame_idx), 2)) <= 200 as near from v_ball) select match_id, frame_idx, least(i, 14) as n_trail, cast(coalesce(sum(case when near then 1 else 0 end) over (partition by match_id order by frame_idx rows between 12 preceding and current row), 0) as bigint) as n_drawn from s",
    "speed_badges": f"with recursive {_SMOOTHED} select match_id, track_id, frame_idx, case when now >= 2.5 then ' ' || printf('%.1f', now) || 'km/h' else '' end as badge from sm",
    "smoothed_speed": f"with recursive {_SMOOTHED} select match_id, track_id, frame_idx, now as smoothed_kmh, {_ACTIVITY.format(s='now')} as activity from sm",
    "squad_summary": f"""with recursive {_SMOOTHED}, last as (select match_id, track_id, max(speed) as top, arg_max(now, frame_idx) as now from sm group by all), dist as (with {_STEPS} select match_id, track_id, sum(counted_m) as distance_m from s group by all)
        select match_id, round(max(top), 1) as max_speed_kmh, round(sum(distance_m) / 1000.0, 3) as total_distance_km, round(coalesce(avg(now) filter (now > 0), 0), 1) as avg_speed_kmh, count(*) as n_tracks from last join dist using (match_id, track_id) group by all""",
    "possession_texts": "with c as (select *, frame_idx % 5 = 0 as contested from v_poss), s as (select match_id, frame_idx, holder_id, contested, sum(case when not contested and holder_team = 0 then 1 else 0 end) over w as a, sum(case when not contested and holder_team = 1 then 1 else 0 end) over w as b from c window w as (partition by match_id order by frame_idx)), p as (select *, case when a + b > 0 then round(a / (a + b) * 100.0, 1) else 50 end as pct from s) select match_id, frame_idx, 'POSS: A ' || printf('%.0f', round(pct)) || '% | B ' || printf('%.0f', round(100.0 - pct)) || '%' as shares, case when holder_id is not null then 'CARRIER: #' || holder_id when contested then 'BALL: 50-50 DUEL' else 'BALL: FREE' end as carrier from p",
    "frame_prefix": "select match_id, count(*) as n, round(sum(dx), 3) as dx from v_motion where frame_idx < 150 group by all",
    "persons_by_order": "with b as (select *, row_number() over (partition by match_id, frame_idx order by det_idx) as k from v_box where class_id = 0), c as (select *, row_number() over (partition by match_id, frame_idx order by x_m * 100 + y_m / 100) as k from v_crowd) select b.match_id, b.frame_idx, b.det_idx, c.x_m, c.y_m from b left join c using (match_id, frame_idx, k)",
    "merged_boxes": "with u as (select 0 as part, * from v_box where track_id % 2 = 0 union all select 1, * from v_box where track_id % 2 = 1 union all select 2, * replace (-1 as track_id) from v_box where class_id = 32) select match_id, frame_idx, row_number() over (partition by match_id, frame_idx order by part, det_idx) - 1 as det_idx, track_id, class_id, x1 from u",
    "pitch_pixels": f"select match_id, frame_idx, det_idx, {_CANVAS.format(pad=12, w=320, h=210, head=0, n='radar')}, {_CANVAS.format(pad=40, w=900, h=640, head=50, n='net')}, {_HEAT_X} as heat_x, {_HEAT_Y} as heat_y from v_pos",
    "minimap_pixels": "select match_id, frame_idx, det_idx, least(greatest(cast(trunc((x1 + x2) / 2 / 1920 * 200) as int), 4), 195) as map_x, least(greatest(cast(trunc(y2 / 1080 * 130) as int), 4), 125) as map_y, case when track_id < 0 then -1 else track_id % 20 end as colour from v_box",
    "projected_feet": "with f as (select match_id, frame_idx, det_idx, (x1 + x2) / 2 as u, y2 as v from v_box) select match_id, frame_idx, det_idx, round((0.05e0 * u + 0.01e0 * v - 3e0) / (0.0001e0 * u + 0.0002e0 * v + 1e0), 5) as x_m, round((0.002e0 * u + 0.06e0 * v - 5e0) / (0.0001e0 * u + 0.0002e0 * v + 1e0), 5) as y_m from f",
    "warped_boxes": "with c as (select match_id, frame_idx, det_idx, [1.01e0 * x1 - 0.02e0 * y1 + 5e0, 1.01e0 * x2 - 0.02e0 * y1 + 5e0, 1.01e0 * x2 - 0.02e0 * y2 + 5e0, 1.01e0 * x1 - 0.02e0 * y2 + 5e0] as xs, [0.02e0 * x1 + 1.01e0 * y1 - 3e0, 0.02e0 * x2 + 1.01e0 * y1 - 3e0, 0.02e0 * x2 + 1.01e0 * y2 - 3e0, 0.02e0 * x1 + 1.01e0 * y2 - 3e0] as ys from v_box) select match_id, frame_idx, det_idx, round(list_min(xs), 4) as x1, round(list_min(ys), 4) as y1, round(list_max(xs), 4) as x2, round(list_max(ys), 4) as y2 from c",
    "box_overlap": f"with {_IOU} select match_id, frame_idx, det_idx, round(iou, 6) as iou from iou where det_idx = gt_idx",
    "role_labels": f"select role_id, count(*) as n, {_ROLE.format(c='role_id')} as name, case role_id when 0 then 'A ' when 1 then 'B ' when 3 then 'A-GK ' when 4 then 'B-GK ' when 5 then 'COACH ' else 'REF ' end as prefix, {_SIDE} as side from v_pos group by role_id",
    "deepest_players": "with o as (select *, row_number() over (partition by match_id, frame_idx order by x_m, det_idx) as lo, row_number() over (partition by match_id, frame_idx order by x_m desc, det_idx) as hi from v_pos where x_m between -2 and 107 and y_m between -2 and 70) select match_id, frame_idx, max(case when lo = 1 and x_m < 32 then det_idx end) as deepest_a, max(case when hi = 1 and x_m > 73 then det_idx end) as deepest_b from o group by all",
    "kit_roles": "with o as (select *, row_number() over (partition by match_id, frame_idx order by x_m, det_idx) as lo, row_number() over (partition by match_id, frame_idx order by x_m desc, det_idx) as hi from v_pos) select match_id, frame_idx, det_idx, case when y2 > 880 then 5 when lo = 1 and x_m < 32 and y_m between 10 and 58 then 3 when hi = 1 and x_m > 73 and y_m between 10 and 58 then 4 when val < 110 then 2 when hue between 40 and 72 and sat >= 68 then 1 when sat < 70 and val >= 120 then 0 when hue between 35 and 75 and sat >= 55 then 1 else 0 end as raw_role from o",
    "voted_roles": "with w as (select match_id, track_id, frame_idx, det_idx, role_id, list(role_id) over (partition by match_id, track_id order by frame_idx, det_idx rows between 14 preceding and current row) as votes from v_pos), d as (select *, unnest(list_distinct(votes)) as cand from w), s as (select match_id, track_id, frame_idx, det_idx, cand, len(list_filter(votes, lambda q: q = cand)) as n, list_position(votes, cand) as first from d) select match_id, track_id, frame_idx, arg_max(cand, n * 1000 - first) as role_id from s group by match_id, track_id, frame_idx, det_idx",
    "role_counts": "select match_id, frame_idx, count(*) filter (role_id in (0, 3)) as team_a, count(*) filter (role_id in (1, 4)) as team_b, count(*) filter (role_id = 2) as referees, count(*) filter (role_id = 3) as keepers_a, count(*) filter (role_id = 4) as keepers_b, count(*) filter (role_id = 5) as coaches from v_pos group by all",
    "space_control": f"with {_CONTROL} select * from control",
    "mean_space_control": f"with {_CONTROL} select match_id, round(avg(a_pct), 1) as a_pct, round(avg(b_pct), 1) as b_pct from control group by all",
    "side_centroids": f"with s as (select *, {_SIDE} as side from v_pos) select match_id, frame_idx, side, round(avg(x_m), 1) as cx, round(avg(y_m), 1) as cy, count(*) as n from s where side is not null group by all",
    "heat_counts": f"select match_id, track_id, {_HEAT_X} as px, {_HEAT_Y} as py, count(*) as n from v_smooth where track_id >= 0 and x_m between -2 and 107 and y_m between -2 and 70 group by all",
    "busiest_tracks": "with c as (select match_id, track_id, count(*) as n from v_smooth where track_id >= 0 and x_m between -2 and 107 and y_m between -2 and 70 group by all), r as (select *, row_number() over (partition by match_id order by n desc, track_id) as rank from c) select * from r where rank <= 4",
    "nearest_two": f"with {_NEAR} select match_id, frame_idx, rank, det_idx, round(dist_m, 4) as dist_m from ranked where rank <= 2",
    "possession_candidates": f"with {_NEAR}, t as (select match_id, frame_idx, max(case when rank = 1 then track_id end) as t1, max(case when rank = 1 then team_id end) as g1, max(case when rank = 1 then dist_m end) as d1, max(case when rank = 2 then team_id end) as g2, max(case when rank = 2 then dist_m end) as d2 from ranked where rank <= 2 group by all) select match_id, frame_idx, case when d1 <= 1.8 then t1 end as candidate, case when d1 <= 1.8 then g1 end as candidate_team, round(coalesce(d1, 999), 4) as dist_m, coalesce(d1 <= 1.8 and g1 <> g2 and d2 <= 1.8 + 0.4, false) as contested from v_ball left join t using (match_id, frame_idx)",
    "possession_account": "with c as (select *, frame_idx % 5 = 0 as contested from v_poss), s as (select match_id, frame_idx, cast(sum(case when not contested and holder_team = 0 then 1 else 0 end) over w as bigint) as a_frames, cast(sum(case when not contested and holder_team = 1 then 1 else 0 end) over w as bigint) as b_frames, cast(sum(case when contested then 1 else 0 end) over w as bigint) as contested_frames, count(*) over w as frames from c window w as (partition by match_id order by frame_idx)) select *, case when a_frames + b_frames > 0 then round(a_frames / (a_frames + b_frames) * 100.0, 1) else 50 end as a_pct from s",
    "possession_frames": "select match_id, holder_id, count(*) as n from v_poss where holder_id is not null group by all",
    "match_events": _MATCH_EVENTS,
    "match_events_fold": _MATCH_EVENTS,
    "event_summary": f"""with {_EVENTS}, c as (select match_id, {", ".join(f"count(*) filter (event_type = '{k}' and team_id = {t}) as {n}_{'ab'[t]}" for k, n in (("PASS", "passes"), ("INTERCEPTION", "interceptions"), ("SHOT", "shots"), ("TACKLE", "tackles")) for t in (0, 1))}, count(*) filter (event_type in ('INTERCEPTION', 'TACKLE')) as turnovers, count(*) as n_events from ev group by all)
        , d as (select *, passes_a + interceptions_b as attempts_a, case when passes_a + interceptions_b > 0 then round(passes_a / (passes_a + interceptions_b) * 100.0, 1) else 100 end as accuracy_a, passes_b + interceptions_a as attempts_b, case when passes_b + interceptions_a > 0 then round(passes_b / (passes_b + interceptions_a) * 100.0, 1) else 100 end as accuracy_b from c)
        select *, passes_a || '/' || attempts_a || ' (' || printf('%.1f', accuracy_a) || '%)' as pass_text_a, passes_b || '/' || attempts_b || ' (' || printf('%.1f', accuracy_b) || '%)' as pass_text_b from d""",
    "event_texts": f"with {_EVENTS}, t as (select *, case team_id when 0 then 'Team A' when 1 then 'Team B' else 'Neutral' end as who from ev) select match_id, event_id, printf('%02d:%02d', cast(floor(floor(timestamp_s) / 60) as int), cast(floor(timestamp_s) as int) % 60) as clock, case event_type when 'TACKLE' then who || ' Tackle: #' || primary_id || ' won duel against #' || secondary_id when 'INTERCEPTION' then who || ' Interception: #' || primary_id || ' intercepted #' || secondary_id when 'SHOT' then who || ' Shot: #' || primary_id || ' (' || printf('%.1f', round(speed_kmh, 1)) || ' km/h)' else who || ' Pass: #' || primary_id || ' -> #' || secondary_id || ' (' || printf('%.1f', round(distance_m, 1)) || 'm)' end as description from t",
    "event_shots": f"with {_EVENTS}, evs as (select match_id, event_id as shot_id, frame_idx, primary_id as shooter_id, team_id, start_x as x_m, start_y as y_m, speed_kmh from ev where event_type = 'SHOT'), {_SHOTS.replace('v_shot', 'evs')} select match_id, shot_id, shooter_id, team_id, defenders, round(dist_m, 4) as dist_m, round(angle_deg, 4) as angle_deg, round(xg, 5) as xg from sh",
    "event_passes": f"with {_EVENTS}, evp as (select match_id, event_id as action_id, frame_idx, primary_id as passer_id, secondary_id as receiver_id, team_id, start_x as sx, start_y as sy, end_x as ex, end_y as ey, speed_kmh from ev where event_type = 'PASS'), {_VALUED.replace('v_pass', 'evp')} select match_id, action_id, passer_id, receiver_id, round(delta_xt, 6) as delta_xt, progressive, round(length_m, 4) as length_m from valued",
    "active_events": f"with {_EVENTS} select p.match_id, p.frame_idx, case when p.frame_idx < ev.frame_idx + 40 then ev.event_id end as event_id, case when p.frame_idx < ev.frame_idx + 40 then ev.event_type end as event_type from v_poss p asof left join ev on p.match_id = ev.match_id and p.frame_idx >= ev.frame_idx",
    "event_timeline": f"with {_EVENTS}, r as (select *, row_number() over (partition by match_id order by event_id desc) as k from ev) select match_id, event_id, event_type, frame_idx from r where k <= 5",
    "shot_xg": f"with {_SHOTS} select match_id, shot_id, team_id, defenders, round(dist_m, 4) as dist_m, round(angle_deg, 4) as angle_deg, round(xg, 5) as xg from sh",
    "pass_values": f"with {_VALUED} select match_id, action_id, team_id, round(xt_start, 6) as xt_start, round(xt_end, 6) as xt_end, round(delta_xt, 6) as delta_xt, progressive, round(length_m, 4) as length_m from valued",
    "threat_grid": f'with {_GRID} select "row", col, round(xt, 6) as xt from grid',
    "pass_links": f"with {_VALUED}, {_LINKS} select match_id, team_id, passer_id, receiver_id, n, round(avg_length_m, 3) as avg_length_m, round(avg_kmh, 3) as avg_kmh, round(delta_xt, 4) as delta_xt, least(greatest(cast(trunc(1 + 0.8 * n) as int), 1), 6) as thickness, round(least(0.85e0, 0.35e0 + 0.1e0 * n), 3) as opacity from links where n >= 2",
    "pass_nodes": f"with {_VALUED}, {_NODES_ONLY} select match_id, team_id, player_id, made, received, involvements, round(xt_created, 4) as xt_created, role, least(greatest(10 + cast(trunc(0.8 * involvements) as int), 10), 22) as radius from nodes",
    "network_summaries": f"""with {_VALUED}, {_LINKS}, {_NODES_PLACED},
        n as (select match_id, team_id, count(*) as n_nodes, arg_max(player_id, involvements * 1000 - player_id) as leader from nodes group by all),
        l as (select match_id, team_id, count(*) as n_links, arg_max(passer_id, n * 10000 - passer_id * 100 - receiver_id) as top_passer, arg_max(receiver_id, n * 10000 - passer_id * 100 - receiver_id) as top_receiver, max(n) as top_count from links group by all),
        a as (select match_id, team_id, avg(length_m) as al from valued group by all)
        select match_id, team_id, n_nodes, coalesce(n_links, 0) as n_links, round(case when n_nodes > 1 then coalesce(n_links, 0) / (n_nodes * (n_nodes - 1)) else 0 end, 5) as density, round(coalesce(al, 14.5), 3) as avg_length_m, leader, top_passer, top_receiver, top_count from n left join l using (match_id, team_id) left join a using (match_id, team_id)""",
    "team_formations": f"""with {_VALUED}, {_NODES_PLACED},
        f as (select match_id, team_id, count(*) as n_nodes, list_sort(list(x_m) filter (role <> 'GK')) as up, avg(x_m) filter (role <> 'GK') as m from nodes group by all),
        x as (select *, case when coalesce(m, 0) <= 55 then up else list_sort(list_transform(up, lambda q: 105 - q)) end as xs from f)
        select match_id, team_id, n_nodes, case when n_nodes < 6 then '4-3-3 (Standard)' when len(xs) < 10 then '4-3-3' when xs[4] - xs[1] > 12 then '3-4-' || (len(xs) - 7) when xs[5] - xs[1] < 8 then '5-3-2' else '4-3-3' end as formation from x""",
    "top_creators": f"with {_VALUED}, {_NODES_ONLY}, r as (select *, row_number() over (partition by match_id, team_id order by xt_created desc, player_id) as rank from nodes) select match_id, team_id, rank, player_id, round(xt_created, 4) as xt_created from r where rank <= 5",
    "latest_actions": f"with {_VALUED}, r as (select *, row_number() over (partition by match_id order by action_id desc) as k from valued) select match_id, action_id, round(delta_xt, 6) as delta_xt from r where k <= 20",
    "threat_totals": f"with {_VALUED}, {_SHOTS}, s as (select match_id, team_id, count(*) as shots, sum(xg) as xg from sh group by all), t as (select match_id, team_id, count(*) as passes, sum(greatest(0, delta_xt)) as xt, count(*) filter (progressive) as progressive from valued group by all) select match_id, team_id, case when team_id = 0 then 'Team A' else 'Team B' end as team, coalesce(shots, 0) as shots, round(coalesce(xg, 0), 3) as xg, coalesce(passes, 0) as passes, round(coalesce(xt, 0), 3) as xt, coalesce(progressive, 0) as progressive from s full outer join t using (match_id, team_id)",
    "camera_labels": f"select {_PAN} as pan, {_TILT} as tilt, {_ZOOM} as zoom_state, count(*) as n from v_motion group by all",
    "pan_histogram": f"with k as (select distinct match_id, pan from v_motion, (values ('STATIC'), ('PAN LEFT'), ('PAN RIGHT')) t(pan)), c as (select match_id, {_PAN} as pan, count(*) as n from v_motion group by all) select match_id, pan, coalesce(n, 0) as n from k left join c using (match_id, pan)",
    "cut_scores": "select match_id, frame_idx, round(least(1, greatest(0, 0.6 * hist_distance + 0.4 * edge_diff + case when flow_inlier < 0.1 then 0.15 else 0 end)), 5) as score from v_motion",
    "camera_cuts": """with recursive c as (select match_id, frame_idx, least(1e0, greatest(0e0, 0.6e0 * hist_distance + 0.4e0 * edge_diff + case when flow_inlier < 0.1e0 then 0.15e0 else 0e0 end)) >= 0.52e0 or (hist_distance >= 0.5e0 and edge_diff >= 0.45e0) as hit, row_number() over (partition by match_id order by frame_idx) as k from v_motion),
        r as (select match_id, k, frame_idx, hit as is_cut, case when hit then frame_idx end as last, case when hit then 1 else 0 end as n from c where k = 1
              union all select c.match_id, c.k, c.frame_idx, c.hit and (r.last is null or c.frame_idx - r.last >= 15), case when c.hit and (r.last is null or c.frame_idx - r.last >= 15) then c.frame_idx else r.last end, r.n + case when c.hit and (r.last is null or c.frame_idx - r.last >= 15) then 1 else 0 end from r join c on c.match_id = r.match_id and c.k = r.k + 1)
        select match_id, frame_idx, is_cut, n as cut_count from r""",
    "last_calibration": "select m.match_id, m.frame_idx, f.dx, f.frame_idx as calibrated_at from v_motion m asof left join (select * from v_motion where frame_idx % 25 = 3) f on m.match_id = f.match_id and m.frame_idx >= f.frame_idx",
    "histogram_distance": "with b as (select match_id, frame_idx, bin, (1 + (frame_idx * 7 + bin * 3) % 11) * 1e0 as p from v_motion, range(8) t(bin)), q as (select *, p / sum(p) over (partition by match_id, frame_idx) as q from b), d as (select a.match_id, a.frame_idx, sum(sqrt(a.q * c.q)) as bc from q a join q c on a.match_id = c.match_id and a.bin = c.bin and a.frame_idx = c.frame_idx + 1 group by all) select match_id, frame_idx, round(sqrt(greatest(0, 1 - bc)), 6) as hist_distance from d",
    "reid_costs": "select c.vec_id // 50 as match_id, c.vec_id as det_idx, t.vec_id as track_id, round(case when c.team_id <> t.team_id or (c.vec_id % 7 > 0 and t.vec_id % 7 > 0 and c.vec_id % 7 <> t.vec_id % 7) then 99 else 1 - list_cosine_similarity(c.emb::double[], t.emb::double[]) end, 4) as cost from v_emb c join v_emb t on c.vec_id // 50 = t.vec_id // 50 where c.candidate and not t.candidate",
    "reid_gallery": """with l as (select vec_id % 40 as track_id, list(emb::double[] order by vec_id) as es, count(*) as n, max(vec_id) as last_seen from v_emb group by all),
        u as (select track_id, n, last_seen, list_transform(es, lambda x: list_transform(x, lambda q: q / sqrt(list_sum(list_transform(x, lambda p: p * p))))) as us, es from l),
        g as (select *, list_reduce(es, lambda a, b: list_transform([list_transform(list_zip(list_transform(a, lambda q: q / sqrt(list_sum(list_transform(a, lambda p: p * p)))), b), lambda z: 0.85e0 * z[1] + 0.15e0 * z[2])], lambda x: list_transform(x, lambda q: q / sqrt(list_sum(list_transform(x, lambda p: p * p)))))[1]) as v from u)
        select track_id, n, last_seen, round(case when n = 1 then us[1][1] else v[1] end, 5) as e0 from g where 700 - last_seen <= 300""",
    "camera_texts": f"with l as (select *, {_PAN} as pan, {_ZOOM} as z from v_motion) select match_id, frame_idx, case when pan <> 'STATIC' then 'CAM: ' || pan || ' (' || case when dx > 0 then '+' else '' end || printf('%.0f', round(dx)) || 'px)' when z <> 'STEADY' then 'CAM: ' || z || ' (' || cast(round(cast(zoom as decimal(18, 6)), 2) as decimal(18, 2)) || 'x)' else 'CAM: STABLE (' || cast(round(cast(zoom as decimal(18, 6)), 2) as decimal(18, 2)) || 'x)' end as text from l",
    "camera_moves": "select match_id, frame_idx, round(dx, 4) as dx, round(dy, 4) as dy, round(zoom, 6) as scale, round(degrees(dx / 100.0), 6) as degrees from v_motion",
    "moved_homographies": """with s as (select *, max(case when frame_idx % 25 = 0 then frame_idx end) over (partition by match_id order by frame_idx) as since from v_motion),
        d as (select match_id, frame_idx, coalesce(sum(case when frame_idx > since then dx end) over w, 0) as x, coalesce(sum(case when frame_idx > since then dy end) over w, 0) as y from s where since is not null window w as (partition by match_id, since order by frame_idx)),
        n as (select *, 1 - 0.0001e0 * x - 0.0002e0 * y as k from d)
        select match_id, frame_idx, round(0.05e0 / k, 6) as h0, round(0.01e0 / k, 6) as h1, round((-3 - 0.05e0 * x - 0.01e0 * y) / k, 6) as h2, round(0.002e0 / k, 6) as h3, round(0.06e0 / k, 6) as h4, round((-5 - 0.002e0 * x - 0.06e0 * y) / k, 6) as h5, round(0.0001e0 / k, 6) as h6, round(0.0002e0 / k, 6) as h7, 1.0 as h8 from n""",
    "coasted_tracks": f"""with recursive {_SEEN_BOX}, o as (select *, row_number() over (partition by match_id, track_id order by frame_idx) as i, lead(frame_idx) over (partition by match_id, track_id order by frame_idx) as nf, max(frame_idx) over (partition by match_id) as ef from ob),
        st as (select match_id, track_id, i, frame_idx, nf, ef, x1, y1, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, 0e0 as vx, 0e0 as vy from o where i = 1
            union all select o.match_id, o.track_id, o.i, o.frame_idx, o.nf, o.ef, o.x1, o.y1, (o.x1 + o.x2) / 2, (o.y1 + o.y2) / 2,
                case when o.frame_idx - st.frame_idx - 1 > 45 then 0 else (o.x1 + o.x2) / 2 - (st.cx + st.vx * list_sum(list_transform(range(0, least(4, o.frame_idx - st.frame_idx - 1) + 1), lambda j: case when j = 0 then 0 else power(0.85e0, j) end))) end,
                case when o.frame_idx - st.frame_idx - 1 > 45 then 0 else (o.y1 + o.y2) / 2 - (st.cy + st.vy * list_sum(list_transform(range(0, least(4, o.frame_idx - st.frame_idx - 1) + 1), lambda j: case when j = 0 then 0 else power(0.85e0, j) end))) end
            from st join o on o.match_id = st.match_id and o.track_id = st.track_id and o.i = st.i + 1),
        co as (select *, unnest(range(1, least(4, coalesce(nf, ef + 1) - frame_idx - 1) + 1)) as j from st)
        select match_id, frame_idx, track_id, round(x1, 3) as x1, round(y1, 3) as y1, false as coasted from st
        union all select match_id, frame_idx + j, track_id, round(x1 + vx * list_sum(list_transform(range(1, j + 1), lambda n: power(0.85e0, n))), 3), round(y1 + vy * list_sum(list_transform(range(1, j + 1), lambda n: power(0.85e0, n))), 3), true from co""",
    "skipped_frame_boxes": f"with {_ONE_BOX}, m as (select *, coalesce(0.9e0 * ((x1 + x2) / 2 - lag((x1 + x2) / 2) over w), 0) as dx, coalesce(0.9e0 * ((y1 + y2) / 2 - lag((y1 + y2) / 2) over w), 0) as dy from ob window w as (partition by match_id, track_id order by frame_idx)) select match_id, frame_idx + 1 as frame_idx, track_id, round(x1 + dx, 3) as x1, round(y2 + dy, 3) as y2, round(conf * 0.98e0, 5) as conf from m where greatest(abs(x1 + dx), abs(x2 + dx), abs(y1 + dy), abs(y2 + dy)) <= 10000",
    "detection_metrics": f"with {_DETECT} select match_id, n_pred, tp, fp, fn, round(precision, 5) as precision, round(recall, 5) as recall, round(f1, 5) as f1, round(map50, 5) as map50, round(map50_95, 5) as map50_95 from det",
    "tracking_metrics": f"with {_TRACKS} select * from tracking",
    "homography_metrics": "with d as (select match_id, sqrt(power((det_idx - 10) / 100.0, 2) + power((det_idx % 3) / 50.0, 2)) as d from v_pos) select match_id, round(sqrt(avg(d * d)), 6) as rmse_m, round(avg(d), 6) as mae_m, round(max(d), 6) as max_m, count(*) as n from d group by all",
    "kinematics_metrics": "select match_id, round(count(*) filter (ball_kmh <= 38) / count(*) * 100.0, 4) as valid_pct, round(coalesce(avg(ball_kmh) filter (ball_kmh <= 38), 0), 4) as mean_kmh, round(coalesce(max(ball_kmh) filter (ball_kmh <= 38), 0), 4) as max_kmh, round(coalesce(var_pop(ball_kmh) filter (ball_kmh <= 38), 0), 4) as variance from v_ball group by all",
    "evaluation_report": f"with {_DETECT}, {_TRACKS}, k as (select match_id, count(*) filter (ball_kmh <= 38) / count(*) * 100.0 as valid_pct from v_ball group by all) select match_id, round(map50, 5) as map50, mota, round(valid_pct, 4) as valid_pct, round(least(98.5, 30 * map50 + 30 * coalesce(mota, 0) + 0.2 * coalesce(valid_pct, 0) + 20), 3) as score from det left join tracking using (match_id) left join k using (match_id)",
    "quality_report": "select match_id, count(*) as n, round(avg(brightness), 4) as brightness, round(stddev_pop(brightness), 4) as brightness_std, round(avg(blur), 4) as blur, round(count(*) filter (blur < 100) / count(*) * 100.0, 4) as blurry_pct, round(avg(grass_pct), 4) as grass_pct, round(avg(turf_h), 4) as turf_h, round(avg(turf_s), 4) as turf_s, round(avg(turf_v), 4) as turf_v, concat_ws('; ', case when avg(brightness) < 80 then 'low illumination: equalize or correct gamma' when avg(brightness) > 180 then 'bright exposure: normalize the histogram' end, case when count(*) filter (blur < 100) / count(*) * 100.0 > 15 then 'motion blur in ' || printf('%.1f', round(count(*) filter (blur < 100) / count(*) * 100.0, 1)) || '% of frames: coast tracks' end, case when avg(grass_pct) > 50 then 'turf covers ' || printf('%.1f', round(avg(grass_pct), 1)) || '% of the view: segment by colour' else 'little turf in view: camera may be close' end) as advice from v_frames group by all",
    "run_stats": "with f as (select match_id, frame_idx, count(*) filter (class_id <> 32) as p, max(case when class_id = 32 then 1 else 0 end) as b from v_box group by all), a as (select match_id, count(*) as frames, avg(p) as ap, avg(b) as br from f group by all), t as (select match_id, count(distinct track_id) as n_tracks from v_box where track_id >= 0 group by all) select match_id, frames, round(ap, 5) as avg_players, round(br, 5) as ball_rate, coalesce(n_tracks, 0) as n_tracks from a left join t using (match_id)",
    "position_rollup": f"with s as (select *, {_SIDE} as side from v_pos) select match_id, side, track_id, count(*) as n, round(avg(x_m), 4) as x_m from s group by rollup (match_id, side, track_id)",
    "stream_windows": "select cast(epoch(time_bucket(interval 1 hour, ts)) as bigint) as start_s, event_type, count(*) as n, round(sum(value), 3) as total from events group by all",
    "stream_events": _MATCH_EVENTS,
    "stream_possession": f"with recursive {_ASSIGNED} select * from assigned",
    "stream_trails": """with t as (select match_id, frame_idx, track_id, x_m, y_m, count(*) over w as n_trail, first_value(x_m) over w as x0, first_value(y_m) over w as y0 from v_pos
        window w as (partition by match_id, track_id order by frame_idx, det_idx rows between 19 preceding and current row))
        select match_id, frame_idx, track_id, cast(n_trail as integer) as n_trail, round(sqrt((x_m - x0) * (x_m - x0) + (y_m - y0) * (y_m - y0)), 4) as net from t""",
    "stream_sessions": """with e as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) > interval 2 hours, true) as opens from events where ts is not null),
        s as (select user_id, ts, sum(case when opens then 1 else 0 end) over (partition by user_id order by ts) as k from e)
        select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts) + interval 2 hours) as end_us, count(*) as n from s group by user_id, k""",
    "possession_assigned": f"with recursive {_ASSIGNED} select * from assigned",
    "possession_summary": f"""with recursive {_ASSIGNED},
        s as (select match_id, count(*) filter (not contested and holder_team = 0) as a, count(*) filter (not contested and holder_team = 1) as b, count(*) filter (contested) as c, count(*) as n, max(turnovers) as turnovers from assigned group by all),
        h as (select match_id, holder_id, count(*) as frames, min(frame_idx) as since from assigned where holder_id is not null group by all),
        t as (select match_id, arg_max(holder_id, frames * 1000000 - since) as top_carrier, max(frames) as top_frames from h group by all)
        select match_id, case when a + b > 0 then round(a / (a + b) * 100.0, 1) else 50 end as a_pct, case when a + b > 0 then round(b / (a + b) * 100.0, 1) else 50 end as b_pct, round(c / n * 100.0, 1) as contested_pct, turnovers, top_carrier, top_frames from s left join t using (match_id)""",
    "pitch_boundaries": """with recursive c as (select match_id, frame_idx, row_number() over (partition by match_id order by frame_idx) as k, case when frame_idx % 4 <> 0 then 100 + dx end as t, case when frame_idx % 4 <> 0 then 800 + dy end as b from v_motion),
        r as (select match_id, k, frame_idx, t as top, b as bottom from c where k = 1
              union all select c.match_id, c.k, c.frame_idx, case when c.t is null then r.top when r.top is null then c.t else 0.8e0 * r.top + 0.2e0 * c.t end, case when c.b is null then r.bottom when r.bottom is null then c.b else 0.8e0 * r.bottom + 0.2e0 * c.b end from r join c on c.match_id = r.match_id and c.k = r.k + 1)
        select match_id, frame_idx, round(top, 4) as top, round(bottom, 4) as bottom from r""",
    "telemetry_packets": f"with recursive {_SMOOTHED}, lf as (select match_id, max(frame_idx) as frame_idx from v_pos group by all) select v.match_id, v.frame_idx, v.det_idx, v.track_id, v.role_id, {_ROLE.format(c='v.role_id')} as role, round(v.x_m, 2) as x_m, round(v.y_m, 2) as y_m, round(coalesce(sm.speed, 0), 1) as speed_kmh, coalesce({_ACTIVITY.format(s='sm.now').replace('else', 'when sm.now is null then null else')}, 'Standing') as activity from v_pos v join lf on lf.match_id = v.match_id and lf.frame_idx = v.frame_idx left join sm on sm.match_id = v.match_id and sm.track_id = v.track_id and sm.frame_idx = v.frame_idx",
    "match_summaries": "with f as (select match_id, frame_idx, count(*) filter (class_id <> 32) as p, max(case when class_id = 32 then 1 else 0 end) as b from v_box group by all), a as (select match_id, count(*) as frames, avg(p) as ap, avg(b) as br from f group by all), t as (select match_id, count(distinct track_id) as n_tracks from v_box where track_id >= 0 group by all), q as (select match_id, count(*) as n, avg(brightness) as bri, avg(blur) as blu from v_frames group by all) select match_id, frames as run_frames, round(ap, 5) as run_avg_players, round(br, 5) as run_ball_rate, case when frames is not null then coalesce(n_tracks, 0) end as run_n_tracks, n as quality_n, round(bri, 4) as quality_brightness, round(blu, 4) as quality_blur from a left join t using (match_id) full outer join q using (match_id)",
    "placed_links": f"with {_VALUED}, {_LINKS}, {_NODES_PLACED} select l.match_id, l.team_id, l.passer_id, l.receiver_id, l.n, round(a.x_m, 3) as passer_x, round(a.y_m, 3) as passer_y, round(b.x_m, 3) as receiver_x, round(b.y_m, 3) as receiver_y from links l join nodes a on a.match_id = l.match_id and a.team_id = l.team_id and a.player_id = l.passer_id join nodes b on b.match_id = l.match_id and b.team_id = l.team_id and b.player_id = l.receiver_id",
    "carrier_places": f"with recursive {_ASSIGNED} select p.match_id, p.frame_idx, p.track_id, p.det_idx, p.x_m, p.y_m from assigned a join v_pos p on p.match_id = a.match_id and p.frame_idx = a.frame_idx and p.track_id = a.holder_id",
}
SQL["stream_roles"] = SQL["voted_roles"]  # a stream of the same rows
SQL["stream_coasted"] = SQL["coasted_tracks"]
SQL["stream_gallery"] = SQL["reid_gallery"].replace(" where 700 - last_seen <= 300", " where (select max(vec_id) from v_emb) - last_seen <= 300")

# Frame by frame: the box is moved by the camera (the box round its moved corners), then replaced, coasted or carried.
_AT = "{f}({a} * x1 + {b} * y1, {a} * x2 + {b} * y1, {a} * x2 + {b} * y2, {a} * x1 + {b} * y2) + {c}"
_WARP = ", ".join(f"{_AT.format(f=f, a=a, b=b, c=c)} as {n}" for n, f, a, b, c in (("wx1", "least", "a", "b", "c"), ("wy1", "least", "-b", "a", "f"), ("wx2", "greatest", "a", "b", "c"), ("wy2", "greatest", "-b", "a", "f")))
_STEP = "case when k.x1 is not null then k.{c} when w.key then w.w{c} + w.v{d} * power(0.85e0, w.lost + 1) else w.w{c} + 0.9e0 * w.v{d} end as {c}"
SQL["carried_boxes"] = SQL["stream_carried"] = f"""with recursive k as (select match_id, track_id, frame_idx, x_m * 10 - 8 as x1, y_m * 10 - 20 as y1, x_m * 10 + 8 as x2, y_m * 10 + 20 as y2 from v_smooth where (frame_idx + track_id) % 8 <> 0 and frame_idx % 3 = 0),
    mo as (select match_id, frame_idx, zoom * 1e0 as a, (frame_idx % 5 - 2) / 1000e0 as b, (3 * dx + 1) / 21 as c, (3 * dy + 1) / 21 as f from v_motion),
    o as (select k.*, row_number() over (partition by match_id, track_id order by frame_idx) as i, max(frame_idx) over (partition by match_id, track_id) as last_found from k),
    st as (select match_id, track_id, frame_idx, last_found, x1, y1, x2, y2, 0e0 as vx, 0e0 as vy, 0 as lost, 'found' as kind from o where i = 1
      union all select n.* replace (case when kind = 'carried' and greatest(abs(x1), abs(y1), abs(x2), abs(y2)) > 10000 then 99 else lost end as lost) from (select w.match_id, w.track_id, w.frame_idx, w.last_found, {", ".join(_STEP.format(c=c, d=c[0]) for c in ("x1", "y1", "x2", "y2"))},
        case when k.x1 is null then w.vx when w.lost > 45 then 0 else (k.x1 + k.x2 - w.wx1 - w.wx2) / 2 end as vx, case when k.x1 is null then w.vy when w.lost > 45 then 0 else (k.y1 + k.y2 - w.wy1 - w.wy2) / 2 end as vy,
        case when k.x1 is not null then 0 else w.lost + w.key::int end as lost, case when k.x1 is not null then 'found' when w.key then 'coasted' else 'carried' end as kind
      from (select u.* replace (case when greatest(abs(wx1), abs(wy1), abs(wx2), abs(wy2)) <= 10000 then lost else 99 end as lost) from (select st.match_id, st.track_id, mo.frame_idx, last_found, vx, vy, lost, mo.frame_idx % 3 = 0 as key, {_WARP} from st join mo on mo.match_id = st.match_id and mo.frame_idx = st.frame_idx + 1 where lost <= 4 or st.frame_idx < last_found) u) w
      left join k on k.match_id = w.match_id and k.track_id = w.track_id and k.frame_idx = w.frame_idx) n)
    select match_id, frame_idx, track_id, round(x1, 3) as x1, round(y1, 3) as y1, round(x2, 3) as x2, round(y2, 3) as y2, case kind when 'found' then 0.9e0 when 'coasted' then 0.5e0 else round(0.9e0 * 0.98e0, 5) end as conf, kind from st where lost <= 4"""

_CELLS = "select distinct match_id, frame_idx, floor(x_m) as cx, floor(y_m) as cy from v_pos where x_m >= 0 and x_m < 105 and y_m >= 0 and y_m < 68"
SQL["film_frames"] = SQL["stream_film"] = f"select match_id, frame_idx, 105 * 68 as n_bytes, count(cx) as n_bright from (select distinct match_id, frame_idx from v_pos) f left join ({_CELLS}) c using (match_id, frame_idx) group by all"
SQL["film_detections"] = f"select match_id, frame_idx, cx * 1e0 as x1, cy * 1e0 as y1, cx + 1e0 as x2, cy + 1e0 as y2, 1e0 as conf, 0 as class_id from ({_CELLS}) c"

SQL["stream_track_counts"] = "select match_id, count(distinct track_id) as n_tracks from v_smooth group by all"
SQL["sql_voronoi"] = f"with {_CONTROL} select match_id, frame_idx, n as a_cells from cc where na > 0 and nb > 0"
# Hull edges: of two neighbours on a line with all points on one side; the sum of their cross products is twice the area.
SQL["territories"] = """with p as (select distinct match_id, track_id, x_m as x, y_m as y from v_pos),
    n as (select match_id, track_id, count(*) as n from v_pos group by all),
    e as (select a.match_id, a.track_id, a.x as ax, a.y as ay, b.x as qx, b.y as qy, min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) as side,
        count(*) filter (abs((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) < 1e-9 and (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) < -1e-12) as between_them
      from p a join p b on a.match_id = b.match_id and a.track_id = b.track_id and (a.x <> b.x or a.y <> b.y) join p c on c.match_id = a.match_id and c.track_id = a.track_id group by all),
    h as (select match_id, track_id, sum(ax * qy - ay * qx) / 2 as area from e where side >= -1e-9 and between_them = 0 group by all)
    select n.match_id, n.track_id, round(coalesce(area, 0), 3) as area_m2, n.n from n left join h using (match_id, track_id)"""
SQL["sql_shots"] = f"""with {_GRID},
    g as (select *, greatest(0.5, sqrt((105 - x_m) * (105 - x_m) + (34 - y_m) * (34 - y_m))) as d, sqrt((105 - x_m) * (105 - x_m) + (30.34 - y_m) * (30.34 - y_m)) as pa, sqrt((105 - x_m) * (105 - x_m) + (37.66 - y_m) * (37.66 - y_m)) as pb,
        least(15, cast(floor(least(104.9, greatest(0, x_m)) / (105 / 16.0)) as int)) as zc, least(11, cast(floor(least(67.9, greatest(0, y_m)) / (68 / 12.0)) as int)) as zr from v_shot),
    t as (select *, degrees(acos(least(1, greatest(-1, ((105 - x_m) * (105 - x_m) + (30.34 - y_m) * (37.66 - y_m)) / greatest(1e-9, pa * pb))))) as ang from g)
    select match_id, shot_id, round(least(0.96, greatest(0.01, 1 / (1 + exp(-(0.85 - 0.115 * d + 0.042 * ang - 0.56 + 0.012 * (least(120, greatest(20, speed_kmh)) - 60) / 10))))), 6) as xg, round(grid.xt, 6) as xt,
      case when speed_kmh < 2 then 'Standing' when speed_kmh < 7.2 then 'Walking' when speed_kmh < 14.4 then 'Jogging' when speed_kmh < 19.8 then 'Running' else 'Sprinting' end as activity,
      round(1 / 7.0, 6) as iou, round((2 * x_m + 1) / (0.001 * y_m + 1), 5) as px from t join grid on grid."row" = t.zr and grid.col = t.zc"""


def _report() -> str:
    """The parts of the report, each by the SQL of its own query, side by side."""
    of = lambda name, columns: f"(select match_id, {columns} from ({SQL[name]}) q)"
    same = lambda part, names: ", ".join(f"{n} as {part}_{n}" for n in names.split())
    teams = lambda name, part, names: f"(select match_id, {', '.join(f'max(case when team_id = {t} then {n} end) as {part}_{n}_{chr(97 + t)}' for n in names.split() for t in (0, 1))} from ({SQL[name]}) q where team_id in (0, 1) group by match_id)"
    kinds = "passes_a passes_b interceptions_a interceptions_b shots_a shots_b tackles_a tackles_b turnovers n_events attempts_a accuracy_a attempts_b accuracy_b pass_text_a pass_text_b"
    parts = [
        f"(select coalesce(a.match_id, b.match_id) as match_id, {same('run', 'frames avg_players ball_rate n_tracks pitch_locked_frames')} from ({SQL['run_stats']}) a full join (select match_id, count(distinct case when area_ratio >= 0.20 then frame_idx end) as pitch_locked_frames from v_pitch group by all) b using (match_id))",
        "(select match_id, count(*) as quality_n, round(avg(brightness), 4) as quality_brightness, round(avg(blur), 4) as quality_blur from v_frames group by all)",
        of("possession_summary", same("possession", "a_pct b_pct contested_pct turnovers top_carrier top_frames")),
        of("mean_space_control", same("control", "a_pct b_pct")),
        of("squad_summary", same("physical", "max_speed_kmh total_distance_km avg_speed_kmh n_tracks")),
        of("event_summary", same("events", kinds)),
        teams("threat_totals", "threat", "shots xg passes xt progressive"),
        teams("network_summaries", "network", "n_nodes n_links density avg_length_m leader top_passer top_receiver"),
        f"(select match_id, count(*) filter (is_cut) as camera_cuts, coalesce(string_agg(frame_idx::varchar, ',' order by frame_idx) filter (is_cut), '') as camera_cut_frames from ({SQL['camera_cuts']}) q group by all)",
    ]
    return "select * from " + " full join ".join(f"{p} p{i}" + (" using (match_id)" if i else "") for i, p in enumerate(parts))


SQL["match_report"] = _report()
SQL["live_packets"] = f"""select match_id, f.frame_idx, n_players, speeds, coalesce(recent, '') as recent
    from (select match_id, frame_idx, count(*) as n_players, round(sum(speed_kmh), 1) as speeds from ({SQL["telemetry_packets"]}) q group by all) f
    left join (select match_id, string_agg(event_type || '@' || frame_idx, ' ' order by event_id) as recent from ({SQL["event_timeline"]}) q group by all) e using (match_id)"""
SQL["stage_latencies"] = """with recursive p as (select match_id::varchar as id, frame_idx, unnest(['ingest', 'analytics']) as stage, unnest([brightness * 1e0, blur * 1e0]) as ms from v_frames),
    o as (select *, row_number() over (partition by id, stage order by frame_idx) as k from p),
    m as (select id, stage, frame_idx, k, 0.1e0 * ms as s from o where k = 1 union all select o.id, o.stage, o.frame_idx, o.k, 0.9e0 * m.s + 0.1e0 * o.ms from m join o on o.id = m.id and o.stage = m.stage and o.k = m.k + 1)
    select id, frame_idx as batch_id, stage, round(s, 5) as smoothed from m"""
SQL |= {"native_possession": SQL["possession_assigned"], "native_cuts": SQL["camera_cuts"], "native_boundaries": SQL["pitch_boundaries"]}
