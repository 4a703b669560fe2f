"""The neutral-table projections written as SQL common table expressions.

These are the independent (DuckDB-dialect) statement of the same rules that
``touchline.sources.projections`` builds with the DataFrame API. The
correctness gate runs a query's DataFrame plan and its SQL twin side by side,
so the two are kept separate on purpose.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}
DEPENDS: dict[str, tuple[str, ...]] = {}
RECURSIVE: set[str] = set()


def view(name: str, sql: str, *deps: str, recursive: bool = False) -> None:
    VIEWS[name] = sql.strip()
    DEPENDS[name] = deps
    if recursive:
        RECURSIVE.add(name)


view("v_teams", """
SELECT concat(CASE WHEN n.n_regionkey = 4 THEN 'af:' ELSE '' END, cast(n.n_nationkey AS varchar)) AS team_id,
       n.n_name AS name, r.r_name AS country, 'unknown' AS gender,
       CASE WHEN n.n_regionkey = 4 THEN 'api_football' ELSE 'statsbomb' END AS source,
       n.n_nationkey AS nationkey, n.n_regionkey AS rk,
       row_number() OVER (PARTITION BY n.n_regionkey ORDER BY n.n_nationkey) - 1 AS pos,
       count(*) OVER (PARTITION BY n.n_regionkey) AS cnt
FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey
""")

view("v_matches", """
SELECT mo.m AS match_id,
       concat(cast(h.rk AS varchar), ':', cast(year(mo.o_orderdate) AS varchar)) AS competition_id,
       cast(year(mo.o_orderdate) AS varchar) AS season_name,
       cast(mo.o_orderdate AS date) AS match_date,
       h.team_id AS home_team_id, h.name AS home_team_name,
       a.team_id AS away_team_id, a.name AS away_team_name,
       CASE WHEN mo.o_custkey % 10 = 0 THEN NULL ELSE cast((mo.m + mo.o_custkey * 3) % 4 AS integer) END AS home_score,
       CASE WHEN mo.o_custkey % 10 = 0 THEN NULL ELSE cast((mo.m * 5 + mo.o_custkey) % 3 AS integer) END AS away_score,
       CASE WHEN mo.o_custkey % 10 = 0 THEN 'scheduled' ELSE 'complete' END AS status,
       mo.o_orderpriority AS stage, h.rk AS region_key, h.source AS source
FROM (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority,
             cast(floor(o_orderkey / 40) AS bigint) AS m
      FROM orders WHERE o_orderkey % 40 = 0) mo
JOIN customer c ON c.c_custkey = mo.o_custkey
JOIN v_teams h ON h.nationkey = c.c_nationkey
JOIN v_teams a ON a.rk = h.rk AND a.pos = (h.pos + 1 + mo.m % (h.cnt - 1)) % h.cnt
""", "v_teams")

view("v_competitions", """
SELECT DISTINCT m.competition_id, r.r_name AS name, r.r_name AS country, m.season_name,
       'unknown' AS gender, false AS is_international, false AS is_youth, m.source
FROM v_matches m JOIN region r ON r.r_regionkey = m.region_key
""", "v_matches")

view("v_events_base", """
SELECT l_orderkey, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln, m,
       row_number() OVER w AS seq,
       sum(1 + l_partkey % 59) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t,
       count(*) OVER (PARTITION BY m) AS cnt,
       (l_partkey * 7 + l_suppkey * 3) % 20 AS k
FROM (SELECT *, cast(floor(l_orderkey / 40) AS bigint) AS m FROM lineitem) li
WINDOW w AS (PARTITION BY m ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)
""")

view("v_events_side", """
SELECT b.*, mt.home_team_id, mt.away_team_id, mt.home_team_name, mt.away_team_name, mt.source AS msrc,
       mt.competition_id AS mcomp,
       (cast(floor((b.seq - 1) / 7) AS bigint) + b.m) % 2 AS poss,
       mt.source = 'api_football' AS feed,
       mt.source <> 'api_football' AND b.k < 9 AS is_pass,
       mt.source <> 'api_football' AND b.k >= 13 AND b.k < 15 AS is_shot,
       ((cast(floor((b.seq - 1) / 7) AS bigint) + b.m) % 2 + CASE WHEN b.pk % 13 = 0 THEN 1 ELSE 0 END) % 2 = 0 AS acting_home
FROM v_events_base b JOIN v_matches mt ON mt.match_id = b.m
""", "v_events_base", "v_matches")

view("v_events", """
SELECT concat(cast(m AS varchar), '-', cast(seq AS varchar)) AS event_id,
       m AS match_id, cast(seq AS integer) AS sequence,
       CASE WHEN seq * 2 <= cnt THEN 1 ELSE 2 END AS period,
       cast(floor(t / 60) AS integer) AS minute, cast(t % 60 AS integer) AS "second",
       CASE WHEN feed THEN (CASE k % 3 WHEN 0 THEN 'Goal' WHEN 1 THEN 'Yellow Card' ELSE 'Substitution' END)
            WHEN k < 9 THEN 'Pass' WHEN k < 13 THEN 'Carry' WHEN k < 15 THEN 'Shot'
            WHEN k = 15 THEN 'Dribble' WHEN k = 16 THEN 'Duel' WHEN k = 17 THEN 'Goal Keeper'
            WHEN k = 18 THEN 'Foul Committed' ELSE 'Pressure' END AS "type",
       CASE WHEN acting_home THEN home_team_id ELSE away_team_id END AS team_id,
       CASE WHEN acting_home THEN home_team_name ELSE away_team_name END AS team_name,
       (CASE WHEN acting_home THEN home_team_id ELSE away_team_id END) || '-P' || cast(pk % 11 AS varchar) AS player_id,
       (CASE WHEN acting_home THEN home_team_name ELSE away_team_name END) || ' ' || cast(pk % 11 AS varchar) AS player_name,
       CASE WHEN pk % 97 = 0 THEN NULL WHEN poss = 0 THEN home_team_id ELSE away_team_id END AS possession_team_id,
       CASE WHEN pk % 97 = 0 THEN NULL WHEN poss = 0 THEN home_team_name ELSE away_team_name END AS possession_team_name,
       CASE WHEN feed OR pk % 41 = 0 THEN NULL WHEN is_shot THEN 90 + ((pk * 37) % 301) / 10.0
            ELSE ((pk * 37 + ln * 11) % 1201) / 10.0 END::double AS location_x,
       CASE WHEN feed OR pk % 41 = 0 THEN NULL ELSE ((pk * 53 + sk) % 801) / 10.0 END::double AS location_y,
       CASE WHEN feed OR k >= 15 THEN NULL ELSE ((pk * 91 + ln) % 1201) / 10.0 END::double AS end_location_x,
       CASE WHEN feed OR k >= 15 THEN NULL ELSE ((pk * 29 + sk * 5) % 801) / 10.0 END::double AS end_location_y,
       CASE WHEN feed THEN NULL ELSE (pk % 30) / 10.0 END::double AS duration_seconds,
       CASE WHEN is_pass THEN (CASE WHEN sk % 5 = 0 THEN 'Incomplete' WHEN sk % 17 = 0 THEN 'Pass Offside' END)
            WHEN is_shot THEN (CASE pk % 6 WHEN 0 THEN 'Goal' WHEN 1 THEN 'Saved' WHEN 2 THEN 'Blocked'
                                            WHEN 3 THEN 'Off T' WHEN 4 THEN 'Wayward' ELSE 'Post' END) END AS outcome,
       CASE WHEN is_pass OR is_shot THEN (CASE pk % 4 WHEN 0 THEN 'left_foot' WHEN 1 THEN 'right_foot'
                                                      WHEN 2 THEN 'head' ELSE 'other' END) END AS body_part,
       CASE WHEN feed THEN NULL WHEN sk % 3 = 1 THEN true WHEN sk % 3 = 2 THEN false END AS under_pressure,
       CASE WHEN feed THEN NULL ELSE (CASE cast(floor((seq - 1) / 7) AS bigint) % 9
            WHEN 0 THEN 'regular_play' WHEN 1 THEN 'from_corner' WHEN 2 THEN 'from_free_kick'
            WHEN 3 THEN 'from_throw_in' WHEN 4 THEN 'from_goal_kick' WHEN 5 THEN 'from_kick_off'
            WHEN 6 THEN 'from_counter' WHEN 7 THEN 'from_keeper' ELSE 'other' END) END AS play_pattern,
       CASE WHEN is_pass THEN pk % 9 = 0 END AS is_cross,
       CASE WHEN is_pass THEN (CASE ln WHEN 1 THEN 'corner' WHEN 2 THEN 'free_kick' WHEN 3 THEN 'throw_in'
                                      WHEN 4 THEN 'goal_kick' ELSE 'open_play' END) END AS pass_type,
       CASE WHEN is_shot THEN (CASE ln WHEN 1 THEN 'penalty' WHEN 2 THEN 'free_kick' ELSE 'open_play' END) END AS shot_type,
       msrc AS source, pk AS src_partkey, mcomp AS competition_id
FROM v_events_side
""", "v_events_side")

view("v_players", """
SELECT t.team_id || '-P' || cast(s.n AS varchar) AS player_id,
       t.name || ' ' || cast(s.n AS varchar) AS name,
       CASE WHEN s.n % 2 = 0 THEN 'P' || cast(s.n AS varchar) END AS display_name,
       t.country, t.source, t.team_id, s.n + 1 AS jersey_number
FROM v_teams t JOIN (SELECT cast(range AS integer) AS n FROM range(11)) s ON true
""", "v_teams")

# The competition the golden questions are bound to: the event feed's
# competition with the most matches, ties by id.
view("wc_comp", """
SELECT competition_id FROM v_matches WHERE source = 'statsbomb'
GROUP BY competition_id ORDER BY count(*) DESC, competition_id LIMIT 1
""", "v_matches")

view("wc", """
SELECT m.match_id FROM v_matches m JOIN wc_comp c ON c.competition_id = m.competition_id
""", "wc_comp", "v_matches")


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in DEPENDS.get(n, ()):
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs for ``names`` (dependencies included).

    ``extra`` adds statement-specific CTEs after the shared ones, in order.
    """
    names = _closure(names)
    parts = [f"{n} AS ({VIEWS[n]})" for n in names]
    for n, sql in (extra or {}).items():
        parts.append(f"{n} AS ({sql.strip()})")
    head = "WITH RECURSIVE " if RECURSIVE.intersection(names) else "WITH "
    return head + ",\n".join(parts) + "\n" + body.strip() if parts else body.strip()


# ------------------------------------------------------------------ SPADL twin
def _norm(x: str) -> str:
    return f"coalesce(lower(trim(replace(replace({x}, '*', ''), '-', ' '))), '')"


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _spadl_sql() -> str:
    from ..operators import spadl as S

    t, pt, st = _norm("e.type"), _norm("e.pass_type"), _norm("e.shot_type")
    crossed = "coalesce(e.is_cross, false)"
    mapped = "CASE " + " ".join(f"WHEN {t} = '{k}' THEN '{v}'" for k, v in S.TYPE_MAPPING.items()) + " ELSE 'non_action' END"
    stype = f"""CASE WHEN {t} = 'pass' THEN (CASE WHEN {pt} = 'corner' THEN (CASE WHEN {crossed} THEN 'corner_crossed' ELSE 'corner_short' END)
                  WHEN {pt} = 'free_kick' THEN (CASE WHEN {crossed} THEN 'freekick_crossed' ELSE 'freekick_short' END)
                  WHEN {pt} = 'throw_in' THEN 'throw_in' WHEN {pt} = 'goal_kick' THEN 'goalkick'
                  WHEN {crossed} THEN 'cross' ELSE 'pass' END)
            WHEN {t} = 'shot' THEN (CASE WHEN {st} = 'penalty' THEN 'shot_penalty' WHEN {st} = 'free_kick' THEN 'shot_freekick' ELSE 'shot' END)
            ELSE {mapped} END"""
    b = _norm("e.body_part")
    body = (f"CASE WHEN {b} = 'left_foot' THEN 'foot_left' WHEN {b} = 'right_foot' THEN 'foot_right' "
            f"WHEN {b} = 'head' THEN 'head' WHEN {b} IN ('other', 'keeper_hands') THEN 'other' ELSE 'foot' END")

    def cx(x):
        return f"greatest(0.0, least(105.0, greatest(0.0, least(120.0, {x})) / 120.0 * 105.0))"

    def cy(y):
        return f"greatest(0.0, least(68.0, (80.0 - greatest(0.0, least(80.0, {y}))) / 80.0 * 68.0))"

    has_end = "e.end_location_x IS NOT NULL AND e.end_location_y IS NOT NULL"
    return f"""
SELECT e.match_id, e.event_id, e.period, e.sequence, e.team_id, e.player_id, m.home_team_id,
       cast(e.minute AS double) * 60.0 + cast(e."second" AS double) AS time_seconds,
       {cx('e.location_x')} AS sx, {cy('e.location_y')} AS sy,
       CASE WHEN {has_end} THEN {cx('e.end_location_x')} ELSE {cx('e.location_x')} END AS ex,
       CASE WHEN {has_end} THEN {cy('e.end_location_y')} ELSE {cy('e.location_y')} END AS ey,
       {stype} AS spadl_type, {_norm('e.outcome')} AS o, {body} AS spadl_bodypart
FROM v_events e JOIN v_matches m ON m.match_id = e.match_id
WHERE e.location_x IS NOT NULL AND e.location_y IS NOT NULL"""


def _spadl_result_sql() -> str:
    from ..operators import spadl as S

    return f"""
SELECT *, CASE WHEN o IN {_in(S.OFFSIDE_OUTCOMES)} THEN 'offside' WHEN o IN {_in(S.OWN_GOAL_OUTCOMES)} THEN 'owngoal'
               WHEN o IN {_in(S.YELLOW_CARD_OUTCOMES)} THEN 'yellow_card' WHEN o IN {_in(S.RED_CARD_OUTCOMES)} THEN 'red_card'
               WHEN o IN {_in(S.FAIL_OUTCOMES)} THEN 'fail' WHEN o IN {_in(S.SUCCESS_OUTCOMES)} THEN 'success'
               WHEN spadl_type IN {_in(S.SUCCESS_DEFAULT_TYPES)} THEN 'success'
               WHEN spadl_type IN {_in(S.SHOT_TYPES)} THEN 'fail' ELSE 'success' END AS spadl_result
FROM v_spadl_stage"""


view("v_spadl_stage", _spadl_sql(), "v_events", "v_matches")
view("v_spadl_staged", _spadl_result_sql(), "v_spadl_stage")
view("v_spadl", """
SELECT event_id AS action_id, match_id,
       cast(row_number() OVER (PARTITION BY match_id ORDER BY period, sequence) - 1 AS integer) AS action_order,
       event_id AS source_event_id, cast(period AS integer) AS period, time_seconds, team_id, player_id,
       CASE WHEN team_id IS NOT DISTINCT FROM home_team_id THEN sx ELSE 105.0 - sx END AS start_x,
       CASE WHEN team_id IS NOT DISTINCT FROM home_team_id THEN sy ELSE 68.0 - sy END AS start_y,
       CASE WHEN team_id IS NOT DISTINCT FROM home_team_id THEN ex ELSE 105.0 - ex END AS end_x,
       CASE WHEN team_id IS NOT DISTINCT FROM home_team_id THEN ey ELSE 68.0 - ey END AS end_y,
       spadl_type, spadl_result, spadl_bodypart
FROM v_spadl_staged
""", "v_spadl_staged")


# -------------------------------------------------------------------- xT twin
def _cell(x: str, y: str) -> str:
    return (f"(cast(least(greatest(floor({y} / 68.0 * 8), 0), 7) AS integer) * 12 + "
            f"cast(least(greatest(floor({x} / 105.0 * 12), 0), 11) AS integer))")


view("v_xt_counts", f"""
SELECT cell, shots, goals, moves,
       CASE WHEN shots + moves > 0 THEN shots / (shots + moves) ELSE 0.0 END AS p_shot,
       CASE WHEN shots > 0 THEN goals / shots ELSE 0.0 END AS p_goal,
       CASE WHEN shots + moves > 0 THEN moves / (shots + moves) ELSE 0.0 END AS p_move
FROM (SELECT {_cell('start_x', 'start_y')} AS cell,
             cast(count(*) FILTER (WHERE spadl_type = 'shot') AS double) AS shots,
             cast(count(*) FILTER (WHERE spadl_type = 'shot' AND spadl_result = 'success') AS double) AS goals,
             cast(count(*) FILTER (WHERE spadl_type IN ('pass', 'cross', 'dribble')) AS double) AS moves
      FROM v_spadl WHERE spadl_type IN ('shot', 'pass', 'cross', 'dribble') GROUP BY 1) c
""", "v_spadl")

view("v_xt_trans", f"""
SELECT o.start_cell, o.end_cell, o.n_ok, s.n_start, o.n_ok / s.n_start AS p
FROM (SELECT {_cell('start_x', 'start_y')} AS start_cell, {_cell('end_x', 'end_y')} AS end_cell, cast(count(*) AS double) AS n_ok
      FROM v_spadl WHERE spadl_type IN ('pass', 'cross', 'dribble') AND spadl_result = 'success' GROUP BY 1, 2) o
JOIN (SELECT {_cell('start_x', 'start_y')} AS start_cell, cast(count(*) AS double) AS n_start
      FROM v_spadl WHERE spadl_type IN ('pass', 'cross', 'dribble') GROUP BY 1) s ON s.start_cell = o.start_cell
""", "v_spadl")

view("v_xt_cells", "SELECT cast(range AS integer) AS cell FROM range(96)")

view("v_xt_params", """
SELECT (SELECT list(coalesce(c.p_shot * c.p_goal, 0.0) ORDER BY k.cell) FROM v_xt_cells k LEFT JOIN v_xt_counts c ON c.cell = k.cell) AS gs,
       (SELECT list(coalesce(c.p_move, 0.0) ORDER BY k.cell) FROM v_xt_cells k LEFT JOIN v_xt_counts c ON c.cell = k.cell) AS pm,
       (SELECT list(coalesce(t.p, 0.0) ORDER BY a.cell, b.cell)
        FROM v_xt_cells a CROSS JOIN v_xt_cells b LEFT JOIN v_xt_trans t ON t.start_cell = a.cell AND t.end_cell = b.cell) AS tm
""", "v_xt_cells", "v_xt_counts", "v_xt_trans")

view("v_xt_iter", """
SELECT 0 AS i, list_transform(range(96), lambda c: 0.0::double) AS g, 1.0::double AS md
UNION ALL
SELECT i + 1, ng, list_max(list_transform(range(1, 97), lambda c: ng[c] - g[c]))
FROM (SELECT it.i, it.g,
             list_transform(range(96), lambda c: p.gs[c + 1] + p.pm[c + 1] *
                 list_sum(list_transform(range(96), lambda j: p.tm[c * 96 + j + 1] * it.g[j + 1]))) AS ng
      FROM v_xt_iter it, v_xt_params p WHERE it.md > 0.00001) s
""", "v_xt_params", recursive=True)

view("v_xt_grid", """
SELECT k.cell, last.g[k.cell + 1] AS xt
FROM (SELECT g FROM v_xt_iter ORDER BY i DESC LIMIT 1) last, v_xt_cells k
""", "v_xt_iter", "v_xt_cells")

view("v_xt_values", f"""
SELECT a.action_id,
       CASE WHEN a.spadl_type IN ('pass', 'cross', 'dribble') AND a.spadl_result = 'success' THEN ge.xt - gs.xt END AS xt_value
FROM v_spadl a
LEFT JOIN v_xt_grid gs ON gs.cell = {_cell('a.start_x', 'a.start_y')}
LEFT JOIN v_xt_grid ge ON ge.cell = {_cell('a.end_x', 'a.end_y')}
""", "v_spadl", "v_xt_grid")


# ------------------------------------------------------- model-free totals twin
def _light_totals(kind: str) -> str:
    key = f"{kind}_id"
    names = "v_players" if kind == "player" else "v_teams"
    return f"""
SELECT coalesce(a.{key}, s.{key}) AS {key}, coalesce(a.competition_id, s.competition_id) AS competition_id,
       coalesce(a.source, s.source) AS source, n.name AS {kind}_name,
       coalesce(a.total_xt, 0) AS total_xt, coalesce(a.xt_action_count, 0) AS xt_action_count,
       coalesce(s.shot_count, 0) AS shot_count, coalesce(a.action_count, 0) AS action_count
FROM (SELECT sa.{key}, m.competition_id, m.source, sum(av.xt_value) AS total_xt,
             count(av.xt_value) AS xt_action_count, count(*) AS action_count
      FROM v_spadl sa JOIN v_matches m ON m.match_id = sa.match_id
      LEFT JOIN v_xt_values av ON av.action_id = sa.action_id
      WHERE sa.{key} IS NOT NULL GROUP BY 1, 2, 3) a
FULL OUTER JOIN (SELECT sa.{key}, m.competition_id, m.source, count(*) AS shot_count
      FROM v_spadl sa JOIN v_matches m ON m.match_id = sa.match_id
      WHERE sa.spadl_type IN ('shot', 'shot_penalty', 'shot_freekick') AND sa.{key} IS NOT NULL GROUP BY 1, 2, 3) s
  ON s.{key} = a.{key} AND s.competition_id = a.competition_id AND s.source = a.source
LEFT JOIN {names} n ON n.{"player_id" if kind == "player" else "team_id"} = coalesce(a.{key}, s.{key})"""


view("v_player_totals", _light_totals("player"), "v_spadl", "v_matches", "v_xt_values", "v_players")
view("v_team_totals", _light_totals("team"), "v_spadl", "v_matches", "v_xt_values", "v_teams")
view("feed_comp", """
SELECT competition_id FROM v_matches WHERE source = 'api_football'
GROUP BY competition_id ORDER BY count(*) DESC, competition_id LIMIT 1
""", "v_matches")


# ------------------------------------------------ freeze frames / tracking twins
view("v_freeze_raw", """
SELECT event_id, match_id, j,
       CASE WHEN j = 1 THEN NULL ELSE [((src_partkey * 3 + j * 17) % 1201) / 10.0, ((src_partkey * 7 + j * 13) % 801) / 10.0]::double[] END AS location,
       CASE WHEN j = 2 THEN NULL ELSE j % 2 = 0 END AS teammate,
       CASE j WHEN 0 THEN 'Goalkeeper' WHEN 1 THEN 'Left Back' WHEN 2 THEN 'Center Forward' ELSE 'Right Wing' END AS position,
       j = 3 AS actor
FROM v_events JOIN (SELECT cast(range AS integer) AS j FROM range(4)) r ON true WHERE type = 'Shot'
""", "v_events")

view("v_freeze_frames", """
SELECT event_id, match_id, cast(row_number() OVER (PARTITION BY event_id ORDER BY j) - 1 AS integer) AS frame_index,
       location[1] AS location_x, location[2] AS location_y, teammate, position, actor
FROM v_freeze_raw WHERE location IS NOT NULL AND len(location) >= 2 AND teammate IS NOT NULL
""", "v_freeze_raw")

view("v_track_points", """
SELECT cast(match_id AS varchar) AS clip_name, player_id AS track_id, sequence AS frame_index,
       cast(minute * 60 + "second" AS double) AS time_seconds, location_x AS cx, location_y AS cy,
       CASE WHEN src_partkey % 11 = 0 THEN 'ball' ELSE 'player' END AS class,
       (src_partkey % 50) / 100.0 + 0.5 AS confidence
FROM v_events WHERE location_x IS NOT NULL AND location_y IS NOT NULL
""", "v_events")


# ------------------------------------------------------------------ Elo twin
view("v_elo_teams", "SELECT team_id, cast(row_number() OVER (ORDER BY team_id) AS integer) AS ti FROM v_teams", "v_teams")
view("v_elo_order", """
SELECT m.match_id, m.match_date, h.ti AS hi, a.ti AS ai, m.home_score, m.away_score,
       cast(row_number() OVER (ORDER BY m.match_date, m.match_id) AS integer) AS r
FROM v_matches m JOIN v_elo_teams h ON h.team_id = m.home_team_id JOIN v_elo_teams a ON a.team_id = m.away_team_id
""", "v_matches", "v_elo_teams")
view("v_elo_walk", """
SELECT 0 AS r, NULL::bigint AS match_id,
       list_transform(range((SELECT count(*) FROM v_elo_teams)), lambda i: 1500.0::double) AS ratings,
       list_transform(range((SELECT count(*) FROM v_elo_teams)), lambda i: 0) AS played,
       NULL::double AS home_pre, NULL::double AS away_pre
UNION ALL
SELECT s.r, s.match_id,
       CASE WHEN s.scored THEN list_transform(range(1, len(s.ratings) + 1), lambda i:
            CASE WHEN i = s.hi THEN s.hr + s.chg * (s.ha - s.he)
                 WHEN i = s.ai THEN s.ar + s.chg * ((1.0 - s.ha) - (1.0 - s.he)) ELSE s.ratings[i] END)
            ELSE s.ratings END,
       CASE WHEN s.scored THEN list_transform(range(1, len(s.played) + 1), lambda i:
            CASE WHEN i = s.hi OR i = s.ai THEN s.played[i] + 1 ELSE s.played[i] END) ELSE s.played END,
       s.hr, s.ar
FROM (SELECT o.r, o.match_id, o.hi, o.ai, w.ratings, w.played, w.ratings[o.hi] AS hr, w.ratings[o.ai] AS ar,
             o.home_score IS NOT NULL AND o.away_score IS NOT NULL AS scored,
             1.0 / (1.0 + pow(10.0, -((w.ratings[o.hi] + 55.0) - w.ratings[o.ai]) / 400.0)) AS he,
             CASE WHEN o.home_score > o.away_score THEN 1.0 WHEN o.home_score < o.away_score THEN 0.0 ELSE 0.5 END AS ha,
             40.0 * CASE WHEN abs(o.home_score - o.away_score) <= 1 THEN 1.0 WHEN abs(o.home_score - o.away_score) = 2 THEN 1.5
                         ELSE (11.0 + abs(o.home_score - o.away_score)) / 8.0 END AS chg
      FROM v_elo_walk w JOIN v_elo_order o ON o.r = w.r + 1) s
""", "v_elo_order", "v_elo_teams", recursive=True)
view("v_elo_pre", """
SELECT match_id, home_pre AS home_elo_pre, away_pre AS away_elo_pre FROM v_elo_walk WHERE r > 0
""", "v_elo_walk")
view("v_elo_final", """
SELECT t.team_id, round(w.ratings[t.ti], 2) AS elo_rating, cast(w.played[t.ti] AS bigint) AS matches_played
FROM (SELECT * FROM v_elo_walk ORDER BY r DESC LIMIT 1) w, v_elo_teams t WHERE w.played[t.ti] > 0
""", "v_elo_walk", "v_elo_teams")
view("v_elo_rates", """
SELECT match_id, exp(ln(1.35) + 0.2 + 0.5 * (0.001 * (home_elo_pre - away_elo_pre))) AS lambda_home,
       exp(ln(1.35) - 0.5 * (0.001 * (home_elo_pre - away_elo_pre))) AS lambda_away, 0.0 AS rho
FROM v_elo_pre
""", "v_elo_pre")
view("v_elo_matrix", """
SELECT match_id, hg, ag, CASE WHEN sum(raw) OVER (PARTITION BY match_id) > 0
                              THEN raw / sum(raw) OVER (PARTITION BY match_id) ELSE raw END AS p
FROM (SELECT match_id, hg, ag, greatest(
        exp(hg * ln(lambda_home) - lambda_home - ln(cast(factorial(hg) AS double)))
        * exp(ag * ln(lambda_away) - lambda_away - ln(cast(factorial(ag) AS double)))
        * CASE WHEN hg = 0 AND ag = 0 THEN 1.0 - lambda_home * lambda_away * rho
               WHEN hg = 0 AND ag = 1 THEN 1.0 + lambda_home * rho
               WHEN hg = 1 AND ag = 0 THEN 1.0 + lambda_away * rho
               WHEN hg = 1 AND ag = 1 THEN 1.0 - rho ELSE 1.0 END, 0.0) AS raw
      FROM v_elo_rates r JOIN (SELECT cast(range AS integer) AS hg FROM range(11)) h ON true
      JOIN (SELECT cast(range AS integer) AS ag FROM range(11)) a ON true) x
""", "v_elo_rates")
view("v_elo_probs", """
SELECT a.*, b.hg AS most_likely_home_goals, b.ag AS most_likely_away_goals FROM
  (SELECT match_id, sum(CASE WHEN hg > ag THEN p ELSE 0 END) AS prob_home_win, sum(CASE WHEN hg = ag THEN p ELSE 0 END) AS prob_draw,
          sum(CASE WHEN hg < ag THEN p ELSE 0 END) AS prob_away_win, sum(hg * p) AS expected_home_goals,
          sum(ag * p) AS expected_away_goals FROM v_elo_matrix GROUP BY match_id) a
JOIN (SELECT match_id, hg, ag, row_number() OVER (PARTITION BY match_id ORDER BY p DESC, hg, ag) AS rk FROM v_elo_matrix) b
  ON b.match_id = a.match_id AND b.rk = 1
""", "v_elo_matrix")
