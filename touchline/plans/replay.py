"""Goal replays (K), freeze frames (A4) and tracking (A11, N) as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import possession as P
from ..operators import tracking as TR
from ..sources.projections import MatchData, raw_freeze_frames, raw_track_points
from .catalog import register
from .golden import WC_VIEWS, wc_events
from .valuation import _rounded, xt_values

FINAL_STAGE = "1-URGENT"  # the test tables' stand-in for a final
FRAME_W, FRAME_H = 120.0, 80.0  # the tracking stand-in's frame size (pixels)


def wc_goals(md: MatchData) -> DataFrame:
    return P.goal_shots(wc_events(md))


def freeze_frames(md: MatchData) -> DataFrame:
    """A4: drop players with no location or no teammate flag, then number 0..n."""
    def build():
        raw = raw_freeze_frames(md.events)
        valid = F.filter("freeze_frame", lambda p: p["location"].isNotNull() & (F.size(p["location"]) >= 2)
                         & p["teammate"].isNotNull())
        ex = raw.select("event_id", "match_id", F.posexplode(valid).alias("frame_index", "p"))
        return ex.select("event_id", "match_id", F.col("frame_index").cast("int").alias("frame_index"),
                         F.col("p.location")[0].alias("location_x"), F.col("p.location")[1].alias("location_y"),
                         F.col("p.teammate").alias("teammate"), F.col("p.position").alias("position"),
                         F.col("p.actor").alias("actor"))
    return md.memo("freeze_frames", build)


@register("explode_freeze_frames", """
SELECT event_id, frame_index, location_x, location_y, teammate, position, actor FROM v_freeze_frames
""", ("v_freeze_frames",))
def explode_freeze_frames(md: MatchData) -> DataFrame:
    return freeze_frames(md).drop("match_id")


GOALS_SQL = """SELECT * FROM v_events WHERE match_id IN (SELECT match_id FROM wc) AND type = 'Shot' AND outcome = 'Goal'
               AND location_x IS NOT NULL AND location_y IS NOT NULL"""


@register("list_goals", f"""
SELECT g.event_id, g.match_id, g.period, g.minute, g."second", coalesce(s.display_name, g.player_name) AS scorer, g.team_name,
       h.name AS home_team_name, w.name AS away_team_name, x.stage, g.shot_type, g.play_pattern
FROM (SELECT * FROM goals WHERE period <= 4) g
JOIN (SELECT *, coalesce(stage = '{FINAL_STAGE}', false) AS is_final FROM v_matches) x USING (match_id)
JOIN v_teams h ON x.home_team_id = h.team_id JOIN v_teams w ON x.away_team_id = w.team_id
LEFT JOIN v_players s USING (player_id)
QUALIFY row_number() OVER (ORDER BY x.is_final AND coalesce(g.shot_type = 'open_play', false) DESC, x.is_final DESC,
                           x.match_date DESC, g.minute, g."second", g.event_id) <= {P.GOAL_LIMIT}
""", WC_VIEWS + ("v_players",), {"goals": GOALS_SQL})
def list_goals(md: MatchData) -> DataFrame:
    return P.list_goals(wc_events(md), md.matches, md.teams, md.players, FINAL_STAGE)


# every event up to a goal, with the number of other-possession events from it to the goal
RUNUP_SQL = """
SELECT *, all_foreign - coalesce(sum(is_foreign) OVER (PARTITION BY goal_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS foreign_left
FROM (SELECT g.event_id AS goal_id, g.team_id AS goal_team_id, e.*, f.is_foreign, sum(f.is_foreign) OVER (PARTITION BY g.event_id) AS all_foreign
      FROM goals g JOIN v_events e ON e.match_id = g.match_id AND e.sequence <= g.sequence,
           LATERAL (SELECT cast(e.possession_team_id IS DISTINCT FROM g.possession_team_id AS integer) AS is_foreign) f)"""


@register("possession_break", "SELECT goal_id, event_id, sequence, cast(foreign_left AS bigint) AS possession_break FROM runup",
          WC_VIEWS, {"goals": GOALS_SQL, "runup": RUNUP_SQL})
def possession_break(md: MatchData) -> DataFrame:
    # the chains live inside the goals' matches: read only their competition (pruned)
    return P.possession_break(wc_events(md), wc_goals(md))


BUILDUP_SQL = f"""
WITH runup AS ({RUNUP_SQL})
SELECT goal_id, event_id, sequence, period, minute, "second", type, player_name, team_name, location_x, location_y,
       end_location_x, end_location_y, event_id = goal_id AS is_goal, least(n, {P.CHAIN_LIMIT}) AS path_event_count
FROM (SELECT *, count(*) OVER (PARTITION BY goal_id) AS n FROM runup
      WHERE foreign_left = 0 AND team_id = goal_team_id AND location_x IS NOT NULL AND location_y IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY goal_id ORDER BY sequence) <= {P.CHAIN_LIMIT}"""


def buildup(md: MatchData) -> DataFrame:
    return md.memo("buildup", lambda: P.goal_buildup(wc_events(md), wc_goals(md)))


@register("goal_buildup", "SELECT * FROM buildup", WC_VIEWS, {"goals": GOALS_SQL, "buildup": BUILDUP_SQL})
def goal_buildup(md: MatchData) -> DataFrame:
    return buildup(md)


@register("buildup_xt", """
SELECT b.goal_id, round(sum(av.xt_value), 6) AS xt_gained FROM buildup b
LEFT JOIN v_xt_values av ON av.action_id = b.event_id GROUP BY b.goal_id
""", WC_VIEWS + ("v_xt_values",), {"goals": GOALS_SQL, "buildup": BUILDUP_SQL})
def buildup_xt(md: MatchData) -> DataFrame:
    return _rounded(P.buildup_xt(buildup(md), xt_values(md)), "xt_gained")


@register("goal_freeze_frame", f"""
SELECT event_id, frame_index, location_x, location_y, teammate, position, actor FROM v_freeze_frames
WHERE event_id IN (SELECT event_id FROM goals) AND frame_index < {P.FREEZE_LIMIT}
""", WC_VIEWS + ("v_freeze_frames",), {"goals": GOALS_SQL})
def goal_freeze_frame(md: MatchData) -> DataFrame:
    return P.goal_freeze_frame(wc_goals(md), freeze_frames(md)).drop("match_id")


@register("goal_timeline", """
SELECT goal_id, sequence, step, cast(segment * 18 + step AS integer) AS frame,
       round(ax + (bx - ax) * step / 18.0, 6) AS x, round(ay + (b_y - ay) * step / 18.0, 6) AS y
FROM (SELECT c.goal_id, c.sequence, c.segment, c.location_x AS ax, c.location_y AS ay,
             coalesce(n.location_x, g.end_location_x, c.location_x) AS bx, coalesce(n.location_y, g.end_location_y, c.location_y) AS b_y,
             CASE WHEN n.goal_id IS NOT NULL THEN 17 WHEN g.end_location_x IS NOT NULL THEN 18 ELSE 0 END AS upto
      FROM chain c LEFT JOIN chain n ON n.goal_id = c.goal_id AND n.segment = c.segment + 1
      LEFT JOIN goals g ON g.event_id = c.goal_id) s
JOIN (SELECT cast(range AS integer) AS step FROM range(19)) r ON r.step <= s.upto
""", WC_VIEWS, {"goals": GOALS_SQL, "buildup": BUILDUP_SQL, "chain": "SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY sequence) - 1 AS segment FROM buildup"})
def goal_timeline(md: MatchData) -> DataFrame:
    return _rounded(P.goal_timeline(buildup(md), wc_goals(md)), "x", "y")


# ------------------------------------------------------------------ tracking
def track_points(md: MatchData) -> DataFrame:
    return md.memo("track_points", lambda: raw_track_points(md.events))


@register("load_track_points", f"""
SELECT 'cv:' || clip_name AS clip_id, 'cv:' || clip_name || ':' || track_id AS track_id, frame_index, time_seconds,
       round(cx / {FRAME_W}, 6) AS x, round(cy / {FRAME_H}, 6) AS y FROM v_track_points
""", ("v_track_points",))
def load_track_points(md: MatchData) -> DataFrame:
    return TR.load_track_points(track_points(md), FRAME_W, FRAME_H)


@register("track_summary", """
SELECT f.clip_name, f.track_id, f.frame_count, f.first_frame, f.last_frame, c.class FROM
  (SELECT clip_name, track_id, count(*) AS frame_count, min(frame_index) AS first_frame, max(frame_index) AS last_frame
   FROM v_track_points GROUP BY 1, 2) f
JOIN (SELECT clip_name, track_id, class, row_number() OVER (PARTITION BY clip_name, track_id ORDER BY n DESC, first_seen) AS rk
      FROM (SELECT clip_name, track_id, class, count(*) AS n, min(frame_index) AS first_seen FROM v_track_points GROUP BY 1, 2, 3) x) c
  ON c.clip_name = f.clip_name AND c.track_id = f.track_id AND c.rk = 1
""", ("v_track_points",))
def track_summary(md: MatchData) -> DataFrame:
    return TR.track_summary(track_points(md))


@register("bbox_center", """
SELECT clip_name, track_id, frame_index, (cx - 1.5 + cx + 1.5) / 2.0 AS center_x, (cy - 2.0 + cy + 2.0) / 2.0 AS center_y,
       CASE WHEN 25.0 > 0 THEN frame_index / 25.0 END AS frame_time
FROM v_track_points
""", ("v_track_points",))
def bbox_center(md: MatchData) -> DataFrame:
    p = track_points(md)
    cx, cy = TR.bbox_center(F.col("cx") - 1.5, F.col("cy") - 2.0, F.col("cx") + 1.5, F.col("cy") + 2.0)
    return p.select("clip_name", "track_id", "frame_index", cx.alias("center_x"), cy.alias("center_y"),
                    TR.frame_time(F.col("frame_index"), F.lit(25.0)).alias("frame_time"))


TRACK_MOVEMENT_SQL = """
SELECT s.clip_name, s.track_id,
       round(CASE WHEN t.nt >= 2 AND t.t1 - t.t0 > 0 THEN t.t1 - t.t0 ELSE 0.0 END, 3) AS time_tracked_seconds,
       round(s.dist, 3) AS total_distance, round(s.top, 3) AS top_speed,
       round(CASE WHEN t.nt >= 2 AND t.t1 - t.t0 > 0 THEN s.dist / (t.t1 - t.t0) ELSE 0.0 END, 3) AS average_speed
FROM (SELECT clip_name, track_id, coalesce(sum(seg), 0.0) AS dist,
             coalesce(max(CASE WHEN dt > 0 THEN seg / dt END), 0.0) AS top
      FROM (SELECT clip_name, track_id,
                   sqrt((cx - lag(cx) OVER w) * (cx - lag(cx) OVER w) + (cy - lag(cy) OVER w) * (cy - lag(cy) OVER w)) AS seg,
                   time_seconds - lag(time_seconds) OVER w AS dt
            FROM v_track_points WINDOW w AS (PARTITION BY clip_name, track_id ORDER BY frame_index)) x
      GROUP BY 1, 2) s
LEFT JOIN (SELECT clip_name, track_id, arg_min(time_seconds, frame_index) AS t0, arg_max(time_seconds, frame_index) AS t1,
                  count(*) AS nt FROM v_track_points WHERE time_seconds IS NOT NULL GROUP BY 1, 2) t
  ON t.clip_name = s.clip_name AND t.track_id = s.track_id"""


def movement(md: MatchData) -> DataFrame:
    return md.memo("track_movement", lambda: TR.track_movement(track_points(md)))


@register("track_movement", TRACK_MOVEMENT_SQL, ("v_track_points",))
def track_movement(md: MatchData) -> DataFrame:
    return movement(md)


# cv_track_metrics / cv_clips as the reference stores them (uncalibrated: pixels)
def track_metrics(md: MatchData) -> DataFrame:
    def build():
        s = TR.track_summary(track_points(md))
        m = movement(md)
        dist_u, speed_u = TR.metric_units(F.lit(False), F.lit(None).cast("string"))
        return s.join(m, ["clip_name", "track_id"]).select(
            F.concat(F.lit(TR.CV_PREFIX), "clip_name").alias("clip_id"), "track_id", "class", "frame_count",
            "first_frame", "last_frame", "time_tracked_seconds", "total_distance", "top_speed", "average_speed",
            dist_u.alias("distance_units"), speed_u.alias("speed_units"))
    return md.memo("track_metrics", build)


def clips(md: MatchData) -> DataFrame:
    """cv_clips stand-in: one clip per match; the name carries the competition region."""
    m = md.matches.select(F.col("match_id").cast("string").alias("clip_name"), "competition_id", "home_team_name")
    r = md.competitions.select("competition_id", F.col("name").alias("region"))
    return m.join(r, "competition_id").select(
        F.concat(F.lit(TR.CV_PREFIX), "clip_name").alias("clip_id"),
        F.concat(F.col("region"), F.lit(" clip "), F.col("clip_name")).alias("clip_name"),
        F.lit(False).alias("calibrated"), F.lit("pixels").alias("distance_units"))


CV_METRICS_SQL = f"""
SELECT 'cv:' || s.clip_name AS clip_id, s.track_id, s.class, s.frame_count, m.total_distance, 'pixels' AS distance_units
FROM (SELECT f.clip_name, f.track_id, f.frame_count, c.class FROM
        (SELECT clip_name, track_id, count(*) AS frame_count FROM v_track_points GROUP BY 1, 2) f
      JOIN (SELECT clip_name, track_id, class, row_number() OVER (PARTITION BY clip_name, track_id ORDER BY n DESC, first_seen) AS rk
            FROM (SELECT clip_name, track_id, class, count(*) AS n, min(frame_index) AS first_seen FROM v_track_points GROUP BY 1, 2, 3) x) c
        ON c.clip_name = f.clip_name AND c.track_id = f.track_id AND c.rk = 1) s
JOIN ({TRACK_MOVEMENT_SQL}) m ON m.clip_name = s.clip_name AND m.track_id = s.track_id"""


@register("metric_units", """
SELECT DISTINCT 'pixels' AS distance_units, 'pixels_per_second' AS speed_units FROM v_track_points
""", ("v_track_points",))
def metric_units(md: MatchData) -> DataFrame:
    return track_metrics(md).select("distance_units", "speed_units").distinct()


@register("broadcast_cv_063", """
SELECT track_id, total_distance, distance_units FROM cvm WHERE class = 'player'
ORDER BY total_distance DESC, track_id LIMIT 1
""", ("v_track_points",), {"cvm": CV_METRICS_SQL})
def broadcast_cv_063(md: MatchData) -> DataFrame:
    t = track_metrics(md).where(F.col("class") == "player")
    return t.orderBy(F.desc("total_distance"), "track_id").limit(1).select("track_id", "total_distance", "distance_units")


@register("broadcast_cv_064", "SELECT count(*) AS cv_player_track_count FROM cvm WHERE class = 'player'",
          ("v_track_points",), {"cvm": CV_METRICS_SQL})
def broadcast_cv_064(md: MatchData) -> DataFrame:
    return track_metrics(md).where(F.col("class") == "player").agg(F.count(F.lit(1)).alias("cv_player_track_count"))


@register("broadcast_cv_065", """
SELECT count(*) AS world_cup_cv_track_count FROM cvm m JOIN (
  SELECT 'cv:' || cast(mt.match_id AS varchar) AS clip_id, c.name || ' clip ' || cast(mt.match_id AS varchar) AS clip_name
  FROM v_matches mt JOIN v_competitions c ON c.competition_id = mt.competition_id) cl ON cl.clip_id = m.clip_id
WHERE cl.clip_name ILIKE '%world cup%'
""", ("v_track_points", "v_matches", "v_competitions"), {"cvm": CV_METRICS_SQL})
def broadcast_cv_065(md: MatchData) -> DataFrame:
    """Truthful zero: no clip name mentions a world cup in the test tables."""
    c = clips(md).where(F.lower("clip_name").contains("world cup")).select("clip_id")
    return track_metrics(md).join(c, "clip_id").agg(F.count(F.lit(1)).alias("world_cup_cv_track_count"))


@register("replay_clips", """
SELECT cl.clip_id, cl.clip_name FROM (
  SELECT 'cv:' || cast(mt.match_id AS varchar) AS clip_id, c.name || ' clip ' || cast(mt.match_id AS varchar) AS clip_name
  FROM v_matches mt JOIN v_competitions c ON c.competition_id = mt.competition_id) cl
WHERE EXISTS (SELECT 1 FROM v_track_points p WHERE 'cv:' || p.clip_name = cl.clip_id)
""", ("v_track_points", "v_matches", "v_competitions"))
def replay_clips(md: MatchData) -> DataFrame:
    pts = TR.load_track_points(track_points(md), FRAME_W, FRAME_H).select("clip_id")
    return clips(md).join(pts, "clip_id", "left_semi").select("clip_id", "clip_name")


@register("replay_tracks", f"""
SELECT p.clip_id, p.clip_id || ':' || p.track_id AS track_id, coalesce(m.class, 'player') AS track_class, p.points, p.last_frame,
       max(p.last_frame) OVER (PARTITION BY p.clip_id) + 1 AS frame_count, p.frames, p.times, p.xs, p.ys
FROM (SELECT clip_id, track_id, count(*) AS points, max(frame_index) AS last_frame,
             list(frame_index ORDER BY frame_index, time_seconds NULLS FIRST, x, y) AS frames, list(time_seconds ORDER BY frame_index, time_seconds NULLS FIRST, x, y) AS times,
             list(x ORDER BY frame_index, time_seconds NULLS FIRST, x, y) AS xs, list(y ORDER BY frame_index, time_seconds NULLS FIRST, x, y) AS ys
      FROM (SELECT 'cv:' || clip_name AS clip_id, track_id, frame_index, time_seconds, round(cx / {FRAME_W}, 6) AS x, round(cy / {FRAME_H}, 6) AS y FROM v_track_points
            QUALIFY row_number() OVER (PARTITION BY clip_name ORDER BY track_id, frame_index) <= {TR.POINT_LIMIT}) GROUP BY 1, 2) p
LEFT JOIN (SELECT 'cv:' || clip_name AS clip_id, track_id, arg_max(class, 100000 * n - first_seen) AS class
           FROM (SELECT clip_name, track_id, class, count(*) AS n, min(frame_index) AS first_seen FROM v_track_points GROUP BY 1, 2, 3)
           GROUP BY 1, 2) m ON m.clip_id = p.clip_id AND m.track_id = p.track_id
""", ("v_track_points",))
def replay_tracks(md: MatchData) -> DataFrame:
    """K8: points per track with their positions (capped per clip), class default
    'player', frames = highest frame + 1. Points and classes meet on the
    clip-prefixed track id."""
    pts = TR.load_track_points(track_points(md), FRAME_W, FRAME_H)
    cls = track_metrics(md).select("clip_id", F.concat_ws(":", "clip_id", "track_id").alias("track_id"), "class")
    return TR.replay_tracks(pts, cls)


@register("track_trail", f"""
SELECT clip_name, track_id, frame_index,
       count(*) OVER (PARTITION BY clip_name, track_id ORDER BY frame_index RANGE BETWEEN {TR.TRAIL_FRAMES} PRECEDING AND CURRENT ROW) AS trail_points
FROM v_track_points
""", ("v_track_points",))
def track_trail(md: MatchData) -> DataFrame:
    w = (Window.partitionBy("clip_name", "track_id").orderBy("frame_index")
         .rangeBetween(-TR.TRAIL_FRAMES, Window.currentRow))
    return track_points(md).select("clip_name", "track_id", "frame_index", F.count(F.lit(1)).over(w).alias("trail_points"))


@register("clip_render_summary", """
SELECT 'cv:' || clip_name AS clip_id, count(*) FILTER (WHERE class = 'player') AS player_tracks,
       count(*) FILTER (WHERE class = 'ball') AS ball_tracks, max(last_frame) + 1 AS frame_count
FROM (SELECT f.clip_name, f.track_id, f.last_frame, c.class FROM
        (SELECT clip_name, track_id, max(frame_index) AS last_frame FROM v_track_points GROUP BY 1, 2) f
      JOIN (SELECT clip_name, track_id, class, row_number() OVER (PARTITION BY clip_name, track_id ORDER BY n DESC, first_seen) AS rk
            FROM (SELECT clip_name, track_id, class, count(*) AS n, min(frame_index) AS first_seen FROM v_track_points GROUP BY 1, 2, 3) x) c
        ON c.clip_name = f.clip_name AND c.track_id = f.track_id AND c.rk = 1) s
GROUP BY clip_name
""", ("v_track_points",))
def clip_render_summary(md: MatchData) -> DataFrame:
    t = track_metrics(md)
    return t.groupBy("clip_id").agg(F.count_if(F.col("class") == "player").alias("player_tracks"),
                                    F.count_if(F.col("class") == "ball").alias("ball_tracks"),
                                    (F.max("last_frame") + 1).alias("frame_count"))


@register("frame_stride_cap", """
SELECT clip_name, track_id, frame_index FROM v_track_points WHERE frame_index % 3 = 0 AND frame_index < least(150 * 25, 100)
""", ("v_track_points",))
def frame_stride_cap(md: MatchData) -> DataFrame:
    return TR.frame_stride_cap(track_points(md), stride=3, fps=25.0, seconds=150.0, max_frames=100).select(
        "clip_name", "track_id", "frame_index")


@register("detection_filter", """
SELECT clip_name, track_id, frame_index, CASE c WHEN 'person' THEN 'player' WHEN 'sports ball' THEN 'ball' END AS class
FROM (SELECT *, CASE class WHEN 'player' THEN 'person' ELSE 'sports ball' END AS c FROM v_track_points) d
WHERE c IN ('person', 'sports ball') AND confidence >= 0.6
""", ("v_track_points",))
def detection_filter(md: MatchData) -> DataFrame:
    det = track_points(md).withColumn("class", F.when(F.col("class") == "player", "person").otherwise("sports ball"))
    return TR.detection_filter(det, 0.6).select("clip_name", "track_id", "frame_index", "class")
