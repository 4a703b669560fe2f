"""Usage, subscriptions, follows and posts over the ``events`` table (2.Q).

Stand-ins (FIXTURES): a request per event; the user is signed in when
user_id is even; forwarded-for / real-ip headers are derived from the ids.
Subscription customers are the users with user_id % 10 = 0; every event is a
subscription event of customer 'cus_<user_id>' arriving in event_id order.
Follows and posts are clicks / purchases carrying ``$.k`` as their parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import author_label
from ..operators import usage as U
from ..sources.projections import SOURCE_EVENTS, SOURCE_FEED, MatchData
from .catalog import register

REQUESTS_SQL = """
SELECT event_id AS request_id, ts,
       CASE WHEN user_id % 2 = 0 THEN 'user' ELSE 'ip' END AS subject_kind,
       CASE WHEN user_id % 2 = 0 THEN cast(user_id AS varchar)
            ELSE coalesce(CASE WHEN length(xff) > 0 THEN nullif(trim(split_part(xff, ',', 1)), '') END,
                          nullif(trim(real_ip), ''), 'unknown') END AS subject
FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN NULL
                  WHEN 1 THEN ' 10.0.' || cast(user_id % 256 AS varchar) || '.' || cast(event_id % 256 AS varchar) || ' , 172.16.0.1'
                  ELSE '' END AS xff,
             CASE WHEN event_id % 5 = 0 THEN NULL ELSE ' 192.168.' || cast(user_id % 256 AS varchar) || '.1 ' END AS real_ip
      FROM events) e"""


def requests(md: MatchData) -> DataFrame:
    return requests_from(md.read("events", "event_id", "ts", "user_id"))


def requests_from(e: DataFrame) -> DataFrame:
    """Request log rows from event rows (batch or streaming alike)."""
    k3 = F.col("event_id") % 3
    xff = (F.when(k3 == 0, F.lit(None).cast("string"))
           .when(k3 == 1, F.concat(F.lit(" 10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."),
                                   (F.col("event_id") % 256).cast("string"), F.lit(" , 172.16.0.1")))
           .otherwise(F.lit("")))
    real_ip = F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit(" 192.168."), (F.col("user_id") % 256).cast("string"), F.lit(".1 ")))
    signed_in = F.when(F.col("user_id") % 2 == 0, F.col("user_id"))
    kind, value = U.resolve_subject(signed_in, xff, real_ip)
    return e.select(F.col("event_id").alias("request_id"), "ts", kind.alias("subject_kind"), value.alias("subject"))


@register("resolve_subject", "SELECT request_id, subject_kind, subject FROM r", (), {"r": REQUESTS_SQL})
def resolve_subject(md: MatchData) -> DataFrame:
    return requests(md).select("request_id", "subject_kind", "subject")


@register("rate_windows", """
SELECT subject_kind, subject, 'minute' AS window_kind, date_trunc('minute', ts) AS window_start, count(*) AS request_count
FROM r GROUP BY 1, 2, 4
UNION ALL
SELECT subject_kind, subject, 'day', date_trunc('day', ts), count(*) FROM r GROUP BY 1, 2, 4
""", (), {"r": REQUESTS_SQL})
def rate_windows(md: MatchData) -> DataFrame:
    return U.rate_windows(requests(md))


SUBS_SQL = """
SELECT c.user_id, c.customer_id, s.status,
       CASE WHEN s.status IN ('active', 'trialing') THEN 'premium' ELSE 'free' END AS tier
FROM (SELECT DISTINCT user_id, 'cus_' || cast(user_id AS varchar) AS customer_id FROM events WHERE user_id % 10 = 0) c
LEFT JOIN (SELECT 'cus_' || cast(user_id AS varchar) AS customer_id,
                  arg_max(CASE event_type WHEN 'signup' THEN 'active' WHEN 'purchase' THEN 'active'
                                          WHEN 'error' THEN 'past_due' WHEN 'click' THEN 'trialing' END, event_id) AS status
           FROM events WHERE event_type <> 'view' GROUP BY 1) s ON s.customer_id = c.customer_id"""

ENT_SQL = """
SELECT u.user_id, CASE WHEN s.tier = 'premium' AND s.status IN ('active', 'trialing') THEN 'premium' ELSE 'free' END AS tier
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN subs s ON s.user_id = u.user_id"""


def _status_of() -> F.Column:
    t = F.col("event_type")
    return (F.when(t.isin("signup", "purchase"), "active").when(t == "error", "past_due")
            .when(t == "click", "trialing"))


def subscriptions(md: MatchData) -> tuple[DataFrame, DataFrame]:
    e = md.read("events", "event_id", "user_id", "event_type")
    ev = e.select(F.concat(F.lit("cus_"), F.col("user_id").cast("string")).alias("customer_id"),
                  F.col("event_id").alias("arrival"), "event_type")
    customers = (e.where(F.col("user_id") % 10 == 0).select("user_id").distinct()
                 .withColumn("customer_id", F.concat(F.lit("cus_"), F.col("user_id").cast("string"))))
    return U.subscription_state(ev, customers, _status_of())


@register("subscription_state", "SELECT user_id, customer_id, status, tier FROM subs", (), {"subs": SUBS_SQL})
def subscription_state(md: MatchData) -> DataFrame:
    return subscriptions(md)[0]


@register("subscription_errors", """
SELECT 'cus_' || cast(user_id AS varchar) AS customer_id, count(*) AS rejected_events
FROM events WHERE event_type <> 'view' AND user_id % 10 <> 0 GROUP BY 1
""")
def subscription_errors(md: MatchData) -> DataFrame:
    return subscriptions(md)[1]


FOLD_SQL = """
SELECT c.user_id, 'cus_' || cast(c.user_id AS varchar) AS customer_id, 'sub_' || cast(l.event_id % 7 AS varchar) AS subscription_id,
       CASE WHEN l.event_type IS NULL THEN NULL WHEN l.event_type = 'click' THEN 'trialing' ELSE 'active' END AS status, l.event_id + 30 AS current_period_end,
       coalesce(l.event_type = 'error', false) AS deleted, CASE WHEN l.event_type IN ('signup', 'purchase', 'click') THEN 'premium' ELSE 'free' END AS tier,
       coalesce(l.n, 0) AS n_events
FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 0) c
LEFT JOIN (SELECT user_id, event_id, event_type, count(*) OVER (PARTITION BY user_id) AS n FROM events
           WHERE event_type <> 'view'{upto} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) l USING (user_id)"""


def _fold(md: MatchData, as_of=None) -> DataFrame:
    e = md.read("events", "event_id", "user_id", "event_type")
    t = F.col("event_type")
    kind = F.when(t == "error", "deleted").when(t.isin("signup", "purchase", "click"), "updated").otherwise("viewed")
    customer = F.concat(F.lit("cus_"), F.col("user_id").cast("string")).alias("customer_id")
    ev = e.select(customer, F.col("event_id").alias("arrival"), kind.alias("kind"),
                  F.concat(F.lit("sub_"), (F.col("event_id") % 7).cast("string")).alias("subscription_id"),
                  F.when(t == "click", "trialing").otherwise("active").alias("status"), (F.col("event_id") + 30).alias("current_period_end"))
    customers = e.where(F.col("user_id") % 10 == 0).select("user_id").distinct().select("user_id", customer)
    return U.subscription_fold(ev, customers, as_of)


@register("subscription_fold", FOLD_SQL.format(upto=""))
def subscription_fold(md: MatchData) -> DataFrame:
    """Q12: deletions are tombstones (free whatever their status), ids and period ends are kept."""
    return _fold(md)


@register("subscription_fold_as_of", FOLD_SQL.format(upto=" AND event_id <= (SELECT max(event_id) // 2 FROM events)"))
def subscription_fold_as_of(md: MatchData) -> DataFrame:
    """Q12: the state at the middle of the event ids."""
    return _fold(md, F.lit((md.read("events", "event_id").agg(F.max("event_id")).first()[0] or 0) // 2))


def entitlements_df(md: MatchData) -> DataFrame:
    users = md.read("events", "user_id").distinct()
    return U.entitlements(users, subscriptions(md)[0])


@register("entitlements", "SELECT user_id, tier FROM ent", (), {"subs": SUBS_SQL, "ent": ENT_SQL})
def entitlements(md: MatchData) -> DataFrame:
    return entitlements_df(md)


LIMITS_SQL = """
SELECT DISTINCT r.subject_kind, r.subject,
       CASE WHEN r.subject_kind <> 'user' THEN 'anonymous' WHEN e.tier = 'premium' THEN 'premium' ELSE 'user' END AS tier
FROM r LEFT JOIN ent e ON cast(e.user_id AS varchar) = r.subject AND r.subject_kind = 'user'"""


def limits(md: MatchData) -> DataFrame:
    subjects = requests(md).select("subject_kind", "subject").distinct()
    return U.tier_limits(subjects, entitlements_df(md))


@register("tier_limits", """
SELECT subject_kind, subject, tier,
       CASE tier WHEN 'anonymous' THEN 12 WHEN 'user' THEN 30 ELSE 90 END AS minute_limit,
       CASE tier WHEN 'anonymous' THEN 300 WHEN 'user' THEN 1000 ELSE 3000 END AS day_limit
FROM lim
""", (), {"r": REQUESTS_SQL, "subs": SUBS_SQL, "ent": ENT_SQL, "lim": LIMITS_SQL})
def tier_limits(md: MatchData) -> DataFrame:
    return limits(md)


@register("rate_decisions", """
SELECT request_id, subject_kind, subject, minute_count, day_count, allowed, scope,
       CASE WHEN scope = 'minute' THEN minute_limit ELSE day_limit END AS "limit",
       CASE WHEN allowed THEN greatest(0, CASE WHEN scope = 'minute' THEN minute_limit - minute_count ELSE day_limit - day_count END)
            ELSE 0 END AS remaining,
       cast(CASE WHEN minute_count > minute_limit THEN greatest(1, ceil(epoch(date_trunc('minute', ts)) + 60 - epoch(ts)))
            WHEN day_count > day_limit THEN greatest(1, ceil(epoch(date_trunc('day', ts)) + 86400 - epoch(ts)))
            ELSE 0 END AS bigint) AS retry_after_seconds
FROM (SELECT *, NOT (minute_count > minute_limit OR day_count > day_limit) AS allowed,
             CASE WHEN minute_count > minute_limit THEN 'minute' WHEN day_count > day_limit THEN 'day'
                  WHEN day_limit - day_count < minute_limit - minute_count THEN 'day' ELSE 'minute' END AS scope
      FROM (SELECT r.*, l.minute_limit, l.day_limit,
                   cast(row_number() OVER (PARTITION BY r.subject_kind, r.subject, date_trunc('minute', r.ts) ORDER BY r.ts, r.request_id) AS integer) AS minute_count,
                   row_number() OVER (PARTITION BY r.subject_kind, r.subject, date_trunc('day', r.ts) ORDER BY r.ts, r.request_id) AS day_count
            FROM r JOIN (SELECT subject_kind, subject,
                                CASE tier WHEN 'anonymous' THEN 12 WHEN 'user' THEN 30 ELSE 90 END AS minute_limit,
                                CASE tier WHEN 'anonymous' THEN 300 WHEN 'user' THEN 1000 ELSE 3000 END AS day_limit FROM lim) l
              ON l.subject_kind = r.subject_kind AND l.subject = r.subject) x) y
""", (), {"r": REQUESTS_SQL, "subs": SUBS_SQL, "ent": ENT_SQL, "lim": LIMITS_SQL})
def rate_decisions(md: MatchData) -> DataFrame:
    return U.rate_decisions(requests(md), limits(md))


# ------------------------------------------------------------------ follows
FOLLOWS_SQL = """
SELECT user_id, event_id,
       CASE WHEN k % 3 <> 1 THEN CASE WHEN k % 30 % 5 = 4 THEN 'af:' ELSE '' END || cast(k % 30 AS varchar) END AS team_id,
       CASE WHEN k % 3 <> 0 THEN (CASE WHEN k % 25 % 5 = 4 THEN 'af:' ELSE '' END || cast(k % 25 AS varchar)) || '-P' || cast(k % 11 AS varchar) END AS player_id,
       ts AS created_at
FROM (SELECT *, cast(json_extract(props, '$.k') AS bigint) AS k FROM events WHERE event_type = 'click') e"""


def follows(md: MatchData) -> DataFrame:
    e = md.read("events", "event_id", "ts", "user_id", "event_type", "props").where(F.col("event_type") == "click")
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = e.withColumn("k", k)
    t = F.concat(F.when(F.col("k") % 30 % 5 == 4, "af:").otherwise(""), (F.col("k") % 30).cast("string"))
    p = F.concat(F.when(F.col("k") % 25 % 5 == 4, "af:").otherwise(""), (F.col("k") % 25).cast("string"),
                 F.lit("-P"), (F.col("k") % 11).cast("string"))
    return e.select("user_id", "event_id", F.when(F.col("k") % 3 != 1, t).alias("team_id"),
                    F.when(F.col("k") % 3 != 0, p).alias("player_id"), F.col("ts").alias("created_at"))


@register("validate_follows", """
SELECT f.user_id, f.team_id, f.player_id, f.created_at,
       CASE WHEN (f.team_id IS NULL) = (f.player_id IS NULL) THEN 'needs_exactly_one_entity'
            WHEN t.team_id IS NULL AND p.player_id IS NULL THEN 'unknown_entity' END AS rejection
FROM f LEFT JOIN v_teams t ON t.team_id = f.team_id LEFT JOIN v_players p ON p.player_id = f.player_id
""", ("v_teams", "v_players"), {"f": FOLLOWS_SQL})
def validate_follows(md: MatchData) -> DataFrame:
    return U.validate_follows(follows(md), md.teams, md.players)


@register("list_follows", """
SELECT user_id, team_id, player_id, name, created_at,
       cast(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, team_id NULLS LAST, player_id NULLS LAST) AS integer) AS position
FROM (SELECT DISTINCT ON (f.user_id, f.team_id, f.player_id) f.user_id, f.team_id, f.player_id,
             CASE WHEN f.team_id IS NOT NULL THEN coalesce(t.name, f.team_id) ELSE coalesce(p.name, f.player_id) END AS name,
             f.created_at
      FROM f LEFT JOIN v_teams t ON t.team_id = f.team_id LEFT JOIN v_players p ON p.player_id = f.player_id
      WHERE (f.team_id IS NULL) <> (f.player_id IS NULL) AND (t.team_id IS NOT NULL OR p.player_id IS NOT NULL)
      ORDER BY f.user_id, f.team_id, f.player_id, f.event_id) s
""", ("v_teams", "v_players"), {"f": FOLLOWS_SQL})
def list_follows(md: MatchData) -> DataFrame:
    """Valid follows, duplicates ignored (the first stored wins), named, newest first."""
    from pyspark.sql import Window
    f = follows(md)
    t = md.teams.select(F.col("team_id").alias("t_ok"))
    p = md.players.select(F.col("player_id").alias("p_ok"))
    valid = (f.join(t, f.team_id == t.t_ok, "left").join(p, f.player_id == p.p_ok, "left")
             .where((F.col("team_id").isNull() != F.col("player_id").isNull())
                    & (F.col("t_ok").isNotNull() | F.col("p_ok").isNotNull())))
    first = Window.partitionBy("user_id", "team_id", "player_id").orderBy("event_id")
    dedup = valid.withColumn("rn", F.row_number().over(first)).where("rn = 1").select(
        "user_id", "team_id", "player_id", "created_at")
    return U.list_follows(dedup, md.teams, md.players)


# -------------------------------------------------------------------- posts
POSTS_SQL = """
SELECT event_id AS post_id, user_id, ts AS created_at,
       CASE cast(json_extract(props, '$.k') AS bigint) % 3 WHEN 0 THEN 'comparison' WHEN 1 THEN 'leaderboard' ELSE 'replay' END AS kind,
       cast(json_extract(props, '$.k') AS bigint) AS k
FROM events WHERE event_type = 'purchase'"""


@register("post_feed", """
SELECT post_id, kind, k, 'Member ' || coalesce(nullif(substr(replace(cast(user_id AS varchar), '-', ''), 1, 6), ''), 'member') AS author
FROM posts ORDER BY created_at DESC, post_id DESC LIMIT 50
""", (), {"posts": POSTS_SQL})
def post_feed(md: MatchData) -> DataFrame:
    e = md.read("events", "event_id", "ts", "user_id", "event_type", "props").where(F.col("event_type") == "purchase")
    params = F.from_json("props", "k long")
    kinds = F.when(params["k"] % 3 == 0, "comparison").when(params["k"] % 3 == 1, "leaderboard").otherwise("replay")
    p = e.select(F.col("event_id").alias("post_id"), F.col("ts").alias("created_at"), kinds.alias("kind"),
                 params["k"].alias("k"), author_label(F.col("user_id").cast("string")).alias("author"))
    return p.orderBy(F.desc("created_at"), F.desc("post_id")).limit(50).select("post_id", "kind", "k", "author")


@register("increment_counter", """
SELECT p.post_id, coalesce(o.opens, 0) AS view_count FROM posts p
LEFT JOIN (SELECT cast(json_extract(props, '$.k') AS bigint) AS post_ref, count(*) AS opens FROM events
           WHERE event_type = 'view' GROUP BY 1) o ON o.post_ref = p.post_id
""", (), {"posts": POSTS_SQL})
def increment_counter(md: MatchData) -> DataFrame:
    """view_count = number of opens (view events whose $.k names the post)."""
    e = md.read("events", "event_id", "event_type", "props")
    posts = e.where(F.col("event_type") == "purchase").select(F.col("event_id").alias("post_id"))
    opens = (e.where(F.col("event_type") == "view").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("post_id"))
             .agg(F.count(F.lit(1)).alias("opens")))
    return posts.join(opens, "post_id", "left").select("post_id", F.coalesce("opens", F.lit(0)).alias("view_count"))


# --------------------------------------------------------- Q10 / Q11 posts
METRICS = ("goals", "xt", "vaep", "passes")
CAPTION_LIMIT = 280


def posts(md: MatchData) -> DataFrame:
    """Shared posts: a purchase event is a post; ``$.k`` picks the kind and the
    parameters (teams, competition, metric, clip) and the caption length."""
    e = md.read("events", "event_id", "ts", "user_id", "event_type", "props").where(F.col("event_type") == "purchase")
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = e.withColumn("k", k)
    kk = F.col("k")

    def team(n):
        return F.concat(F.when(n % 5 == 4, "af:").otherwise(""), n.cast("string"))

    metrics = F.array(*[F.lit(m) for m in METRICS])
    return e.select(
        F.col("event_id").alias("post_id"), "user_id", F.col("ts").alias("created_at"),
        F.when(kk % 3 == 0, "comparison").when(kk % 3 == 1, "leaderboard").otherwise("replay").alias("kind"),
        team(kk % 25).alias("team_a"), team((kk * 7) % 25).alias("team_b"),
        F.concat((kk % 5).cast("string"), F.lit(":"), (1995 + kk % 8).cast("string")).alias("competition_id"),
        F.element_at(metrics, (kk % 4 + 1).cast("int")).alias("metric"),
        F.concat(F.lit("cv:"), (kk * 3).cast("string")).alias("clip_id"),
        F.repeat(F.lit("x"), (kk * 3).cast("int")).alias("caption"))


POSTS_SQL = """
  SELECT event_id AS post_id, k,
         CASE k % 3 WHEN 0 THEN 'comparison' WHEN 1 THEN 'leaderboard' ELSE 'replay' END AS kind,
         CASE WHEN (k % 25) % 5 = 4 THEN 'af:' ELSE '' END || cast(k % 25 AS varchar) AS team_a,
         CASE WHEN ((k * 7) % 25) % 5 = 4 THEN 'af:' ELSE '' END || cast((k * 7) % 25 AS varchar) AS team_b,
         cast(k % 5 AS varchar) || ':' || cast(1995 + k % 8 AS varchar) AS competition_id,
         ['goals', 'xt', 'vaep', 'passes'][cast(k % 4 AS integer) + 1] AS metric,
         'cv:' || cast(k * 3 AS varchar) AS clip_id, k * 3 AS caption_len
  FROM (SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k FROM events WHERE event_type = 'purchase') e"""
_CLIPS_SQL = """SELECT DISTINCT 'cv:' || cast(match_id AS varchar) AS clip_id FROM v_events
WHERE location_x IS NOT NULL AND location_y IS NOT NULL"""
# an entity is in a competition if it has stored metrics there, or, in the match feed, if the team exists
_IN_SQL = """SELECT DISTINCT m.competition_id, a.team_id FROM v_spadl a JOIN v_matches m ON m.match_id = a.match_id WHERE m.source = 'statsbomb'
UNION SELECT c.competition_id, t.team_id FROM v_competitions c, v_teams t WHERE c.source = 'api_football'"""


@register("validate_posts", """
SELECT p.post_id, p.kind,
       CASE WHEN p.caption_len > 280 THEN 'caption_too_long'
            WHEN p.kind = 'comparison' AND p.team_a = p.team_b THEN 'same_entity'
            WHEN p.kind <> 'replay' AND c.competition_id IS NULL THEN 'unknown_competition'
            WHEN p.kind = 'comparison' AND (a.team_id IS NULL OR b.team_id IS NULL) THEN 'unknown_entity'
            WHEN p.kind = 'leaderboard' AND NOT (c.source = 'statsbomb' OR p.metric = 'goals') THEN 'metric_unavailable'
            WHEN p.kind = 'replay' AND k.clip_id IS NULL THEN 'clip_without_points'
       END AS rejection
FROM p LEFT JOIN v_competitions c ON c.competition_id = p.competition_id
LEFT JOIN inside a ON a.competition_id = p.competition_id AND a.team_id = p.team_a
LEFT JOIN inside b ON b.competition_id = p.competition_id AND b.team_id = p.team_b
LEFT JOIN clips k ON k.clip_id = p.clip_id
""", ("v_teams", "v_competitions", "v_events", "v_matches", "v_spadl"), {"p": POSTS_SQL, "inside": _IN_SQL, "clips": _CLIPS_SQL})
def validate_posts(md: MatchData) -> DataFrame:
    """Q10: per-kind parameter checks as joins. A comparison needs two different
    entities and a competition that exists and holds both; a leaderboard
    needs a competition whose feed has the metric; a replay needs a clip with
    points."""
    from .insights import AVAILABILITY
    from .valuation import spadl
    p = posts(md)
    comp = md.competitions.select("competition_id", "source")
    played = (spadl(md).select("match_id", "team_id").distinct()
              .join(md.matches.where(F.col("source") == SOURCE_EVENTS).select("match_id", "competition_id"), "match_id")
              .select("competition_id", "team_id").distinct())
    pairs = p.where(F.col("kind") == "comparison").select("post_id", "competition_id", F.explode(F.array("team_a", "team_b")).alias("team_id"))
    fed = (pairs.join(comp.where(F.col("source") == SOURCE_FEED), "competition_id").join(md.teams.select("team_id"), "team_id")
           .select("post_id", "team_id"))
    inside = (pairs.join(played, ["competition_id", "team_id"]).select("post_id", "team_id").unionByName(fed).distinct()
              .groupBy("post_id").agg(F.count(F.lit(1)).alias("held")))
    # 7 fixed rows
    avail = F.broadcast(md.spark.createDataFrame([(s, m, True) for s, e, m in AVAILABILITY if e == "teams"], "source string, metric string, m_ok boolean"))
    clips = (md.events.where(F.col("location_x").isNotNull() & F.col("location_y").isNotNull())
             .select(F.concat(F.lit("cv:"), F.col("match_id").cast("string")).alias("clip_id")).distinct()
             .withColumn("c_ok", F.lit(True)))
    j = (p.join(comp, "competition_id", "left").join(inside, "post_id", "left")
         .join(avail, ["source", "metric"], "left").join(clips, "clip_id", "left"))
    kind = F.col("kind")
    reason = (F.when(F.length("caption") > CAPTION_LIMIT, "caption_too_long")
              .when((kind == "comparison") & (F.col("team_a") == F.col("team_b")), "same_entity")
              .when((kind != "replay") & F.col("source").isNull(), "unknown_competition")
              .when((kind == "comparison") & (F.coalesce("held", F.lit(0)) < 2), "unknown_entity")
              .when((kind == "leaderboard") & F.col("m_ok").isNull(), "metric_unavailable")
              .when((kind == "replay") & F.col("c_ok").isNull(), "clip_without_points"))
    return j.select("post_id", "kind", reason.alias("rejection"))
