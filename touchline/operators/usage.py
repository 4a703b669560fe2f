"""Usage accounting: request subjects, fixed rate windows and decisions,
tiers, subscriptions and entitlements, follows and posts.

Rate decisions are skew-safe: the per-request rank inside a day window is
the count of the subject's earlier minutes (a running sum over per-minute
counts, at most 1,440 rows per subject-day) plus the rank inside the minute,
so one very busy subject never forces a whole day of requests into one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: per-minute / per-day limits by tier
LIMITS = {"anonymous": (12, 300), "user": (30, 1000), "premium": (90, 3000)}
PREMIUM_STATUSES = ("active", "trialing")


def resolve_subject(user_id: Column, forwarded_for: Column, real_ip: Column) -> tuple[Column, Column]:
    """Q0: ('user', id) when authenticated, else ('ip', first forwarded-for
    address, else real ip, else 'unknown')."""
    first = F.nullif(F.trim(F.split(forwarded_for, ",").getItem(0)), F.lit(""))
    ip = F.coalesce(F.when(F.length(forwarded_for) > 0, first), F.nullif(F.trim(real_ip), F.lit("")), F.lit("unknown"))
    kind = F.when(user_id.isNotNull(), F.lit("user")).otherwise(F.lit("ip"))
    value = F.when(user_id.isNotNull(), user_id.cast("string")).otherwise(ip)
    return kind, value


def rate_windows(requests: DataFrame) -> DataFrame:
    """Q1: request counts per subject in fixed minute and day windows."""
    m = requests.groupBy("subject_kind", "subject", F.date_trunc("minute", "ts").alias("window_start")).agg(
        F.count(F.lit(1)).alias("request_count")).withColumn("window_kind", F.lit("minute"))
    d = requests.groupBy("subject_kind", "subject", F.date_trunc("day", "ts").alias("window_start")).agg(
        F.count(F.lit(1)).alias("request_count")).withColumn("window_kind", F.lit("day"))
    cols = ["subject_kind", "subject", "window_kind", "window_start", "request_count"]
    return m.select(*cols).unionAll(d.select(*cols))


def tier_limits(subjects: DataFrame, entitlements: DataFrame) -> DataFrame:
    """Q5: (minute, day) limits by anonymous / user / premium."""
    e = entitlements.select(F.col("user_id").cast("string").alias("subject"), "tier")
    j = subjects.join(e, "subject", "left")
    tier = (F.when(F.col("subject_kind") != "user", "anonymous")
            .when(F.col("tier") == "premium", "premium").otherwise("user"))
    lim = F.create_map(*[x for k, (a, b) in LIMITS.items() for x in (F.lit(k), F.array(F.lit(a), F.lit(b)))])
    return j.select("subject_kind", "subject", tier.alias("tier"),
                    F.element_at(lim, tier).getItem(0).alias("minute_limit"),
                    F.element_at(lim, tier).getItem(1).alias("day_limit"))


def rate_decisions(requests: DataFrame, limits: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Q2: per request: counts in its minute and day windows (blocked requests
    count too), the first exceeded window, remaining of the tightest window and
    retry-after seconds. ``carried`` holds counts of requests decided before
    these (rows of ``rate_windows``), which are added."""
    r = requests.select("request_id", "subject_kind", "subject", "ts",
                        F.date_trunc("minute", "ts").alias("minute_start"), F.date_trunc("day", "ts").alias("day_start"))
    in_minute = F.row_number().over(Window.partitionBy("subject_kind", "subject", "minute_start").orderBy("ts", "request_id"))
    r = r.withColumn("minute_count", in_minute)
    per_minute = r.groupBy("subject_kind", "subject", "day_start", "minute_start").agg(F.count(F.lit(1)).alias("n"))
    before = per_minute.select(
        "subject_kind", "subject", "minute_start",
        F.coalesce(F.sum("n").over(Window.partitionBy("subject_kind", "subject", "day_start").orderBy("minute_start")
                                   .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    r = r.join(before, ["subject_kind", "subject", "minute_start"]).withColumn(
        "day_count", F.col("earlier") + F.col("minute_count"))
    if carried is not None:
        for kind in ("minute", "day"):
            seen = carried.where(F.col("window_kind") == kind).select(
                "subject_kind", "subject", F.col("window_start").alias(f"{kind}_start"), F.col("request_count").alias("seen"))
            r = r.join(seen, ["subject_kind", "subject", f"{kind}_start"], "left").withColumn(
                f"{kind}_count", F.col(f"{kind}_count") + F.coalesce("seen", F.lit(0))).drop("seen")
    r = r.join(limits.select("subject_kind", "subject", "minute_limit", "day_limit"), ["subject_kind", "subject"])
    mc, dc, ml, dl = F.col("minute_count"), F.col("day_count"), F.col("minute_limit"), F.col("day_limit")
    epoch = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    retry_minute = F.greatest(F.lit(1), F.ceil((F.unix_micros("minute_start") / 1e6 + 60 - epoch)))
    retry_day = F.greatest(F.lit(1), F.ceil((F.unix_micros("day_start") / 1e6 + 86400 - epoch)))
    minute_over, day_over = mc > ml, dc > dl
    scope = (F.when(minute_over, "minute").when(day_over, "day")
             .when((dl - dc) < (ml - mc), "day").otherwise("minute"))
    tight_limit = F.when(scope == "minute", ml).otherwise(dl)
    tight_count = F.when(scope == "minute", mc).otherwise(dc)
    allowed = ~(minute_over | day_over)
    return r.select(
        "request_id", "subject_kind", "subject", "minute_count", "day_count", allowed.alias("allowed"),
        scope.alias("scope"), tight_limit.alias("limit"),
        F.when(allowed, F.greatest(F.lit(0), tight_limit - tight_count)).otherwise(0).alias("remaining"),
        F.when(minute_over, retry_minute).when(day_over, retry_day).otherwise(0).cast("long").alias("retry_after_seconds"))


def subscription_state(events: DataFrame, customers: DataFrame, status_of: Column) -> tuple[DataFrame, DataFrame]:
    """Q12: fold subscription events per customer in arrival order: the last
    relevant event sets the status (other event types are ignored); tier is
    premium for active / trialing, free otherwise. Events of unknown customers
    come back as error rows."""
    ev = events.select("customer_id", "arrival", status_of.alias("status")).where(F.col("status").isNotNull())
    last = ev.groupBy("customer_id").agg(F.max_by("status", "arrival").alias("status"),
                                         F.max("arrival").alias("last_arrival"))
    state = customers.join(last, "customer_id", "left").select(
        "user_id", "customer_id", "status",
        F.when(F.col("status").isin(*PREMIUM_STATUSES), "premium").otherwise("free").alias("tier"))
    errors = ev.join(customers.select("customer_id"), "customer_id", "left_anti").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("rejected_events"))
    return state, errors


def entitlements(users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Q13: free by default; premium only when stored tier and status agree."""
    s = subscriptions.select("user_id", F.col("tier").alias("stored_tier"), "status")
    j = users.join(s, "user_id", "left")
    premium = (F.col("stored_tier") == "premium") & F.col("status").isin(*PREMIUM_STATUSES)
    return j.select("user_id", F.when(premium, "premium").otherwise("free").alias("tier"))


def validate_follows(follows: DataFrame, teams: DataFrame, players: DataFrame) -> DataFrame:
    """Q7: exactly one entity, and it exists; duplicates collapse (insert-ignore)."""
    one = F.col("team_id").isNull() != F.col("player_id").isNull()
    t = teams.select(F.col("team_id").alias("t_ok"))
    p = players.select(F.col("player_id").alias("p_ok"))
    j = (follows.join(t, F.col("team_id") == F.col("t_ok"), "left")
         .join(p, F.col("player_id") == F.col("p_ok"), "left"))
    exists = F.col("t_ok").isNotNull() | F.col("p_ok").isNotNull()
    reason = F.when(~one, "needs_exactly_one_entity").when(~exists, "unknown_entity")
    return j.select("user_id", "team_id", "player_id", "created_at", reason.alias("rejection"))


def list_follows(follows: DataFrame, teams: DataFrame, players: DataFrame) -> DataFrame:
    """Q6: follows with names (falling back to the id), newest first per user."""
    t = teams.select("team_id", F.col("name").alias("team_name"))
    p = players.select("player_id", F.col("name").alias("player_name"))
    j = follows.join(t, "team_id", "left").join(p, "player_id", "left")
    name = F.when(F.col("team_id").isNotNull(), F.coalesce("team_name", "team_id")).otherwise(
        F.coalesce("player_name", "player_id"))
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.col("team_id").asc_nulls_last(),
                                              F.col("player_id").asc_nulls_last())
    return j.select("user_id", "team_id", "player_id", name.alias("name"), "created_at",
                    F.row_number().over(w).alias("position"))


SUBSCRIPTION = ("subscription_id", "status", "current_period_end")


def subscription_fold(events: DataFrame, customers: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Q12 in full: each customer's state after its events in order of
    ``arrival`` (whatever order the rows come in), up to and with ``as_of``.

    ``events``: ``customer_id, arrival, kind, subscription_id, status,
    current_period_end``. ``updated`` sets the tier by its status; ``deleted`` is a
    tombstone: the tier is free whatever the status says, while its id, status
    and period end are kept; a later update lifts it. Other kinds and events without an arrival are
    ignored; among equal arrivals a tombstone wins. Customers without events are free."""
    e = events.where(F.col("kind").isin("updated", "deleted") & F.col("arrival").isNotNull())
    if as_of is not None:
        e = e.where(F.col("arrival") <= as_of)
    deleted = F.col("kind") == "deleted"
    last = e.groupBy("customer_id").agg(F.max_by(F.struct(*SUBSCRIPTION, deleted.alias("deleted")), F.struct(
        "arrival", deleted, F.xxhash64(*SUBSCRIPTION))).alias("s"), F.count(F.lit(1)).alias("n_events"))
    tier = F.when(F.coalesce(~F.col("s.deleted"), F.lit(False)) & F.col("s.status").isin(*PREMIUM_STATUSES), "premium").otherwise("free")
    return customers.join(last, "customer_id", "left").select(
        "user_id", "customer_id", *(F.col(f"s.{c}").alias(c) for c in SUBSCRIPTION), F.coalesce("s.deleted", F.lit(False)).alias("deleted"),
        tier.alias("tier"), F.coalesce("n_events", F.lit(0)).alias("n_events"))
