"""Elo walk-forward, Dixon-Coles fits per cutoff, scoreline matrices, title odds.

Elo is a recursion: each update depends on the previous one, but only
through the two teams involved. Teams of different connected components of
the who-plays-whom graph never interact, so the walk is split exactly by
component (label propagation with DataFrame joins) and each component is
walked in date order by one grouped pandas function. A component's rows are
six narrow columns, so even a 10^6-match component is one cheap task.

Dixon-Coles is never refitted on raw rows: the likelihood collapses to
per-(home, away) sufficient statistics, so a fit's size is bounded by the
number of team pairs, not by the number of matches. The stats for every
cutoff are built with windows, and the fits of different cutoffs run in
parallel (``groupBy(cutoff).applyInPandas``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ------------------------------------------------------------ fixed values
BASE_RATING = 1500.0
K_FACTOR = 40.0
HOME_ADVANTAGE = 55.0
SCALE = 400.0
MAX_GOALS = 10
RIDGE = 0.5
MIN_FIT_MATCHES = 8
FULL_TRUST_MATCHES = 24
DEFAULT_BASE_GOALS = 1.35
DEFAULT_HOME_ADVANTAGE = 0.2
ELO_TO_LOG_GOAL = 0.001
RHO_BOUND = 0.3
MODEL_VERSION = "wp-1.0.0"


# ------------------------------------------------------------------ L1 / L2
def expected_score(rating_for: Column, rating_against: Column) -> Column:
    """L1: 1 / (1 + 10^(-d/400)) (callers add the home advantage)."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -(rating_for - rating_against) / SCALE))


def result_score(hg: Column, ag: Column) -> tuple[Column, Column]:
    """L2: 1 / 0.5 / 0 for home and away."""
    home = F.when(hg > ag, 1.0).when(hg < ag, 0.0).otherwise(0.5)
    return home, 1.0 - home


def margin_multiplier(hg: Column, ag: Column) -> Column:
    """L2: 1 for a margin <= 1, 1.5 for 2, (11 + d) / 8 beyond."""
    d = F.abs(hg - ag)
    return F.when(d <= 1, 1.0).when(d == 2, 1.5).otherwise((11.0 + d) / 8.0)


# -------------------------------------------------------- connected components
def team_components(matches: DataFrame) -> DataFrame:
    """(team_id, component) by min-label propagation over home/away edges.

    Each round is one join + aggregation over the edge list; the label table
    is checkpointed every few rounds to keep the plan short.
    """
    edges = matches.select(F.col("home_team_id").alias("a"), F.col("away_team_id").alias("b"))
    # distinct team pairs, written once: every round reads them
    edges = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint(eager=True)
    labels = edges.select(F.col("a").alias("team_id")).distinct().withColumn("component", F.col("team_id"))
    labels = labels.checkpoint(eager=True)
    while True:  # ends when a round changes no label
        nb = (edges.join(labels.withColumnRenamed("team_id", "b"), "b")
              .groupBy(F.col("a").alias("team_id")).agg(F.min("component").alias("nb")))
        # each round's labels are cut from the lineage, so a round never
        # recomputes the rounds before it
        new = labels.join(nb, "team_id", "left").select(
            "team_id", F.least("component", F.coalesce("nb", "component")).alias("component")).checkpoint(eager=True)
        changed = new.join(labels.withColumnRenamed("component", "old"), "team_id").where(
            F.col("component") != F.col("old")).limit(1).count()
        labels = new
        if changed == 0:
            break
    return labels


# --------------------------------------------------------------- L3 Elo walk
ELO_SCHEMA = ("match_id long, home_elo_pre double, away_elo_pre double, "
              "home_elo_post double, away_elo_post double, applied boolean")


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["match_date", "match_id"], kind="mergesort")
    ratings: dict[str, float] = {}
    out = []
    for mid, h, a, hs, as_ in zip(pdf["match_id"], pdf["home_team_id"], pdf["away_team_id"],
                                  pdf["home_score"], pdf["away_score"]):
        hr, ar = ratings.get(h, BASE_RATING), ratings.get(a, BASE_RATING)
        if pd.isna(hs) or pd.isna(as_):
            out.append((mid, hr, ar, hr, ar, False))
            continue
        hs, as_ = int(hs), int(as_)
        he = 1.0 / (1.0 + 10.0 ** (-((hr + HOME_ADVANTAGE) - ar) / SCALE))
        ha = 1.0 if hs > as_ else 0.0 if hs < as_ else 0.5
        d = abs(hs - as_)
        mult = 1.0 if d <= 1 else 1.5 if d == 2 else (11.0 + d) / 8.0
        change = K_FACTOR * mult
        ratings[h] = hr + change * (ha - he)
        ratings[a] = ar + change * ((1.0 - ha) - (1.0 - he))
        out.append((mid, hr, ar, ratings[h], ratings[a], True))
    return pd.DataFrame(out, columns=["match_id", "home_elo_pre", "away_elo_pre", "home_elo_post",
                                      "away_elo_post", "applied"])


def elo_walk_forward(matches: DataFrame) -> DataFrame:
    """Pre- and post-match ratings for every match (unscored: rated, not applied)."""
    comp = team_components(matches)
    m = matches.select("match_id", "match_date", "home_team_id", "away_team_id", "home_score", "away_score")
    m = m.join(comp.withColumnRenamed("team_id", "home_team_id"), "home_team_id")
    return m.groupBy("component").applyInPandas(_walk, ELO_SCHEMA)


STATE_SCHEMA = "team_id string, rating double, played long"


def _walk_seeded(pdf: pd.DataFrame) -> pd.DataFrame:
    """One component: seed rows carry the stored (rating, played) of a team,
    match rows are walked in (date, id) order from those ratings."""
    seeds = pdf[pdf["kind"] == "seed"]
    ratings = dict(zip(seeds["home_team_id"], seeds["rating"]))
    played = dict(zip(seeds["home_team_id"], seeds["played"].astype("int64")))
    walked = _walk_from(pdf[pdf["kind"] == "match"], ratings, played)
    rows = [(t, float(r), int(played.get(t, 0))) for t, r in ratings.items()]
    return pd.DataFrame(rows, columns=["team_id", "rating", "played"]) if rows else walked.iloc[0:0, 0:0]


def _walk_from(pdf: pd.DataFrame, ratings: dict, played: dict) -> pd.DataFrame:
    pdf = pdf.sort_values(["match_date", "match_id"], kind="mergesort")
    for h, a, hs, as_ in zip(pdf["home_team_id"], pdf["away_team_id"], pdf["home_score"], pdf["away_score"]):
        if pd.isna(hs) or pd.isna(as_):
            continue
        hr, ar = ratings.get(h, BASE_RATING), ratings.get(a, BASE_RATING)
        hs, as_ = int(hs), int(as_)
        he = 1.0 / (1.0 + 10.0 ** (-((hr + HOME_ADVANTAGE) - ar) / SCALE))
        ha = 1.0 if hs > as_ else 0.0 if hs < as_ else 0.5
        d = abs(hs - as_)
        change = K_FACTOR * (1.0 if d <= 1 else 1.5 if d == 2 else (11.0 + d) / 8.0)
        ratings[h] = hr + change * (ha - he)
        ratings[a] = ar + change * ((1.0 - ha) - (1.0 - he))
        played[h] = played.get(h, 0) + 1
        played[a] = played.get(a, 0) + 1
    return pdf


def elo_update(matches: DataFrame, state: DataFrame) -> DataFrame:
    """Q3 step: apply a batch of results to stored ratings; returns the new
    state rows of every team the batch touched (others are unchanged).
    Components are those of the batch's own who-plays-whom graph."""
    comp = team_components(matches)
    m = matches.select(F.lit("match").alias("kind"), "match_id", "match_date", "home_team_id", "away_team_id",
                       "home_score", "away_score", F.lit(None).cast("double").alias("rating"),
                       F.lit(None).cast("long").alias("played"))
    m = m.join(comp.withColumnRenamed("team_id", "home_team_id"), "home_team_id")
    seeds = state.join(comp, "team_id").select(
        F.lit("seed").alias("kind"), F.lit(None).cast("long").alias("match_id"), F.lit(None).cast("date").alias("match_date"),
        F.col("team_id").alias("home_team_id"), F.lit(None).cast("string").alias("away_team_id"),
        F.lit(None).cast("int").alias("home_score"), F.lit(None).cast("int").alias("away_score"),
        "rating", "played", "component")
    return m.unionByName(seeds).groupBy("component").applyInPandas(_walk_seeded, STATE_SCHEMA)


def final_ratings(matches: DataFrame, walk: DataFrame) -> DataFrame:
    """L4: last rating of every team with a scored match, matches played."""
    m = matches.select("match_id", "match_date", "home_team_id", "away_team_id")
    w = walk.where("applied").join(m, "match_id")
    sides = (w.select(F.col("home_team_id").alias("team_id"), "match_date", "match_id", F.col("home_elo_post").alias("post"))
             .unionAll(w.select(F.col("away_team_id").alias("team_id"), "match_date", "match_id",
                                F.col("away_elo_post").alias("post"))))
    return sides.groupBy("team_id").agg(
        F.round(F.max_by("post", F.struct("match_date", "match_id")), 2).alias("elo_rating"),
        F.count(F.lit(1)).alias("matches_played"))


# ---------------------------------------------------------- L5 DC statistics
def dc_pair_stats(matches: DataFrame) -> DataFrame:
    """Per (home, away) pair: n, sum of goals, and the four low-score counts."""
    s = matches.where(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    hg, ag = F.col("home_score"), F.col("away_score")
    return s.groupBy("home_team_id", "away_team_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(hg).alias("shg"), F.sum(ag).alias("sag"),
        F.count_if((hg == 0) & (ag == 0)).alias("n00"), F.count_if((hg == 0) & (ag == 1)).alias("n01"),
        F.count_if((hg == 1) & (ag == 0)).alias("n10"), F.count_if((hg == 1) & (ag == 1)).alias("n11"))


def match_order(matches: DataFrame) -> DataFrame:
    """Dense position of every match in (date, id) order, 0-based.

    Only the per-date counts (bounded by the calendar, not by the data) go
    through a global running sum; within a date the numbering is a window
    partitioned by date.
    """
    per_date = matches.groupBy("match_date").agg(F.count(F.lit(1)).alias("k"))
    offsets = per_date.select("match_date", (F.sum("k").over(
        Window.orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1))).alias("off"))
    within = matches.select("match_id", "match_date",
                            F.row_number().over(Window.partitionBy("match_date").orderBy("match_id")).alias("rn"))
    return within.join(offsets, "match_date").select(
        "match_id", (F.coalesce("off", F.lit(0)) + F.col("rn") - 1).alias("position"))


def date_order(matches: DataFrame) -> DataFrame:
    """Dense rank of every match's date (0-based); the ranking window runs over
    the distinct dates only (bounded by the calendar)."""
    dates = matches.select("match_date").distinct()
    ranked = dates.select("match_date", (F.row_number().over(Window.orderBy("match_date")) - 1).alias("position"))
    return matches.select("match_id", "match_date").join(ranked, "match_date").select("match_id", "position")


def cutoff_order(matches: DataFrame, refit: str = "match") -> DataFrame:
    """Cutoff position per match: ``match`` refits before every match (earlier
    matches of the same date count as prior, as in the reference);
    ``date`` refits once per match date, so the number of fits is bounded by
    the calendar instead of the match count."""
    if refit == "match":
        return match_order(matches)
    if refit == "date":
        return date_order(matches)
    raise ValueError(f"refit must be 'match' or 'date', not {refit!r}")


def dc_cutoff_stats(matches: DataFrame, refit: str = "match") -> DataFrame:
    """Pair statistics of all scored matches before each cutoff position.

    For every pair the running totals (ordered by position) are valid from the
    next position up to the pair's next position; each running row is expanded
    over exactly that range, so no cross join is needed.
    """
    pos = cutoff_order(matches, refit)
    n_total = pos.agg(F.max("position")).first()[0]
    m = matches.join(pos, "match_id").where(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    hg, ag = F.col("home_score"), F.col("away_score")
    # one row per (pair, position): positions repeat within a date in 'date' mode
    per = m.groupBy("home_team_id", "away_team_id", "position").agg(
        F.count(F.lit(1)).alias("c"), F.sum(hg).alias("h"), F.sum(ag).alias("a"),
        F.count_if((hg == 0) & (ag == 0)).alias("c00"), F.count_if((hg == 0) & (ag == 1)).alias("c01"),
        F.count_if((hg == 1) & (ag == 0)).alias("c10"), F.count_if((hg == 1) & (ag == 1)).alias("c11"))
    w = Window.partitionBy("home_team_id", "away_team_id").orderBy("position")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = per.select(
        "home_team_id", "away_team_id", "position",
        F.sum("c").over(run).alias("n"), F.sum("h").over(run).alias("shg"), F.sum("a").over(run).alias("sag"),
        F.sum("c00").over(run).alias("n00"), F.sum("c01").over(run).alias("n01"),
        F.sum("c10").over(run).alias("n10"), F.sum("c11").over(run).alias("n11"),
        F.lead("position").over(w).alias("next_position"))
    last = F.coalesce(F.col("next_position"), F.lit(n_total + 1))
    return cum.select("*", F.explode(F.sequence(F.col("position") + 1, last)).alias("cutoff")).where(
        F.col("cutoff") <= n_total).drop("position", "next_position")


# ------------------------------------------------------------- L6 DC fit
def _nll_grad(theta, hi, ai, n, shg, sag, n00, n01, n10, n11, nt):
    c, home, rho = theta[0], theta[1], theta[2]
    att, dfn = theta[3:3 + nt], theta[3 + nt:]
    ll = c + home + att[hi] - dfn[ai]
    lm = c + att[ai] - dfn[hi]
    lam, mu = np.exp(ll), np.exp(lm)
    t00 = 1.0 - lam * mu * rho
    t01 = 1.0 + lam * rho
    t10 = 1.0 + mu * rho
    t11 = 1.0 - rho
    c00, c01, c10, c11 = (np.maximum(t, 1e-9) for t in (t00, t01, t10, t11))
    val = -(np.sum(shg * ll - n * lam + sag * lm - n * mu)
            + np.sum(n00 * np.log(c00) + n01 * np.log(c01) + n10 * np.log(c10) + n11 * np.log(c11)))
    val += RIDGE * (np.sum(att ** 2) + np.sum(dfn ** 2))
    # derivatives of the negative log likelihood w.r.t. ll and lm per pair
    a00 = np.where(t00 > 1e-9, 1.0 / c00, 0.0)
    a01 = np.where(t01 > 1e-9, 1.0 / c01, 0.0)
    a10 = np.where(t10 > 1e-9, 1.0 / c10, 0.0)
    g_ll = -(shg - n * lam) - (n00 * a00 * (-lam * mu * rho) + n01 * a01 * (lam * rho))
    g_lm = -(sag - n * mu) - (n00 * a00 * (-lam * mu * rho) + n10 * a10 * (mu * rho))
    g_rho = -(np.sum(n00 * a00 * (-lam * mu)) + np.sum(n01 * a01 * lam) + np.sum(n10 * a10 * mu)
              + np.sum(n11 * (np.where(t11 > 1e-9, 1.0 / c11, 0.0)) * -1.0))
    grad = np.zeros_like(theta)
    grad[0] = np.sum(g_ll) + np.sum(g_lm)
    grad[1] = np.sum(g_ll)
    grad[2] = g_rho
    ga = np.zeros(nt)
    gd = np.zeros(nt)
    np.add.at(ga, hi, g_ll)
    np.add.at(ga, ai, g_lm)
    np.add.at(gd, ai, -g_ll)
    np.add.at(gd, hi, -g_lm)
    grad[3:3 + nt] = ga + 2 * RIDGE * att
    grad[3 + nt:] = gd + 2 * RIDGE * dfn
    return val, grad


def fit_pairs(pdf: pd.DataFrame, max_iter: int = 500, gtol: float = 1e-5):
    """Bounded quasi-Newton (projected BFGS) on the collapsed likelihood.

    Returns (teams, theta, n_matches) or None when too few matches / teams.
    """
    n_matches = int(pdf["n"].sum())
    teams = sorted(set(pdf["home_team_id"]) | set(pdf["away_team_id"]))
    if n_matches < MIN_FIT_MATCHES or len(teams) < 2:
        return None
    idx = {t: i for i, t in enumerate(teams)}
    hi = pdf["home_team_id"].map(idx).to_numpy()
    ai = pdf["away_team_id"].map(idx).to_numpy()
    arr = {k: pdf[k].to_numpy(float) for k in ("n", "shg", "sag", "n00", "n01", "n10", "n11")}
    nt = len(teams)
    mean_goals = (arr["shg"].sum() + arr["sag"].sum()) / (2.0 * n_matches)
    theta = np.concatenate([[math.log(max(mean_goals, 0.2)), 0.2, 0.0], np.zeros(2 * nt)])
    lo = np.concatenate([[math.log(0.2), -1.0, -RHO_BOUND], np.full(2 * nt, -3.0)])
    hi_b = np.concatenate([[math.log(6.0), 1.0, RHO_BOUND], np.full(2 * nt, 3.0)])

    def f(t):
        return _nll_grad(t, hi, ai, arr["n"], arr["shg"], arr["sag"], arr["n00"], arr["n01"], arr["n10"], arr["n11"], nt)

    val, g = f(theta)
    hinv, free = np.eye(len(theta)), np.ones(len(theta), bool)
    for _ in range(max_iter):
        now = ~(((theta <= lo) & (g > 0)) | ((theta >= hi_b) & (g < 0)))
        if np.max(np.abs(g[now]), initial=0.0) < gtol:
            break
        if (now != free).any():  # curvature is kept for the free parameters only
            hinv, free = np.eye(len(theta)), now
        d = np.where(free, -hinv @ np.where(free, g, 0.0), 0.0)
        if g @ d >= 0:
            hinv = np.eye(len(theta))
            d = np.where(free, -g, 0.0)
        step = 1.0
        while step > 1e-12:
            cand = np.clip(theta + step * d, lo, hi_b)
            cv, cg = f(cand)
            if cv <= val + 1e-4 * (g @ (cand - theta)):
                break
            step *= 0.5
        else:
            if np.max(np.abs(g[free])) < 1e-3:
                break  # at the rounding of the likelihood: no smaller value can be told apart
            if (hinv == np.eye(len(theta))).all():
                raise RuntimeError(f"no descent step found (gradient {np.max(np.abs(g[free])):.3g})")
            hinv = np.eye(len(theta))
            continue
        s, y = cand - theta, np.where(free, cg - g, 0.0)
        theta, val, g = cand, cv, cg
        sy = s @ y
        if sy > 1e-12:
            rho_ = 1.0 / sy
            eye = np.eye(len(theta))
            hinv = (eye - rho_ * np.outer(s, y)) @ hinv @ (eye - rho_ * np.outer(y, s)) + rho_ * np.outer(s, s)
    else:
        raise RuntimeError(f"the fit did not converge in {max_iter} iterations")
    return teams, theta, n_matches


FIT_SCHEMA = ("cutoff long, team_id string, attack double, defense double, intercept double, "
              "home_advantage double, rho double, n_matches long")


def _fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
    cutoff = int(pdf["cutoff"].iloc[0])
    res = fit_pairs(pdf)
    if res is None:
        return pd.DataFrame([], columns=["cutoff", "team_id", "attack", "defense", "intercept",
                                         "home_advantage", "rho", "n_matches"])
    teams, th, n = res
    nt = len(teams)
    return pd.DataFrame({"cutoff": cutoff, "team_id": teams, "attack": th[3:3 + nt], "defense": th[3 + nt:],
                         "intercept": th[0], "home_advantage": th[1], "rho": th[2], "n_matches": n})


def dc_fits(cutoff_stats: DataFrame) -> DataFrame:
    """One fit per cutoff (teams' attack/defence + shared parameters)."""
    return cutoff_stats.groupBy("cutoff").applyInPandas(_fit_group, FIT_SCHEMA)


# ----------------------------------------------------------- L7 prediction
def dc_rates(matches: DataFrame, elo_pre: DataFrame, fits: DataFrame | None, refit: str = "match") -> DataFrame:
    """Log-rate blend of the fit (weight min(1, n/24)) with the Elo prior."""
    pos = cutoff_order(matches, refit)
    m = matches.select("match_id", "home_team_id", "away_team_id").join(pos, "match_id").join(
        elo_pre.select("match_id", "home_elo_pre", "away_elo_pre"), "match_id")
    sup = ELO_TO_LOG_GOAL * (F.col("home_elo_pre") - F.col("away_elo_pre"))
    elo_home = math.log(DEFAULT_BASE_GOALS) + DEFAULT_HOME_ADVANTAGE + 0.5 * sup
    elo_away = math.log(DEFAULT_BASE_GOALS) - 0.5 * sup
    if fits is None:
        return m.select("match_id", F.exp(elo_home).alias("lambda_home"), F.exp(elo_away).alias("lambda_away"),
                        F.lit(0.0).alias("rho"), F.lit(0).cast("long").alias("training_matches"))
    g = fits.select("cutoff", "intercept", "home_advantage", "rho", "n_matches").dropDuplicates(["cutoff"])
    ft = fits.select("cutoff", "team_id", "attack", "defense")
    j = (m.join(g, m.position == g.cutoff, "left").drop("cutoff")
         .join(ft.select(F.col("cutoff").alias("position"), F.col("team_id").alias("home_team_id"),
                         F.col("attack").alias("ah"), F.col("defense").alias("dh")), ["position", "home_team_id"], "left")
         .join(ft.select(F.col("cutoff").alias("position"), F.col("team_id").alias("away_team_id"),
                         F.col("attack").alias("aa"), F.col("defense").alias("da")), ["position", "away_team_id"], "left"))
    fitted = F.col("n_matches").isNotNull()
    wgt = F.when(fitted, F.least(F.lit(1.0), F.col("n_matches") / float(FULL_TRUST_MATCHES))).otherwise(0.0)
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))  # noqa: E731 (unseen team = 0)
    dc_home = F.col("intercept") + F.col("home_advantage") + z("ah") - z("da")
    dc_away = F.col("intercept") + z("aa") - z("dh")
    lh = F.when(fitted, wgt * dc_home + (1 - wgt) * elo_home).otherwise(elo_home)
    la = F.when(fitted, wgt * dc_away + (1 - wgt) * elo_away).otherwise(elo_away)
    return j.select("match_id", F.exp(lh).alias("lambda_home"), F.exp(la).alias("lambda_away"),
                    F.coalesce("rho", F.lit(0.0)).alias("rho"),
                    F.coalesce("n_matches", F.lit(0)).cast("long").alias("training_matches"))


# ----------------------------------------------------------- L8 / L9 matrix
def log_factorial(k: Column) -> Column:
    """ln(k!) for 0 <= k <= 20 (exact factorial)."""
    return F.log(F.factorial(k).cast("double"))


def scoreline_matrix(rates: DataFrame) -> DataFrame:
    """0..10 x 0..10 Poisson product with the low-score correction,
    clipped at 0 and renormalised per match (explode, no join)."""
    goals = F.sequence(F.lit(0), F.lit(MAX_GOALS))
    cells = rates.select("match_id", "lambda_home", "lambda_away", "rho", F.explode(goals).alias("hg")).select(
        "*", F.explode(goals).alias("ag"))
    lh, la, rho = F.col("lambda_home"), F.col("lambda_away"), F.col("rho")
    hg, ag = F.col("hg"), F.col("ag")
    p = (F.exp(hg * F.log(lh) - lh - log_factorial(hg)) * F.exp(ag * F.log(la) - la - log_factorial(ag)))
    tau = (F.when((hg == 0) & (ag == 0), 1.0 - lh * la * rho).when((hg == 0) & (ag == 1), 1.0 + lh * rho)
           .when((hg == 1) & (ag == 0), 1.0 + la * rho).when((hg == 1) & (ag == 1), 1.0 - rho).otherwise(1.0))
    raw = F.greatest(p * tau, F.lit(0.0))
    total = F.sum("raw").over(Window.partitionBy("match_id"))
    return cells.select("match_id", "hg", "ag", raw.alias("raw")).select(
        "match_id", "hg", "ag", F.when(total > 0, F.col("raw") / total).otherwise(F.col("raw")).alias("p"))


def match_probabilities(matrix: DataFrame) -> DataFrame:
    """Home / draw / away, expected goals, most likely score (first
    maximum in row-major order)."""
    hg, ag, p = F.col("hg"), F.col("ag"), F.col("p")
    return matrix.groupBy("match_id").agg(
        F.sum(F.when(hg > ag, p).otherwise(0.0)).alias("prob_home_win"),
        F.sum(F.when(hg == ag, p).otherwise(0.0)).alias("prob_draw"),
        F.sum(F.when(hg < ag, p).otherwise(0.0)).alias("prob_away_win"),
        F.sum(hg * p).alias("expected_home_goals"), F.sum(ag * p).alias("expected_away_goals"),
        F.max_by(F.struct(hg.alias("h"), ag.alias("a")),
                 F.struct(p, (-hg).alias("nh"), (-ag).alias("na"))).alias("ml"),
    ).select("match_id", "prob_home_win", "prob_draw", "prob_away_win", "expected_home_goals",
             "expected_away_goals", F.col("ml.h").alias("most_likely_home_goals"),
             F.col("ml.a").alias("most_likely_away_goals"))


# ------------------------------------------------------------ L12 title odds
def knockout_title_odds(first_round: DataFrame, three_way) -> DataFrame:
    """Exact probability of winning a single-elimination bracket.

    ``first_round``: (slot, team, rating) with slots 0..2^k-1 in bracket order.
    ``three_way(matchups)`` adds p_win / p_draw for rows (slot, team, rating,
    opp, opp_rating); a draw is a coin flip. In round r a team meets the teams
    that can come out of the sibling block of size 2^r, so
    P(reach r+1) = P(reach r) * sum_opp P(opp reaches r) * (p_win + p_draw / 2).
    One join on the block key + one aggregation per round (log2 n rounds); the
    rows are the bracket's possible pairings only.
    """
    n, slots, last = first_round.agg(F.count(F.lit(1)), F.countDistinct("slot"), F.max("slot")).first()
    if n & (n - 1) or n != slots or (n and last != n - 1):
        raise ValueError(f"a bracket needs 2^k teams in slots 0 .. 2^k - 1, not {n}")
    rounds = max(n.bit_length() - 1, 0)
    cur = first_round.select("slot", "team", "rating", F.lit(1.0).alias("p"))
    for r in range(rounds):
        size = 1 << r
        me = cur.select("slot", "team", "rating", "p",
                        (F.floor(F.col("slot") / size).bitwiseXOR(F.lit(1))).alias("block"))
        opp = cur.select(F.floor(F.col("slot") / size).alias("block"), F.col("team").alias("opp"),
                         F.col("rating").alias("opp_rating"), F.col("p").alias("po"))
        matchups = me.join(opp, "block").drop("block")
        rated = three_way(matchups)
        cur = rated.groupBy("slot", "team", "rating").agg(
            (F.first("p") * F.sum(F.col("po") * (F.col("p_win") + F.col("p_draw") / 2.0))).alias("p"))
    return cur.select("team", F.col("p").alias("title_probability"))
