"""Dixon-Coles fits before every cutoff, from block prefixes and deltas.

Cutoffs are positions in the match order. They are cut into blocks; a block
gets the totals of every pair of teams over all earlier blocks, and its own
matches. It walks through its cutoffs, adds each match to its pair, and fits
again from the last solution. With a block of at least a quarter of the pairs the
prefix rows are at most four times the matches, so rows grow with the matches and not
with pairs x cutoffs. Blocks are independent and spread over tasks; a
block's memory is its pairs and its matches.

The solver takes projected Newton steps. Each is solved by conjugate gradients
from products with the second derivatives, pair by pair, so there is never a
matrix over the parameters. (Leagues that never meet leave directions that only
the ridge holds; there a quasi-Newton method with a few kept steps stalls.)
Fits are returned for the teams that play at a cutoff, which is what a
prediction asks for, or for every team that has played before it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ratings import FIT_SCHEMA, MIN_FIT_MATCHES, RHO_BOUND, RIDGE, cutoff_order

MEMORY = 12
GTOL = 1e-7
MAX_ITER = 2_000
LEAST_BLOCK = 128
MOST_TASKS = 1024
STATS = ("n", "shg", "sag", "n00", "n01", "n10", "n11")


def objective(theta: np.ndarray, home: np.ndarray, away: np.ndarray, stats: np.ndarray, n_teams: int) -> tuple[float, np.ndarray]:
    """Negative log likelihood with ridge, and its gradient. Rows of ``stats``
    are pair totals in the order of :data:`STATS`; sums by team are bin counts."""
    n, shg, sag, n00, n01, n10, n11 = stats
    rho, att, dfn = theta[2], theta[3:3 + n_teams], theta[3 + n_teams:]
    log_home = theta[0] + theta[1] + att[home] - dfn[away]
    log_away = theta[0] + att[away] - dfn[home]
    x, y = np.exp(log_home), np.exp(log_away)
    # low scores: n00 (1 - xy rho), n01 (1 + x rho), n10 (1 + y rho), n11 (1 - rho), each at least a tiny number
    slopes = (-x * y, x, y, np.full_like(x, -1.0))
    value = float(np.sum(n * (x + y) - shg * log_home - sag * log_away) + RIDGE * (att @ att + dfn @ dfn))
    d_rho, d_home, d_away = 0.0, n * x - shg, n * y - sag
    for count, slope, in_home, in_away in zip((n00, n01, n10, n11), slopes, (1, 1, 0, 0), (1, 0, 1, 0)):
        term = 1.0 + rho * slope
        value -= float(count @ np.log(np.maximum(term, 1e-9)))
        part = np.where(term > 1e-9, count / np.maximum(term, 1e-9), 0.0) * slope
        d_rho -= part.sum()
        d_home = d_home - in_home * rho * part
        d_away = d_away - in_away * rho * part

    def by_team(own: np.ndarray, other: np.ndarray) -> np.ndarray:
        return np.bincount(home, own, n_teams) + np.bincount(away, other, n_teams)

    gradient = np.concatenate([[d_home.sum() + d_away.sum(), d_home.sum(), d_rho],
                               by_team(d_home, d_away) + 2 * RIDGE * att, by_team(-d_away, -d_home) + 2 * RIDGE * dfn])
    return value, gradient


def curvature(theta: np.ndarray, home: np.ndarray, away: np.ndarray, stats: np.ndarray, n_teams: int):
    """Second derivatives of :func:`objective`: their product with a vector, and their diagonal."""
    n, _, _, n00, n01, n10, n11 = stats
    rho, att, dfn = theta[2], theta[3:3 + n_teams], theta[3 + n_teams:]
    x, y = np.exp(theta[0] + theta[1] + att[home] - dfn[away]), np.exp(theta[0] + att[away] - dfn[home])
    hh, aa, ha, hr, ar, rr = n * x, n * y, np.zeros_like(x), np.zeros_like(x), np.zeros_like(x), 0.0
    for count, slope, in_home, in_away in zip((n00, n01, n10, n11), (-x * y, x, y, np.full_like(x, -1.0)), (1, 1, 0, 0), (1, 0, 1, 0)):
        term = 1.0 + rho * slope
        # log(1 + u), u = rho * slope: by log rate u / (1 + u)^2, by log rate and rho slope / (1 + u)^2
        part = np.where(term > 1e-9, count / np.maximum(term, 1e-9) ** 2, 0.0) * slope
        rr += float(part @ slope)
        hh, aa, ha = hh - in_home * rho * part, aa - in_away * rho * part, ha - in_home * in_away * rho * part
        hr, ar = hr - in_home * part, ar - in_away * part
    both = np.concatenate([home, away])

    def times(v: np.ndarray) -> np.ndarray:
        va, vd = v[3:3 + n_teams], v[3 + n_teams:]
        vh, vw = v[0] + v[1] + va[home] - vd[away], v[0] + va[away] - vd[home]
        oh, ow = hh * vh + ha * vw + hr * v[2], ha * vh + aa * vw + ar * v[2]
        return np.concatenate([[oh.sum() + ow.sum(), oh.sum(), hr @ vh + ar @ vw + rr * v[2]],
                               np.bincount(both, np.concatenate([oh, ow]), n_teams) + 2 * RIDGE * va,
                               np.bincount(both, np.concatenate([-ow, -oh]), n_teams) + 2 * RIDGE * vd])

    diagonal = np.concatenate([[(hh + 2 * ha + aa).sum(), hh.sum(), rr],
                               np.bincount(both, np.concatenate([hh, aa]), n_teams) + 2 * RIDGE,
                               np.bincount(both, np.concatenate([aa, hh]), n_teams) + 2 * RIDGE])
    return times, diagonal


def newton_step(g: np.ndarray, times, diagonal: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Conjugate gradients for the step on the free parameters; a direction of
    no positive curvature ends them with the step found so far."""
    scale = np.where(free, 1.0 / np.maximum(np.abs(diagonal), 1e-6), 0.0)
    r = np.where(free, -g, 0.0)
    z = scale * r
    step, d, rz = np.zeros_like(g), z, r @ z
    goal = rz * min(1e-2, math.sqrt(rz)) ** 2
    for i in range(4 * len(g)):
        hd = np.where(free, times(d), 0.0)
        dhd = d @ hd
        if dhd <= 1e-14 * (d @ d):
            return step if i else z
        alpha = rz / dhd
        step, r = step + alpha * d, r - alpha * hd
        z = scale * r
        new = r @ z
        if new <= goal:
            break
        d, rz = z + (new / rz) * d, new
    return step


def minimise(f, theta: np.ndarray, low: np.ndarray, high: np.ndarray, gtol: float = GTOL, max_iter: int = MAX_ITER,
             second=None) -> np.ndarray:
    """Least point of ``f`` (value, gradient) between the bounds; raises if it is not reached.
    With ``second`` (see :func:`curvature`) the steps are Newton steps, without it
    those of a limited-memory quasi-Newton method that keeps :data:`MEMORY` steps."""
    value, g = f(theta)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    plain = False
    for _ in range(max_iter):
        free = ~(((theta <= low) & (g > 0)) | ((theta >= high) & (g < 0)))
        size = np.max(np.abs(g[free]), initial=0.0)
        if size < gtol:
            return theta
        newton = second is not None and not plain
        d = newton_step(g, *second(theta), free) if newton else -_inverse_times(np.where(free, g, 0.0), steps, free)
        if g @ d >= 0:
            steps, d, newton = [], np.where(free, -g, 0.0), False
        t = 1.0 if steps or newton else min(1.0, 1.0 / max(size, 1e-12))
        while True:
            new = np.clip(theta + t * d, low, high)
            v, h = f(new)
            if v <= value + 1e-4 * (g @ (new - theta)):
                break
            # too near the least value to tell values apart: the gradient decides
            if abs(v - value) <= 1e-12 * max(1.0, abs(value)) and np.max(np.abs(h[free])) < size:
                break
            t *= 0.5
            if t < 1e-14:
                break
        if t < 1e-14:
            if size < 1e-5:
                return theta
            if not steps and not newton:
                raise RuntimeError(f"no descent step found (gradient {size:.3g})")
            steps, plain = [], True
            continue
        s, y, plain = new - theta, h - g, False
        if second is None and s @ y > 1e-14:
            steps = [*steps[-MEMORY + 1:], (s, y)]
        theta, value, g = new, v, h
    raise RuntimeError(f"the fit did not converge in {max_iter} iterations")


def _inverse_times(g: np.ndarray, steps: list, free: np.ndarray) -> np.ndarray:
    """The two-loop recursion over the kept steps, on the free parameters."""
    q, kept = g.copy(), []
    own = [(np.where(free, s, 0.0), np.where(free, y, 0.0)) for s, y in steps]
    for s, y in reversed(own):
        sy = s @ y
        if sy <= 1e-14:
            continue
        a = (s @ q) / sy
        q -= a * y
        kept.append((a, s, y, sy))
    if kept:
        _, _, y, sy = kept[0]
        q *= sy / (y @ y)
    for a, s, y, sy in reversed(kept):
        q += (a - (y @ q) / sy) * s
    return np.where(free, q, 0.0)


def walk(before: pd.DataFrame, matches: pd.DataFrame, every: bool = False) -> pd.DataFrame:
    """Fits of one block: ``before`` holds pair totals, ``matches`` the block's
    own matches with their position (without teams: a cutoff only). Rows for the
    teams that play at a cutoff, or for ``every`` team with a match before it."""
    played = matches.dropna(subset=["home_team_id", "away_team_id"])
    teams = sorted(set(before["home_team_id"]) | set(before["away_team_id"]) | set(played["home_team_id"]) | set(played["away_team_id"]))
    number = {t: i for i, t in enumerate(teams)}
    n_teams = len(teams)
    pairs: dict[tuple[int, int], int] = {}
    for frame in (before, played):
        for h, a in zip(frame["home_team_id"], frame["away_team_id"]):
            pairs.setdefault((number[h], number[a]), len(pairs))
    home = np.array([h for h, _ in pairs], np.int64)
    away = np.array([a for _, a in pairs], np.int64)
    stats = np.zeros((len(STATS), len(pairs)))
    if len(before):
        at = [pairs[number[h], number[a]] for h, a in zip(before["home_team_id"], before["away_team_id"])]
        stats[:, at] = before[list(STATS)].to_numpy(float).T
    low = np.concatenate([[math.log(0.2), -1.0, -RHO_BOUND], np.full(2 * n_teams, -3.0)])
    high = np.concatenate([[math.log(6.0), 1.0, RHO_BOUND], np.full(2 * n_teams, 3.0)])
    theta, out = None, []
    fitted_on = -1.0
    ordered = matches.sort_values("position", kind="stable")
    for cutoff, rows in ordered.groupby("position"):
        n = stats[0].sum()
        seen = np.zeros(n_teams, bool)
        seen[home[stats[0] > 0]] = seen[away[stats[0] > 0]] = True
        if n >= MIN_FIT_MATCHES and seen.sum() >= 2:
            if theta is None:
                goals = (stats[1].sum() + stats[2].sum()) / (2.0 * n)
                theta = np.concatenate([[math.log(max(goals, 0.2)), 0.2, 0.0], np.zeros(2 * n_teams)])
            if n != fitted_on:
                theta, fitted_on = minimise(
                    lambda x: objective(x, home, away, stats, n_teams), theta, low, high,
                    second=lambda x: curvature(x, home, away, stats, n_teams)), n
            at = np.flatnonzero(seen) if every else sorted({number[t] for c in ("home_team_id", "away_team_id") for t in rows[c]})
            for i in at:
                # a team without a match before the cutoff has no parameters, the shared ones stand
                out.append((int(cutoff), teams[i], *((theta[3 + i], theta[3 + n_teams + i]) if seen[i] else (0.0, 0.0)), *theta[:3], int(n)))
        for h, a, x, y in zip(rows["home_team_id"], rows["away_team_id"], rows["home_score"], rows["away_score"]):
            if not (pd.isna(x) or pd.isna(y)):
                low_score = [x == 0 and y == 0, x == 0 and y == 1, x == 1 and y == 0, x == 1 and y == 1]
                stats[:, pairs[number[h], number[a]]] += [1, x, y, *low_score]
    return pd.DataFrame(out, columns=["cutoff", "team_id", "attack", "defense", "intercept", "home_advantage", "rho", "n_matches"])


def fits_in_blocks(matches: DataFrame, refit: str = "match", block: int | None = None, every: bool = False) -> DataFrame:
    """One fit a cutoff (see :func:`ratings.cutoff_order`), as rows of
    ``FIT_SCHEMA`` for the teams that play there, or for ``every`` team that
    has a match before it (then a match without id is a cutoff too)."""
    m = cutoff_order(matches, refit).join(matches, "match_id", "left" if every else "inner").select("position", "home_team_id", "away_team_id", "home_score", "away_score")
    if block is None:
        block = max(LEAST_BLOCK, m.select("home_team_id", "away_team_id").distinct().count() // 4)
    m = m.withColumn("block", (F.col("position") / block).cast("long"))
    last = m.agg(F.max("block")).first()[0]
    if last is None:
        return matches.sparkSession.createDataFrame([], FIT_SCHEMA)
    x, y = F.col("home_score"), F.col("away_score")
    own = m.where(x.isNotNull() & y.isNotNull()).groupBy("home_team_id", "away_team_id", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("shg"), F.sum(y).alias("sag"),
        *(F.count_if((x == i) & (y == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)))
    w = Window.partitionBy("home_team_id", "away_team_id").orderBy("block")
    total = own.select("home_team_id", "away_team_id", "block", F.lead("block").over(w).alias("after"),
                       *(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(c) for c in STATS))
    # a running total holds from the next block up to the block of the pair's next match
    before = total.withColumn("of", F.explode(F.when(F.col("block") < last, F.sequence(
        F.col("block") + 1, F.least(F.coalesce("after", F.lit(last)), F.lit(last)))))).select(
        "of", *(F.col(c).alias(c) for c in ("home_team_id", "away_team_id", *STATS)))
    # the rows are few but each costs a fit: tasks by blocks, not by bytes
    tasks = min(last + 1, MOST_TASKS)
    return before.repartition(tasks, "of").groupBy("of").cogroup(m.repartition(tasks, "block").groupBy("block")).applyInPandas(
        lambda totals, own: walk(totals, own, every), FIT_SCHEMA)
