"""Fits from block prefixes against a cold fit on all matches before each cutoff."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from touchline.operators import dixon_coles as DC
from touchline.operators import ratings as R

SCHEMA = "match_id long, match_date date, home_team_id string, away_team_id string, home_score int, away_score int"


def made(n=90, teams=6, seed=4):
    rng = random.Random(seed)
    strength = {f"t{i}": rng.gauss(0, 0.4) for i in range(teams)}
    rows = []
    for i in range(n):
        h, a = rng.sample(sorted(strength)[: 2 + i // 6] if i < 24 else sorted(strength), 2)
        goals = [np.random.default_rng(seed * 1000 + 2 * i + k).poisson(np.exp(0.2 + strength[x] - strength[y])) for k, (x, y) in enumerate(((h, a), (a, h)))]
        rows.append((i + 1, dt.date(2020, 1, 1) + dt.timedelta(days=i // 3), h, a, *((None, None) if i % 11 == 5 else map(int, goals))))
    return rows


def cold(rows, refit):
    """Every cutoff from the start values, on the matches before it."""
    order = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    days = {d: i for i, d in enumerate(sorted({r[1] for r in rows}))}
    at = {r[0]: order[r[0]] if refit == "match" else days[r[1]] for r in rows}
    out = {}
    for cutoff in sorted(set(at.values())):
        own = [r for r in rows if at[r[0]] < cutoff and r[4] is not None]
        teams = sorted({t for r in own for t in r[2:4]})
        if len(own) < R.MIN_FIT_MATCHES:
            continue
        i = {t: k for k, t in enumerate(teams)}
        h, a = (np.array([i[r[c]] for r in own]) for c in (2, 3))
        x, y = (np.array([r[c] for r in own], float) for c in (4, 5))
        stats = np.array([np.ones_like(x), x, y, *((x == p) & (y == q) for p in (0, 1) for q in (0, 1))], float)
        start = np.concatenate([[np.log(max((x.sum() + y.sum()) / 2 / len(own), 0.2)), 0.2, 0.0], np.zeros(2 * len(teams))])
        low = np.concatenate([[np.log(0.2), -1.0, -R.RHO_BOUND], np.full(2 * len(teams), -3.0)])
        high = np.concatenate([[np.log(6.0), 1.0, R.RHO_BOUND], np.full(2 * len(teams), 3.0)])
        th = DC.minimise(lambda t: DC.objective(t, h, a, stats, len(teams)), start, low, high, gtol=1e-9)
        for r in rows:
            if at[r[0]] == cutoff:
                for t in r[2:4]:
                    own_par = (th[3 + i[t]], th[3 + len(teams) + i[t]]) if t in i else (0.0, 0.0)
                    out[(cutoff, t)] = (*own_par, *th[:3], len(own))
    return out


@pytest.mark.parametrize("refit,block", [("match", 7), ("match", None), ("date", 4)])
def test_blocks_give_the_cold_fit(spark, refit, block):
    rows = made()
    got = DC.fits_in_blocks(spark.createDataFrame(rows, SCHEMA), refit, block).collect()
    want = cold(rows, refit)
    assert len(got) == len(want)
    for r in got:
        assert np.allclose((r.attack, r.defense, r.intercept, r.home_advantage, r.rho, r.n_matches), want[(r.cutoff, r.team_id)], atol=1e-6)


def test_objective_is_that_of_the_full_fit():
    """Same value and gradient as the pairwise likelihood of the one-off fit."""
    rng = np.random.default_rng(2)
    home, away = np.array([0, 1, 2, 3, 0, 2]), np.array([1, 2, 3, 0, 2, 1])
    stats = np.array([rng.integers(4, 9, 6), rng.integers(0, 20, 6), rng.integers(0, 20, 6), *rng.integers(0, 2, (4, 6))], float)
    for _ in range(20):
        theta = np.concatenate([rng.normal(size=2) * 0.3, rng.uniform(-0.3, 0.3, 1), rng.normal(size=8) * 0.5])
        value, g = DC.objective(theta, home, away, stats, 4)
        other, h = R._nll_grad(theta, home, away, *stats, 4)
        assert np.isclose(value, other) and np.allclose(g, h)


def test_solver():
    """Bounds, a valley, and a limit that is too small."""
    def f(t):
        return float(100 * (t[1] - t[0] ** 2) ** 2 + (1 - t[0]) ** 2), np.array([-400 * t[0] * (t[1] - t[0] ** 2) - 2 * (1 - t[0]), 200 * (t[1] - t[0] ** 2)])

    wide = np.full(2, 9.0)
    assert np.allclose(DC.minimise(f, np.array([-1.2, 1.0]), -wide, wide), [1, 1], atol=1e-6)
    assert np.allclose(DC.minimise(f, np.array([-1.2, 1.0]), -wide, np.array([0.5, 9.0])), [0.5, 0.25], atol=1e-6)
    with pytest.raises(RuntimeError):
        DC.minimise(f, np.array([-1.2, 1.0]), -wide, wide, max_iter=2)


def test_an_empty_block():
    none = pd.DataFrame(columns=["home_team_id", "away_team_id", *DC.STATS])
    assert DC.walk(none, pd.DataFrame(columns=["position", "home_team_id", "away_team_id", "home_score", "away_score"])).empty


def test_edges(spark):
    assert DC.fits_in_blocks(spark.createDataFrame([], SCHEMA)).count() == 0
    few = [(i, dt.date(2020, 1, 1), "a", "b", 1, 0) for i in range(5)]
    assert DC.fits_in_blocks(spark.createDataFrame(few, SCHEMA)).count() == 0
    unscored = [(i, dt.date(2020, 1, 1 + i), "a", "b", None, None) for i in range(20)]
    assert DC.fits_in_blocks(spark.createDataFrame(unscored, SCHEMA)).count() == 0


def leagues(n, first=0, sizes=(5, 5, 5, 5, 5)):
    """Matches in leagues that never meet, scores by a rule on the number."""
    rows = []
    for i in range(first, first + n):
        league, k = i % len(sizes), sizes[i % len(sizes)]
        h = (i // len(sizes)) % k
        rows.append((i, f"{league}:{h}", f"{league}:{(h + 1 + i % (k - 1)) % k}", float((i + i * 7 // 3) % 4), float((i * 5 + i // 7) % 3)))
    return pd.DataFrame(rows, columns=["position", "home_team_id", "away_team_id", "home_score", "away_score"])


def test_many_matches_in_leagues_that_never_meet():
    """Directions that only the ridge holds, beside thousands of matches."""
    m = leagues(6000)
    x, y = m["home_score"], m["away_score"]
    m = m.assign(n=1.0, shg=x, sag=y, **{f"n{i}{j}": ((x == i) & (y == j)).astype(float) for i in (0, 1) for j in (0, 1)})
    before = m.groupby(["home_team_id", "away_team_id"])[list(DC.STATS)].sum().reset_index()
    got = DC.walk(before, leagues(40, 6000))
    assert got["cutoff"].nunique() == 40 and (got["n_matches"] == got["cutoff"]).all()


def test_second_derivatives():
    rng = np.random.default_rng(3)
    home, away = np.array([0, 1, 2, 3, 0, 2]), np.array([1, 2, 3, 0, 2, 1])
    stats = np.array([rng.integers(4, 9, 6), rng.integers(0, 20, 6), rng.integers(0, 20, 6), *rng.integers(0, 2, (4, 6))], float)
    for _ in range(10):
        theta = np.concatenate([rng.normal(size=2) * 0.3, rng.uniform(-0.2, 0.2, 1), rng.normal(size=8) * 0.3])
        times, diagonal = DC.curvature(theta, home, away, stats, 4)
        for k, e in enumerate(np.eye(11)):
            up, down = (DC.objective(theta + s * 1e-5 * e, home, away, stats, 4)[1] for s in (1, -1))
            assert np.allclose(times(e), (up - down) / 2e-5, atol=1e-4) and np.isclose(times(e)[k], diagonal[k])


@pytest.mark.parametrize("block", [7, None])
def test_every_team_at_every_cutoff(spark, block):
    """The rows of one cold fit a cutoff for all its teams; a match without id is a cutoff."""
    rows = [*made(60), (None, dt.date(2020, 1, 6), "t0", "t1", 1, 1)]
    m = spark.createDataFrame(rows, SCHEMA)
    got = {(r.cutoff, r.team_id): r[2:] for r in DC.fits_in_blocks(m, block=block, every=True).collect()}
    want = {(r.cutoff, r.team_id): r[2:] for r in R.dc_fits(R.dc_cutoff_stats(m)).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-4) for k in want)
