"""Ratings, forecasts and the backtest as registered queries (2.L, 2.M).

Model-free parts (Elo, sufficient statistics, scorelines from the Elo prior)
carry SQL twins; the Dixon-Coles fits and everything downstream of them are
checked on rows and by the invariants in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dixon_coles as DC
from ..operators import ratings as R
from ..sources.projections import MatchData
from .catalog import register
from .valuation import _rounded

PROB_COLS = ("prob_home_win", "prob_draw", "prob_away_win", "expected_home_goals", "expected_away_goals")


def elo_walk(md: MatchData) -> DataFrame:
    return md.memo("elo_walk", lambda: R.elo_walk_forward(md.matches).checkpoint(eager=True))


def elo_probs(md: MatchData) -> DataFrame:
    """Predictions from the Elo prior alone (the no-fit branch of L7)."""
    return md.memo("elo_probs", lambda: R.match_probabilities(R.scoreline_matrix(R.dc_rates(md.matches, elo_walk(md), None))))


def dc_fits(md: MatchData) -> DataFrame:
    return md.memo("dc_fits", lambda: DC.fits_in_blocks(md.matches, every=True).checkpoint(eager=True))


def block_fits(md: MatchData, refit: str = "match") -> DataFrame:
    """Fits for the teams of each cutoff, rows linear in the matches."""
    return md.memo(f"block_fits_{refit}", lambda: DC.fits_in_blocks(md.matches, refit).checkpoint(eager=True))


def predictions(md: MatchData) -> DataFrame:
    """match_predictions: Elo prior blended with the walk-forward fits."""
    def build():
        rates = R.dc_rates(md.matches, elo_walk(md), block_fits(md))
        probs = R.match_probabilities(R.scoreline_matrix(rates))
        m = md.matches.select("match_id", "home_team_id", "away_team_id", "home_team_name", "away_team_name",
                              "match_date", "stage", "home_score", "away_score")
        return (m.join(probs, "match_id").join(elo_walk(md).select("match_id", "home_elo_pre", "away_elo_pre"), "match_id")
                .join(rates.select("match_id", "training_matches"), "match_id")
                .select("match_id", "home_team_id", "away_team_id", "home_team_name", "away_team_name", "match_date",
                        "stage", "home_score", "away_score",
                        *[F.round(c, 6).alias(c) for c in ("prob_home_win", "prob_draw", "prob_away_win")],
                        F.round("expected_home_goals", 4).alias("expected_home_goals"),
                        F.round("expected_away_goals", 4).alias("expected_away_goals"),
                        "most_likely_home_goals", "most_likely_away_goals",
                        F.round("home_elo_pre", 2).alias("home_elo_pre"), F.round("away_elo_pre", 2).alias("away_elo_pre"),
                        "training_matches", F.lit(R.MODEL_VERSION).alias("model_version"))
                .checkpoint(eager=True))
    return md.memo("predictions", build)


# ------------------------------------------------------------------ L1 / L2
@register("elo_expected_score", """
SELECT p.match_id, round(1.0 / (1.0 + pow(10.0, -((p.home_elo_pre + 55.0) - p.away_elo_pre) / 400.0)), 6) AS home_expected
FROM v_elo_pre p
""", ("v_elo_pre",))
def elo_expected_score(md: MatchData) -> DataFrame:
    w = elo_walk(md)
    return w.select("match_id", F.round(R.expected_score(F.col("home_elo_pre") + R.HOME_ADVANTAGE, F.col("away_elo_pre")), 6)
                    .alias("home_expected"))


@register("elo_result_and_multiplier", """
SELECT match_id, CASE WHEN home_score > away_score THEN 1.0 WHEN home_score < away_score THEN 0.0 ELSE 0.5 END::double AS home_result,
       CASE WHEN abs(home_score - away_score) <= 1 THEN 1.0 WHEN abs(home_score - away_score) = 2 THEN 1.5
            ELSE (11.0 + abs(home_score - away_score)) / 8.0 END::double AS multiplier
FROM v_matches WHERE home_score IS NOT NULL AND away_score IS NOT NULL
""", ("v_matches",))
def elo_result_and_multiplier(md: MatchData) -> DataFrame:
    m = md.matches.where(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    home, _ = R.result_score(F.col("home_score"), F.col("away_score"))
    return m.select("match_id", home.alias("home_result"),
                    R.margin_multiplier(F.col("home_score"), F.col("away_score")).alias("multiplier"))


# ------------------------------------------------------------------ L3 / L4
@register("elo_walk_forward", """
SELECT match_id, round(home_elo_pre, 2) AS home_elo_pre, round(away_elo_pre, 2) AS away_elo_pre FROM v_elo_pre
""", ("v_elo_pre",))
def elo_walk_forward(md: MatchData) -> DataFrame:
    return elo_walk(md).select("match_id", F.round("home_elo_pre", 2).alias("home_elo_pre"),
                               F.round("away_elo_pre", 2).alias("away_elo_pre"))


@register("final_ratings", "SELECT team_id, elo_rating, matches_played FROM v_elo_final", ("v_elo_final",))
def final_ratings(md: MatchData) -> DataFrame:
    return R.final_ratings(md.matches, elo_walk(md))


@register("team_ratings")
def team_ratings(md: MatchData) -> DataFrame:
    """team_ratings: final Elo + exp(strength) of the fit on all matches."""
    full = R.dc_pair_stats(md.matches).withColumn("cutoff", F.lit(-1).cast("long"))
    fit = R.dc_fits(full).select("team_id", F.round(F.exp("attack"), 4).alias("attack_strength"),
                                 F.round(F.exp("defense"), 4).alias("defense_strength"))
    return R.final_ratings(md.matches, elo_walk(md)).join(fit, "team_id", "left").withColumn(
        "model_version", F.lit(R.MODEL_VERSION))


# ------------------------------------------------------------------ L5 - L7
@register("dc_sufficient_stats", """
SELECT home_team_id, away_team_id, count(*) AS n, cast(sum(home_score) AS bigint) AS shg, cast(sum(away_score) AS bigint) AS sag,
       count(*) FILTER (WHERE home_score = 0 AND away_score = 0) AS n00,
       count(*) FILTER (WHERE home_score = 0 AND away_score = 1) AS n01,
       count(*) FILTER (WHERE home_score = 1 AND away_score = 0) AS n10,
       count(*) FILTER (WHERE home_score = 1 AND away_score = 1) AS n11
FROM v_matches WHERE home_score IS NOT NULL AND away_score IS NOT NULL GROUP BY 1, 2
""", ("v_matches",))
def dc_sufficient_stats(md: MatchData) -> DataFrame:
    return R.dc_pair_stats(md.matches)


@register("dc_cutoff_stats", """
SELECT p.r - 1 AS cutoff, m.home_team_id, m.away_team_id, count(*) AS n, cast(sum(m.home_score) AS bigint) AS shg
FROM (SELECT match_id, row_number() OVER (ORDER BY match_date, match_id) AS r FROM v_matches) p
JOIN (SELECT *, row_number() OVER (ORDER BY match_date, match_id) AS r FROM v_matches) m ON m.r < p.r
WHERE m.home_score IS NOT NULL AND m.away_score IS NOT NULL
GROUP BY 1, 2, 3
""", ("v_matches",))
def dc_cutoff_stats(md: MatchData) -> DataFrame:
    return R.dc_cutoff_stats(md.matches).select("cutoff", "home_team_id", "away_team_id", "n", "shg")


@register("dc_fit")
def dc_fit(md: MatchData) -> DataFrame:
    return _rounded(dc_fits(md), "attack", "defense", "intercept", "home_advantage", "rho")


@register("dc_fit_by_date")
def dc_fit_by_date(md: MatchData) -> DataFrame:
    """L6 with ``refit='date'``: one fit per match date (the scale mode)."""
    rates = R.dc_rates(md.matches, elo_walk(md), block_fits(md, "date"), refit="date")
    return _rounded(rates, "lambda_home", "lambda_away", "rho")


@register("dc_predict")
def dc_predict(md: MatchData) -> DataFrame:
    return _rounded(R.dc_rates(md.matches, elo_walk(md), block_fits(md)), "lambda_home", "lambda_away", "rho")


@register("dc_fit_blocks")
def dc_fit_blocks(md: MatchData) -> DataFrame:
    """L6 from block prefixes: the fits of :func:`dc_fit` for the teams that play at each cutoff."""
    return _rounded(block_fits(md), "attack", "defense", "intercept", "home_advantage", "rho")


# ------------------------------------------------------------------ L8 / L9
@register("scoreline_matrix", "SELECT match_id, hg, ag, round(p, 6) AS p FROM v_elo_matrix", ("v_elo_matrix",))
def scoreline_matrix(md: MatchData) -> DataFrame:
    return _rounded(R.scoreline_matrix(R.dc_rates(md.matches, elo_walk(md), None)), "p")


PROBS_SQL = """SELECT match_id, round(prob_home_win, 6) AS prob_home_win, round(prob_draw, 6) AS prob_draw,
       round(prob_away_win, 6) AS prob_away_win, round(expected_home_goals, 6) AS expected_home_goals,
       round(expected_away_goals, 6) AS expected_away_goals, most_likely_home_goals, most_likely_away_goals
FROM v_elo_probs"""


@register("match_probabilities", PROBS_SQL, ("v_elo_probs",))
def match_probabilities(md: MatchData) -> DataFrame:
    return _rounded(elo_probs(md), *PROB_COLS)


@register("three_way_from_rates", """
SELECT match_id, round(prob_home_win, 6) AS prob_home_win, round(prob_draw, 6) AS prob_draw,
       round(prob_away_win, 6) AS prob_away_win FROM v_elo_probs
""", ("v_elo_probs",))
def three_way_from_rates(md: MatchData) -> DataFrame:
    return _rounded(elo_probs(md).select("match_id", "prob_home_win", "prob_draw", "prob_away_win"),
                    "prob_home_win", "prob_draw", "prob_away_win")


# --------------------------------------------------------------- L10 / L11
@register("predictions_table")
def predictions_table(md: MatchData) -> DataFrame:
    return predictions(md)


@register("prediction_checks", """
SELECT count(*) FILTER (WHERE prob_home_win < 0 OR prob_home_win > 1 OR prob_draw < 0 OR prob_draw > 1
                        OR prob_away_win < 0 OR prob_away_win > 1) AS violations, count(*) AS checked
FROM v_elo_probs
""", ("v_elo_probs",))
def prediction_checks(md: MatchData) -> DataFrame:
    p = elo_probs(md)
    bad = F.lit(False)
    for c in ("prob_home_win", "prob_draw", "prob_away_win"):
        bad = bad | (F.col(c) < 0) | (F.col(c) > 1)
    return p.agg(F.count_if(bad).alias("violations"), F.count(F.lit(1)).alias("checked"))


# ------------------------------------------------------------------ L12
@register("knockout_title_odds")
def knockout_title_odds(md: MatchData) -> DataFrame:
    """A 4-team bracket of the golden competition's region, seeded by final Elo
    (1 v 4, 2 v 3); pair probabilities from the Elo prior on neutral ground."""
    from .golden import bound_competition
    comp = bound_competition(md)
    region_teams = (md.matches.join(F.broadcast(comp), "competition_id").select(F.col("home_team_id").alias("team_id"))
                    .unionAll(md.matches.join(F.broadcast(comp), "competition_id").select(F.col("away_team_id").alias("team_id")))
                    .distinct())
    fr = R.final_ratings(md.matches, elo_walk(md)).join(region_teams, "team_id")
    seeded = fr.orderBy(F.desc("elo_rating"), "team_id").limit(4)
    from pyspark.sql import Window
    ranked = seeded.withColumn("seed", F.row_number().over(Window.orderBy(F.desc("elo_rating"), "team_id")) - 1)
    slot = F.when(F.col("seed") == 0, 0).when(F.col("seed") == 3, 1).when(F.col("seed") == 1, 2).otherwise(3)
    first_round = ranked.select(slot.alias("slot"), F.col("team_id").alias("team"), F.col("elo_rating").alias("rating"))
    return _rounded(R.knockout_title_odds(first_round, neutral_three_way), "title_probability")


def neutral_three_way(matchups: DataFrame) -> DataFrame:
    """P(win), P(draw) of ``team`` v ``opp`` on neutral ground from the Elo prior."""
    import math
    sup = R.ELO_TO_LOG_GOAL * (F.col("rating") - F.col("opp_rating"))
    rates = matchups.select("slot", "opp", F.concat_ws("|", F.col("slot").cast("string"), "opp").alias("match_id"),
                            F.exp(math.log(R.DEFAULT_BASE_GOALS) + 0.5 * sup).alias("lambda_home"),
                            F.exp(math.log(R.DEFAULT_BASE_GOALS) - 0.5 * sup).alias("lambda_away"), F.lit(0.0).alias("rho"))
    probs = R.match_probabilities(R.scoreline_matrix(rates))
    return matchups.join(rates.select("slot", "opp", "match_id"), ["slot", "opp"]).join(probs, "match_id").select(
        *matchups.columns, F.col("prob_home_win").alias("p_win"), F.col("prob_draw").alias("p_draw"))


# ---------------------------------------------------------------- 2.M backtest
def backtest_scores(predicted: DataFrame) -> DataFrame:
    """M1: actual vs predicted class; arg-max ties go home, draw, away."""
    p = predicted.where(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    h, d, a = F.col("prob_home_win"), F.col("prob_draw"), F.col("prob_away_win")
    predicted = F.when((h >= d) & (h >= a), "home_win").when(d >= a, "draw").otherwise("away_win")
    actual = (F.when(F.col("home_score") > F.col("away_score"), "home_win")
              .when(F.col("home_score") < F.col("away_score"), "away_win").otherwise("draw"))
    p_actual = F.when(actual == "home_win", h).when(actual == "draw", d).otherwise(a)
    return p.select("match_id", actual.alias("actual"), predicted.alias("predicted"), "training_matches",
                    h.alias("h"), d.alias("d"), a.alias("a"), p_actual.alias("p_actual"))


@register("backtest_scores")
def backtest_scores_query(md: MatchData) -> DataFrame:
    return backtest_scores(predictions(md)).select("match_id", "actual", "predicted", "training_matches")


def elo_predictions(md: MatchData) -> DataFrame:
    """Elo-only predictions of every match, whose SQL is known. A third of them
    counts as not fitted (no training match), by a rule on the id."""
    m = md.matches.select("match_id", "home_score", "away_score", (F.col("match_id") % 3).alias("training_matches"))
    return elo_probs(md).join(m, "match_id")


ELO_SCORED_SQL = """
SELECT match_id, training, hp, dp, ap, actual, CASE actual WHEN 'home_win' THEN hp WHEN 'draw' THEN dp ELSE ap END AS p_actual,
       CASE WHEN hp = greatest(hp, dp, ap) THEN 'home_win' WHEN dp >= ap THEN 'draw' ELSE 'away_win' END AS predicted
FROM (SELECT e.match_id, m.match_id % 3 AS training, e.prob_home_win AS hp, e.prob_draw AS dp, e.prob_away_win AS ap,
             CASE sign(m.home_score - m.away_score) WHEN 1 THEN 'home_win' WHEN 0 THEN 'draw' ELSE 'away_win' END AS actual
      FROM v_elo_probs e JOIN v_matches m ON m.match_id = e.match_id
      WHERE m.home_score IS NOT NULL AND m.away_score IS NOT NULL)"""


@register("backtest_scores_elo", "SELECT match_id, actual, predicted, training AS training_matches FROM scored",
          ("v_elo_probs", "v_matches"), {"scored": ELO_SCORED_SQL})
def backtest_scores_elo(md: MatchData) -> DataFrame:
    return backtest_scores(elo_predictions(md)).select("match_id", "actual", "predicted", "training_matches")


@register("backtest_report_elo", """
SELECT count(*) AS matches, round(avg(hit), 4) AS model_accuracy, round(avg(is_h), 4) AS home_pick_baseline_accuracy,
       arg_max(actual, weight) AS majority_class, round(max(weight_n) / count(*), 4) AS majority_class_baseline_accuracy,
       round(coalesce(avg(hit) FILTER (WHERE training > 0), 0), 4) AS model_accuracy_on_fitted_matches,
       count(*) FILTER (WHERE training > 0) AS fitted_matches, round(avg(p_actual), 4) AS mean_probability_on_actual,
       round(avg((hp - is_h) ** 2 + (dp - is_d) ** 2 + (ap - is_a) ** 2), 4) AS brier_score,
       round(avg(-ln(greatest(p_actual, 1e-12))), 4) AS log_loss,
       cast(sum(is_h) AS bigint) AS home_wins, cast(sum(is_d) AS bigint) AS draws, cast(sum(is_a) AS bigint) AS away_wins
FROM (SELECT s.*, cast(predicted = actual AS int) AS hit, cast(actual = 'home_win' AS int) AS is_h, cast(actual = 'draw' AS int) AS is_d,
             cast(actual = 'away_win' AS int) AS is_a, count(*) OVER (PARTITION BY actual) AS weight_n,
             count(*) OVER (PARTITION BY actual) * 4 + CASE actual WHEN 'home_win' THEN 3 WHEN 'draw' THEN 2 ELSE 1 END AS weight
      FROM scored s)
""", ("v_elo_probs", "v_matches"), {"scored": ELO_SCORED_SQL})
def backtest_report_elo(md: MatchData) -> DataFrame:
    return report_of(backtest_scores(elo_predictions(md)))


@register("backtest_report")
def backtest_report(md: MatchData) -> DataFrame:
    return report_of(backtest_scores(predictions(md)))


def report_of(s: DataFrame) -> DataFrame:
    """M2-M5 in one aggregation, with the outcome counts."""
    is_h, is_d, is_a = [(F.col("actual") == k).cast("double") for k in ("home_win", "draw", "away_win")]
    brier = (F.col("h") - is_h) ** 2 + (F.col("d") - is_d) ** 2 + (F.col("a") - is_a) ** 2
    fitted = F.col("training_matches") > 0
    agg = s.agg(
        F.count(F.lit(1)).alias("matches"),
        F.avg((F.col("predicted") == F.col("actual")).cast("double")).alias("acc"),
        F.sum(is_h).alias("nh"), F.sum(is_d).alias("nd"), F.sum(is_a).alias("na"),
        F.avg(F.when(fitted, (F.col("predicted") == F.col("actual")).cast("double"))).alias("acc_fit"),
        F.count_if(fitted).alias("fitted_matches"),
        F.avg("p_actual").alias("mpa"), F.avg(brier).alias("brier"),
        F.avg(-F.log(F.greatest(F.col("p_actual"), F.lit(1e-12)))).alias("ll"))
    nh, nd, na = F.col("nh"), F.col("nd"), F.col("na")
    # majority class: most frequent actual outcome, ties in home, draw, away order
    majority = F.when((nh >= nd) & (nh >= na), "home_win").when(nd >= na, "draw").otherwise("away_win")
    return agg.select(
        "matches", F.round("acc", 4).alias("model_accuracy"),
        F.round(nh / F.col("matches"), 4).alias("home_pick_baseline_accuracy"),
        majority.alias("majority_class"),
        F.round(F.greatest(nh, nd, na) / F.col("matches"), 4).alias("majority_class_baseline_accuracy"),
        F.round(F.coalesce("acc_fit", F.lit(0.0)), 4).alias("model_accuracy_on_fitted_matches"),
        "fitted_matches", F.round("mpa", 4).alias("mean_probability_on_actual"),
        F.round("brier", 4).alias("brier_score"), F.round("ll", 4).alias("log_loss"),
        nh.cast("long").alias("home_wins"), nd.cast("long").alias("draws"), na.cast("long").alias("away_wins"))


@register("brier_score")
def brier_score(md: MatchData) -> DataFrame:
    return backtest_report(md).select("brier_score")


@register("log_loss")
def log_loss(md: MatchData) -> DataFrame:
    return backtest_report(md).select("log_loss")


@register("mean_prob_on_actual")
def mean_prob_on_actual(md: MatchData) -> DataFrame:
    return backtest_report(md).select("mean_probability_on_actual")


# ------------------------------------------- golden prediction questions
def _final_match(md: MatchData) -> DataFrame:
    """The stand-in 'final': the last match of the golden competition."""
    from .golden import wc_matches
    return wc_matches(md).orderBy(F.desc("match_date"), F.desc("match_id")).limit(1).select("match_id")


@register("predictions_051")
def predictions_051(md: MatchData) -> DataFrame:
    p = predictions(md).join(F.broadcast(_final_match(md)), "match_id")
    return p.select(F.round(F.col("prob_away_win") * 100, 1).alias("france_win_percentage"))


@register("predictions_052", """
SELECT t.name AS team_name, r.elo_rating FROM v_elo_final r JOIN v_teams t ON t.team_id = r.team_id
ORDER BY r.elo_rating DESC, t.name LIMIT 1
""", ("v_elo_final", "v_teams"))
def predictions_052(md: MatchData) -> DataFrame:
    r = R.final_ratings(md.matches, elo_walk(md)).join(md.teams.select("team_id", F.col("name").alias("team_name")), "team_id")
    return r.orderBy(F.desc("elo_rating"), "team_name").limit(1).select("team_name", "elo_rating")


@register("predictions_053")
def predictions_053(md: MatchData) -> DataFrame:
    p = predictions(md).join(F.broadcast(_final_match(md)), "match_id")
    return p.select(F.round(F.col("prob_draw") * 100, 1).alias("draw_percentage"))


@register("predictions_054")
def predictions_054(md: MatchData) -> DataFrame:
    return predictions(md).join(F.broadcast(_final_match(md)), "match_id").select("most_likely_home_goals")


@register("predictions_055")
def predictions_055(md: MatchData) -> DataFrame:
    t = team_ratings(md).where(F.col("attack_strength").isNotNull()).join(
        md.teams.select("team_id", F.col("name").alias("team_name")), "team_id")
    return t.orderBy(F.desc("attack_strength"), "team_name").limit(1).select("team_name", "attack_strength")


@register("predictions_056")
def predictions_056(md: MatchData) -> DataFrame:
    p = predictions(md).join(F.broadcast(_final_match(md)), "match_id")
    return p.select(F.col("expected_home_goals").alias("argentina_expected_goals"))
