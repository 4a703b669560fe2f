"""Logistic models: least point and number of passes."""

from __future__ import annotations

import numpy as np

from touchline.operators import models


def _least(x, y):
    """Recipe in dense form: population deviation, C = 1, free intercept."""
    spread = x.std(0)
    z = np.where(spread > 0, (x - x.mean(0)) / np.where(spread > 0, spread, 1.0), 0.0)
    z = np.concatenate([z, np.ones((len(z), 1))], 1)
    penalty = np.ones(z.shape[1])
    penalty[-1] = 0.0
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * b)
    return 1 / (1 + np.exp(-z @ b))


def test_codes_fit_like_dense_one_hot_inputs_in_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 700
    a, c, k, j = rng.normal(50, 20, n), rng.integers(0, 2, n), rng.integers(0, 6, n), rng.integers(-1, 3, n)
    marks = np.concatenate([np.eye(6), np.repeat(np.eye(2), 3, 0)], 1)  # a code marks its value and its half
    y = (rng.random(n) < 1 / (1 + np.exp(-(a - 60) / 15 - (k == 2) + (j == 1)))).astype(int)
    rows = [(i, float(a[i]) if i % 50 else None, int(c[i]), 7, int(k[i]), int(j[i]) if j[i] >= 0 else None, int(y[i]), 1 - int(y[i]), 1)
            for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, c int, same int, k int, j int, y int, z int, one int").repartition(5)
    passes = []
    reduced = models._reduced
    monkeypatch.setattr(models, "_reduced", lambda *args: passes.append(1) or reduced(*args))
    got = models.fit_predict_all(df, ["a", "c", "same"], {"y": "p", "z": "q", "one": "always"}, ["id"], {"k": marks, "j": np.eye(3)})
    found = {r["id"]: r for r in got.collect()}
    a[::50] = 0.0
    dense = np.concatenate([np.stack([a, c, np.full(n, 7.0)], 1), marks[k], (j[:, None] == np.arange(3)).astype(float)], 1)
    for label, out in ((y, "p"), (1 - y, "q")):
        assert np.abs(_least(dense, label) - np.array([found[i][out] for i in range(n)])).max() < 1e-7
    assert {r["always"] for r in found.values()} == {1.0} and len(found) == n
    assert len(passes) <= 15  # former fits made a pass a quasi-Newton step, about 150


def test_vaep_fits_share_their_passes(md, monkeypatch):
    from touchline.operators import vaep as VA
    from touchline.plans import valuation

    passes = []
    reduced = models._reduced
    monkeypatch.setattr(models, "_reduced", lambda *args: passes.append(1) or reduced(*args))
    actions = valuation.spadl(md)
    probs = VA.probabilities(actions)
    assert probs.columns == ["action_id", "p_scores", "p_concedes"] and probs.count() == actions.count()
    assert len(passes) <= 20


def test_fits_of_tables_without_rows(spark):
    empty = spark.createDataFrame([], "id long, a double, y int")
    assert models.fit_predict(empty, ["a"], "y", "p", ["id"]).collect() == []
