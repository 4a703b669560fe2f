"""Homographies from point pairs, and fits that must converge."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import models
from touchline.operators import tracking as TR


def test_homography_is_found_again():
    rng = np.random.default_rng(1)
    for n in (4, 5, 30):
        h = np.eye(3) + 0.2 * rng.normal(size=(3, 3))
        h[2, :2] *= 0.001
        h /= h[2, 2]
        pixels = rng.uniform(0, 1920, (n, 2))
        w = np.c_[pixels, np.ones(n)] @ h.T
        assert np.allclose(TR.homography(pixels, w[:, :2] / w[:, 2:]), h, rtol=1e-6, atol=1e-8)


def test_noisy_pairs_are_fitted_closely():
    rng = np.random.default_rng(2)
    pixels = rng.uniform(0, 1000, (60, 2))
    pitch = pixels * 0.1 + 3
    h = TR.homography(pixels, pitch + rng.normal(size=pitch.shape) * 0.01)
    w = np.c_[pixels, np.ones(60)] @ h.T
    assert np.abs(w[:, :2] / w[:, 2:] - pitch).max() < 0.05


def test_a_fit_that_does_not_converge_raises(spark, monkeypatch):
    df = spark.range(200).select("id", (F.rand(3) * 5).alias("a"), F.rand(4).alias("b")).withColumn("y", (F.col("a") + 3 * F.col("b") + F.rand(5) > 4).cast("int")).checkpoint()
    assert models.fit_predict(df, ["a", "b"], "y", "p", ["id"]).count() == 200
    monkeypatch.setattr(models, "MAX_ITER", 1)
    with pytest.raises(RuntimeError, match="converge"):
        models.fit_predict(df, ["a", "b"], "y", "p", ["id"])
