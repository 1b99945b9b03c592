from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cambium.functions import emission as em
from cambium.functions.params import Emission, default_emission, static_log_trans

THREE = Emission(np.array([0.8, 0.1, 0.01]), np.array([0.01, 0.10, 0.40]), np.array([50.0, 20.0, 10.0]))


def test_beta_density_integrates_to_one():
    x = np.linspace(1e-6, 1 - 1e-6, 200_001)
    for mu, phi in ((0.1, 20), (0.4, 10), (0.6, 5)):
        area = np.trapezoid(np.exp(em.log_beta_pdf(x, mu * phi, (1 - mu) * phi)), x)
        assert abs(area - 1) < 0.01


def test_zero_gives_the_log_of_pi():
    assert np.allclose(em.zib_log_prob(np.array([0.0]), THREE)[0], np.log(THREE.pi))


def test_extremes_prefer_their_states_and_all_is_finite():
    e = em.zib_log_prob(np.array([0.0, 0.60]), default_emission())
    assert e[0].argmax() == 0 and e[1].argmax() == 5
    assert np.isfinite(em.zib_log_prob(np.array([0, 0.001, 0.5, 0.99, 0.999]), default_emission())).all()


def test_batch_equals_single_and_order_of_the_probes():
    x = np.array([0.02, 0.05, 0.07, 0.18, 0.38, 0.6])
    whole = em.zib_log_prob(x, default_emission())
    assert all(np.array_equal(whole[i], em.zib_log_prob(x[i], default_emission())) for i in range(len(x)))
    assert [int(whole[i].argmax()) for i in (2, 3, 4, 5)] == [2, 3, 4, 5]


def test_table_covers_all_percents_and_missing_is_zero():
    t = em.zib_table(THREE)
    assert t.shape == (102, 3) and not t[em.MISSING].any()
    assert np.allclose(t[100], em.zib_log_prob(np.array(0.999), THREE))


def test_constrained_parameters_are_ordered_and_in_range():
    rng = np.random.default_rng(3)
    for _ in range(20):
        e = em.constrain(rng.normal(0, 3, 6), rng.normal(-1, 2, 6), rng.normal(0, 3, 6))
        assert (np.diff(e.mu) >= 0).all() and ((e.mu >= 1e-4) & (e.mu <= 0.999)).all()
        assert ((e.pi > 0) & (e.pi < 1)).all() and (e.phi > 1).all()


def test_constrain_inverts_unconstrain_within_the_clip():
    e = Emission(np.array([0.5, 0.2, 0.1]), np.array([0.1, 0.3, 0.6]), np.array([12.0, 8.0, 5.0]))
    back = em.constrain(*em.unconstrain(e))
    assert np.allclose(back.pi, e.pi) and np.allclose(back.mu, e.mu) and np.allclose(back.phi, e.phi)
    assert em.constrain(*em.unconstrain(Emission(e.pi, e.mu, np.full(3, 100.0)))).phi.max() <= 21.01


def test_defaults_are_for_six_states():
    with pytest.raises(ValueError):
        default_emission(5)
    assert np.allclose(np.exp(static_log_trans()).sum(1), 1, atol=1e-9)


def test_gaussian_matches_the_formula():
    rng = np.random.default_rng(42)
    x, m, v = rng.uniform(0, 20, (50, 35)), np.array([1.5, 10.0]), np.array([44.89, 44.89])
    want = -0.5 * np.log(2 * np.pi * v) - 0.5 * (x[..., None] - m) ** 2 / v
    assert np.allclose(em.gaussian_log_prob(x, m, v), want)


def test_column_forms_equal_the_arrays(spark):
    rows = spark.createDataFrame([(0,), (1,), (50,), (100,), (None,), (255,)], "pct int")
    got = rows.select(em.zib_by_cover(F.col("pct"), THREE).alias("e")).toPandas().e.tolist()
    t = em.zib_table(THREE)
    assert all(np.allclose(g, t[i]) for g, i in zip(got, (0, 1, 50, 100, em.MISSING, em.MISSING)))
    x = spark.createDataFrame([(0.0,), (0.3,), (0.999,)], "x double")
    for k in range(3):
        col = x.select(em.zib_expression(F.col("x"), THREE.pi[k], THREE.mu[k], THREE.phi[k]).alias("e")).toPandas().e
        assert np.allclose(col, em.zib_log_prob(np.array([0.0, 0.3, 0.999]), THREE)[:, k])
    f = rows.select(em.fraction(F.col("pct")).alias("x")).toPandas().x.tolist()
    assert f[:4] == [0.0, 0.01, 0.5, 0.999] and np.isnan(f[4])
