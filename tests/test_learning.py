from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cambium.config import EMConfig
from cambium.functions.emission import zib_table
from cambium.functions.kernels import forward_backward, pairs, viterbi
from cambium.functions.optimise import digamma, lbfgs
from cambium.functions.params import HMMParams, default_params, load, save, tables
from cambium.operators import learn


def synthetic(n: int, t: int, seed: int):
    """Covers and states drawn from the default model."""
    rng, p = np.random.default_rng(seed), default_params()
    a, e = np.exp(p.log_trans), p.emission
    init = np.exp(p.log_init) / np.exp(p.log_init).sum()
    states = np.empty((n, t), int)
    states[:, 0] = rng.choice(6, n, p=init)
    for s in range(1, t):
        for k in range(6):
            rows = states[:, s - 1] == k
            states[rows, s] = rng.choice(6, rows.sum(), p=a[k] / a[k].sum())
    beta = rng.beta((e.mu * e.phi)[states], ((1 - e.mu) * e.phi)[states])
    pct = np.where(rng.random((n, t)) < e.pi[states], 0, np.clip(np.round(beta * 100), 1, 100)).astype(int)
    return pct, states


def frame_of(spark, pct):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(pct)], "pid long, pct array<smallint>")


def test_statistics_equal_the_posteriors(spark):
    pct, _ = synthetic(80, 9, 0)
    p = default_params()
    s = learn.expectations(frame_of(spark, pct), p)
    smooth = forward_backward(zib_table(p.emission)[pct], p.log_init, p.log_trans)
    assert np.allclose(s.pairs, pairs(smooth, p.log_trans).sum((0, 1))) and np.isclose(s.log_lik, smooth.log_lik.sum())
    assert np.allclose(s.first, smooth.gamma[:, 0].sum(0)) and np.allclose(s.before_last, smooth.gamma[:, :-1].sum((0, 1)))
    assert np.allclose(s.cover[0], smooth.gamma[pct == 0].sum(0)) and s.series == 80
    twice = frame_of(spark, np.vstack([pct, pct]))
    assert np.allclose(learn.expectations(learn.collapsed(twice), p, weight="n").cover, 2 * s.cover)


def test_beta_loss_gradient():
    sums = np.array([120.0, -250.0, -40.0])
    for raw in (np.array([-1.0, 1.5]), np.array([0.3, 4.0])):
        _, g = learn.beta_loss(raw, sums)
        for d in range(2):
            h = np.zeros(2)
            h[d] = 1e-6
            assert np.isclose(g[d], (learn.beta_loss(raw + h, sums)[0] - learn.beta_loss(raw - h, sums)[0]) / 2e-6, rtol=1e-4)


def test_digamma_and_lbfgs():
    assert np.isclose(digamma(1.0), -0.5772156649015329) and np.isclose(digamma(10.5), 2.3030010343)
    rosenbrock = lambda x: ((1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2, np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)]))
    assert np.allclose(lbfgs(rosenbrock, np.array([-1.2, 1.0]), 200, 1e-8), 1, atol=1e-4)


def test_em_recovers_and_never_loses(spark):
    pct, _ = synthetic(1500, 20, 42)
    frame = frame_of(spark, pct).cache()
    found = learn.baum_welch(frame, config=EMConfig(max_iter=8))
    ll = np.array(found.log_likelihoods)
    assert (np.diff(ll) >= -1.0).all() and np.isfinite(ll).all()
    e, true = found.params.emission, default_params().emission
    assert (np.abs(e.mu - true.mu) <= 0.5 * true.mu + 0.01).all() and (np.diff(e.mu) >= 0).all()
    assert np.isclose(np.exp(found.params.log_init).sum(), 1) and np.allclose(np.exp(found.params.log_trans).sum(1), 1)


def test_em_stops_with_the_parameters_before_the_step(spark):
    pct, _ = synthetic(60, 8, 1)
    found = learn.baum_welch(frame_of(spark, pct), config=EMConfig(max_iter=50, tol=0.5))
    assert found.converged and found.n_iter == len(found.log_likelihoods) >= 2
    s = learn.expectations(frame_of(spark, pct), found.params)
    assert np.isclose(s.log_lik, found.log_likelihoods[-1])
    short = learn.baum_welch(frame_of(spark, pct), config=EMConfig(max_iter=2, tol=0.0))
    assert not short.converged and short.n_iter == 2


def test_sorted_states_permute_everything():
    p = default_params()
    order = [5, 4, 3, 2, 1, 0]
    from cambium.functions.params import Emission

    mixed = HMMParams(p.log_init[order], p.log_trans[np.ix_(order, order)], Emission(p.emission.pi[order], p.emission.mu[order], p.emission.phi[order]))
    rng = np.random.default_rng(0)
    s = learn.Statistics(rng.random((101, 6)) * 5, rng.random((6, 6)), rng.random(6), rng.random(6) + 6, 0.0, 3.0)
    t = learn.Statistics(s.cover[:, order], s.pairs[np.ix_(order, order)], s.first[order], s.before_last[order], 0.0, 3.0)
    a, b = learn.maximise(s, p), learn.maximise(t, mixed)
    assert np.allclose(a.emission.mu, b.emission.mu) and np.allclose(a.log_trans, b.log_trans) and np.allclose(a.log_init, b.log_init)


def test_decode_accuracy_with_true_parameters():
    pct, states = synthetic(500, 35, 42)
    p = default_params()
    got, _ = viterbi(zib_table(p.emission)[pct], p.log_init, p.log_trans)
    assert (got == states).mean() > 0.3


def test_weight_fit_gains_and_its_gradient(spark):
    rng = np.random.default_rng(7)
    pct, _ = synthetic(40, 8, 5)
    x = np.concatenate([np.ones((40, 7, 1)), rng.normal(size=(40, 7, 2))], axis=2)
    frame = spark.createDataFrame([(pct[i].tolist(), x[i].tolist()) for i in range(40)], "pct array<smallint>, x array<array<double>>")
    found, seen = learn.fit_weights(frame, default_params(), 3, EMConfig(weight_iters=3, lbfgs_maxiter=8))
    assert found.weights.shape == (6, 5, 3) and np.isfinite(found.weights).all() and seen[-1] > seen[0]
    made, _ = learn.pair_table(frame, found)
    w = rng.normal(0, 0.3, (6, 5, 3))
    _, g = learn.weight_loss(made, w, 1e-3)
    for at in ((0, 0, 0), (3, 2, 1), (5, 4, 2)):
        h = np.zeros_like(w)
        h[at] = 1e-5
        assert np.isclose(g[at], (learn.weight_loss(made, w + h, 1e-3)[0] - learn.weight_loss(made, w - h, 1e-3)[0]) / 2e-5, rtol=1e-3, atol=1e-5)


def test_params_round_trip(spark, tmp_path):
    p = default_params()
    for weights in (None, np.arange(60.0).reshape(6, 5, 2)):
        save(spark, HMMParams(p.log_init, p.log_trans, p.emission, weights), str(tmp_path / "p"))
        back = load(spark, str(tmp_path / "p"))
        assert np.array_equal(back.log_trans, p.log_trans) and np.array_equal(back.emission.phi, p.emission.phi)
        assert (back.weights is None) == (weights is None) and (weights is None or np.array_equal(back.weights, weights))
    t = tables(spark, back)
    assert t["trans"].count() == 36 and t["weights"].where("i = target").count() == 0 and t["weights"].agg(F.max("w")).first()[0] == 59.0


def test_k_is_generic(spark):
    from cambium.functions.params import Emission

    p = HMMParams(np.log([0.6, 0.4]), np.log([[0.9, 0.1], [0.2, 0.8]]), Emission(np.array([0.8, 0.05]), np.array([0.02, 0.4]), np.array([50.0, 8.0])))
    found = learn.baum_welch(frame_of(spark, synthetic(50, 10, 3)[0]), p, EMConfig(max_iter=3))
    assert found.params.n_states == 2
    with pytest.raises(ValueError):
        default_params(4)
