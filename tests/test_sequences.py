from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from cambium.functions import kernels as kn
from cambium.functions.emission import zib_table
from cambium.functions.params import HMMParams, default_params
from cambium.operators import decode, panel


def random_model(k: int, t: int, n: int, seed: int = 42):
    rng = np.random.default_rng(seed)
    a = 0.8 * np.eye(k) + 0.2 / k
    return rng.normal(0, 2, (n, t, k)), np.log(np.full(k, 1 / k)), np.log(a / a.sum(1, keepdims=True))


def every_path(e, init, trans):
    """Paths and their log-probabilities, one sequence, by enumeration."""
    t, k = e.shape
    paths = list(product(range(k), repeat=t))
    step = lambda s, i, j: trans[i, j] if trans.ndim == 2 else trans[s, i, j]
    return paths, np.array([init[p[0]] + e[0, p[0]] + sum(step(s - 1, p[s - 1], p[s]) + e[s, p[s]] for s in range(1, t)) for p in paths])


@pytest.mark.parametrize("dynamic", [False, True])
def test_against_all_paths(dynamic):
    e, init, trans = random_model(3, 4, 6)
    if dynamic:
        trans = kn.dynamic_log_trans(np.random.default_rng(1).normal(size=(6, 3, 2)), np.random.default_rng(2).normal(size=(3, 2, 2)))
    states, best = kn.viterbi(e, init, trans)
    smooth = kn.forward_backward(e, init, trans)
    xi = kn.pairs(smooth, trans)
    for n in range(6):
        own = trans[n] if dynamic else trans
        paths, scores = every_path(e[n], init, own)
        assert tuple(states[n]) == paths[scores.argmax()] and np.isclose(best[n], scores.max())
        total = np.logaddexp.reduce(scores)
        assert np.isclose(smooth.log_lik[n], total)
        p = np.exp(scores - total)
        for s in range(4):
            assert np.allclose(smooth.gamma[n, s], [p[[q[s] == k for q in paths]].sum() for k in range(3)])
        for s in range(3):
            assert np.allclose(xi[n, s], [[p[[q[s] == i and q[s + 1] == j for q in paths]].sum() for j in range(3)] for i in range(3)])
    assert np.allclose(kn.pair_sums(smooth, trans, np.ones(6)), xi.sum((0, 1)))


@pytest.mark.parametrize(("k", "t", "n"), [(3, 8, 10), (5, 35, 20), (6, 35, 100)])
def test_shapes_and_sums(k, t, n):
    e, init, trans = random_model(k, t, n)
    s = kn.forward_backward(e, init, trans)
    assert s.gamma.shape == (n, t, k) and np.allclose(s.gamma.sum(2), 1, atol=1e-9) and np.isfinite(s.log_lik).all()
    xi = kn.pairs(s, trans)
    assert np.allclose(xi.sum(3), s.gamma[:, :-1], atol=1e-8) and np.allclose(xi.sum(2), s.gamma[:, 1:], atol=1e-8)
    states, _ = kn.viterbi(e, init, trans)
    assert states.shape == (n, t) and states.min() >= 0 and states.max() < k


def test_dominant_emissions_and_ties():
    e = np.full((1, 5, 3), -10.0)
    e[:, :, 1] = 0
    _, init, trans = random_model(3, 5, 1)
    assert kn.viterbi(e, init, trans)[0].tolist() == [[1] * 5]
    flat = np.log(np.full((3, 3), 1 / 3))
    assert not kn.viterbi(np.zeros((2, 4, 3)), init, flat)[0].any()


def test_one_step_and_no_step():
    _, init, trans = random_model(3, 5, 1)
    e = np.array([[[0.0, 3.0, 1.0]]])
    assert kn.viterbi(e, init, trans)[0].tolist() == [[1]]
    assert np.isclose(kn.forward_backward(e, init, trans).log_lik[0], np.logaddexp.reduce(init + e[0, 0]))
    assert kn.viterbi(np.zeros((2, 0, 3)), init, trans)[0].shape == (2, 0)
    assert not kn.forward_backward(np.zeros((2, 0, 3)), init, trans).log_lik.any()


def test_two_state_gaussian_decode():
    from cambium.functions.emission import gaussian_log_prob

    x = np.array([[1.0, 1.2, 0.5, 11, 10, 12]])
    e = gaussian_log_prob(x, np.array([1.5, 10.0]), np.array([4.0, 4.0]))
    assert kn.viterbi(e, np.log([0.9, 0.1]), np.log([[0.97, 0.03], [0.01, 0.99]]))[0].tolist() == [[0, 0, 0, 1, 1, 1]]


def test_decode_frame_with_ragged_missing_and_strict(spark):
    rows = [(1, [0, 0, 10, 50]), (2, []), (3, [None, 255, 30]), (4, [100]), (5, None), (6, [0, 0, 10, 50])]
    frame = spark.createDataFrame(rows, "pid long, pct array<smallint>")
    got = {r["pid"]: r for r in decode.decode(frame, default_params(), ("states", "log_prob", "log_lik", "posterior", "posterior_q")).collect()}
    p, table = default_params(), zib_table(default_params().emission)
    for pid, index in ((1, [0, 0, 10, 50]), (3, [101, 101, 30]), (4, [100])):
        states, lp = kn.viterbi(table[np.array([index])], p.log_init, p.log_trans)
        assert got[pid]["states"] == states[0].tolist() and np.isclose(got[pid]["log_prob"], lp[0])
        assert np.allclose(np.sum(got[pid]["posterior"], axis=1), 1)
        assert np.array(got[pid]["posterior_q"]).max() <= 200
    assert got[2]["states"] == [] and got[5]["states"] == [] and got[1]["states"] == got[6]["states"]
    strict = {r["pid"]: r["states"] for r in decode.decode(frame, p, ("states",), strict=True).collect()}
    assert strict[3][1] == 5
    again = {r["pid"]: r["states"] for r in decode.decode(frame, p, ("states",), collapse=True).collect()}
    assert again == {k: r["states"] for k, r in got.items()}
    fold = {r["pid"]: r["states"] for r in decode.viterbi_expression(frame.where("size(pct) > 0"), p).collect()}
    assert fold == {k: got[k]["states"] for k in fold} and len(fold) == 4


def test_partitioning_does_not_matter(spark):
    rng = np.random.default_rng(0)
    frame = spark.createDataFrame([(i, rng.integers(0, 101, 12).tolist()) for i in range(60)], "pid long, pct array<smallint>")
    one = sorted(map(str, decode.decode(frame.coalesce(1), default_params()).collect()))
    assert one == sorted(map(str, decode.decode(frame.repartition(7), default_params()).collect()))


def test_dynamic_with_zero_weights_is_uniform_and_checks_its_input(spark):
    p = default_params()
    zero = HMMParams(p.log_init, p.log_trans, p.emission, np.zeros((6, 5, 2)))
    frame = spark.createDataFrame([(1, [0, 10, 60], [[1.0, None], [1.0, float("nan")]])], "pid long, pct array<smallint>, x array<array<double>>")
    got = decode.decode_dynamic(frame, zero, ("states",)).first()["states"]
    flat = np.log(np.full((6, 6), 1 / 6))
    assert got == kn.viterbi(zib_table(p.emission)[np.array([[0, 10, 60]])], p.log_init, flat)[0][0].tolist()
    with pytest.raises(ValueError):
        decode.decode_dynamic(frame, p)


def test_fractions_equal_percents(spark):
    frame = spark.createDataFrame([(1, [0.0, 0.1, 0.6, None])], "pid long, x array<double>")
    ints = spark.createDataFrame([(1, [0, 10, 60, None])], "pid long, pct array<smallint>")
    a, b = decode.decode_fractions(frame, default_params()).first(), decode.decode(ints, default_params()).first()
    assert a["states"] == b["states"] and np.isclose(a["log_prob"], b["log_prob"])


def test_series_round_trip(spark):
    long = spark.createDataFrame([(1, 0, 5), (1, 2, 7), (1, 2, 9), (2, 1, None), (2, 9, 1)], "pid long, t int, pct int")
    got = {r["pid"]: r["pct"] for r in panel.series(long, 3).collect()}
    assert got == {1: [5, None, 9], 2: [None, None, None]}
    filled = {r["pid"]: r["pct"] for r in panel.series(long, 3, absent=0).collect()}
    assert filled[1] == [5, 0, 9]
