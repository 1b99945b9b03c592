"""Learning (L1-L11): expectation-maximisation whose rounds exchange a few hundred numbers with the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.config import EMConfig
from cambium.functions.emission import COVERS, MISSING, zib_table
from cambium.functions.kernels import dynamic_log_trans, forward_backward, pair_sums, pairs
from cambium.functions.optimise import digamma, lbfgs
from cambium.functions.params import Emission, EMResult, HMMParams, default_params
from cambium.operators.decode import cover_index

_X = np.clip(np.minimum(np.arange(COVERS) / 100.0, 0.999), 1e-6, 1 - 1e-6)
_CLIP = (1e-4, 1e4)


@dataclass(frozen=True)
class Statistics:
    """cover (101, K): posterior mass at each cover; pairs (K, K); first, before_last (K,); likelihood and series."""

    cover: np.ndarray
    pairs: np.ndarray
    first: np.ndarray
    before_last: np.ndarray
    log_lik: float
    series: float


def expectations(frame: DataFrame, params: HMMParams, column: str = "pct", weight: str | None = None) -> Statistics:
    """E-step. Each Arrow batch becomes one row of sums; those are added in a partial and a final aggregation.

    No posterior of a series leaves its batch. weight: a column with how often a series counts (collapsed copies).
    """
    k, table, init, trans = params.n_states, zib_table(params.emission), params.log_init, params.log_trans
    size = COVERS * k + k * k + 2 * k + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            every = np.asarray(b.column(weight), np.float64) if weight else np.ones(b.num_rows)
            for rows, index in cover_index(b.column(column)):
                if not index.shape[1]:
                    continue
                w = every[rows]
                smooth = forward_backward(table[index], init, trans)
                gamma = smooth.gamma * w[:, None, None]
                cover = np.bincount((index[..., None] * k + np.arange(k)).ravel(), gamma.ravel(), (MISSING + 1) * k)[: COVERS * k]
                total += np.concatenate([cover, pair_sums(smooth, trans, w).ravel(), gamma[:, 0].sum(0), gamma[:, :-1].sum((0, 1)), [(smooth.log_lik * w).sum(), w.sum()]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "v"])

    columns = [column, *([weight] if weight else [])]
    got = np.zeros(size)
    for r in frame.select(*columns).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # `size` rows
        got[r["i"]] = r["v"]
    parts = np.split(got, np.cumsum([COVERS * k, k * k, k, k]))
    return Statistics(parts[0].reshape(COVERS, k), parts[1].reshape(k, k), parts[2], parts[3], float(parts[4][0]), float(parts[4][1]))


def initial_step(s: Statistics) -> np.ndarray:
    """L3: log of the mean first posterior, clipped and normalised."""
    p = np.clip(s.first / max(s.series, 1e-10), 1e-8, None)
    return np.log(p / p.sum())


def transition_step(s: Statistics) -> np.ndarray:
    """L4."""
    p = np.clip(s.pairs / np.maximum(s.before_last, 1e-10)[:, None], 1e-8, None)
    return np.log(p / p.sum(1, keepdims=True))


def zero_fraction(s: Statistics) -> np.ndarray:
    """L5."""
    return np.clip(s.cover[0] / np.maximum(s.cover.sum(0), 1e-10), 1e-6, 1 - 1e-6)


def beta_sums(s: Statistics) -> np.ndarray:
    """(K, 3): weight, weighted ln x and ln(1 - x) of covers above 0: all that the Beta likelihood depends on."""
    inside = s.cover[1:]
    return np.stack([inside.sum(0), np.log(_X[1:]) @ inside, np.log1p(-_X[1:]) @ inside], axis=1)


def beta_loss(raw: np.ndarray, sums: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log-likelihood and gradient in (logit mu, softplus^-1(phi - 1)); clipped a, b have no slope."""
    import math

    mu = 1 / (1 + math.exp(-min(max(raw[0], -500.0), 500.0)))
    phi = float(np.logaddexp(0, raw[1])) + 1
    a, b = min(max(mu * phi, _CLIP[0]), _CLIP[1]), min(max((1 - mu) * phi, _CLIP[0]), _CLIP[1])
    w, ln_x, ln_y = sums
    value = -(w * (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) + (a - 1) * ln_x + (b - 1) * ln_y)
    both = digamma(a + b)
    da = -(w * (both - digamma(a)) + ln_x) if _CLIP[0] < mu * phi < _CLIP[1] else 0.0
    db = -(w * (both - digamma(b)) + ln_y) if _CLIP[0] < (1 - mu) * phi < _CLIP[1] else 0.0
    d_mu, d_phi = (da - db) * phi, da * mu + db * (1 - mu)
    return value, np.array([d_mu * mu * (1 - mu), d_phi / (1 + math.exp(-min(max(raw[1], -500.0), 500.0)))])


def emission_step(s: Statistics, before: Emission, max_iter: int = 50) -> tuple[Emission, np.ndarray]:
    """Zero fractions, then each state's Beta from its three sums, warm-started; sorted by mean. Also the order."""
    mu, phi = before.mu.copy(), before.phi.copy()
    for k, sums in enumerate(beta_sums(s)):
        if sums[0] <= 1e-8:
            continue
        m = min(max(mu[k], 1e-6), 1 - 1e-6)
        start = np.array([np.log(m / (1 - m)), np.log(np.expm1(min(max(phi[k] - 1, 1e-2), 500.0))) if phi[k] < 501 else phi[k] - 1])
        scale = 1 / max(sums[0], 1.0)
        raw = lbfgs(lambda x, q=sums, c=scale: tuple(v * c for v in beta_loss(x, q)), start, max_iter, 1e-7)
        mu[k], phi[k] = 1 / (1 + np.exp(-raw[0])), np.logaddexp(0, raw[1]) + 1
    order = np.argsort(mu, kind="stable")
    return Emission(zero_fraction(s)[order], mu[order], phi[order]), order


def maximise(s: Statistics, before: HMMParams, max_iter: int = 50) -> HMMParams:
    """All of the M-step, with initial and transition probabilities in the order of the sorted states."""
    emission, order = emission_step(s, before.emission, max_iter)
    return HMMParams(initial_step(s)[order], transition_step(s)[np.ix_(order, order)], emission, before.weights)


def baum_welch(frame: DataFrame, params: HMMParams | None = None, config: EMConfig = EMConfig(), column: str = "pct", weight: str | None = None) -> EMResult:
    """L1: EM until the likelihood changes by less than tol relatively; returns the parameters that gave the last one.

    frame is read once a round: cache it, or write it, before. A round is one job over it.
    """
    params = params or default_params()
    seen: list[float] = []
    for i in range(config.max_iter):
        s = expectations(frame, params, column, weight)
        seen.append(s.log_lik)
        if i and abs(seen[-1] - seen[-2]) / max(abs(seen[-2]), 1.0) < config.tol:
            return EMResult(params, tuple(seen), True, i + 1)
        params = maximise(s, params, config.lbfgs_maxiter)
    return EMResult(params, tuple(seen), False, config.max_iter)


def collapsed(frame: DataFrame, column: str = "pct") -> DataFrame:
    """Distinct series and how often each occurs, for `baum_welch(weight="n")`."""
    return frame.groupBy(column).agg(F.count("*").alias("n"))


def _covariates(b: pa.RecordBatch, column: str, d: int) -> tuple[np.ndarray, np.ndarray]:
    lists = b.column(column)
    many = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    flat = np.nan_to_num(np.asarray(pc.fill_null(lists.flatten().flatten(), 0.0), np.float64)).reshape(-1, d)
    return flat, np.concatenate([[0], np.cumsum(many)])


def pair_table(frame: DataFrame, params: HMMParams, column: str = "pct", covariates: str = "x") -> tuple[DataFrame, float]:
    """(x, xi): covariates and expected transitions of every series and step, and the total likelihood.

    xi, K x K numbers a step, is kept as rows in Spark for the weight fit, never on the driver.
    """
    k, d, table, init, weights = params.n_states, params.weights.shape[2], zib_table(params.emission), params.log_init, params.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, start = _covariates(b, covariates, d)
            for rows, index in cover_index(b.column(column)):
                steps = max(index.shape[1] - 1, 0)
                x = flat[start[rows][:, None] + np.arange(steps)]
                trans = dynamic_log_trans(x, weights)
                smooth = forward_backward(table[index], init, trans)
                xi = pairs(smooth, trans).reshape(len(rows), -1)
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(pa.float64())) if a.shape[1] else pa.array([[]] * len(rows), pa.list_(pa.float64())) for a in (x.reshape(len(rows), -1), xi)] + [pa.array(smooth.log_lik)], ["x", "xi", "ll"])

    made = frame.select(column, covariates).mapInArrow(run, "x array<double>, xi array<double>, ll double").cache()
    return made, float(made.agg(F.sum("ll")).first()[0] or 0.0)


def weight_loss(made: DataFrame, weights: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """L9's objective and gradient for all source states at once: one job, K (K - 1) D + 1 sums.

    -sum xi_ij log softmax_j + l2 sum w^2, the intercept included.
    """
    k, _, d = weights.shape
    size = weights.size + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            x = np.asarray(b.column("x").flatten(), np.float64).reshape(-1, d)
            xi = np.asarray(b.column("xi").flatten(), np.float64).reshape(-1, k, k)
            la = dynamic_log_trans(x[None], weights)[0]
            miss = xi.sum(2, keepdims=True) * np.exp(la) - xi
            slope = [miss[:, i, [j for j in range(k) if j != i]].T @ x for i in range(k)]
            total += np.concatenate([[-(xi * la).sum()], np.stack(slope).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "v"])

    got = np.zeros(size)
    for r in made.select("x", "xi").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # `size` rows
        got[r["i"]] = r["v"]
    return got[0] + l2 * float((weights**2).sum()), got[1:].reshape(weights.shape) + 2 * l2 * weights


def fit_weights(frame: DataFrame, params: HMMParams, n_features: int, config: EMConfig = EMConfig(), column: str = "pct", covariates: str = "x") -> tuple[HMMParams, tuple[float, ...]]:
    """EM over the weights of dynamic transitions, emissions and initial probabilities held; zero weights at first.

    Weights that params already has are where it starts from.
    """
    k = params.n_states
    weights = params.weights if params.weights is not None else np.zeros((k, k - 1, n_features))
    seen: list[float] = []
    for i in range(config.weight_iters):
        made, likelihood = pair_table(frame, HMMParams(params.log_init, params.log_trans, params.emission, weights), column, covariates)
        seen.append(likelihood)
        if i and abs(seen[-1] - seen[-2]) / max(abs(seen[-2]), 1.0) < config.weight_tol:
            made.unpersist()
            break

        def loss(flat: np.ndarray, made=made) -> tuple[float, np.ndarray]:
            value, slope = weight_loss(made, flat.reshape(weights.shape), config.l2)
            return value, slope.ravel()

        weights = lbfgs(loss, weights.ravel(), config.lbfgs_maxiter, 1e-3).reshape(weights.shape)
        made.unpersist()
    return HMMParams(params.log_init, params.log_trans, params.emission, weights), tuple(seen)
