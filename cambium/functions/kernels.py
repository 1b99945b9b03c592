"""NumPy kernels over batches of sequences (H1-H6, T2, P5, P6); nothing here knows Spark."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_TINY = np.finfo(np.float64).tiny


def log_sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def viterbi(emissions: np.ndarray, log_init: np.ndarray, log_trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(N, T, K) -> states (N, T) and log-probabilities (N,). Ties go to the lowest state.

    log_trans: (K, K), or (N, T - 1, K, K) for transitions of each sequence and step.
    """
    n, t, k = emissions.shape
    if not t:
        return np.zeros((n, 0), np.int8), np.zeros(n)
    delta = log_init + emissions[:, 0]
    back = np.zeros((n, max(t - 1, 0), k), np.int8)
    for s in range(1, t):
        step = log_trans if log_trans.ndim == 2 else log_trans[:, s - 1]
        best = delta[:, 0, None] + step[..., 0, :]
        source = back[:, s - 1]
        for i in range(1, k):
            other = delta[:, i, None] + step[..., i, :]
            better = other > best
            source[better] = i
            best = np.where(better, other, best)
        delta = best + emissions[:, s]
    states = np.empty((n, t), np.int8)
    states[:, -1] = delta.argmax(1)
    rows = np.arange(n)
    for s in range(t - 2, -1, -1):
        states[:, s] = back[rows, s, states[:, s + 1]]
    return states, delta.max(1)


@dataclass
class Smoothed:
    """gamma (N, T, K) posteriors, log_lik (N,), and what `pairs` needs."""

    gamma: np.ndarray
    log_lik: np.ndarray
    alpha: np.ndarray
    later: np.ndarray


def forward_backward(emissions: np.ndarray, log_init: np.ndarray, log_trans: np.ndarray) -> Smoothed:
    """Posteriors by the scaled recursions: each step's alpha sums to 1, and the scales make up the likelihood."""
    n, t, k = emissions.shape
    if not t:
        return Smoothed(np.zeros((n, 0, k)), np.zeros(n), np.zeros((n, 0, k)), np.zeros((n, 0, k)))
    top = emissions.max(axis=2)
    b = np.exp(emissions - top[:, :, None])
    dynamic = log_trans.ndim == 4
    a = np.exp(log_trans)
    alpha, scale = np.empty((n, t, k)), np.empty((n, t))
    now = np.exp(log_init) * b[:, 0]
    for s in range(t):
        if s:
            moved = np.einsum("ni,nij->nj", alpha[:, s - 1], a[:, s - 1]) if dynamic else alpha[:, s - 1] @ a
            now = moved * b[:, s]
        scale[:, s] = np.maximum(now.sum(1), _TINY)
        alpha[:, s] = now / scale[:, s, None]
    beta = np.ones((n, k))
    gamma, later = np.empty((n, t, k)), np.empty((n, max(t - 1, 0), k))
    gamma[:, -1] = alpha[:, -1]
    for s in range(t - 2, -1, -1):
        later[:, s] = b[:, s + 1] * beta / scale[:, s + 1, None]
        beta = np.einsum("nij,nj->ni", a[:, s], later[:, s]) if dynamic else later[:, s] @ a.T
        gamma[:, s] = alpha[:, s] * beta
    gamma /= np.maximum(gamma.sum(axis=2, keepdims=True), _TINY)
    return Smoothed(gamma, (np.log(scale) + top).sum(1), alpha, later)


def pair_sums(smoothed: Smoothed, log_trans: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(K, K) expected transitions over all sequences and steps, without keeping them by sequence."""
    w = smoothed.alpha[:, :-1] * weights[:, None, None]
    if log_trans.ndim == 2:
        return np.exp(log_trans) * np.einsum("nti,ntj->ij", w, smoothed.later, optimize=True)
    return np.einsum("nti,ntij,ntj->ij", w, np.exp(log_trans), smoothed.later, optimize=True)


def pairs(smoothed: Smoothed, log_trans: np.ndarray) -> np.ndarray:
    """(N, T - 1, K, K) expected transitions of each sequence and step."""
    a = np.exp(log_trans)
    return smoothed.alpha[:, :-1, :, None] * (a if a.ndim == 4 else a[None, None]) * smoothed.later[:, :, None, :]


def dynamic_log_trans(covariates: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(N, T - 1, D) and (K, K - 1, D) -> (N, T - 1, K, K): softmax rows whose own state is the reference category."""
    n, t, _ = covariates.shape
    k = weights.shape[0]
    out = np.zeros((n, t, k, k))
    for i in range(k):
        others = [j for j in range(k) if j != i]
        out[:, :, i, others] = covariates @ weights[i].T
    return out - log_sum_exp(out, 3)[..., None]


def seed_distance(cover: np.ndarray, threshold: float = 0.04, cell: float = 30.0, none: float = 50_000.0) -> np.ndarray:
    """(H, W) -> metres to the nearest cell with cover >= threshold: an exact two-pass Euclidean distance transform."""
    h, w = cover.shape
    seeds = np.nan_to_num(cover, nan=-1.0) >= threshold
    if not seeds.any():
        return np.full((h, w), none)
    far = float((h + w) * 4)
    rows = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(seeds, rows, -far), axis=0)
    below = np.minimum.accumulate(np.where(seeds, rows, 2 * far)[::-1], axis=0)[::-1]
    in_column = np.minimum(rows - above, below - rows).astype(np.float64)
    across = (np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2
    square = np.empty((h, w))
    for r in range(h):
        square[r] = (in_column[r] ** 2 + across).min(axis=1)
    return cell * np.sqrt(square)


def focal_mean(cover: np.ndarray, radius: int = 5) -> np.ndarray:
    """(H, W) -> mean over a (2 radius + 1) square; the grid is mirrored at its edges, repeatedly if it is small."""
    h, w = cover.shape
    size = 2 * radius + 1

    def mirrored(n: int) -> np.ndarray:
        m = np.arange(-radius, n + radius) % (2 * n)
        return np.where(m < n, m, 2 * n - 1 - m)

    wide = cover[mirrored(h)][:, mirrored(w)].astype(np.float64)
    sums = np.pad(wide.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]) / size**2
