"""Emission log-probabilities (E1-E6): tables on the driver for integer cover, expressions for anything else."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from cambium.functions.params import Emission

EPS = 1e-6
#: Cover values 0..100; the row after them is that of a missing value, which tells nothing.
COVERS, MISSING = 101, 101


def log_beta_pdf(x, a: float, b: float):
    return math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * np.log(x) + (b - 1) * np.log1p(-np.asarray(x))


def zib_log_prob(x: np.ndarray, emission: Emission) -> np.ndarray:
    """(..., K) log-probabilities of fractions x in [0, 1): ln pi at 0, else ln(1 - pi) and the Beta density."""
    x = np.asarray(x, np.float64)
    inside = np.clip(x, EPS, 1 - EPS)
    out = []
    for pi, mu, phi in zip(emission.pi, emission.mu, emission.phi):
        zero, more = math.log(min(max(pi, EPS), 1 - EPS)), math.log(min(max(1 - pi, EPS), 1 - EPS))
        out.append(np.where(x == 0, zero, more + log_beta_pdf(inside, mu * phi, (1 - mu) * phi)))
    return np.stack(out, axis=-1)


def zib_table(emission: Emission) -> np.ndarray:
    """(102, K): a row for each cover 0..100 %, and zeros for a missing value."""
    fractions = np.minimum(np.arange(COVERS) / 100.0, 0.999)
    return np.vstack([zib_log_prob(fractions, emission), np.zeros((1, len(emission.pi)))])


def gaussian_log_prob(x: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)[..., None]
    return -0.5 * (np.log(2 * np.pi * variances) + (x - means) ** 2 / variances)


def constrain(raw_pi: np.ndarray, raw_steps: np.ndarray, raw_phi: np.ndarray) -> Emission:
    """Unconstrained values -> parameters: sigmoid, means increasing by stick-breaking, softplus + 1."""
    pi = 1 / (1 + np.exp(-np.asarray(raw_pi, np.float64)))
    share = np.clip(1 / (1 + np.exp(-np.asarray(raw_steps, np.float64))), 1e-6, 1 - 1e-6)
    left, mu = 1.0, []
    for s in share:
        left *= 1 - s
        mu.append(1 - left)
    return Emission(pi, np.clip(np.array(mu), 1e-4, 0.999), np.logaddexp(0, np.asarray(raw_phi, np.float64)) + 1)


def unconstrain(emission: Emission) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The inverse of `constrain`; phi - 1 is clipped to [0.01, 20], so larger phi aren't recovered."""
    pi = np.clip(emission.pi, 1e-6, 1 - 1e-6)
    rest = 1 - np.concatenate([[0.0], emission.mu])
    share = np.clip(1 - rest[1:] / rest[:-1], 1e-6, 1 - 1e-6)
    return np.log(pi / (1 - pi)), np.log(share / (1 - share)), np.log(np.expm1(np.clip(emission.phi - 1, 0.01, 20)))


def fraction(pct: Column) -> Column:
    """S3: percent to a fraction in [0, 0.999]; an exact zero stays zero, null stays null."""
    return F.when(pct.isNotNull(), F.least(F.greatest(pct.cast("double") / 100, F.lit(0.0)), F.lit(0.999)))


def zib_by_cover(pct: Column, emission: Emission) -> Column:
    """array<double>, K log-probabilities of an integer cover, from a literal table; null or beyond 0..100: zeros."""
    rows = zib_table(emission)
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in rows])
    return F.element_at(table, F.when(pct.between(0, 100), pct.cast("int") + 1).otherwise(F.lit(MISSING + 1)))


def zib_expression(x: Column, pi: float, mu: float, phi: float) -> Column:
    """The same for a fraction of any value, one state: the constants are folded on the driver."""
    a, b = mu * phi, (1 - mu) * phi
    constant = math.log(min(max(1 - pi, EPS), 1 - EPS)) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    inside = F.least(F.greatest(x, F.lit(EPS)), F.lit(1 - EPS))
    return F.when(x == 0, F.lit(math.log(min(max(pi, EPS), 1 - EPS)))).otherwise(F.lit(constant) + (a - 1) * F.ln(inside) + (b - 1) * F.ln(1 - inside))


def gaussian_expression(x: Column, mean: float, variance: float) -> Column:
    return -0.5 * (F.lit(math.log(2 * math.pi * variance)) + (x - mean) * (x - mean) / variance)
