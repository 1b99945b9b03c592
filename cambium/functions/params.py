"""Parameters of the hidden Markov model: arrays on the driver, small tables in Spark, JSON on disk."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Default parameters: fixed values.
DEFAULT_PI = (0.90, 0.20, 0.05, 0.01, 0.005, 0.001)
DEFAULT_MU = (0.005, 0.02, 0.07, 0.18, 0.38, 0.60)
DEFAULT_PHI = (100.0, 50.0, 30.0, 15.0, 10.0, 5.0)
DEFAULT_INIT = (0.50, 0.15, 0.12, 0.10, 0.08, 0.05)
DEFAULT_TRANS = (
    (0.950, 0.030, 0.012, 0.005, 0.002, 0.001),
    (0.020, 0.930, 0.035, 0.010, 0.003, 0.002),
    (0.010, 0.020, 0.930, 0.030, 0.007, 0.003),
    (0.005, 0.008, 0.017, 0.940, 0.025, 0.005),
    (0.003, 0.004, 0.006, 0.017, 0.950, 0.020),
    (0.002, 0.003, 0.005, 0.010, 0.010, 0.970),
)


@dataclass(frozen=True)
class Emission:
    """Zero-inflated Beta by state: P(0) = pi, otherwise Beta(mu phi, (1 - mu) phi)."""

    pi: np.ndarray
    mu: np.ndarray
    phi: np.ndarray


@dataclass(frozen=True)
class HMMParams:
    """log_init (K,), log_trans (K, K), emission, and weights (K, K - 1, D) of dynamic transitions or None."""

    log_init: np.ndarray
    log_trans: np.ndarray
    emission: Emission
    weights: np.ndarray | None = None

    @property
    def n_states(self) -> int:
        return len(self.log_init)


@dataclass(frozen=True)
class EMResult:
    params: HMMParams
    log_likelihoods: tuple[float, ...]
    converged: bool
    n_iter: int


def default_emission(k: int = 6) -> Emission:
    if k != len(DEFAULT_PI):
        raise ValueError(f"defaults are for {len(DEFAULT_PI)} states, not {k}: give parameters")
    return Emission(np.array(DEFAULT_PI), np.array(DEFAULT_MU), np.array(DEFAULT_PHI))


def static_log_trans(probabilities=None) -> np.ndarray:
    return np.log(np.array(DEFAULT_TRANS if probabilities is None else probabilities, np.float64))


def default_params(k: int = 6) -> HMMParams:
    emission = default_emission(k)
    return HMMParams(np.log(np.array(DEFAULT_INIT)), static_log_trans(), emission)


def tables(spark: SparkSession, params: HMMParams) -> dict[str, DataFrame]:
    """emission(k, pi, mu, phi), init(k, lp), trans(i, j, lp) and, if there are weights, weights(i, target, d, w)."""
    e, k = params.emission, params.n_states
    out = {
        "emission": spark.createDataFrame([(i, float(e.pi[i]), float(e.mu[i]), float(e.phi[i])) for i in range(k)], "k int, pi double, mu double, phi double"),
        "init": spark.createDataFrame([(i, float(params.log_init[i])) for i in range(k)], "k int, lp double"),
        "trans": spark.createDataFrame([(i, j, float(params.log_trans[i, j])) for i in range(k) for j in range(k)], "i int, j int, lp double"),
    }
    if params.weights is not None:
        rows = [(i, j + (j >= i), d, float(w)) for i, per in enumerate(params.weights) for j, vector in enumerate(per) for d, w in enumerate(vector)]
        out["weights"] = spark.createDataFrame(rows, "i int, target int, d int, w double")
    return out


def save(spark: SparkSession, params: HMMParams, path: str) -> None:
    """One JSON row; weights only if there are any."""
    row = {"log_init": params.log_init.tolist(), "log_trans": params.log_trans.tolist(), "pi": params.emission.pi.tolist(), "mu": params.emission.mu.tolist(), "phi": params.emission.phi.tolist()}
    if params.weights is not None:
        row["weights"] = params.weights.tolist()
    spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> HMMParams:
    row = json.loads(spark.read.text(path).where(F.length("value") > 0).first()[0])
    a = {k: np.array(v, np.float64) for k, v in row.items()}
    return HMMParams(a["log_init"], a["log_trans"], Emission(a["pi"], a["mu"], a["phi"]), a.get("weights"))
