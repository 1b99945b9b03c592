"""Decoding of series (H1-H8): one narrow Arrow stage that gives states, likelihoods and posteriors together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.functions.emission import MISSING, zib_table
from cambium.functions.kernels import dynamic_log_trans, forward_backward, viterbi
from cambium.functions.params import HMMParams

OUTPUTS = {
    "states": T.ArrayType(T.ByteType()),
    "log_prob": T.DoubleType(),
    "log_lik": T.DoubleType(),
    "posterior": T.ArrayType(T.ArrayType(T.DoubleType())),
    "posterior_q": T.ArrayType(T.ArrayType(T.ShortType())),
}


def cover_index(column: pa.Array, strict: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, (n, T) table rows) for each length of series in a batch; values beyond 0..100 and nulls are missing.

    strict: values above 100, the missing-data code among them, count as 100.
    """
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = np.asarray(pc.fill_null(column.flatten(), -1), np.int64)
    if strict:
        flat = np.where(flat > 100, 100, flat)
    flat = np.where((flat < 0) | (flat > 100), MISSING, flat)
    start = np.concatenate([[0], np.cumsum(lengths)])
    for t in sorted(set(lengths.tolist())):
        rows = np.flatnonzero(lengths == t)
        yield rows, flat[start[rows][:, None] + np.arange(t)]


def _nested(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """(n, T) or (n, T, K) as lists."""
    for _ in values.shape[1:]:
        kind = pa.list_(kind)
    if not values.shape[1]:
        return pa.array([[]] * values.shape[0], kind)
    out = pa.array(np.ascontiguousarray(values).ravel())
    for size in reversed(values.shape[1:]):
        edges = np.arange(len(out) // size + 1) * size
        out = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), out)
    return out.cast(kind)


def quantised(p: np.ndarray) -> np.ndarray:
    """K3: posteriors as 0..200; rounded at the ninth digit before the cut, so that 1 - 1e-16 isn't 199."""
    return np.floor(np.clip(np.round(p, 9) * 200, 0, 200)).astype(np.int16)


def outputs(emissions: np.ndarray, log_init: np.ndarray, log_trans: np.ndarray, wanted: tuple[str, ...]) -> dict[str, pa.Array]:
    found: dict[str, pa.Array] = {}
    if {"states", "log_prob"} & set(wanted):
        states, log_prob = viterbi(emissions, log_init, log_trans)
        found |= {"states": _nested(states, pa.int8()), "log_prob": pa.array(log_prob)}
    if {"log_lik", "posterior", "posterior_q"} & set(wanted):
        smooth = forward_backward(emissions, log_init, log_trans)
        found["log_lik"] = pa.array(smooth.log_lik)
        if "posterior" in wanted:
            found["posterior"] = _nested(smooth.gamma, pa.float64())
        if "posterior_q" in wanted:
            found["posterior_q"] = _nested(quantised(smooth.gamma), pa.int16())
    return found


def _mapped(frame: DataFrame, keep: list[str], wanted: tuple[str, ...], kernel: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, dict[str, pa.Array]]]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, found in kernel(b):
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in keep), *(found[w] for w in wanted)], [*keep, *wanted])

    schema = T.StructType([*(frame.schema[c] for c in keep), *(T.StructField(w, OUTPUTS[w]) for w in wanted)])
    return frame.mapInArrow(run, schema)


def decode(frame: DataFrame, params: HMMParams, wanted: tuple[str, ...] = ("states", "log_prob"), column: str = "pct", strict: bool = False, collapse: bool = False) -> DataFrame:
    """Adds the `wanted` outputs to series of integer cover, static transitions; the series column itself is dropped.

    wanted is chosen on the driver, so what isn't asked for isn't computed. A missing value leaves its step without
    evidence; an empty series has no states and likelihood 0. collapse: decode each distinct series once and join
    back, worth its two shuffles only where most series are repeated.
    """
    table, init, trans = zib_table(params.emission), params.log_init, params.log_trans

    def kernel(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        for rows, index in cover_index(b.column(column), strict):
            yield rows, outputs(table[index], init, trans, wanted)

    if collapse:
        apart = frame.select(column).distinct()
        found = _mapped(apart, [column], wanted, kernel)
        return frame.join(found, frame[column].eqNullSafe(found[column])).drop(column)
    return _mapped(frame, [c for c in frame.columns if c != column], wanted, kernel)


def decode_dynamic(frame: DataFrame, params: HMMParams, wanted: tuple[str, ...] = ("states", "log_prob"), column: str = "pct", covariates: str = "x", strict: bool = False) -> DataFrame:
    """The same with transitions of each step from covariates, array<array<double>> (T - 1, D), and params.weights.

    Transition matrices exist only inside the kernel, for one batch. Null and NaN covariates count as 0.
    """
    if params.weights is None:
        raise ValueError("dynamic decoding needs weights")
    table, init, weights = zib_table(params.emission), params.log_init, params.weights
    d = weights.shape[2]

    def kernel(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        steps = b.column(covariates)
        many = np.asarray(pc.fill_null(pc.list_value_length(steps), 0), np.int64)
        start = np.concatenate([[0], np.cumsum(many)])
        flat = np.nan_to_num(np.asarray(pc.fill_null(steps.flatten().flatten(), 0.0), np.float64), posinf=0.0, neginf=0.0).reshape(-1, d)
        for rows, index in cover_index(b.column(column), strict):
            t = index.shape[1]
            if t > 1 and (many[rows] < t - 1).any():
                raise ValueError(f"series of {t} steps need covariates of {t - 1}")
            x = flat[start[rows][:, None] + np.arange(max(t - 1, 0))]
            yield rows, outputs(table[index], init, dynamic_log_trans(x, weights), wanted)

    return _mapped(frame, [c for c in frame.columns if c not in (column, covariates)], wanted, kernel)


def decode_fractions(frame: DataFrame, params: HMMParams, wanted: tuple[str, ...] = ("states", "log_prob"), column: str = "x") -> DataFrame:
    """The same for series of any fractions (array<double>), for which there is no table."""
    from cambium.functions.emission import zib_log_prob

    def kernel(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        lengths = np.asarray(pc.fill_null(pc.list_value_length(b.column(column)), 0), np.int64)
        flat = np.asarray(pc.fill_null(b.column(column).flatten(), np.nan), np.float64)
        start = np.concatenate([[0], np.cumsum(lengths)])
        for t in sorted(set(lengths.tolist())):
            rows = np.flatnonzero(lengths == t)
            x = flat[start[rows][:, None] + np.arange(t)]
            e = np.where(np.isnan(x)[..., None], 0.0, zib_log_prob(np.nan_to_num(x), params.emission))
            yield rows, outputs(e, params.log_init, params.log_trans, wanted)

    return _mapped(frame, [c for c in frame.columns if c != column], wanted, kernel)


def viterbi_expression(frame: DataFrame, params: HMMParams, column: str = "pct") -> DataFrame:
    """states and log_prob by a fold in Spark SQL: slower, and an independent check of the kernel."""
    k = params.n_states
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in zib_table(params.emission)])
    row = lambda v: F.element_at(table, F.coalesce(F.when(v.between(0, 100), v.cast("int") + 1), F.lit(MISSING + 1)))
    start = row(F.col(column)[0])
    first = F.array(*[F.struct((F.lit(float(params.log_init[j])) + start[j]).alias("v"), F.array(F.lit(j).cast("tinyint")).alias("p")) for j in range(k)])

    def best(acc, j):
        options = [F.struct((acc[i]["v"] + F.lit(float(params.log_trans[i, j]))).alias("v"), acc[i]["p"].alias("p")) for i in range(k)]
        out = options[0]
        for o in options[1:]:
            out = F.when(o["v"] > out["v"], o).otherwise(out)
        return out

    def step(acc, v):
        e = row(v)
        return F.transform(F.array(*[F.struct(best(acc, j).alias("b"), F.lit(j).cast("tinyint").alias("j"), e[j].alias("e")) for j in range(k)]), lambda x: F.struct((x["b"]["v"] + x["e"]).alias("v"), F.concat(x["b"]["p"], F.array(x["j"])).alias("p")))

    last = F.aggregate(F.slice(F.col(column), 2, F.greatest(F.size(column) - 1, F.lit(0))), first, step)
    top = F.aggregate(last, F.struct(F.lit(float("-inf")).alias("v"), F.array().cast("array<tinyint>").alias("p")), lambda a, x: F.when(x["v"] > a["v"], x).otherwise(a))
    return frame.select(*[c for c in frame.columns if c != column], top["p"].alias("states"), top["v"].alias("log_prob"))
