"""Mixing to target weights: domain posteriors and document rates by projected-gradient least squares (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.llm import toxicity
from cambium.llm.common import batched, durable, fresh, slices
from cambium.llm.features import passages

DOMAINS = ("good", "poor", "toxic")
#: Shares of the mixed tokens; the good domain is to have `GROWTH` times the tokens that it has.
TARGETS, GROWTH = (0.95, 0.04, 0.01), 1.02
FIT_ROWS = 4000
ROUNDS, CLOSE = 50, 1e-6


@dataclass(frozen=True)
class Rates:
    """Rates after the last round, as what the rounds subtract from 1: all that a document needs besides its posteriors."""

    steps: tuple[tuple[float, ...], ...]
    targets: tuple[float, ...]
    reached: tuple[float, ...]

    def column(self, posteriors: list[Column]) -> Column:
        return _rate(self.steps, posteriors)


def _rate(steps, posteriors: list[Column]) -> Column:
    """The rounds of the projected gradient for one document: from 1, a step against the gradient, then back to >= 0."""
    if not steps:
        return F.lit(1.0)
    every = F.array(*[F.struct(*[F.lit(float(v)).alias(f"u{d}") for d, v in enumerate(u)]) for u in steps])
    move = lambda u: sum((p * u[f"u{d}"] for d, p in enumerate(posteriors)), F.lit(0.0))
    return F.aggregate(every, F.lit(1.0), lambda r, u: F.greatest(F.lit(0.0), r - move(u)))


def posteriors(docs: DataFrame, chain: toxicity.Chain, names: tuple[str, ...], tokens: str) -> DataFrame:
    """docs with one posterior a domain and the number of words in text; whole texts, null and empty ones have 0 words."""
    batched(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for b in slices(batches):
            low, toxic = chain.probabilities(b.column("text")).T
            parts = [(1 - toxic) * (1 - low), (1 - toxic) * low, toxic]
            words = pa.array(passages(b.column("text")).words.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, words, *map(pa.array, parts)], [*b.schema.names, tokens, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField(tokens, T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names)])
    return docs.mapInArrow(run, schema)


def solve(table: DataFrame, targets: tuple[float, ...] = TARGETS, growth: float = GROWTH, rounds: int = ROUNDS) -> Rates:
    """Nonnegative rates r of a table (n, p0, p1, ...) whose expected domain totals sum(r n p) match the targets.

    Least squares in the residuals of the D domains, under the metric of the inverse Gram matrix sum(n p p'), in which
    the step length 1 is safe; rates start at 1 and stay as near as the gradient leaves them. A round is one aggregation
    to D sums; a document's rate is computed anew from the D numbers of each round before, so no state is kept between
    rounds. Domains without tokens, or an empty table, leave their part of the rates alone.
    """
    d = len(targets)
    p = [F.col(f"p{i}") for i in range(d)]
    gram = table.agg(*[F.sum(F.col("n") * p[i] * p[j]) for i in range(d) for j in range(i, d)], *[F.sum(F.col("n") * x) for x in p]).first()
    values = [float(v or 0.0) for v in gram]
    have, metric, k = np.array(values[-d:]), np.zeros((d, d)), 0
    for i in range(d):
        for j in range(i, d):
            metric[i, j] = metric[j, i] = values[k]
            k += 1
    if not have[0] or not targets[0]:
        return Rates((), tuple(have.tolist()), tuple(have.tolist()))
    goal = growth * have[0] / targets[0] * np.array(targets)
    goal[have == 0] = 0
    inverse, steps, now = np.linalg.pinv(metric, rcond=1e-10), [], have
    for _ in range(rounds):
        if np.abs(now - goal).max() <= CLOSE * goal.sum():
            break
        steps.append(tuple((inverse @ (now - goal)).tolist()))
        r = _rate(steps, p)
        now = np.array([float(v or 0.0) for v in table.agg(*[F.sum(F.col("n") * x * r) for x in p]).first()])
    return Rates(tuple(steps), tuple(goal.tolist()), tuple(now.tolist()))


def _table(docs: DataFrame, chain: toxicity.Chain) -> DataFrame:
    return posteriors(docs, chain, ("p0", "p1", "p2"), "n")


def rates(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS, growth: float = GROWTH) -> DataFrame:
    """(doc_id, n_tokens, p_good, p_poor, p_toxic, rate) for every row of docs.

    The classifier is fitted on a bounded sample of labelled rows; posteriors, totals and rates cover all rows. Null
    and empty texts have no tokens, weigh nothing and get a rate like any other; repeated rows get equal rates.
    """
    chain = toxicity.fit(docs, labels, FIT_ROWS)
    table = durable(_table(docs.select("doc_id", "text"), chain).select("doc_id", "n", "p0", "p1", "p2"))
    found = solve(table, targets, growth)
    return table.select("doc_id", F.col("n").alias("n_tokens"), *[F.col(f"p{i}").alias(f"p_{name}") for i, name in enumerate(DOMAINS)], found.column([F.col(f"p{i}") for i in range(3)]).alias("rate"))


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS, growth: float = GROWTH, key: int = 20) -> DataFrame:
    """docs with mix_rate and mix_copies, without the rows that get no copy.

    mix_copies is the whole part of the rate, and one more with the probability of its fraction, drawn from a keyed
    hash of doc_id and text (equal rows draw equally). Texts aren't shuffled: posteriors are computed again here.
    """
    chain = toxicity.fit(docs, labels, FIT_ROWS)
    table = durable(_table(docs.select("text"), chain).select("n", "p0", "p1", "p2"))
    found = solve(table, targets, growth)
    names, tokens = tuple(fresh("p") for _ in DOMAINS), fresh("n")
    draw = F.pmod(F.xxhash64(F.lit(key), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rate = found.column([F.col(n) for n in names])
    out = posteriors(docs.drop("mix_rate", "mix_copies"), chain, names, tokens).withColumn("mix_rate", rate).drop(*names, tokens)
    return out.withColumn("mix_copies", (F.floor("mix_rate") + (draw < F.col("mix_rate") - F.floor("mix_rate")).cast("int")).cast("int")).where("mix_copies > 0")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return rates(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
