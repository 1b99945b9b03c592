"""Quality by attention-based multiple-instance learning over passages (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.llm.common import batched, held_out, slices
from cambium.llm.features import N_STATS, N_TEXT, N_WORDS, labelled_sample, passages

#: Labelled documents that the model is fitted on, at most (about).
FIT_ROWS = 6000
HIDDEN, GATE = 16, 8


@dataclass(frozen=True)
class AttentionModel:
    """h = tanh(W x + b); attention softmax over w . (tanh(V h) * sigmoid(U h)); score = sigmoid(c . sum a h + d)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, stats: np.ndarray, first: np.ndarray) -> np.ndarray:
        p = _forward(self.weights, np.clip((stats - self.mean) / self.scale, -6, 6), first)[0]
        return np.round(p, 9)  # the last bits depend on the place in the batch


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> tuple:
    h = np.tanh(x @ w["W"] + w["b"])
    left, right = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    raw = (left * right) @ w["w"]
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    e = np.exp(raw - np.maximum.reduceat(raw, first[:-1])[bag])
    a = e / np.add.reduceat(e, first[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    return _sigmoid(z @ w["c"] + w["d"]), h, left, right, a, z, bag


def train(stats: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Adam on the log loss of document labels; passages have no labels of their own. Without two classes: the share of label 1."""
    rng = np.random.default_rng(seed)
    d = stats.shape[1]
    mean, scale = (stats.mean(0), stats.std(0) + 1e-6) if len(stats) else (np.zeros(d), np.ones(d))
    w = {"W": rng.normal(0, d**-0.5, (d, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(())}
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return AttentionModel(mean, scale, w | {"c": np.zeros(HIDDEN), "d": np.log(share / (1 - share))})
    x = np.clip((stats - mean) / scale, -6, 6)
    m, v, t = {k: 0.0 * p for k, p in w.items()}, {k: 0.0 * p for k, p in w.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            pick = order[at : at + batch]
            many = first[pick + 1] - first[pick]
            own = np.concatenate([[0], np.cumsum(many)])
            xs = x[np.repeat(first[pick] - own[:-1], many) + np.arange(own[-1])]
            p, h, left, right, a, z, bag = _forward(w, xs, own)
            up = (p - y[pick]) / len(pick)
            dz = up[:, None] * w["c"]
            da = (dz[bag] * h).sum(1)
            draw = a * (da - np.add.reduceat(a * da, own[:-1])[bag])
            dleft, dright = draw[:, None] * w["w"] * right * (1 - left**2), draw[:, None] * w["w"] * left * right * (1 - right)
            dh = (a[:, None] * dz[bag] + dleft @ w["V"].T + dright @ w["U"].T) * (1 - h**2)
            grad = {"W": xs.T @ dh, "b": dh.sum(0), "V": h.T @ dleft, "U": h.T @ dright, "w": (left * right).T @ draw, "c": z.T @ up, "d": up.sum()}
            t += 1
            for k in w:
                g = grad[k] + decay * w[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return AttentionModel(mean, scale, w)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> AttentionModel:
    """The model from whole texts of a bounded sample of labelled, not held-out documents; only passages' inputs (statistics and projected words) are gathered."""
    batched(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = passages(b.column("text"), projected=True)
            flat = pa.array(found.stats.astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), b.column("quality").cast(pa.int32()), pa.ListArray.from_arrays(pa.array((found.first * found.stats.shape[1]).astype(np.int32)), flat)], ["id", "y", "x"])

    sample = labelled_sample(docs, labels, rows, ("quality",)).select("doc_id", "text", "quality").mapInArrow(run, "id string, y int, x array<float>").toArrow().sort_by("id")
    d = N_STATS + N_TEXT + N_WORDS
    lists = sample.column("x").combine_chunks()
    many = np.asarray(pc.list_value_length(lists), np.int64) // d
    flat = np.asarray(lists.flatten(), np.float64).reshape(-1, d)
    return train(flat, np.concatenate([[0], np.cumsum(many)]), np.asarray(sample.column("y"), np.float64))


def score(docs: DataFrame, model: AttentionModel, cut: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row of docs (doc_id, text), in one narrow pass.

    Every passage of a whole text is encoded, whatever its length; an empty or null text is one passage of zeros and
    gets a score too. Equal texts get equal scores; predicted is 1 from `cut` on.
    """
    batched(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches):
            found = passages(b.column("text"), projected=True)
            p = model.scores(found.stats, found.first)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out().alias("held_out"), "score", F.col("predicted"))
