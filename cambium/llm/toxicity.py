"""Toxicity by a chain of linear classifiers trained with out-of-fold probabilities (operator 6)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cambium.llm.common import batched, slices
from cambium.llm.features import BUCKETS, N_STATS, N_TEXT, bag, labelled_sample, passages

#: Labelled documents that the chain is fitted on, at most (about).
FIT_ROWS = 12000
#: Hashed words kept for each category, those whose share differs most between its classes.
FEATURES = 3000
FOLDS = 3
#: Steps in which cuts are tried on out-of-fold probabilities.
CUTS = np.arange(0.05, 0.951, 0.05)
#: The categories in the order of the chain: name, label column, the label's value that means the category.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


@dataclass(frozen=True)
class Linear:
    bias: float
    words: np.ndarray
    dense: np.ndarray


@dataclass(frozen=True)
class Chain:
    """Linear models in order; the dense inputs of each end with the log odds of the categories before it."""

    names: tuple[str, ...]
    wanted: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    models: tuple[Linear, ...]
    #: For each category the probability from which on a document counts as of it.
    cuts: tuple[float, ...]

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """(texts, categories)."""
        owner, word = bag(texts, self.wanted)
        dense = (_whole(texts) - self.mean) / self.scale
        out = []
        for model in self.models:
            extra = np.hstack([np.clip(dense, -6, 6), *[_logit(p)[:, None] for p in out]])
            out.append(np.round(_sigmoid(model.bias + np.bincount(owner, model.words[word], len(texts)) + extra @ model.dense), 9))  # the last bits depend on the place in the batch
        return np.stack(out, axis=1) if out else np.zeros((len(texts), 0))


def _whole(texts: pa.Array) -> np.ndarray:
    """Statistics of whole texts: the mean over their passages."""
    found = passages(texts)
    return np.add.reduceat(found.stats, found.first[:-1], axis=0) / np.diff(found.first)[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def logistic(owner: np.ndarray, word: np.ndarray, n_words: int, dense: np.ndarray, y: np.ndarray, steps: int = 200, decay: float = 5e-5, rate: float = 0.1) -> Linear:
    """Log loss with an L2 penalty by Adam over all rows; with one class only, its smoothed share as the bias."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias, w, d = np.log(share / (1 - share)), np.zeros(n_words), np.zeros(dense.shape[1])
    if len(set(y.tolist())) < 2:
        return Linear(float(bias), w, d)
    x, n = np.concatenate([[bias], w, d]), len(y)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        p = _sigmoid(x[0] + np.bincount(owner, x[1 + word], n) + dense @ x[1 + n_words :])
        up = (p - y) / n
        g = np.concatenate([[up.sum()], np.bincount(word, up[owner], n_words), up @ dense])
        g[1:] += decay * x[1:]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    return Linear(float(x[0]), x[1 : 1 + n_words], x[1 + n_words :])


def _select(owner: np.ndarray, bucket: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Buckets in four rows or more, the FEATURES whose log shares in the classes differ most for their number."""
    yes = np.bincount(bucket, y[owner], BUCKETS)
    every = np.bincount(bucket, minlength=BUCKETS)
    n_yes = y.sum()
    gain = np.abs(np.log((yes + 0.5) / (n_yes + 1)) - np.log((every - yes + 0.5) / (len(y) - n_yes + 1))) * np.sqrt(every)
    gain[every < 4] = 0
    return np.sort(np.argsort(-gain, kind="stable")[: min(FEATURES, int((gain > 0).sum()))])


def _fitted(owner: np.ndarray, bucket: np.ndarray, dense: np.ndarray, y: np.ndarray, keep: np.ndarray) -> tuple[Linear, np.ndarray]:
    """A model over the kept buckets, and the number of each bucket in it."""
    wanted = np.full(BUCKETS, -1, np.int32)
    wanted[keep] = np.arange(len(keep))
    word = wanted[bucket]
    return logistic(owner[word >= 0], word[word >= 0], len(keep), dense, y), wanted


def _out_of_fold(owner: np.ndarray, bucket: np.ndarray, dense: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Each row's probability from a model that its fold had no part in, the choice of words included."""
    n, out = len(y), np.zeros(len(y))
    for f in range(FOLDS):
        rows = np.flatnonzero(fold != f)
        place = np.full(n, -1)
        place[rows] = np.arange(len(rows))
        inside = place[owner] >= 0
        model, wanted = _fitted(place[owner[inside]], bucket[inside], dense[rows], y[rows], _select(place[owner[inside]], bucket[inside], y[rows]))
        word = wanted[bucket]
        score = model.bias + np.bincount(owner[word >= 0], model.words[word[word >= 0]], n) + dense @ model.dense
        out[fold == f] = _sigmoid(score)[fold == f]
    return out


def _cut(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the largest F1 (ties: the smallest); one half without both classes."""
    if len(set(y.tolist())) < 2:
        return 0.5
    return float(CUTS[int(np.argmax([2 * y[p >= c].sum() / ((p >= c).sum() + y.sum()) for c in CUTS]))])


def train(owner: np.ndarray, bucket: np.ndarray, dense: np.ndarray, labels: list[np.ndarray], names: tuple[str, ...], fold: np.ndarray | None = None) -> Chain:
    """The chain from (row, bucket) pairs, dense statistics and one 0/1 array a category.

    What a later model learns from are out-of-fold probabilities: each row's come from earlier models fitted without
    its fold, their words chosen without it too. What it gets in use are those of models fitted on all rows. The cuts
    come from out-of-fold probabilities as well.
    """
    n = dense.shape[0]
    mean, scale = (dense.mean(0), dense.std(0) + 1e-6) if n else (np.zeros(dense.shape[1]), np.ones(dense.shape[1]))
    x = np.clip((dense - mean) / scale, -6, 6)
    keep = np.unique(np.concatenate([_select(owner, bucket, y) for y in labels])) if n else np.zeros(0, np.int64)
    fold = np.arange(n) % FOLDS if fold is None else fold
    models, cuts, wanted = [], [], np.full(BUCKETS, -1, np.int32)
    for y in labels:
        model, wanted = _fitted(owner, bucket, x, y, keep)
        apart = _out_of_fold(owner, bucket, x, y, fold) if n else np.zeros(0)
        models.append(model)
        cuts.append(_cut(apart, y))
        x = np.hstack([x, _logit(apart)[:, None]])
    return Chain(names, wanted, mean, scale, tuple(models), tuple(cuts))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, categories: tuple[tuple[str, str, int], ...] = CATEGORIES) -> Chain:
    """The chain from whole texts of a bounded sample of labelled documents; hashed words and statistics are gathered. Copies of a text are in one fold."""
    batched(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            owner, bucket = bag(b.column("text"))
            edges = np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32)
            stats = _whole(b.column("text"))
            dense = pa.ListArray.from_arrays(pa.array((np.arange(b.num_rows + 1) * stats.shape[1]).astype(np.int32)), pa.array(stats.astype(np.float32).ravel()))
            words = pa.ListArray.from_arrays(pa.array(edges), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), *(b.column(c).cast(pa.int32()) for _, c, _ in categories), words, dense, pa.array([zlib.crc32((t or "").encode()) % FOLDS for t in b.column("text").to_pylist()], pa.int32())], ["id", *(f"y{i}" for i in range(len(categories))), "words", "dense", "fold"])

    schema = ", ".join(["id string", *(f"y{i} int" for i in range(len(categories))), "words array<int>", "dense array<float>", "fold int"])
    got = labelled_sample(docs, labels, rows).mapInArrow(run, schema).toArrow().sort_by("id")
    words = got.column("words").combine_chunks()
    many = np.diff(np.asarray(words.offsets, np.int64))
    owner, bucket = np.repeat(np.arange(len(many)), many), np.asarray(words.flatten(), np.int64)
    dense = np.asarray(got.column("dense").combine_chunks().flatten(), np.float64).reshape(-1, N_STATS + N_TEXT)
    y = [(np.asarray(got.column(f"y{i}"), np.int64) == value).astype(np.float64) for i, (_, _, value) in enumerate(categories)]
    return train(owner, bucket, dense, y, tuple(name for name, _, _ in categories), np.asarray(got.column("fold"), np.int64))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_<category> ...) of every row of docs, in one narrow pass.

    Whole texts count, whatever their length; a null or empty text has no words and statistics of zero, and gets
    probabilities too. Equal texts get equal probabilities; other columns of docs aren't looked at.
    """
    batched(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{n}" for n in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for b in slices(batches):
            p = chain.probabilities(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(p[:, i]) for i in range(p.shape[1]))], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{n} double" for n in names)]))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, chain).selectExpr("doc_id", "p_low_quality", "p_toxic", f"p_toxic >= {chain.cuts[1]!r}D AS toxic")
