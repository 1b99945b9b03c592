"""Operators 4, 6, 9 and 10, the features, and the pipeline."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cambium.llm import features, mixing, quality, topk, toxicity
from cambium.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def labels(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_passages_and_bags():
    texts = pa.array(["", None, "Hello hello, world!\n a | b", "ÀB cd " + "w " * 200])
    p = features.passages(texts)
    assert p.words.tolist() == [0, 0, 6, 202] and p.first.tolist() == [0, 1, 2, 3, 7]
    assert not p.stats[:2, : features.N_STATS].any() and np.isfinite(p.stats).all()
    whole = features.passages(texts.slice(2))
    assert np.allclose(whole.stats, p.stats[2:])
    owner, bucket = features.bag(texts)
    assert set(owner.tolist()) == {2, 3} and (bucket < features.BUCKETS).all()


def test_op10_separates_held_out_labels(spark):
    known = labels(spark)
    got = QUERIES["op10_quality"](spark, SF).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] in known]
    right = [r["predicted"] == known[r["doc_id"]]["quality"] for r in held]
    assert np.mean(right) > 0.95 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_attention_gradient():
    rng = np.random.default_rng(0)
    first = np.array([0, 3, 4, 9, 12])
    x, y = rng.normal(size=(12, 5)), np.array([1.0, 0, 1, 0])
    model = quality.train(x, first, y, epochs=200)
    p = model.scores(x, first)
    assert ((p > 0.5) == (y > 0.5)).all()
    only = quality.train(x, first, np.ones(4))
    assert np.allclose(only.scores(x, first), 0.9)


def test_op6_catches_held_out_toxic_documents(spark):
    known = labels(spark)
    got = {r["doc_id"]: r for r in QUERIES["op6_toxicity"](spark, SF).collect()}
    toxic = [i for i, r in known.items() if r["toxic"] == 1]
    plain = [i for i, r in known.items() if r["toxic"] == 0]
    assert np.mean([got[i]["toxic"] for i in toxic]) > 0.85 and np.mean([got[i]["toxic"] for i in plain]) < 0.02


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(1)
    n = 600
    first = (rng.random(n) < 0.5).astype(float)
    second = first.copy()
    dense = np.column_stack([first + rng.normal(0, 0.3, n), rng.normal(size=n)])
    chain = toxicity.train(np.zeros(0, np.int64), np.zeros(0, np.int64), dense, [first, second], ("a", "b"))
    assert chain.models[0].dense.shape == (2,) and chain.models[1].dense.shape == (3,) and chain.models[1].dense[2] > 0


@pytest.mark.parametrize("score", ["quality", "toxicity"])
def test_scores_on_odd_rows(spark, odd_docs, no_docs, score):
    docs, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    module = {"quality": quality, "toxicity": toxicity}[score]
    model = module.fit(docs, lab)
    got = module.score(odd_docs, model)
    assert got.count() == odd_docs.count() and got.dropna(subset=got.columns[1:]).count() == odd_docs.count()
    assert got.where("doc_id = 5").distinct().count() == 1 and module.score(no_docs, model).count() == 0
    blank = module.fit(docs, lab.limit(0))
    assert module.score(odd_docs, blank).count() == odd_docs.count()


def test_op4_meets_its_targets(spark):
    rows = QUERIES["op4_mixing"](spark, SF).toPandas()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and (rows.rate >= 0).all()
    p = rows[["p_good", "p_poor", "p_toxic"]].to_numpy()
    assert np.allclose(p.sum(1), 1)
    total = (rows.rate * rows.n_tokens).to_numpy() @ p
    assert np.allclose(total / total.sum(), mixing.TARGETS, atol=1e-4)


def test_solver_equals_plain_projected_gradient(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    n = rng.integers(0, 500, 300)
    frame = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n long, p0 double, p1 double, p2 double")
    for targets in ((0.95, 0.04, 0.01), (0.2, 0.2, 0.6)):
        found = mixing.solve(frame, targets)
        r = np.ones(300)
        goal = np.array(found.targets)
        inverse = np.linalg.pinv((p * n[:, None]).T @ p)
        losses = []
        for _ in found.steps:
            miss = (n * r) @ p - goal
            losses.append(miss @ inverse @ miss)
            r = np.maximum(0, r - p @ (inverse @ miss))
        got = frame.select(found.column([F.col(f"p{i}") for i in range(3)]).alias("r")).toPandas().r
        assert np.allclose(got, r) and np.allclose(found.reached, (n * r) @ p) and (np.diff(losses) <= 1e-9).all()


def test_op4_on_odd_rows(spark, odd_docs, no_docs):
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    assert mixing.rates(odd_docs, lab).count() == odd_docs.count() and mixing.rates(no_docs, lab).count() == 0
    out = mixing.mixed_documents(odd_docs, lab)
    assert set(odd_docs.columns) | {"mix_copies"} == set(out.columns) and out.where("mix_copies < 1").count() == 0
    assert mixing.mixed_documents(no_docs, lab).count() == 0


def test_op9_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = db.sql(ORACLES["op9_topk"]).fetchall()
    got = QUERIES["op9_topk"](spark, SF).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_op9_ties_bad_vectors_and_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("QUERIES", 8), ("GROUP", 2), ("SEEDS", 40), ("PIVOTS", 4)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(3)
    vectors = [(i, rng.integers(-2, 3, 4).astype(float).tolist() if i % 3 else [1.0, 0.0, 0.0, 1.0]) for i in range(400)]
    bad = [(1000, None), (1001, [1.0, None, 0.0, 0.0]), (1002, [float("nan"), 0.0, 0.0, 0.0]), (1003, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (1020, [])]
    frame = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(frame, F.col("vec_id") % 20 == 0, 7).collect())
    x = np.floor(64 * np.array([v for _, v in vectors])).astype(int)
    want = []
    for q in range(0, 400, 20):
        order = sorted((-int(x[q] @ x[i]), i) for i in range(400) if i != q)[:7]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(order, 1)]
    assert got == want
    few = topk.search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"), F.col("vec_id") == 0, 20).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 64 * 128)]
    assert topk.search(frame.limit(0), F.col("vec_id") == 0, 3).count() == 0


def test_pipeline_against_brute_force(spark):
    """Each stage held against the plain computation of what it may keep, on its own input."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = docs.sparkSession.createDataFrame(stage(spark, docs, SF).toArrow())
        now = {r["doc_id"]: r for r in docs.collect()}
        assert set(now) <= set(before) and len(now) == docs.count()
        gone = set(before) - set(now)
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language_id":
            assert len(gone) < 0.03 * len(before)
        elif name == "near_dedup":
            texts = {}
            for r in before.values():
                texts.setdefault(r["text"], []).append(r["doc_id"])
            assert all(not set(ids[1:]) & set(now) for ids in (sorted(v) for v in texts.values()))
        elif name == "decontamination":
            assert {i for i, r in before.items() if any(b in r["text"] for b in bench)} <= gone
        elif name == "pii":
            from cambium.llm.pii import entities

            assert not gone and all(now[i]["text"] == r["text"] for i, r in before.items() if not entities(r["text"]))
        else:
            known = labels(spark)
            clean = [i for i in before if i in known and known[i]["quality"] == 1 and known[i]["toxic"] == 0]
            assert set(clean) <= set(now)
        before = now


def test_pipeline_takes_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def near_dedup_by_all_pairs(rows):
    """doc_ids that stay: the smallest of each component of all pairs with five-word Jaccard >= 0.8."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    ids = sorted(first.values())
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {i for i in ids if root[i] == i}


def test_near_dedup_against_all_pairs(spark):
    """Both directions: no two similar documents stay, no unlike document goes; edits of 1 to 40 % are planted."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rng = np.random.default_rng(11)
    long = [r for r in rows if r[1] and 60 <= len(r[1].split()) <= 600][:60]
    for k, r in enumerate(x for x in long for _ in range(3)):
        words = r[1].split()
        for at in rng.integers(0, len(words), max(1, len(words) * (k % 8) // 100)):
            words[at] = f"edit{k}"
        rows.append((1_000_000 + k, " ".join(words), *r[2:]))
    common = " ".join(f"line{i}" for i in range(40))
    rows += [(2_000_000 + k, f"{common} {' '.join(f'own{k}x{j}' for j in range(k))}", "en", "s", 0) for k in range(30)]
    want = near_dedup_by_all_pairs([r[:2] for r in rows])
    frame = spark.createDataFrame(rows, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, SF).select("doc_id").collect()}
    assert got == want
    assert 50 < sum(i >= 1_000_000 for i, *_ in rows) - sum(i >= 1_000_000 for i in want) < 210


def best_by_brute_force(rows, asks, k):
    """Sorted (query_id, rank, vec_id, score), every row a candidate but the query's own, in integers."""
    whole = [(i, [int(np.floor(64 * np.float64(x))) for x in v]) for i, v in rows]
    want = []
    for at, (q, v) in enumerate(whole):
        if asks(q):
            scores = sorted((-max(-topk.LIMIT, min(topk.LIMIT, sum(a * b for a, b in zip(v, x)))), i) for j, (i, x) in enumerate(whole) if j != at and len(x) == len(v))
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(want)


@pytest.mark.parametrize("kind", ["repeated", "ragged", "large", "huge", "chunks", "clustered"])
def test_op9_odd_vectors_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(5)
    if kind == "repeated":
        rows = [(int(i), rng.integers(-2, 3, 3).astype(float).tolist()) for i in rng.integers(0, 40, 120)]
        rows += rows[:30] + [(20, [9.0, 9.0, 9.0])] * 9 + [(21, [8.0, 9.0, 9.0])] * 3
    elif kind == "ragged":
        rows = [(i, rng.normal(size=1 + i % 3).tolist()) for i in range(90)]
    elif kind == "large":
        rows = [(i, (rng.normal(size=5) * 10.0**6 + 1e8).tolist()) for i in range(150)]
    elif kind == "huge":
        rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(0, 30)).tolist()) for i in range(120)]
    elif kind == "chunks":
        monkeypatch.setattr(topk, "CHUNK", 6)
        monkeypatch.setattr(topk, "QUERIES", 2)
        rows = [(i, rng.normal(size=6).tolist()) for i in range(200)]
    else:
        rows = [(i, (np.eye(8)[i % 8] * 5 + rng.normal(size=8) * 0.1).tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.search(frame, F.col("vec_id") % 20 == 0, 7).collect()
    assert sorted(map(tuple, got)) == best_by_brute_force(rows, lambda q: q % 20 == 0, 7)


def test_near_dedup_recall_at_the_threshold(spark):
    """Pairs of a similarity of 0.80 to 0.83, alone and among many documents that share a passage: at least 0.99 are found."""
    from cambium.llm import shingles

    rng = np.random.default_rng(3)
    passage = [f"line{i}" for i in range(60)]
    rows, pairs = [], []
    for k in range(300):
        words = [f"w{x}" for x in rng.integers(0, 5000, 250)]
        if k % 2:
            words[100:160] = passage
        twin = words.copy()
        base = {tuple(words[i : i + 5]) for i in range(246)}
        for at in rng.permutation(250):
            new = twin.copy()
            new[at] = f"edit{k}x{at}"
            other = {tuple(new[i : i + 5]) for i in range(246)}
            if 5 * len(base & other) < 4 * len(base | other):
                break
            twin = new
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(twin))]
        pairs.append((2 * k, 2 * k + 1))
    part = dict(map(tuple, shingles.components(spark.createDataFrame(rows, "h long, text string"), 5).collect()))
    assert np.mean([part[a] == part[b] for a, b in pairs]) >= 0.99
    assert len(set(part.values())) >= 299


@pytest.mark.parametrize("original", [True, False])
def test_near_dedup_of_a_large_edited_group(spark, original):
    """One text edited 0 to 12 times, by words replaced, dropped and added, some copies edited again: as by all pairs."""
    import corpus_pipeline

    rng = np.random.default_rng(17)
    base, own = [f"w{x}" for x in rng.integers(0, 900, 150)], iter(range(10**6))

    def edited(words, times):
        words = list(words)
        for _ in range(times):
            at, kind = int(rng.integers(0, len(words))), int(rng.integers(0, 3))
            words[at : at + (kind != 2)] = [] if kind == 1 else [f"edit{next(own)}"]
        return words

    texts = [base] * original + [edited(base, 1 + k % 12) for k in range(250)]
    texts += [edited(texts[k], 1 + k % 4) for k in range(0, 250, 3)]
    rows = [(k, " ".join(t), "en", "s", 0) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, SF).select("doc_id").collect()}
    want = near_dedup_by_all_pairs([r[:2] for r in rows])
    assert got == want and 20 < len(want) < 300


def test_near_dedup_of_many_texts_with_a_passage(spark, monkeypatch):
    """As by all pairs; of unlike texts that share a passage, no share of all pairs is verified."""
    import corpus_pipeline
    from cambium.llm import shingles

    rng = np.random.default_rng(23)
    passage, texts = [f"line{i}" for i in range(60)], []
    for k in range(600):
        own = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(12, 110)))]
        texts.append(own[: len(own) // 2] + passage + own[len(own) // 2 :])
    for k in range(0, 600, 20):
        twin = texts[k].copy()
        for at in rng.integers(0, len(twin), 1 + k // 20 % 4):
            twin[at] = f"edit{k}"
        texts.append(twin)
    rows = [(k, " ".join(t), "en", "s", 0) for k, t in enumerate(texts)]
    verified, many = shingles._verified, []

    def counted(pairs, *more):
        many.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(shingles, "_verified", counted)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, SF).select("doc_id").collect()}
    assert got == near_dedup_by_all_pairs([r[:2] for r in rows])
    assert many and sum(many) < len(rows)


@pytest.mark.parametrize("told", [0, 2, 40])
def test_prefixes_of_similar_sets_meet(told):
    """Whatever is known of the frequent shingles, two sets of similarity 0.8 share one of their first fifths; in the smaller, one of its first ninth."""
    from cambium.llm import shingles

    rng = np.random.default_rng(29)
    common = rng.integers(0, 2**63, 40).astype(np.uint64)
    frequent = np.sort(common[:told])
    rank = rng.permutation(told)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(np.concatenate([rng.choice(common, min(n, 20), replace=False), rng.integers(0, 2**63, n).astype(np.uint64)]))
        b = np.unique(np.concatenate([rng.permutation(a)[int(rng.integers(0, len(a) // 9 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, len(a) // 9 + 1))).astype(np.uint64)]))
        if 5 * len(np.intersect1d(a, b)) < 4 * len(np.union1d(a, b)):
            continue
        sets, offsets = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        at, place = shingles._prefixes(sets, offsets, frequent, rank)
        first, second = ({int(sets[i]): p for i, p in zip(at, place) if (i >= len(a)) == side} for side in (False, True))
        if len(a) < len(b):
            first, second = second, first
        assert any(x in first and p <= min(len(a), len(b)) // 9 for x, p in second.items())


def test_op6_and_op10_held_out_figures(spark):
    """Only rows that no model learned from, on a table that has enough toxic ones; figures are in the README."""
    import zlib

    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/labels.parquet").collect()
    known = {r["doc_id"]: r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    got = {r["doc_id"]: r["toxic"] for r in QUERIES["op6_toxicity"](spark, sf).collect()}
    toxic, plain = ([got[i] for i, r in known.items() if r["toxic"] == x] for x in (1, 0))
    assert np.mean(toxic) >= 0.8 and np.mean(plain) <= 0.02
    quality = {r["doc_id"]: r["predicted"] for r in QUERIES["op10_quality"](spark, sf).collect()}
    assert np.mean([quality[i] == r["quality"] for i, r in known.items()]) > 0.95


def test_words_of_a_fold_are_chosen_without_it():
    """A word that only one row has can't tell that row's own label."""
    rng = np.random.default_rng(4)
    y = (rng.random(300) < 0.5).astype(float)
    owner, bucket = np.repeat(np.arange(300), 8), rng.integers(0, 200, 2400)
    got = toxicity._out_of_fold(owner, bucket, np.zeros((300, 1)), y, np.arange(300) % 3)
    assert abs(np.corrcoef(got, y)[0, 1]) < 0.2
