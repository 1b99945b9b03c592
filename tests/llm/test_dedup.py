"""Operators 1 and 7, and components, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from cambium.llm import simhash, substrings
from cambium.llm.components import connected_components
from cambium.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept(rows, window):
    """(n_words, n_removed, kept text) of each (id, text)."""
    count = Counter()
    for _, t in rows:
        w = words(t)
        count.update(tuple(w[j : j + window]) for j in range(len(w) - window + 1))
    out = []
    for _, t in rows:
        w = words(t)
        bad = [False] * len(w)
        for j in range(len(w) - window + 1):
            if count[tuple(w[j : j + window])] > 1:
                bad[j : j + window] = [True] * window
        out.append((len(w), sum(bad), " ".join(x for x, b in zip(w, bad) if not b)))
    return out


def removed(frame, window=35):
    return [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(frame, window).collect()]


def key(row):
    return tuple((x is None, x) for x in row)


def test_op1_on_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (n, g, t) in zip(rows, kept(rows, 35))}
    assert {tuple(r) for r in QUERIES["op1_substrings"](spark, SF).collect()} == want


@pytest.mark.parametrize("hot", [2000, 1])
def test_op1_on_periodic_and_near_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD", 3)
    rng = random.Random(1)
    base = [f"w{rng.randrange(50)}" for _ in range(90)]
    texts = [" ".join(["a", "b", "c"] * 20), " ".join(["a"] * 60), "  ".join(base)]
    for i in range(12):
        near = base.copy()
        near[rng.randrange(90)] = f"edit{i}"
        texts.append("\n".join(near[rng.randrange(8) :]))
    texts += [" ".join(f"u{i}_{j}" for j in range(100)) for i in range(3)] + [" ".join(base[:34]), " ".join(base[:35])]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(removed(frame)) == sorted((i, *x) for (i, _), x in zip(rows, kept(rows, 35)))


def test_op1_on_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = sorted(((i, *x) for (i, _), x in zip(rows, kept(rows, 35))), key=key)
    assert sorted(removed(odd_docs), key=key) == want
    out = substrings.remove_repeats(odd_docs)
    assert set(odd_docs.columns) <= set(out.columns) and out.select("key", "spans").distinct().count() == 1
    assert substrings.remove_repeats(no_docs).count() == 0


def test_external_reference(spark):
    rng = random.Random(2)
    secret = " ".join(f"r{rng.randrange(1000)}" for _ in range(50))
    docs = spark.createDataFrame([(1, f"before {secret} after"), (2, "before " + secret[: len(secret) // 2]), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substrings.remove_reference(docs, spark.createDataFrame([(f"x {secret}",), (None,)], "text string")).collect()}
    assert got == {1: "before after", 2: "before " + secret[: len(secret) // 2], 3: None}


def test_suffix_automaton_counts():
    rng = random.Random(0)
    sequences = [([rng.randrange(3) for _ in range(rng.randrange(1, 14))], rng.randrange(1, 4)) for _ in range(12)]
    automaton = substrings.SuffixAutomaton(sequences)
    for size in (1, 2, 3, 5):
        count = Counter()
        for s, w in sequences:
            for j in range(len(s) - size + 1):
                count[tuple(s[j : j + size])] += w
        probe = [rng.randrange(3) for _ in range(60)]
        for least in (1, 2, 4):
            want = [j for j in range(len(probe) - size + 1) if count[tuple(probe[j : j + size])] >= least]
            assert list(automaton.matches(probe, size, least)) == want


def fingerprint(text, n=3):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[j : j + n]).encode(), 42) for j in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_op7_on_the_table(spark):
    docs = {r["doc_id"]: fingerprint(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs)
    want = groups(ids, [(a, b) for a in ids for b in ids if a < b and (docs[a] ^ docs[b]).bit_count() <= 2])
    got = QUERIES["op7_simhash"](spark, SF).collect()
    assert len(got) == len(ids) and all(r["fingerprint"] == f"{docs[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]] for r in got)


def test_links_connect_all_pairs_within_the_radius(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(6)]
    for p in list(prints):
        for _ in range(8):
            p ^= 1 << rng.randrange(64)
            prints.append(p)
    prints = sorted(set(prints))
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    found = connected_components(simhash.links(spark.createDataFrame(signed, "fp long, rep long")))
    want = groups(range(len(prints)), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    got = dict(map(tuple, found.collect()))
    assert all(got.get(i, i) == w for i, w in want.items())


def test_components_of_chains_and_odd_edges(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 1), (200, 205), (205, 210)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = dict(map(tuple, connected_components(frame).collect()))
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[210] == 200 and 7 in got
    assert connected_components(frame.limit(0)).count() == 0


def test_op7_on_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs)
    assert got.count() == odd_docs.count() and simhash.near_duplicates(no_docs).count() == 0
    by = {r["id"]: (r["fp"], r["component"]) for r in got.collect() if r["id"] is not None}
    assert by[0] == by[1] == by[2] == (0, 0) and by[6][1] == 5
    stay = simhash.drop_near_duplicates(odd_docs)
    assert stay.columns == odd_docs.columns
    rows = [r["doc_id"] for r in stay.collect()]
    assert rows.count(None) == 2 and rows.count(5) == 1 and 6 not in rows and 1 not in rows and {0, 3, 4, 8} <= set(rows)
    assert simhash.drop_near_duplicates(no_docs).count() == 0


def test_unlike_texts_under_one_id_both_stay(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(40)) for w in "ab")
    rows = [(5, one), (5, two), (3, two), (7, one + " tail"), (5, one)]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(3, two), (5, one)]
    rows = [(5, one), (5, two), (5, one + " tail")]
    got = [r["text"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == 2 and two in got


@pytest.mark.parametrize("window", [10, 12, 72])
def test_op1_windows(spark, window):
    rng = random.Random(8)
    base = [f"w{rng.randrange(30)}" for _ in range(200)]
    rows = [(i, " ".join(base[rng.randrange(100) :][: rng.randrange(5, 150)])) for i in range(30)]
    got = sorted(removed(spark.createDataFrame(rows, "doc_id long, text string"), window))
    assert got == sorted((i, *x) for (i, _), x in zip(rows, kept(rows, window)))
    with pytest.raises(ValueError, match="window"):
        substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 73 if window == 72 else 9)
