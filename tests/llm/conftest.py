from __future__ import annotations

import random

import pytest

#: Columns whose names clash with what operators use inside or add.
EXTRA = "key string, spans string, lang_pred string, secrets string, n string, mix_rate string, h string, surrogate string, n_words string"


def sentence(rng: random.Random, n: int, stock: list[str]) -> str:
    return " ".join(rng.choice(stock) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null in every column, empty and blank texts, a very long one, copies, repeated rows, clashing column names."""
    rng = random.Random(5)
    stock = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    base = sentence(rng, 120, stock)
    texts = [None, "", " \n\t ", "one", "Two words", base, base, base + " tail", sentence(rng, 30_000, stock), "Ünïcode ß 漢字 " + base[:200], "x" * 5000]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, *["clash"] * 9) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
