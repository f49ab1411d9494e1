import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (id, text) pairs, with further columns that clash with names used inside the operators."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), i, "x", 1, "y") for i, t in rows]
        return spark.createDataFrame(full, DOCS + ", row long, word string, n long, sketch string")

    return make


@pytest.fixture
def written(monkeypatch, tmp_path):
    """Labels of the tables in the shared folder, which is empty at first."""
    from wirelore import session
    from wirelore.llm import tables

    kept = tmp_path / "kept"
    kept.mkdir()
    folder = lambda spark, label: f"file://{kept}/{label}-{len(made)}{made.append(label) or ''}"
    made = []
    monkeypatch.setattr(session, "shared_folder", folder)
    monkeypatch.setattr(tables, "shared_folder", folder)
    return lambda: sorted(p.name.rsplit("-", 1)[0] for p in kept.iterdir())


@pytest.fixture
def words():
    rng = random.Random(5)
    parts = "ka lo mi ne tu ra si vo pe du fa gi".split()

    def some(n, seed=None):
        r = rng if seed is None else random.Random(seed)
        return " ".join("".join(r.choice(parts) for _ in range(r.randint(2, 4))) for _ in range(n))

    return some


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "word"), (4, "word"), (None, "word two three four five six"), (5, "é ü 日本語 😀 \u0001 <|endoftext|> \x1c's"), (6, "a " * 30_000)]


@pytest.fixture
def odd_docs(make_docs):
    return make_docs(ODD)


@pytest.fixture
def odd_rows():
    return ODD
