import itertools
import random

import numpy as np
import pytest

from wirelore.llm import near_dedup as nd
from wirelore.llm.components import connected_components


def brute(rows):
    sets = []
    for _, text in rows:
        w = nd.words_of(text or "")
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
            parent[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d if d is not None else -1), len(s), least[root(i)] if d is not None else -1) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def got(docs):
    null = lambda x: -1 if x is None else x
    rows = nd.link_documents(docs).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    return sorted((null(r.doc_id), r.n_shingles, null(r.component_id)) for r in rows)


@pytest.mark.parametrize("chunk", [512, 7])
def test_components_agree_with_all_pairs(make_docs, words, monkeypatch, chunk):
    monkeypatch.setattr(nd, "CHUNK", chunk)
    rng, rows = random.Random(9), []
    for base in range(4):  # dense groups with edits around the limit, quoted passages, copies, short texts
        text = words(rng.choice([12, 40, 120])).split()
        for _ in range(25):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 20))):
                copy[rng.randrange(len(copy))] = rng.choice("abc") + str(rng.random())
            rows.append(" ".join(copy))
    passage = words(60)
    rows += [words(rng.randint(0, 30)) + " " + passage for _ in range(20)] + ["one two", "one two", "ONE\ttwo", "one"] + [rows[0]] * 5
    rng.shuffle(rows)
    rows = [(100 - i if i % 2 else 100 + i, t) for i, t in enumerate(rows)]
    assert got(make_docs(rows)) == brute(rows)


def test_edges(make_docs, odd_docs, odd_rows, words):
    assert got(odd_docs) == brute(odd_rows)
    assert got(odd_docs.limit(0)) == []
    text = words(40)
    rows = [(1, text), (1, words(40)), (2, text + " more"), (3, text), (None, text)]  # a repeated id with two texts
    assert got(make_docs(rows)) == brute(rows)


def test_estimates_keep_pairs_at_the_limit():
    rng = np.random.default_rng(4)
    for size in (20, 64, 80, 400):
        for _ in range(200):
            common = int(np.ceil(0.75 / 1.75 * 2 * size))
            h = np.unique(rng.integers(0, 2**63, 2 * size - common, dtype=np.uint64))
            rng.shuffle(h)
            a, b = np.sort(h[:size]), np.sort(np.concatenate([h[:common], h[size:]]))
            assert nd._estimate(a[: nd.K], b[: nd.K], len(a), len(b))


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 201), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 200, 201: 200}
