import math
import random
import zlib
from collections import Counter

import numpy as np

from wirelore.llm import suffix_tree as st


def base(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter()
    for i, t in rows:
        if not held(i):
            count.update([*st.words_of(t or ""), "end"])
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        tokens = [*st.words_of(t or ""), "end"]
        out.append((-1 if i is None else i, held(i), len(tokens), sum(count[w] > 0 for w in tokens), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), 6)))
    return sorted(out)


def got(rows):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)


def test_base_columns_and_gain(make_docs):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    text = lambda: " ".join(w + " " + w.upper() + "x" for w in (rng.choice(words) for _ in range(60))) + f" rare{rng.random()}"
    rows = [(i, text()) for i in range(120)]
    found = st.score_texts(make_docs(rows)).collect()
    assert got(found) == base(rows)
    assert all(r.score > r.base_score * 0.75 for r in found if r.held_out)  # every second word follows from the one before


def test_edges(odd_docs, odd_rows):
    assert got(st.score_texts(odd_docs).collect()) == base(odd_rows)
    assert st.score_texts(odd_docs.limit(0)).count() == 0
    only_held = [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in st.score_texts(odd_docs.sparkSession.createDataFrame(only_held, "doc_id long, text string")).collect())


def test_distributions_add_up():
    import pandas as pd

    rng = np.random.default_rng(3)
    size = 12
    symbols = rng.integers(2, size, 4000).astype(np.uint16)
    symbols[1::2] = (symbols[::2] + 1 - 2) % (size - 2) + 2
    counted = []
    for d in (1, 2):
        key, n = np.unique(st._keys(symbols, d), return_counts=True)
        counted.append(pd.DataFrame({"key": key.view(np.int64), "n": n})[n > 3])
    counts = np.bincount(symbols, minlength=size)
    root = (counts + 0.1) / (counts + 0.1).sum()
    tree = st.grow(root, counts, counted)
    assert len(tree.levels[0].contexts)
    for history in range(0, 4000, 97):
        h = np.full(size, (int(symbols[history]) << 16) | int(symbols[history + 1]), np.uint64)
        assert abs(tree.probability(h, np.arange(size).astype(np.uint16)).sum() - 1) < 1e-6


def test_scores_are_those_of_the_tree_in_memory(make_docs, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(st, "HOT", 40)  # the other sequences and words are joined
    monkeypatch.setattr(st, "HOT_WORDS", 3)
    rng = random.Random(4)
    texts = []
    for _ in range(150):
        out = [rng.choice("abcdefgh")]
        for _ in range(rng.randint(20, 60)):
            out.append(rng.choice("abcdefgh") if rng.random() < 0.4 or len(out) < 3 else chr(97 + (ord(out[-1]) * 3 + ord(out[-3])) % 8))
        texts.append(" ".join(out))
    rows = list(enumerate(texts))
    symbol = {w.encode(): i + 2 for i, w in enumerate("abcdefgh")}
    coded = {i: np.array([symbol[w] for w in st.words_of(t)] + [1], np.uint16) for i, t in rows}
    train = [x for i, x in coded.items() if zlib.crc32(str(i).encode()) % 10]
    counts = np.bincount(np.concatenate(train), minlength=10)
    root = (counts + 0.1) / (counts.sum() + 0.1 * 10)
    counted, allowed = [], None
    for d in (1, 2, 3):
        key, n = np.unique(np.concatenate([st._keys(x, d) for x in train]), return_counts=True)
        context = key >> np.uint64(16)
        ok = np.isin(context, allowed) if d > 1 else counts[context.astype(int)] >= 16
        key, n = key[ok & (n >= 2)], n[ok & (n >= 2)]
        allowed = key[n >= 16]
        counted.append(pd.DataFrame({"key": key.view(np.int64), "n": n}))
    tree = st.grow(root, counts, counted)
    assert all(len(level.contexts) for level in tree.levels)

    def score(x):
        history = [sum(int(s) << (16 * k) for k, s in enumerate(reversed(x[max(0, i - 3):i]))) for i in range(len(x))]
        # Outside of a text stands a symbol that no context has.
        history = [h | sum(0xFFFF << (16 * k) for k in range(min(i, 3), 3)) for i, h in enumerate(history)]
        return round(float(np.log10(tree.probability(np.array(history, np.uint64), x)).sum()), 6)

    got = {r.doc_id: round(r.score, 6) for r in st.score_texts(make_docs(rows)).collect()}
    assert got == {i: score(x) for i, x in coded.items()}


def test_a_repeated_passage_is_learned_in_a_large_table(make_docs, words):
    passage = words(12, seed=1)
    rng = random.Random(8)
    filler = [f"v{i}" for i in range(30_000)]
    # About 23 copies in 1.8 million words: less than one word in 60 000.
    rows = [(i, " ".join(rng.choices(filler, k=60_000))) for i in range(1, 35)] + [(9_000 + i, passage) for i in range(26)]
    held = st.score_texts(make_docs(rows)).filter("held_out and doc_id >= 9000").collect()
    assert held and all(r.score - r.base_score > 8 for r in held)


def test_gaps_give_the_ids_back_and_shrink():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 5000):
        ids = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        assert (st._of_gaps(st._gaps(ids)) == ids).all() and len(st._of_gaps(st._gaps(ids))) == n
    ids.sort()
    assert len(zlib.compress(st._gaps(ids))) < 0.88 * len(zlib.compress(ids.tobytes()))


def test_sums_of_a_batch_come_back_together(make_docs, words, monkeypatch):
    """Few frequent words at hand, so nearly all is looked up in buckets, of which there are several."""
    rows = [(i, words(60, seed=i % 50)) for i in range(150)] + [(None, words(12)), (3, None)]
    plain = sorted((r.doc_id or -1, round(r.score, 6)) for r in st.score_texts(make_docs(rows)).collect())
    for name, value in (("HOT", 3), ("HOT_WORDS", 3), ("_BUCKET", 1 << 11), ("_ASKED", 2)):
        monkeypatch.setattr(st, name, value)
    found = st.score_texts(make_docs(rows)).collect()
    assert got(found) == base(rows) and sorted((r.doc_id or -1, round(r.score, 6)) for r in found) == plain


def test_hashes_are_polynomials_of_the_words_and_need_no_new_powers(monkeypatch):
    def plain(word):
        h = sum((b + 1) * pow(int(st._BASE), i, 1 << 64) for i, b in enumerate(word)) % (1 << 64)
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ (h >> 33)) * factor % (1 << 64)
        return h ^ (h >> 33)

    rng = random.Random(41)
    texts = [bytes(rng.choices(b"aAzZ \t\n\x0b\x0c\r.\xc3\xa9\xfe", k=rng.randint(0, 40))) for _ in range(300)]
    long = b"Q" * (5 * st._PIECE) + b" ab\tC "
    assert st._hashes(long).tolist() == [plain(w) for w in long.lower().split()]
    monkeypatch.setattr(st, "_powers", None)
    for text in [*texts, b" \xff ".join([*texts, b""])]:
        assert st._hashes(text).tolist() == [plain(w) for w in text.lower().split()]
    assert int(st.END) == plain(st._END)
