import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from wirelore.llm import packing
from wirelore.llm.queries import public_vocabulary


def check(rows, wanted, tokenizer, window):
    """All ids of all documents, once each, and gapless sequences."""
    by_text, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_text[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and r.length > 0
    for doc_id, texts in wanted.items():
        want = sorted(bytes(struct.pack(f"<{len(ids)}I", *ids)) for ids in ([*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts))
        if len(texts) == 1:
            pieces = sorted(by_text[doc_id], key=lambda r: r.start)
            assert [r.start for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))]
            assert [b"".join(bytes(r.ids) for r in pieces)] == want and {r.doc_tokens for r in pieces} == {len(want[0]) // 4}
        else:
            assert sum(r.length for r in by_text[doc_id]) == sum(map(len, want)) // 4
    short = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        short += at < window
    return short


@pytest.mark.parametrize("window, shard", [(64, 300), (2048, 1 << 19)])
def test_round_trip(make_docs, words, odd_rows, monkeypatch, window, shard):
    monkeypatch.setattr(packing, "SHARD_TOKENS", shard)
    vocabulary = public_vocabulary()
    rows = [(100 + i, words(n)) for i, n in enumerate([0, 1, 5, 30, 300, 80, 20, 7, 7] * 3)] + odd_rows
    wanted = defaultdict(list)
    for i, t in rows:
        wanted[i].append(t or "")
    got = packing.pack(make_docs(rows), vocabulary, window).collect()
    assert check(got, wanted, Tokenizer.from_file(vocabulary.tokenizer_path), window) <= 1
    digest = packing.digest(packing.pack(make_docs(rows), vocabulary, window)).collect()
    assert {(r.doc_id, r.start, r.ids_crc32) for r in digest} == {(r.doc_id, r.start, zlib.crc32(r.ids)) for r in got}


def test_related_documents_share_a_window(make_docs, words):
    topics = [words(12, seed=s) for s in range(6)]
    rows = [(10 * t + i, " ".join([topics[t]] * 3 + [words(5, seed=100 * t + i)])) for i in range(5) for t in range(6)]
    got = packing.pack(make_docs(rows), public_vocabulary(), 512).collect()
    windows = defaultdict(set)
    for r in got:
        windows[r.sequence_id].add(r.doc_id // 10)
    assert sum(map(len, windows.values())) / len(windows) < 3.5  # six topics in turn would give about all of them


def test_empty(make_docs):
    assert packing.pack(make_docs([]), public_vocabulary()).count() == 0


def test_both_tokenizers_agree(words):
    both, slow = packing.encoder(public_vocabulary()), packing.encoder(packing.Vocabulary(public_vocabulary().tokenizer_path))
    for text in [words(100), "It's  a\n\n test's\t<|endoftext|>", "<| x", "été über ñ", "x\x1c's", "１２ ½ ª", "  lead", "trail  ", "don't WE'LL", ""]:
        assert both(text) == slow(text), text


def test_scores_are_those_of_plain_bm25():
    rng = random.Random(17)
    documents = [np.array([rng.choice([5, 6, 7, rng.randint(8, 60)]) for _ in range(rng.randint(0, 50))] + [1], "<u2") for _ in range(40)]
    bags = [Counter(int(t) for t in d[:-1]) for d in documents]
    df = np.zeros(100, np.int64)
    for bag in bags:
        df[list(bag)] += 1
    mean = sum(map(len, documents)) / len(documents)
    corpus = packing.Corpus(len(documents), mean, df, "<u2")
    index = packing.Index(documents, corpus, corpus.idf())
    for seed, bag in enumerate(bags):
        want = []
        for other, ids in zip(bags, documents, strict=True):
            scale = packing.K1 * (1 - packing.B + packing.B * len(ids) / mean)
            want.append(sum(math.log1p((len(documents) - df[t] + 0.5) / (df[t] + 0.5)) * other[t] * (packing.K1 + 1) / (other[t] + scale) for t in bag if t in other))
        got = index.scores(seed)
        assert got == pytest.approx(want, rel=1e-4, abs=1e-6)
        clear = [(a, b) for a in range(40) for b in range(40) if want[a] > want[b] + 1e-3]
        assert all(got[a] > got[b] for a, b in clear)


def test_routes_are_the_two_heaviest_terms():
    rng = random.Random(23)
    documents = [np.array([rng.randint(0, 30) for _ in range(rng.randint(0, 12))] + [1], "<u2") for _ in range(200)]
    ranks = np.log1p(np.arange(40))
    found = packing._routes(packing.Terms.of(documents), ranks)
    for d, got in zip(documents, found.tolist(), strict=True):
        bag = Counter(int(t) for t in d[:-1])
        best = sorted(bag, key=lambda t: (-(bag[t] / (bag[t] + packing.K1) * ranks[t]), t))[:2]
        assert got == [*best, -1, -1][:2]


def test_two_runs_pack_alike(make_docs, words):
    rows = [(i % 30, words(40, seed=i % 7)) for i in range(120)]
    docs = make_docs(rows)
    runs = [sorted(packing.digest(packing.pack(docs, public_vocabulary(), 256)).collect()) for _ in range(2)]
    assert runs[0] == runs[1]


def test_split_without_looking_ahead_gives_the_tokenizers_ids():
    vocabulary, rng = public_vocabulary(), random.Random(31)
    exact, ids = Tokenizer.from_file(vocabulary.tokenizer_path), packing.array_encoder(vocabulary, 1)
    parts = ["a", "The", "'s", "'", "ll", "é", "ſ", "23", ".", "_", " ", " ", "\n", "\t", " ", "中", "<|"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(4000)]
    for text in texts:
        assert ids(text).tolist() == [*exact.encode(text, add_special_tokens=False).ids, 1], text
    parted = [t for t in texts if packing._plain(t) and packing._parted(t)]
    assert len(parted) > 500 and not any(a.isspace() and b.isspace() for t in parted for a, b in zip(t, t[1:]))


def test_a_smaller_index_scores_what_is_left_as_before():
    rng = np.random.default_rng(37)
    documents = [np.append(rng.integers(2, 40, rng.integers(0, 30)), 1).astype("<u2") for _ in range(60)]
    df = np.bincount(np.concatenate([np.unique(d[:-1]) for d in documents]), minlength=50)
    corpus = packing.Corpus(60, float(np.mean([len(d) for d in documents])), df, "<u2")
    index, left = packing.Index(documents, corpus, corpus.idf()), rng.random(60) < 0.4
    before, postings = [index.scores(d) for d in range(60)], len(index.owner)
    index.keep(left)
    assert len(index.owner) < postings
    for d in range(60):
        assert index.scores(d)[left].tolist() == before[d][left].tolist() and not index.scores(d)[~left].any()
