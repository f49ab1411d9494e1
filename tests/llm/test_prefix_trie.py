import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from wirelore.llm import prefix_trie as pt


def plain(rows, rebuilt=True):
    """(conv_id, turn, role, text) rows -> set of node rows, from all prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            order = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0, order), (role, text)))
    own = {c: tuple(t for _, t in sorted(x)) for c, x in own.items()}
    full = own
    if rebuilt:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        base = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)
        full = {c: own.get(base(c), ())[:h[c]] + x[h[c]:] for c, x in own.items()}
    members = defaultdict(list)
    for c, x in full.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = sorted(c for c in m if full[c] == p)
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], digest))
    return sorted(out, key=repr)


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def nodes(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", b"k") for r in rows], "conv_id long, turn long, role string, text string, depth int, cells string, key binary")


@pytest.fixture
def talk():
    rng = random.Random(4)
    rows = []
    for c in [*range(-120, 0, 17), *range(0, 320)]:
        hot = rng.random() < 0.3
        for t in range(2 if hot else rng.randint(1, 9)):
            said = "hi" if hot or t < rng.randint(0, 4) else f"é{rng.randint(0, 3)}😀"
            rows.append((c, rng.choice([t, t, t, None]), ["user", "assistant", None][t % 2 if rng.random() < 0.95 else 2], None if rng.random() < 0.05 else said))
    rows += rows[5:9] + [(None, 1, "user", "lost")]
    rows += [(500, t, "user", f"long {t % 7}") for t in range(400)] + [(501, t, "user", f"long {t % 7}") for t in range(300)]
    return rows


@pytest.mark.parametrize("cells", [1, 25, pt.CELLS])
def test_equals_all_prefixes(spark, talk, cells):
    assert nodes(pt.rebuilt_trie(frame(spark, talk), cells)) == plain(talk)


def test_conversations_as_they_are(spark, talk):
    assert nodes(pt.conversation_trie(frame(spark, talk), 50)) == plain(talk, False)


def test_turnless_conversations_and_no_rows(spark):
    # Short conversations whose base doesn't exist lose all their turns: the root is then their end.
    rows = [(c, 0, "user", "a") for c in range(201, 260)]
    got = nodes(pt.rebuilt_trie(frame(spark, rows)))
    assert got == plain(rows) and got[0][-1] != pt.NO_ENDS
    assert pt.rebuilt_trie(frame(spark, rows[:1]).limit(0)).collect() == []
    assert pt.rebuilt_trie(frame(spark, [(None, 0, "user", "a")])).columns == COLUMNS


def test_double_array_holds_its_sequences():
    rng = random.Random(9)
    every = sorted({tuple(rng.randint(0, 60) for _ in range(rng.randint(0, 6))) for _ in range(3000)})
    trie = pt.DoubleArray([list(x) for x in every])
    places = {(): 0}
    for x in every:
        for d in range(1, len(x) + 1):
            child = trie.step(places[x[:d - 1]], x[d - 1])
            assert child > 0 and places.setdefault(x[:d], child) == child
    assert len(set(places.values())) == len(places) == len(trie.order)
    for prefix, state in places.items():
        for turn in range(61):
            assert (trie.step(state, turn) >= 0) == (prefix + (turn,) in places)
    assert len(trie.check) < 2 * len(places) + 200
