import hashlib
import itertools
import random
import zlib

import pytest

from wirelore.llm import conversation_repair as cr

WHITE = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """(role, text) in order -> counters, cost, audit and lines: a forward program that keeps the least (cost, audit) of each state."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.strip(WHITE)
        fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "k"
        seen.add((role, text))
        faults.append(fault)
    follow = {"0": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for st, (c, audit, lines) in list(out.items()):
                new = follow[st]
                it = (c + 5, audit + "I", (*lines, ({"u": "user", "a": "assistant"}[new], "")))
                if new not in out or it[:2] < out[new][:2]:
                    out[new] = it
        return out

    states = inserted({"0": (0, "", ())})
    for (role, text), fault in zip(rows, faults):
        new = {}
        for st, (c, audit, lines) in states.items():
            found = [(st, c + 2, "D", ())]
            if fault in "kt":
                more = 5 * (fault == "t")
                if st + role[:1] in ("0s", "0u", "su", "ua", "au"):
                    found.append((role[0], c + more, "K", ((role, text),)))
                to = follow[st]
                found.append((to, c + 1 + more, "R", (({"u": "user", "a": "assistant"}[to], text),)))
            for to, cost, letter, line in found:
                it = (cost, audit + letter, lines + line)
                if to not in new or it[:2] < new[to][:2]:
                    new[to] = it
        states = inserted(new)
    cost, audit, lines = min((states[s] for s in "0a" if s in states), key=lambda x: x[:2])
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    counts = [faults.count(x) for x in "bdt"] + [sum(p not in ("su", "ua", "au") for p in pairs)]
    return (*counts, cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))


def plain(table):
    """conv_id -> result over (conv_id, turn, role, text) rows after damage."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role = "user" if kind == 4 else role
            text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
            rows += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()))
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        *counts, body = plain_repair([x[1:] for x in rows])
        out[conv] = (gaps, *counts, hashlib.sha256(body.encode()).hexdigest())
    return out


def test_tables_give_the_least_audit():
    tables = cr.Tables()
    assert len(tables.vectors) < 256
    roles, texts = ["system", "user", "assistant", "tool", ""], ["fine.", "cut", "  "]
    pool = [(r, t) for r in roles for t in texts]

    def check(rows):
        seen, symbols = set(), ""
        for role, text in rows:
            mark = cr.DOOMED if not text.strip() or (role, text) in seen else cr.SOUND if text[-1] in ".!?" else cr.TRUNCATED
            seen.add((role, text))
            symbols += cr.DIGITS[3 * ("sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3) + mark]
        want = plain_repair(rows)
        assert (cr.illegal_pairs(symbols), *tables.repair(symbols)) == want[3:6], rows
        replay = cr.Replay(want[5])
        lines = [x for r in rows for x in replay.row(*r)] + list(replay.rest())
        assert "\n".join(f"{r}:{t}" for r, t in lines) == want[6]

    for n in range(3):
        for rows in itertools.product(pool, repeat=n):
            check(list(rows))
    rng = random.Random(3)
    for n in [*range(3, 30)] * 12:
        check([(rng.choice(roles), rng.choice(["fine.", "cut", " ", f"own {rng.random()}.", f"own {rng.random()}"])) for _ in range(n)])
    for block in (1, 2, 3):
        other, s = cr.Tables(block), "".join(rng.choice(cr.DIGITS) for _ in range(50))
        assert other.repair(s) == tables.repair(s)


@pytest.fixture
def talk():
    rng = random.Random(11)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(0, 12)):
            text = rng.choice(["Yes.", "No!", "cut off", " \n", None, f"w{rng.randint(0, 9)}.", "é日本 😀?"])
            rows.append((conv, rng.choice([turn, turn, turn * 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), text))
        rows += rows[-1:] * rng.choice([0, 0, 3])
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1, True) for r in rows], "conv_id long, turn long, role string, text string, seq int, mark string, cost int, present boolean")


def results(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_equals_the_plain_program(spark, talk, monkeypatch):
    rng = random.Random(2)
    long = [(900, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"{t}.", f"{t}"])) for t in range(3000)]
    want = plain(talk + long)
    monkeypatch.setattr(cr, "PIECE", 64)
    assert results(cr.repair_digests(cr.damage(frame(spark, talk + long)), "present")) == want
    monkeypatch.setattr(cr, "BLOCK", 4)
    lines = cr.repaired_turns(cr.damage(frame(spark, talk + long)), "present").collect()
    for conv, w in want.items():
        own = sorted((r.position, r.role, r.text) for r in lines if r.conv_id == conv)
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in own).encode()).hexdigest() == w[-1]


def test_all_rows_dropped_and_no_rows(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    got = results(cr.repair_digests(cr.damage(frame(spark, [(1, turn, "user", "x")])), "present"))
    assert got == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    empty = cr.repair_digests(cr.damage(frame(spark, []).limit(0)), "present")
    assert empty.collect() == [] and set(empty.columns) == {"conv_id", *cr.COUNTERS, "audit", "repaired_sha256"}


def test_far_turns_and_long_texts(spark):
    rows = [(1, -(2**63), "user", "a." * 200_000), (1, 2**63 - 1, "assistant", "b.")]
    got = cr.find_repairs(frame(spark, rows)).collect()
    assert [(r.gaps, r.cost, r.audit) for r in got] == [(None, 0, "KK")]
