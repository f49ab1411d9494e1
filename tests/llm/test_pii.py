import hashlib
import random
import re

import pytest

from wirelore.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), m.end(), 0) for m in EMAIL.finditer(text)]
    found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), m.end(), 2) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found)


def test_plain_spans_agree_with_the_expressions():
    rng = random.Random(1)
    for alphabet in ("ab1290.@-+ ()_", "0123456789. ", "a@.b", "+1 (5)-2"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(50))
            assert sorted(pii.plain_spans(text)) == brute(text), text


@pytest.mark.parametrize("text, kind, hidden", [
    ("mail john.doe at example dot com now", "email", "john.doe at example dot com"),
    ("jane [at] mail [dot] example [dot] org", "email", "jane [at] mail [dot] example [dot] org"),
    ("x jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("call plus one five five five, one two three four five six seven please", "phone", "plus one five five five, one two three four five six seven"),
    ("ip 192[.]168[.]1[.]1 x", "ip", "192[.]168[.]1[.]1"),
    ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
])
def test_disguises(text, kind, hidden):
    _, added = pii.all_spans(text)
    assert [(pii.KINDS[k], text[s:e]) for s, e, k in added] == [(kind, hidden)]


@pytest.mark.parametrize("text", ["see you at example.com", "one two three go", "at noon the dot", "die Straße in Köln", "connect the dot at the end"])
def test_ordinary_text_is_left_alone(text):
    assert pii.all_spans(text) == ([], [])


def test_offsets_survive_edits_before_a_hit():
    text = "﻿ze​ro [at] x [dot] io and 😀 bob (at) y (dot) de"
    got = [text[s:e] for s, e, _ in pii.all_spans(text)[1]]
    assert got == ["ze​ro [at] x [dot] io", "bob (at) y (dot) de"]


def test_digest_and_redaction(spark, make_docs, odd_docs, odd_rows):
    docs = make_docs([(1, "a@b.co and 10.0.0.1"), (2, "ann at b dot co")])
    rows = {r.doc_id: r for r in pii.digest(pii.find_pii(docs)).collect()}
    assert (rows[1].n_email, rows[1].n_ip, rows[1].n_card, rows[1].spans) == (1, 1, 0, "email:0:6,ip:11:19")
    assert rows[1].base_sha256 == hashlib.sha256(b"email:0:6,ip:11:19").hexdigest()
    assert (rows[2].n_email, rows[2].spans, rows[2].base_sha256) == (0, "email:0:15", hashlib.sha256(b"").hexdigest())
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and [r.text for r in clean.orderBy("doc_id").collect()] == ["<EMAIL> and <IP>", "<EMAIL>"]
    assert pii.find_pii(odd_docs).count() == len(odd_rows) and pii.redact(odd_docs).filter("text is null").count() == 1
    assert pii.find_pii(odd_docs.limit(0)).count() == 0


def test_long_runs_stay_linear():
    for text in ("1" * 200_000, "a" * 200_000, "a@" * 100_000, "+" * 200_000, "+1" + " " * 200_000, "one " * 50_000, "1.2.3." * 40_000, " at " * 50_000):
        pii.all_spans(text)


@pytest.mark.parametrize("text, kind, hidden", [
    ("x j\u043ehn@example.com y", "email", "j\u043ehn@example.com"),  # the plain expression finds hn@example.com
    ("x john@example.c\u043em y", "email", "john@example.c\u043em"), ("x john@mail.example.c\u043em y", "email", "john@mail.example.c\u043em"),
    ("ip 10.0.0.1\uff12\uff13 y", "ip", "10.0.0.1\uff12\uff13"), ("call +1 555 123 456\uff17\uff18 y", "phone", "+1 555 123 456\uff17\uff18"),
    ("x john dot doe@example.com y", "email", "john dot doe@example.com"), ("x john[.]doe@example.com y", "email", "john[.]doe@example.com"),
])
def test_a_plain_stump_does_not_hide_the_whole(spark, text, kind, hidden):
    _, added = pii.all_spans(text)
    assert [(pii.KINDS[k], text[s:e]) for s, e, k in added] == [(kind, hidden)]
    clean = pii.redact(spark.createDataFrame([(text,)], "text string")).first().text
    assert clean == text.replace(hidden, f"<{kind.upper()}>")


def test_a_sentence_before_a_plain_address_is_not_part_of_it():
    assert pii.all_spans("the end . bob@example.com dot")[1] == [] and pii.all_spans("(dot) the end . bob@example.com")[1] == []


@pytest.mark.parametrize("text, kind, span", [
    ("write bob@example . com now", "email", (6, 23)), ("host 10 . 0 . 0 . 1 is up", "ip", (5, 19)),
    ("call plus one two double three four five triple six seven eight", "phone", (5, 63)),
])
def test_gates_are_as_wide_as_the_rewriting(text, kind, span):
    _, added = pii.all_spans(text)
    assert [(pii.KINDS[k], s, e) for s, e, k in added] == [(kind, *span)]


def test_prose_is_left_alone():
    for text in ("We ended . Then we went on . So it was", "meet me at example.com today", "version 1 . 2 of it", "double trouble, one two"):
        assert pii.all_spans(text)[1] == []
