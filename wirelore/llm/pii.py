"""Personal data with offsets, also behind disguises.

A text runs through a chain of small transducers. Each one rewrites pieces of its input (look-alike characters,
spelled digits, "at" and "dot" in words or brackets) and keeps for every output character the source span it came
from. The detectors then run on the rewritten text, and a hit is mapped back to the source characters.

Left alone: "name at host.tld" with a plain dot (ordinary prose), "at" and "dot" with other than one space around them or in
other languages, fewer than three spelled digits in a row, and identifiers broken over lines.

Defined results: a null or empty text has no spans; rows are independent, so repeated rows come back repeated and
an empty table gives an empty table; a null id is kept; other columns are ignored. Every pass is linear in the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import id_and_text, small_batches

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A digit run is taken whole, so a match can only start where a run starts.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, end, index in KINDS


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        done = at + 1
        if match:
            yield start, match.end(), 0
            done = match.end()
        at = text.find("@", done)


def plain_spans(text: str) -> list[Span]:
    """The undisguised identifiers: leftmost, non-overlapping per kind."""
    found = list(_emails(text))
    if "." in text:
        # int() of a very long run is refused, and such a part is over 255 in any case.
        found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


# Letters of other scripts that look like Latin ones, and signs that stand for ASCII signs.
_LOOKALIKES = {
    "а": "a", "в": "B", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "M", "н": "H", "о": "o", "р": "p",
    "ѕ": "s", "т": "T", "х": "x", "у": "y", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i", "ո": "n", "ս": "u",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S",
    "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
    "․": ".", "。": ".", "﹒": ".", "﹫": "@", "﹢": "+",
    " ": " ", " ": " ", " ": " ", "　": " ",
    "­": "", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "",
}
_FOREIGN = re.compile(r"[^\x00-\x7f\u00c0-\u017f]")  # letters with accents are left alone
_WORDS = "zero one two three four five six seven eight nine".split()
_DIGIT_WORD = {w: str(i) for i, w in enumerate(_WORDS)} | {"oh": "0", "plus": "+"}
_TIMES = {"double": 2, "triple": 3}
_NUMBER = "(?:(?:double |triple )?(?:" + "|".join(_WORDS) + "|oh))"
# At least three spelled digits in a row, with further spelled or plain ones around them.
_SPELLED = re.compile(
    rf"(?<![A-Za-z0-9])(?:plus[ ,-]*)?(?:(?:[0-9]+|{_NUMBER})[ ,.-]{{1,3}})*?{_NUMBER}(?:[ ,.-]{{1,3}}{_NUMBER}){{2,}}"
    rf"(?:[ ,.-]{{1,3}}(?:[0-9]+|{_NUMBER}))*(?![A-Za-z0-9])", re.IGNORECASE)
_SPELLED_GATE = re.compile(rf"\b{_NUMBER}[ ,.-]{{1,3}}{_NUMBER}[ ,.-]{{1,3}}{_NUMBER}\b", re.IGNORECASE)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT_SIGN = rf"(?: ?{_OPEN} ?(?:at|@) ?{_CLOSE} ?| ?[_-]at[_-] ?| @ )"
_AT_WORD = r" at "
_DOT = rf"(?: ?{_OPEN} ?(?:dot|\.) ?{_CLOSE} ?| dot | ?[_-]dot[_-] ?| \. )"
_LABEL = r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*"
# A bare " at " only counts before a disguised dot; "see you at example.com" is ordinary prose.
_MAIL = re.compile(
    rf"(?<![A-Za-z0-9%+])[A-Za-z0-9%+]+(?:(?:[._-]|{_DOT})[A-Za-z0-9%+]+)*?"
    rf"(?:(?P<sign>{_AT_SIGN}){_LABEL}(?:(?:{_DOT}|\.){_LABEL})+|(?P<word>@|{_AT_WORD}){_LABEL}(?:\.{_LABEL})*(?:{_DOT}{_LABEL})+(?:\.{_LABEL})*"
    rf"|(?P<plain>@){_LABEL}(?:\.{_LABEL})+)", re.IGNORECASE)
_MAIL_GATE = re.compile(rf"{_OPEN} ?(?:at|@|dot|\.) ?{_CLOSE}|[_-](?:at|dot)[_-]| dot | @ |[A-Za-z0-9] \. [A-Za-z0-9]", re.IGNORECASE)
_AT_ANY, _DOT_ANY = re.compile(rf"{_AT_SIGN}|{_AT_WORD}", re.IGNORECASE), re.compile(_DOT, re.IGNORECASE)
_DOTTED = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:{_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)


class Tape:
    """A rewritten text; character i of it stands for source characters ``begin[i]`` to ``end[i]``."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.begin: list[int] | range = range(len(text))
        self.end: list[int] | range = range(1, len(text) + 1)
        self.changed: list[bool] = [False] * len(text)

    def rewrite(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Replace disjoint, ascending pieces. An output character of an edit covers the whole piece."""
        parts, begin, end, changed, at = [], [], [], [], 0
        for a, b, new in edits:
            if self.text[a:b] == new:
                continue
            parts += [self.text[at:a], new]
            begin += [*self.begin[at:a], *[self.begin[a]] * len(new)]
            end += [*self.end[at:a], *[self.end[b - 1]] * len(new)]
            changed += [*self.changed[at:a], *[True] * len(new)]
            at = b
            if not new and changed:
                changed[-1] = True
        if parts:
            self.text = "".join([*parts, self.text[at:]])
            self.begin, self.end = [*begin, *self.begin[at:]], [*end, *self.end[at:]]
            self.changed = changed + self.changed[at:]


def _plain_letter(c: str) -> str:
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if "\uff01" <= c <= "\uff5e":
        return chr(ord(c) - 0xFEE0)
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    if 0x1D400 <= ord(c) <= 0x1D7FF:  # mathematical letters and digits
        return unicodedata.normalize("NFKC", c)
    return c


def _spelled_digits(match: re.Match) -> str:
    out, times = [], 1
    for token in re.findall(r"[A-Za-z]+|[0-9]+", match[0].lower()):
        if token not in _TIMES:
            out.append(_DIGIT_WORD.get(token, token) * times)
        times = _TIMES.get(token, 1)
    return "".join(out)


def normalised(text: str) -> Tape | None:
    """The text after all transducers, or None if none of them had anything to do."""
    foreign = _FOREIGN.search(text)
    if not (foreign or _MAIL_GATE.search(text) or _SPELLED_GATE.search(text)):
        return None
    tape = Tape(text)
    if foreign:
        tape.rewrite([(m.start(), m.end(), _plain_letter(m[0])) for m in _FOREIGN.finditer(text)])
    if _SPELLED_GATE.search(tape.text):
        tape.rewrite([(m.start(), m.end(), _spelled_digits(m)) for m in _SPELLED.finditer(tape.text)])
    if _MAIL_GATE.search(tape.text):
        edits = []
        for m in _MAIL.finditer(tape.text):
            kind = next(k for k in ("sign", "word", "plain") if m[k])
            a, b = m.span(kind)
            # Before a plain address a spaced full stop ends a sentence.
            start = max(m.start(), tape.text.rfind(" . ", m.start(), a) + 3) if kind == "plain" and " . " in m[0] else m.start()
            edits += [(d.start(), d.end(), ".") for d in _DOT_ANY.finditer(tape.text, start, a)]
            edits.append((a, b, "@"))
            edits += [(d.start(), d.end(), ".") for d in _DOT_ANY.finditer(tape.text, b, m.end())]
        tape.rewrite(edits)
        tape.rewrite([(d.start(), d.end(), ".") for m in _DOTTED.finditer(tape.text) for d in _DOT_ANY.finditer(tape.text, *m.span())])
    return tape if any(tape.changed) else None


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and those that only appear once the disguises are off."""
    plain, tape = plain_spans(text), normalised(text)
    if tape is None:
        return plain, []
    hits = plain_spans(tape.text)
    # A number that was spelled out is a number on purpose, so it needs no plus sign.
    taken = [(s, e) for s, e, k in hits if k in (2, 3)]
    for m in re.finditer(r"(?<![0-9+])[0-9]{10,15}(?![0-9])", tape.text):
        if all(tape.changed[m.start():m.end()]) and not any(s < m.end() and m.start() < e for s, e in taken) and _SPELLED.match(text, tape.begin[m.start()]):
            hits.append((m.start(), m.end(), 3))
    added = []
    for s, e, kind in hits:
        if any(tape.changed[s:e]):
            a, b = tape.begin[s], tape.end[e - 1]
            # A plain span may be a stump of the hit: only one that covers the hit makes it superfluous.
            if not any(k == kind and x <= a and b <= y for x, y, k in plain):
                added.append((a, b, kind))
    return plain, added


_SPANS = "array<struct<kind:string,start:int,end:int,added:boolean>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and ``spans``, ordered by start and kind; offsets are code points of the source text, end exclusive."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                plain, added = all_spans(text)
                spans = sorted([(s, k, e, False) for s, e, k in plain] + [(s, k, e, True) for s, e, k in added])
                out.append([{"kind": KINDS[k], "start": s, "end": e, "added": a} for s, k, e, a in spans])
            yield batch.assign(spans=out)

    return id_and_text(docs, id_col, text_col).mapInPandas(scan, f"doc_id long, text string, spans {_SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind of the plain spans, their hash, and the list of all spans."""
    base = F.filter("spans", lambda s: ~s["added"])

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span replaced by its kind in angle brackets; overlapping spans become one.

    A null text stays null."""
    small_batches(docs.sparkSession)
    place, kind = docs.columns.index(text_col), docs.schema

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        plain, added = all_spans(text)
        out, at = [], 0
        for s, e, k in sorted(plain + added, key=lambda x: (x[0], x[2])):
            if s >= at:
                out += [text[at:s], f"<{KINDS[k].upper()}>"]
            at = max(at, e)
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(clean)

    return docs.select(*[cleaned(docs[f.name]).alias(f.name) if i == place else docs[f.name] for i, f in enumerate(kind.fields)])
