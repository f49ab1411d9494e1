"""License notices by conditional compression.

A candidate block (neighbouring lines that hold a licensing word, or the name of a licence whose wording has none) is compressed alone and with every template as a
zstandard raw dictionary. The template that saves the largest share of the block's size ranks first. Ranked templates
are then confirmed in order by their exact wording: block and template are aligned word by word, and the first one whose
differences stay below ``max_difference`` and touch no version or licence name wins. It is cut out, and what remains of the
block is judged again. Long blocks are looked at in windows of a few times the longest template, so the alignment, which
is quadratic, stays within a window and the time grows with the text.

Defined results: a null or empty text has no notices; rows are independent, so repeated rows come back repeated and an
empty table gives an empty table; a null id is kept; other columns are ignored. Equal savings rank by template order.
Blocks without a confirmed template are reported as ``unknown`` with their best-ranked template.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from .tables import id_and_text

Template = tuple[str, str]  # licence id, wording

# Names and public notice texts of licences. {} in a form takes the name.
_NAMES = (
    ("Apache-2.0", "the Apache License, Version 2.0"), ("MIT", "the MIT License"), ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"), ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-3.0", "the GNU General Public License, version 3"), ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"), ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0"), ("ISC", "the ISC License"), ("Unlicense", "the Unlicense"),
    ("CC0-1.0", "CC0 1.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
)
_FORMS = ("Licensed under {}.", "This work is licensed under {}.", "Released under {}.")
_NOTICES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."), ("proprietary", "Copyright. All rights reserved."),
)
TEMPLATES: tuple[Template, ...] = tuple((key, form.format(name)) for key, name in _NAMES for form in _FORMS) + _NOTICES

CUES = ("licen", "copyright", "spdx", "hereby granted", "redistribut", "public domain", "rights reserved", "creative commons", "free software")
_WORD = re.compile(r"[0-9]+(?:\.[0-9]+)*|[^\W\d_]+(?:-[^\W\d_]+)*")
_KEY = re.compile(r"[0-9]|^(?:apache|mit|bsd|gnu|general|lesser|affero|mozilla|isc|unlicense|gpl|lgpl|agpl|mpl|cc|cc0|by|by-.*|nc|nd|sa|clause|reserved)$")


def _name_of(template: str) -> list[str]:
    """The longest run of words that name a licence or version."""
    best: list[str] = []
    run: list[str] = []
    for word in _WORD.findall(template):
        run = [*run, word] if _KEY.search(word.lower()) else []
        best = max(best, run, key=len)
    return best


def cue_pattern(templates: Sequence[Template], cues: Sequence[str] = CUES) -> re.Pattern:
    """The licensing words, and the name in every template that holds none of them."""
    plain = re.compile("|".join(map(re.escape, cues)), re.IGNORECASE)
    names = {r"\s*".join(map(re.escape, _name_of(t))) for _, t in templates if not plain.search(t)} - {""}
    return re.compile("|".join([plain.pattern, *(rf"\b{n}\b" for n in sorted(names))]), re.IGNORECASE)


def candidate_blocks(text: str, cue: re.Pattern) -> list[tuple[int, int]]:
    """Runs of lines with a licensing word, or with such a line right before and after them."""
    if not cue.search(text):
        return []
    blocks: list[list[int]] = []
    at, last = 0, -9
    for i, line in enumerate(text.split("\n")):
        end = at + len(line)
        if cue.search(line):
            if blocks and i - last <= 2:
                blocks[-1][1] = end
            else:
                blocks.append([at, end])
            last = i
        at = end + 1
    return [(s, e) for s, e in blocks]


class Scanner:
    def __init__(self, templates: Sequence[Template] = TEMPLATES, max_difference: float = 0.25, level: int = 3) -> None:
        self.templates, self.max_difference = templates, max_difference
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.words = [self._words(t) for _, t in templates]
        self.given = [zstandard.ZstdCompressor(level=level, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
            (t + "\n").encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in templates]
        self.cue = cue_pattern(templates)
        # Words looked at together: an altered notice that starts in the first part of a window ends inside it.
        longest = max(map(len, self.words), default=0)
        self.reach = int(longest * (1 + max_difference)) + 1
        self.window = 4 * self.reach
        self.memo: dict[str, tuple[dict, str]] = {}

    @staticmethod
    def _words(text: str) -> list[str]:
        return [w.lower() for w in _WORD.findall(text)]

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """(share of the size saved, template), best first."""
        data = block.encode("utf-8", "replace")
        alone = len(self.plain.compress(data))
        saved = [(1 - len(c.compress(data)) / alone, i) for i, c in enumerate(self.given)]
        return sorted(saved, key=lambda x: (-x[0], x[1]))

    def aligned(self, words: list[str], template: int) -> tuple[int, int, bool, tuple[int, int]]:
        """Words that differ inside the aligned stretch, its template words, whether a name or version differs, and the stretch."""
        other = self.words[template]
        matcher = difflib.SequenceMatcher(None, words, other, autojunk=False)
        same = matcher.get_matching_blocks()[:-1]
        if not same:
            return max(len(words), len(other)), 0, True, (0, 0)
        # Words around the template belong to the document, missing template words are differences. Of all stretches from one
        # matching run to another the one with the fewest differences counts: far-off runs are chance.
        best = None
        for i, m in enumerate(same):
            kept = 0
            for j in range(i, len(same)):
                kept += same[j].size
                differing = same[j].a + same[j].size - m.a + len(other) - 2 * kept
                if best is None or differing < best[0]:
                    best = (differing, kept, i, j)
        _, kept, i, j = best
        first, last = same[i], same[j]
        inside = words[first.a:last.a + last.size]
        extra, missing = len(inside) - kept, len(other) - kept
        mine, theirs = [w for w in inside if _KEY.search(w)], [w for w in other if _KEY.search(w)]
        return extra + missing, len(other), mine != theirs, (first.a, last.a + last.size)

    def _confirmed(self, found: tuple[int, int, bool, tuple[int, int]]) -> bool:
        differing, size, key, _ = found
        return size > 0 and not key and differing <= self.max_difference * size

    @staticmethod
    def _cover(found: tuple[int, int, bool, tuple[int, int]]) -> float:
        """Words in common less those that differ."""
        differing, size, _, (first, last) = found
        return (last - first + size - differing) / 2 - differing

    def judge(self, block: str) -> tuple[dict, str]:
        """The best confirmed notice in a block and its wording; without one, an unknown notice and no wording."""
        words, ranks = self._words(block), self.ranked(block)
        nearest = self.templates[ranks[0][1]][0] if ranks else None
        for saved, i in ranks:
            if saved <= 0:
                break
            if not self._confirmed(self.aligned(words, i)):
                continue
            # Of the wordings of this licence the one that covers most takes the stretch.
            name = self.templates[i][0]
            every = [(self.aligned(words, k), -r) for r, (_, k) in enumerate(ranks) if self.templates[k][0] == name]
            (differing, _, _, (first, last)), _ = max((x for x in every if self._confirmed(x[0])), key=lambda x: (self._cover(x[0]), x[1]))
            places = [m.span() for m in _WORD.finditer(block)]
            return {"license": name, "nearest": nearest, "saved": float(saved), "differing_words": differing}, block[places[first][0]:places[last - 1][1]]
        saved, i = ranks[0] if ranks else (0.0, -1)
        differing = self.aligned(words, i)[0] if ranks else len(words)
        return {"license": "unknown", "nearest": nearest, "saved": float(saved), "differing_words": differing}, ""

    def _judged(self, block: str) -> tuple[dict, str]:
        if block not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[block] = self.judge(block)
        return self.memo[block]

    def _window(self, text: str, start: int, end: int) -> tuple[int, int]:
        """Where the window from ``start`` ends, and where the next one starts if nothing is found in it."""
        resume = end
        for i, m in enumerate(_WORD.finditer(text, start, end)):
            if i == self.window - self.reach:
                resume = m.start()
            if i == self.window:
                return m.start(), resume
        return end, end

    def _open(self, text: str, start: int, end: int) -> bool:
        """Whether a stretch can hold a notice: a licensing word or a word that names a licence."""
        return self.cue.search(text, start, end) is not None or any(_KEY.search(m.group().lower()) for m in _WORD.finditer(text, start, end))

    def notices(self, text: str) -> list[dict]:
        """Every confirmed notice is cut out of its block, at all places of its wording, and what remains is judged again if it
        has a licensing word or a licence's name. A notice reaches to the ends of its block, or to its wording's where
        a rest is judged. Blocks of many words are judged window by window."""
        found: list[dict] = []
        splits: set[int] = set()
        waiting = candidate_blocks(text, self.cue)
        while waiting:
            start, end = waiting.pop()
            stop, resume = self._window(text, start, end)
            block = text[start:stop]
            notice, wording = self._judged(block)
            if not wording:
                if stop < end:
                    splits.add(resume)
                    waiting.append((resume, end))
                    stop = resume
                if self.cue.search(text, start, stop):
                    found.append(notice | {"start": start, "end": stop})
                continue
            cuts = [(start + m.start(), start + m.end()) for m in re.finditer(re.escape(wording), block)]
            at = start
            for k, (a, b) in enumerate(cuts):
                final = k + 1 == len(cuts)
                left, right = at, b
                if at < a and self._open(text, at, a):
                    waiting.append(_stripped(text, at, a))
                    left = a
                if final:
                    if b < end and (stop < end or self._open(text, b, end)):
                        waiting.append(_stripped(text, b, end))
                    else:
                        right = end
                found.append(notice | {"start": left, "end": right})
                at = b
        found.sort(key=lambda n: (n["start"], n["end"]))
        out: list[dict] = []
        for n in found:
            # An unknown block that took several windows is one notice.
            if out and n["start"] in splits and n["license"] == out[-1]["license"] == "unknown" and out[-1]["end"] == n["start"]:
                out[-1]["end"] = n["end"]
            else:
                out.append({k: n[k] for k in _FIELDS})
        return out


def _stripped(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in _AROUND:
        start += 1
    while start < end and text[end - 1] in _AROUND:
        end -= 1
    return start, end


MEMO = 10_000
_AROUND = " \t\r\n.,;:"
_FIELDS = ("license", "nearest", "start", "end", "saved", "differing_words")
_NOTICE = "license:string,nearest:string,start:int,end:int,saved:double,differing_words:int"


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, max_difference: float = 0.25,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and its notices in text order (possibly none); offsets are code points."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, max_difference)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "notices": [scanner.notices(t) for t in batch["text"]]})

    return id_and_text(docs, id_col, text_col).mapInPandas(scan, f"doc_id long, notices array<struct<{_NOTICE}>>")
