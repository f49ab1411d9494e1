import random
import time

import pytest

from wirelore.llm import license_scan as ls


@pytest.mark.parametrize("text, names", [
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]), ("x\nReleased under the MIT License.\ny", ["MIT"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]), ("Licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]), ("Licence: ask me", ["unknown"]), ("all rights\n", []),
    ("Licensed under the MIT License.\n\n\n\nLicensed under CC0 1.0.", ["MIT", "CC0-1.0"]),
])
def test_notices(text, names):
    assert [n["license"] for n in ls.Scanner().notices(text)] == names


def test_small_changes_in_long_notices():
    name, text = next(t for t in ls.TEMPLATES if t[0] == "MIT" and len(t[1]) > 200)
    changed = text.replace("free of charge", "without charge").replace("copies", "copy")
    found = ls.Scanner().notices("code\n\n\n" + changed + "\n\n\nmore")[0]
    assert found["license"] == name and 0 < found["differing_words"] < 10 and (found["start"], found["end"]) == (7, 7 + len(changed))


def test_edges(odd_docs, odd_rows):
    rows = ls.scan_licenses(odd_docs).collect()
    assert len(rows) == len(odd_rows) and all(r.notices == [] for r in rows)
    assert ls.scan_licenses(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("text, names", [
    ("Licensed under the MIT License.\nLicensed under the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
    ("Licensed under the MIT License. Licensed under the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
    ("x\nLicensed under CC BY 4.0.\nAll rights reserved.\ny", ["CC-BY-4.0", "proprietary"]),
    ("Released under the MIT License.\ncode\nLicensed under CC0 1.0.\nReleased under the MIT License.", ["MIT", "CC0-1.0", "MIT"]),
    ("Licensed under the MIT License.\nLicence of the logo: ask me", ["MIT", "unknown"]),
])
def test_every_notice_of_a_block(text, names):
    found = ls.Scanner().notices(text)
    assert [n["license"] for n in found] == names
    assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:]))


def test_many_equal_notices_are_judged_once(monkeypatch):
    scanner, calls = ls.Scanner(), []
    judge = scanner.judge
    monkeypatch.setattr(scanner, "judge", lambda block: calls.append(block) or judge(block))
    assert len(scanner.notices("Released under the MIT License.\n" * 40)) == 40 and len(calls) == 1


@pytest.mark.parametrize("text, names", [
    ("Licensed under the MIT License.\nReleased under CC BY 4.0.", ["MIT", "CC-BY-4.0"]),
    ("Licensed under the MIT License.\nReleased under CC BY 4.0.\nLicensed under the MIT License.", ["MIT", "CC-BY-4.0", "MIT"]),
    ("Released under CC0 1.0.", ["CC0-1.0"]), ("x\nReleased under CC  BY-NC-SA 4.0.\ny", ["CC-BY-NC-SA-4.0"]),
    ("Licensed under the MIT License. See also page 4.", ["MIT"]),
])
def test_names_are_cues(text, names):
    assert [n["license"] for n in ls.Scanner().notices(text)] == names


def plain_scan(text, templates):
    """Every template tried at every word, the longest first; words of found ones are used up."""
    words = ls.Scanner._words(text)
    free, found = [True] * len(words), []
    for name, t in sorted(templates, key=lambda x: -len(ls.Scanner._words(x[1]))):
        own = ls.Scanner._words(t)
        for i in range(len(words) - len(own) + 1):
            if words[i:i + len(own)] == own and all(free[i:i + len(own)]):
                free[i:i + len(own)] = [False] * len(own)
                found.append((i, name))
    return [name for _, name in sorted(found)]


def test_equals_every_template_at_every_word():
    rng = random.Random(21)
    scanner = ls.Scanner()
    # "Copyright. All rights reserved." holds another template; either reading of it is "proprietary".
    pool = [t for t in ls.TEMPLATES if t[1] != "All rights reserved."]
    prose = ["und so weiter", "el perro come", "some plain words here", "", "x y z"]
    for _ in range(250):
        lines = [rng.choice([rng.choice(pool)[1], rng.choice(pool)[1], rng.choice(prose)]) for _ in range(rng.randint(1, 7))]
        text = rng.choice(["\n", "\n", "\n\n", "\n\n\n", " "]).join(lines)
        assert [n["license"] for n in scanner.notices(text)] == plain_scan(text, pool), text


def test_long_blocks_take_time_in_proportion():
    scanner = ls.Scanner()
    lines = ["Licence: ask me", "licence terms of part"]
    start = time.perf_counter()
    found = scanner.notices("\n".join(f"{lines[i % 2]} {i}" for i in range(4000)) + "\nLicensed under the MIT License.\n" + "\n".join("Licence: ask" for _ in range(2000)))
    assert [n["license"] for n in found] == ["unknown", "MIT", "unknown"] and time.perf_counter() - start < 60
    assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:]))
