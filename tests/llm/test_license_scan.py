"""License notices within the limits, against a brute force that compares every window with every template."""

import random

from quarry.llm import license_scan as L

DOCS = "doc_id bigint, text string"


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    return {(r.doc_id, r.license): r for r in L.scan_licenses(docs).collect()}


def test_short_notices_with_a_differing_word(spark):
    mit = L.TEMPLATES["MIT-text"]
    texts = ["This work is released under the GNU General Public License, version 3.", mit.split(" ", 1)[1], "Consent" + mit.removeprefix("Permission"),
             "Released under the MIT-licensed terms.", "Distributed under the MIT License.", "Released under the MIT Licence.", "Published under CC BY-NC 4.0."]
    got = scan(spark, texts)
    assert set(got) == {(0, "GPL-3.0"), (1, "MIT-text"), (2, "MIT-text"), (3, "MIT"), (4, "MIT"), (5, "MIT"), (6, "CC-BY-NC-4.0")}
    assert all(r.n_diff == 1 for r in got.values())
    assert got[0, "GPL-3.0"].differences == "licensed -> released" and got[1, "MIT-text"].differences == "permission -> "
    assert texts[5][got[5, "MIT"].start_char:got[5, "MIT"].end_char] == "Released under the MIT Licence"


def test_another_license_is_no_difference(spark):
    texts = ["Released under the BSD License.", "Licensed under the Apache License, Version 1.1.", "Licensed under CC BY 4.0.",
             "This work is licensed under the GNU Lesser General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2."]
    got = {(i, name) for i, name in scan(spark, texts) if name in ("MIT", "Apache-2.0", "CC-BY-NC-4.0", "GPL-3.0")}
    assert got == set()


def test_every_template_finds_itself(spark):
    assert {"GPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "ISC", "BSD-3-Clause"} <= set(L.TEMPLATES)
    names = list(L.TEMPLATES)
    got = scan(spark, [f"Some words before. {L.TEMPLATES[n]} Some words after." for n in names])
    assert [(i, n) for i, n in sorted(got)] == list(enumerate(names)) and all(r.n_diff == 0 for r in got.values())


def least(words, block):
    """Plain edit distance."""
    row = list(range(len(block) + 1))
    for i, w in enumerate(words, 1):
        nxt = [i]
        for j, x in enumerate(block, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (w != x)))
        row = nxt
    return row[-1]


def brute(words, tw):
    """Fewest differences over every window, and the windows that have them."""
    most, out = L.allowed(len(tw)), {}
    for a in range(len(words)):
        for b in range(a + max(1, len(tw) - most), min(len(words), a + len(tw) + most) + 1):
            if (n := least(tw, words[a:b])) <= most:
                out[a, b] = n
    return out


def test_every_window_against_every_template():
    rng, scanner = random.Random(8), L.Scanner(L.TEMPLATES)
    short = [t for t, (_, tw, _) in enumerate(scanner.templates) if len(tw) <= 40]
    seen = 0
    for _ in range(120):
        t = rng.choice(short)
        tw = scanner.templates[t][1]
        text = list(tw)
        for _ in range(rng.randrange(L.allowed(len(tw)) + 2)):
            at, how = rng.randrange(len(text)), rng.randrange(3)
            text[at:at + 1] = [["other"], [], [text[at], "other"]][how]
        pad = [rng.choice(["under", "the", "license", "word", "is", "of"]) for _ in range(12)]
        cut = rng.randrange(13)
        words = pad[:cut] + text + pad[cut:]
        hits = scanner.hits(words)
        for u in short:
            tw = scanner.templates[u][1]
            got, want = {h[1:3]: h[4] for h in hits if h[0] == u}, brute(words, tw)
            assert all(want[w] == n for w, n in got.items())
            # Windows whose differences name another license are none.
            named = [n for w, n in want.items() if not L.renames(L.extend(tw, words[w[0]:w[1]], n)[2])]
            if want and min(want.values()) in named:
                assert min(got.values()) == min(named)
                seen += u == t
    assert seen > 40
