"""License scans by conditional compression.

A block of text is compressed alone and with each license template that it may copy as a raw zstandard dictionary. A
template that the block copies makes it much smaller; of blocks that overlap, those that a template takes the most
bytes from are ranked first, and winners are confirmed by the exact differences in wording, from an alignment of the
words.

Candidate blocks are complete: a template that may differ in k words is cut into k + 1 pieces, and a block within
that limit holds at least one piece word for word. Every place of every piece is extended to both sides by the
alignment with the fewest differing words. Only documents that hold the longest word of a piece leave the JVM.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

WORD = re.compile(r"[A-Za-z0-9]+(?:[.'][A-Za-z0-9]+)*")
MIN_REDUCTION = 0.2
MAX_DIFFERENCE = 0.15  # differing words over the template's words
ONE_WORD = 4  # templates of so many words may always differ in one
LEVEL = 3
MEMO = 50_000

#: The wording of public license notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software."),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "BSD-3-Clause-text": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."),
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "ISC": "Released under the ISC License.",
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."),
    "MIT-licensed": "This project is MIT licensed.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "MPL-2.0": "Released under the Mozilla Public License 2.0.",
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at"),
    "Unlicense-text": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-short": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    **{f"SPDX-{x}": f"SPDX-License-Identifier: {x}" for x in (
        "MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "ISC", "BSD-2-Clause", "BSD-3-Clause")},
}


#: Words that tell licenses apart: no difference may add one, or take one or a number away.
NAMES = frozenset("mit apache mozilla mpl bsd isc cc gpl lgpl agpl lesser library affero nc sa nd noncommercial sharealike noderivatives noderivs".split())
NUMBER = re.compile(r"v?([0-9][0-9.]*?)(?:[.]0)?")


@dataclass(frozen=True)
class Match:
    license: str
    start: int
    end: int
    reduction: float
    n_diff: int
    differences: str


def allowed(size: int) -> int:
    """Differing words that a template of `size` words may have."""
    return max(int(MAX_DIFFERENCE * size), int(size >= ONE_WORD))


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def pieces(words: list[str]) -> list[tuple[int, int]]:
    """Begin and end of the pieces of which one is whole in any block within the template's limit."""
    n = allowed(len(words)) + 1
    at = [len(words) * i // n for i in range(n + 1)]
    return list(zip(at, at[1:], strict=False))


def key_of(piece: list[str]) -> int:
    """Place of a piece's longest word, as the rarest."""
    return max(range(len(piece)), key=lambda i: len(piece[i]))


def extend(words: list[str], text: list[str], most: int) -> tuple[int, int, list[tuple[str, str]]] | None:
    """Fewest differing words between `words` and a beginning of `text`, that beginning's length, and the word pairs.

    Of beginnings that tie, the one nearest to the template's length is taken. None above `most` differences.
    """
    far = most + 1
    rows = [{j: j for j in range(min(most, len(text)) + 1)}]
    for i, w in enumerate(words, 1):
        last, row = rows[-1], {}
        for j in range(max(0, i - most), min(len(text), i + most) + 1):
            d = last.get(j, far) + 1
            if j:
                d = min(d, row.get(j - 1, far) + 1, last.get(j - 1, far) + (w != text[j - 1]))
            if d <= most:
                row[j] = d
        if not row:
            return None
        rows.append(row)
    n, _, j = min((d, abs(j - len(words)), j) for j, d in rows[-1].items())
    end, i, pairs = j, len(words), []
    while i or j:
        d = rows[i][j]
        if i and j and rows[i - 1].get(j - 1, far) + (words[i - 1] != text[j - 1]) == d:
            i, j = i - 1, j - 1
            pairs.append((words[i], text[j]))
        elif i and rows[i - 1].get(j, far) + 1 == d:
            i -= 1
            pairs.append((words[i], ""))
        else:
            j -= 1
            pairs.append(("", text[j]))
    return n, end, pairs[::-1]


def spoken(pairs: list[tuple[str, str]]) -> str:
    """The runs of differing words, as `template -> text`."""
    runs, run = [], []
    for p in [*pairs, ("", "")]:
        if p[0] != p[1]:
            run.append(p)
        elif run:
            runs.append(" -> ".join(" ".join(w for w in side if w) for side in zip(*run, strict=True)))
            run = []
    return "; ".join(runs)


def renames(pairs: list[tuple[str, str]]) -> bool:
    """Whether the differences make another license of it: a name or number goes, or a name comes."""
    plain = lambda w: m[1] if (m := NUMBER.fullmatch(w)) else w
    gone = [plain(a) for a, b in pairs if a != b and (a in NAMES or NUMBER.fullmatch(a))]
    come = [plain(b) for a, b in pairs if a != b]
    return any(w not in come for w in gone) or any(w in NAMES and w not in gone for w in come)


class Scanner:
    def __init__(self, templates: dict[str, str]):
        import zstandard

        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.templates = []
        self.pieces: dict[str, list[tuple[int, int, int, int]]] = {}
        for name, text in templates.items():
            words = words_of(text)
            if not words:
                continue
            data = " ".join(words).encode()
            # A dictionary needs a few bytes more than short notices have; the repeat adds no new wording.
            raw = zstandard.ZstdCompressionDict(data * max(1, -(-64 // len(data))), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            press = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False)
            for a, b in pieces(words):
                key = a + key_of(words[a:b])
                self.pieces.setdefault(words[key], []).append((len(self.templates), a, b, key))
            self.templates.append((name, words, press))
        self.memo: dict[str, tuple[int, int]] = {}

    def sizes(self, index: int, block: list[str]) -> tuple[int, int]:
        """Bytes of a block compressed alone, and with a template as dictionary."""
        text = " ".join(block)
        key = f"{index} {text}"
        if key not in self.memo:
            if len(self.memo) > MEMO:
                self.memo.clear()
            data = text.encode()
            self.memo[key] = len(self.alone.compress(data)), len(self.templates[index][2].compress(data))
        return self.memo[key]

    def align(self, index: int, a: int, b: int, words: list[str], at: int) -> tuple[int, int, int, list[tuple[str, str]]] | None:
        """(begin, end, differences, pairs) of the best block whose words from `at` are the template's piece a to b."""
        tw = self.templates[index][1]
        most, first = allowed(len(tw)), at - a
        if first >= 0 and words[first:first + len(tw)] == tw:
            return first, first + len(tw), 0, []
        left = extend(tw[:a][::-1], words[max(0, first - most):at][::-1], most)
        if left is None:
            return None
        stop = at + b - a
        right = extend(tw[b:], words[stop:first + len(tw) + most], most - left[0])
        if right is None:
            return None
        return at - left[1], stop + right[1], left[0] + right[0], left[2][::-1] + [(w, w) for w in tw[a:b]] + right[2]

    def hits(self, words: list[str]) -> list[tuple[int, int, int, float, int, str, int]]:
        """(template, begin, end, reduction, differences, their wording, bytes saved) of every block within the limits."""
        found = {}
        for i, w in enumerate(words):
            for t, a, b, key in self.pieces.get(w, ()):
                at, tw = i - (key - a), self.templates[t][1]
                if at < 0 or words[at:at + b - a] != tw[a:b] or (got := self.align(t, a, b, words, at)) is None:
                    continue
                begin, end, n, pairs = got
                if (t, begin, end) in found or (n and renames(pairs)):
                    continue
                alone, given = self.sizes(t, words[begin:end])
                if 1 - given / alone >= MIN_REDUCTION:
                    found[t, begin, end] = (t, begin, end, 1 - given / alone, n, spoken(pairs), alone - given)
        return list(found.values())

    def scan(self, text: str) -> list[Match]:
        found = list(WORD.finditer(text))
        # Of overlapping blocks the one that its template saves the most bytes of stays, then the one with the fewest differences.
        order = lambda h: (-h[6], h[4], -len(self.templates[h[0]][1]), h[1], self.templates[h[0]][0], h[2])
        starts: list[int] = []
        out: list[Match] = []
        for t, a, b, reduction, n, said, _ in sorted(self.hits([m.group().lower() for m in found]), key=order):
            m = Match(self.templates[t][0], found[a].start(), found[b - 1].end(), reduction, n, said)
            i = bisect.bisect(starts, m.start)
            if (i == 0 or out[i - 1].end <= m.start) and (i == len(out) or m.end <= out[i].start):
                starts.insert(i, m.start)
                out.insert(i, m)
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each license notice found: id, license, start_char, end_char, reduction, n_diff, differences.

    Texts of any length are scanned whole, one at a time; work grows with their length and the places that may hold a
    notice. An empty table gives no rows. Null, empty and clean texts give no rows; repeated rows and null ids give theirs each;
    notices that overlap are ranked by the bytes that their template saves, then by the fewest differences.
    A block differs from its template in at most MAX_DIFFERENCE of the words, and in one at least where the template has
    ONE_WORD words; a difference that makes another license of it (see NAMES) is none of this template. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        for b in batches:
            ids, rows = [], []
            for i, text in enumerate(b.column("text")):
                got = scanner.scan(text.as_py())
                ids += [i] * len(got)
                rows += got
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(ids, pa.int64())), pa.array([m.license for m in rows], pa.string()),
                 pa.array([m.start for m in rows], pa.int64()), pa.array([m.end for m in rows], pa.int64()), pa.array([m.reduction for m in rows], pa.float64()),
                 pa.array([m.n_diff for m in rows], pa.int32()), pa.array([m.differences for m in rows], pa.string())],
                ["id", "license", "start_char", "end_char", "reduction", "n_diff", "differences"])

    kind = dict(docs.dtypes)[id_col]
    keys = sorted({words[a:b][key_of(words[a:b])] for words in map(words_of, chosen.values()) if words for a, b in pieces(words)})
    if not keys:
        keys = ["(?!)"]
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        F.col("text").rlike(f"(?i)(?<![A-Za-z0-9])(?:{'|'.join(k.replace('.', '[.]') for k in keys)})"))
    out = held.mapInArrow(lean(run), f"id {kind}, license string, start_char bigint, end_char bigint, reduction double, n_diff int, differences string")
    return out.withColumnRenamed("id", id_col)
