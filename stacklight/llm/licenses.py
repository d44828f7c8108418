"""License scans by patience alignment.

Text and template become lower-case words. Words that occur once in both are anchors; the
longest increasing subsequence of their places is kept, and the gaps between them are
aligned in the same way, after equal ends are matched. Coverage is the share of a
template's words that are aligned.

Where a text may hold a template is found without losing any: a template's rarest words,
just more of them than a match may miss, are its markers; a match of the wanted coverage
has at least one of them. Around each marker the text's words that the template could
span are aligned; equal windows are aligned once. Where words of the template are missing,
the window grows by ``gap`` words to the side where they should be, for as long as that aligns more:
so a match holds any number of inserted stretches of up to ``gap`` words each; what is farther
apart isn't one match. Of overlapping matches of one template the best coverage stays, then the
shortest; what another has beside it is aligned again. Texts without any marker are passed over by one search.

Defined results: null and empty texts have no matches; every occurrence in a text counts;
ties go to the shorter, then to the earlier place; repeated rows give repeated matches; other columns
are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklight.llm.common import in_slices, utf8

COVERAGE, GAP = 0.8, 256

# Notices and short texts of public licenses.
TEMPLATES: Mapping[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "MIT": "Released under the MIT License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-3-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.""",
}

_WORDS = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """The places of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile:
            back[i] = ends[pile - 1]
        tops[pile : pile + 1] = [v]
        ends[pile : pile + 1] = [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), ascending in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        times_a, times_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if times_b[w] == 1}
        once = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if times_a[w] == 1 and w in place]
        anchors = [once[k] for k in increasing([j for _, j in once])]
        if not anchors:
            continue
        found += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            if k - i > 1 and m - j > 1:
                todo.append((i + 1, k, j + 1, m))
    return sorted(found)


class Scanner:
    """Finds templates in texts."""

    def __init__(self, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE, gap: int = GAP):
        self.coverage, self.gap = coverage, gap
        self.templates = {name: w for name, text in templates.items() if (w := words_of(text))}
        common = Counter(w for words in self.templates.values() for w in set(words))
        self.marks: dict[str, list[tuple[str, list[int]]]] = {}  # marker -> templates and its places in them
        for name, words in self.templates.items():
            may_miss, taken = int(len(words) * (1 - coverage) + 1e-9), 0
            times = Counter(words)
            for w in sorted(times, key=lambda w: (times[w], -len(w), common[w], w)):
                self.marks.setdefault(w, []).append((name, [i for i, x in enumerate(words) if x == w]))
                taken += times[w]
                if taken > may_miss:
                    break
        self.any = re.compile(r"\b(?:" + "|".join(map(re.escape, self.marks)) + r")\b").search if self.marks else lambda _: None
        self.known: dict[tuple, list[tuple[int, int]]] = {}

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first character, one past the last) of each match."""
        low = text.lower()
        if self.any(low) is None:
            return []
        if len(low) != len(text):  # lower-casing that changes lengths would shift places
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        spans = [m.span() for m in _WORDS.finditer(low)]
        words = [low[a:b] for a, b in spans]
        windows: dict[str, set[tuple[int, int]]] = {}
        for p, w in enumerate(words):
            for name, places in self.marks.get(w, ()):
                size = len(self.templates[name])
                slack = size // 4 + 1
                for q in places:
                    windows.setdefault(name, set()).add((max(0, p - q - slack), min(len(words), p - q + size + slack)))
        out = []
        for name, own in windows.items():
            hits = []
            for a, b in sorted(own):
                hits += self._matches(name, words, a, b)
            out += [(name, covered, spans[first][0], spans[last][1]) for covered, first, last in self._apart(name, words, hits)]
        return sorted(out, key=lambda m: (m[2], m[0]))

    def _apart(self, name: str, words: list[str], hits: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
        """The hits that stay: the best first; what an overlapping one has beside a better one is aligned again."""
        queue = sorted({(-covered, last - first, first, last) for covered, first, last in hits})
        taken: list[tuple[int, int]] = []
        out = []
        while queue:
            minus, _, first, last = heappop(queue)
            k = bisect_left(taken, (first, last))
            over = [t for t in taken[max(0, k - 1) : k + 1] if t[0] <= last and first <= t[1]]
            if not over:
                taken.insert(k, (first, last))
                out.append((-minus, first, last))
            for a, b in [(first, over[0][0]), (over[0][1] + 1, last + 1)] if over else []:
                pairs = self._aligned(name, tuple(words[a:b])) if b > a else []
                if len(pairs) >= self.coverage * len(self.templates[name]):
                    heappush(queue, (-len(pairs) / len(self.templates[name]), pairs[-1][0] - pairs[0][0], a + pairs[0][0], a + pairs[-1][0]))
        return out

    def _matches(self, name: str, words: list[str], a: int, b: int) -> Iterator[tuple[float, int, int]]:
        """(coverage, first word, last word) of the matches that a window and its extensions hold."""
        size, pairs = len(self.templates[name]), self._aligned(name, tuple(words[a:b]))
        while pairs:
            if len(pairs) >= self.coverage * size:
                yield len(pairs) / size, a + pairs[0][0], a + pairs[-1][0]
            wider = []
            if pairs[-1][1] < size - 1 and b < len(words):  # the template's end is missing
                wider.append((a, min(len(words), b + self.gap + size)))
            if pairs[0][1] > 0 and a > 0:  # its beginning is
                wider.append((max(0, a - self.gap - size), b))
            found = [(self._aligned(name, tuple(words[x:y])), x, y) for x, y in wider]
            better = max(found, key=lambda f: len(f[0]), default=None)
            if better is None or len(better[0]) <= len(pairs):
                return
            pairs, a, b = better

    def _aligned(self, name: str, window: tuple[str, ...]) -> list[tuple[int, int]]:
        key = (name, window)
        if key not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[key] = align(list(window), self.templates[name])
        return self.known[key]


_SCHEMA = "doc_id bigint, license string, coverage double, start bigint, end bigint"


def _scanned(batches: Iterator[pa.RecordBatch], templates: Mapping[str, str], coverage: float, gap: int) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(templates, coverage, gap)
    for batch in in_slices(batches, 1):
        rows = [(i, *m) for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in scanner.scan((b or b"").decode("utf-8"))]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "license", "coverage", "start", "end"])


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE, gap: int = GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, coverage, start, end (in characters) of every match in every whole text; one pass, no shuffle."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("body"))
    return rows.mapInArrow(lambda it: _scanned(it, dict(templates), coverage, gap), _SCHEMA)
