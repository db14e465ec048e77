"""License scans by patience alignment against notice templates.

A template and a stretch of a text are aligned on the words that occur once in both: the longest
increasing subsequence of their positions anchors, and the gaps between anchors are aligned in the
same way. Words at the ends of a gap that are equal on both sides are matched as well. Coverage is
the share of the template's words that are matched; a stretch with at least ``threshold`` is a find.

Stretches come from the template's rarest words: each place in the whole text where one occurs
proposes the stretch a template starting there would cover, with some slack. Overlapping finds of
one template are one; finds within a better find of another template (a one-line reference that is
part of a full notice) go.

Words are runs of letters and digits, lower-cased. Defined cases: null and empty texts have no
finds; a notice that a text repeats is found each time; equal finds of two templates go to the longer
template, then the smaller name; equal rows get equal finds; an empty table gives none; other
columns are not used.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
#: Public notices, and the one-line references that name a license.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the"
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable"
        " law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES"
        " OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and"
        " limitations under the License."
    ),
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        " files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy,"
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice"
        " shall be included in all copies or substantial portions of the Software."
    ),
    "ISC-notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "All-rights-reserved": "All rights reserved.",
}
#: A template word proposes stretches unless it is one of these common ones.
COMMON = frozenset("2 3 a all an and any as at be by can for found form from has have in is it no not of on or of see shall so such that the this to under use used v was we with without work you".split())


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def longest_increasing(values: Sequence[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience sorting)."""
    tops: list[int] = []
    top_at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before[i] = top_at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(v)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = v, i
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), increasing in both. Gaps wait on a stack, not in calls."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        pairs = [(i, at_b[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in at_b]
        anchors = [pairs[k] for k in longest_increasing([j for _, j in pairs])]
        if not anchors:
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            todo.append((i + 1, k, j + 1, m))
    return sorted(out)


class Scanner:
    """Templates with the words that propose stretches for each."""

    def __init__(self, templates: dict[str, str], threshold: float, cues: int = 3) -> None:
        self.threshold = threshold
        self.templates = {name: words_of(text) for name, text in templates.items()}
        spread = Counter(w for words in self.templates.values() for w in set(words))
        #: word -> [(template, place in it)]; more cues than a find may miss words, so one is left
        self.cues: dict[str, list[tuple[str, int]]] = {}
        for name, words in self.templates.items():
            own = Counter(words)
            may = sorted((w for w in own if w not in COMMON or len(own) <= cues), key=lambda w: (own[w], spread[w], words.index(w)))
            missing = int(len(words) * (1 - threshold) + 1e-9)
            for w in may[: max(cues, missing + 1)]:
                self.cues.setdefault(w, []).append((name, words.index(w)))

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(template, start, end, coverage) of each find, in word positions, ordered by place."""
        words = words_of(text)
        if self.cues.keys().isdisjoint(words):
            return []
        starts: dict[str, set[int]] = {}
        for p, w in enumerate(words):
            for name, at in self.cues.get(w, ()):
                starts.setdefault(name, set()).add(p - at)
        finds = []
        for name, places in starts.items():
            template, done = self.templates[name], -1
            slack = max(2, len(template) // 4)
            for s in sorted(places):
                lo, hi = max(0, s - slack, done), min(len(words), s + len(template) + slack)
                matched = align(template, words[lo:hi]) if hi > lo else []
                coverage = len(matched) / len(template)
                if coverage >= self.threshold:
                    found = (name, lo + matched[0][1], lo + matched[-1][1] + 1, coverage)
                    finds.append(found)
                    done = found[2]
        finds.sort(key=lambda f: (-(f[3] * len(self.templates[f[0]])), f[0], f[1]))
        # finds that are kept lie apart, so a further one can only meet its neighbours in place
        kept: list[tuple[int, int, str, float]] = []
        for name, start, end, coverage in finds:
            i = bisect_left(kept, (start,))
            if (i == len(kept) or kept[i][0] >= end) and (i == 0 or kept[i - 1][1] <= start):
                kept.insert(i, (start, end, name, coverage))
        return [(name, start, end, coverage) for start, end, name, coverage in kept]


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = 0.8
) -> DataFrame:
    """doc_id, license, start, end, coverage, matched: one row a find."""
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(templates or TEMPLATES, threshold))
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(d, *f) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for f in scanner.value.scan(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, license string, start int, end int, coverage double")
