"""License scans by patience alignment.

Words are runs of letters and digits, lower-cased. A template is laid against
windows of a text, two and a half times its length and one length apart, so that
every passage of up to one and a half lengths lies whole in a window. In a
window, words that occur once in both are paired, the longest increasing
subsequence of the pairs anchors the alignment, and the gaps between anchors are
aligned in the same way; common words at the ends of a gap are matched first.
Aligned words that stand far off at either end are trimmed until the passage is
dense. Coverage is the share of the template's words that are aligned.

What a window yields is aligned again with the words around it, as the window may
have cut it; then it is masked and the window laid again, so neighbouring
passages are found one after the other. Where a window has enough of the words
but yields nothing (two copies side by side leave no word that occurs once),
narrower windows a quarter length apart follow.

Windows that hold too few of the template's words to reach the coverage, in any
order, are skipped: they could not match. Texts are independent of each other,
so this is one pass over the table without a shuffle; whole texts are scanned,
and the work in a window is bounded by the template.

Licenses that differ in a name or a number are told apart. The names of a template
are computed: its numbers, and its words with a capital inside a sentence, without
those that more than half of all templates hold. In a template of up to
NAMED_WORDS words, names that follow each other must do so in the passage
("Attribution-NonCommercial 4.0" is not "Attribution 4.0"), and no number may be
missing; of up to SHORT_WORDS words, no name at all. Of passages that lie on
nearly the same words (RIVAL of the longer one) the one with the most aligned
words, less the template's other words, stands.

Templates are the whole texts of common licenses, in the folder ``licenses``
beside this module, and the short notices that stand for them; both are
parameters of ``scan``.

Defined cases: a null or empty text matches nothing. A null ``doc_id`` is
carried. Very long texts are scanned whole, in time proportional to their
length. A text that holds a template several times has a match for each; of two
alignments that overlap (a tie) the first stands. A passage within a longer one,
as a notice in a license text, has a match beside it. Repeated rows match each. An empty table
gives no rows. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from pathlib import Path
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
#: Least share of a matched passage that the template's words make up.
DENSITY = 0.6
#: Templates of so many words must have all their names, or their numbers and unbroken names; rivals share so much of the longer passage.
SHORT_WORDS, NAMED_WORDS, RIVAL = 20, 200, 0.8

# License notices in their published wording.
NOTICES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
}

#: Whole license texts, a file each.
TEXTS = Path(__file__).parent / "licenses"


def catalogue(folder: Path = TEXTS) -> dict[str, str]:
    """All templates by name: the notices and the texts of a folder."""
    return NOTICES | {f.stem: f.read_text() for f in sorted(folder.glob("*.txt"))}


_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
        back[i] = at[pile - 1] if pile else -1
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two word lists, in order."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        single = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if w in place and in_a[w] == 1]
        if not single:
            continue
        last = (a0, b0)
        for i, j in (single[k] for k in increasing([j for _, j in single])):
            pairs.append((i, j))
            gaps.append((last[0], i, last[1], j))
            last = (i + 1, j + 1)
        gaps.append((last[0], a1, last[1], b1))
    return sorted(pairs)


class Template(NamedTuple):
    name: str
    words: list[str]
    counts: Counter
    names: list[bool]  # of each word, whether it names the license


@cache
def _common() -> frozenset[str]:
    """The words that more than half of the shipped templates hold."""
    every = [set(words_of(t)) for t in catalogue().values()]
    held = Counter(w for t in every for w in t)
    return frozenset(w for w, n in held.items() if 2 * n > len(every))


def names_of(text: str) -> list[bool]:
    """For each word of a template's text, whether it is a number or a name."""
    out = []
    for found in _WORD.finditer(text):
        word, before = found[0], text[: found.start()].rstrip(" \t\"'(“‘")
        inside = before and before[-1] not in ".!?:\n"
        out.append(word.isdigit() or bool(inside and word[0].isupper() and word.lower() not in _common()))
    return out


def templates_of(texts: dict[str, str]) -> list[Template]:
    return [Template(k, w := words_of(v), Counter(w), names_of(v)) for k, v in texts.items()]


def named(pairs: list[tuple[int, int]], template: Template) -> bool:
    """Whether a passage has the names of its template."""
    m = len(template.words)
    if m > NAMED_WORDS:
        return True
    at = dict(pairs)
    missing = [i for i in range(m) if template.names[i] and i not in at]
    if any(m <= SHORT_WORDS or template.words[i].isdigit() for i in missing):
        return False
    return all(at[i + 1] == at[i] + 1 for i in range(m - 1) if template.names[i] and template.names[i + 1] and i in at and i + 1 in at)


def trimmed(pairs: list[tuple[int, int]], need: float, density: float) -> list[tuple[int, int]]:
    """The aligned pairs without those far off at an end, or none if too few are left."""
    first, last = 0, len(pairs) - 1
    while last - first + 1 >= need and last - first + 1 < density * (pairs[last][1] - pairs[first][1] + 1):
        if pairs[first + 1][1] - pairs[first][1] > pairs[last][1] - pairs[last - 1][1]:
            first += 1
        else:
            last -= 1
    return pairs[first : last + 1] if last - first + 1 >= need else []


def matches(words: list[str], template: Template, coverage: float = COVERAGE, density: float = DENSITY) -> list[tuple[int, int, int]]:
    """(first word, end, aligned words) of each passage that covers the template."""
    m = len(template.words)
    need = coverage * m - 1e-9
    known = template.counts
    places = [i for i, w in enumerate(words) if w in known]
    left: list[str | None] = list(words)  # found passages are masked
    found: list[tuple[int, int, int]] = []

    def search(width: int, step: int) -> bool:
        """Whether some window had the words but gave no passage."""
        missed, done = False, -1
        for p in places:
            for k in range(max(done + 1, (p - width) // step + 1, 0), p // step + 1):  # the windows that hold this word
                done = k
                start = k * step
                if bisect_left(places, start + width) - bisect_left(places, start) < need:
                    continue
                while True:
                    window = left[start : start + width]
                    held = Counter(w for w in window if w in known)
                    if sum(min(n, known[w]) for w, n in held.items()) < need:
                        break
                    pairs = trimmed(align(template.words, window), need, density)
                    if not pairs:
                        missed = True
                        break
                    first, end = start + pairs[0][1], start + pairs[-1][1] + 1
                    # The window may have cut the passage: look again for what it lacks, around it.
                    more = 2 * (m - len(pairs))
                    begin = max(0, first - more)
                    wider = trimmed(align(template.words, left[begin : end + more]), need, density) if more else []
                    if len(wider) > len(pairs):
                        pairs, first, end = wider, begin + wider[0][1], begin + wider[-1][1] + 1
                    left[first:end] = [None] * (end - first)
                    if named(pairs, template):
                        found.append((first, end, len(pairs)))
        return missed

    if search(m * 5 // 2 + 1, m):
        search(m + m // 4 + 1, m // 4 + 1)
    return sorted(found)


def without_rivals(found: list[tuple[int, int, int, Template]]) -> list[tuple[int, int, int, Template]]:
    """Of passages (start, end, aligned words, template) on nearly the same words the best one."""
    kept: list[tuple[int, int, int, Template]] = []
    for row in sorted(found, key=lambda r: (-(2 * r[2] - len(r[3].words)), -r[2] / len(r[3].words), r[3].name, r[0])):
        start, end = row[:2]
        if all(min(end, e) - max(start, s) < RIVAL * max(end - start, e - s) for s, e, _, t in kept if t.name != row[3].name):
            kept.append(row)
    return kept


_FIELDS = [("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_aligned", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, n_aligned and the passage's word interval, a row per match."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    laid = templates_of(catalogue() if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = frozenset(w for t in laid for w in t.counts)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = words_of(text.as_py())
                present, found = every.intersection(words), []
                for t in laid:
                    # All the template's words that the text has, wherever they are, must do.
                    need = coverage * len(t.words) - 1e-9
                    if t.words and len(words) >= need and sum(map(t.counts.__getitem__, present.intersection(t.counts))) >= need:
                        found += [(*match, t) for match in matches(words, t, coverage)]
                rows += [(doc, t.name, n / len(t.words), n, a, b) for a, b, n, t in without_rivals(found)]
            cols = zip(*rows) if rows else ((),) * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(cols, _FIELDS)], [k for k, _ in _FIELDS])

    return held.mapInArrow(run, "doc_id long, license string, coverage double, n_aligned long, start long, end long")
