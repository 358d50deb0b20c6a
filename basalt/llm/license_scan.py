"""License scans by patience alignment.

A text and a license template are aligned as sequences of words: common words
at both ends are matched; words that occur once in the text and once in the template are
anchors; the longest increasing subsequence of anchors (by patience sorting) is kept; gaps between them are aligned
in the same way. Where a range has no anchor since the template stands in it more than once,
the range is halved and both halves are aligned. Coverage is the share of the template's words that are matched within a
window of the text of twice the template's length, so that words strewn over a long text don't add up.

Only texts that can reach the coverage are aligned: to match a share c of a template of n words a
text must hold one of any floor((1 - c) n) + 1 of its words. The longest are looked for first.

Patience anchors can be drawn apart where a template's words recur. So a text that holds enough of the words, but falls short, is checked exactly: longest
common subsequences of ranges of windows, by bits, bound those of the windows in them; ranges that can't do better are left, others halved. Nothing that reaches the coverage is missed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

#: Templates of up to so many words have their exact coverage.
SHORT = 64
_WORDS = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")

#: Notices of well-known public licenses, by SPDX identifier: one-line ones and fragments here, and the standard notices
#: (-notice) and full texts (-full) of the files in licenses/. Only the driver reads them.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All-Rights-Reserved": "All rights reserved.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "Apache-2.0-text": "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
}
TEMPLATES |= {p.stem if p.stem.endswith("-notice") else f"{p.stem}-full": p.read_text() for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    holders: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile:
            before[k] = holders[pile - 1]
        if pile == len(tops):
            tops.append(v)
            holders.append(k)
        else:
            tops[pile], holders[pile] = v, k
    out = []
    k = holders[-1] if holders else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched (text position, template position) pairs, both rising."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a >= b or c >= d:
            continue
        wanted = Counter(template[c:d])
        at: dict[str, list[int]] = {}
        for k in range(a, b):
            if text[k] in wanted:
                at.setdefault(text[k], []).append(k)
        anchors = [(at[w][0], k) for k, w in enumerate(template[c:d], c) if wanted[w] == 1 and len(at.get(w, ())) == 1]
        anchors = [anchors[k] for k in longest_increasing([x for x, _ in anchors])]
        if anchors:
            matched += anchors
            for (x, y), (x2, y2) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
                todo.append((x + 1, x2, y + 1, y2))
        elif at and b - a > 1:
            # Several copies of the words: the half in which more of the template aligns.
            half = (a + b) // 2
            halves = [align(text[lo:hi], template[c:d]) for lo, hi in ((a, half), (half, b))]
            best, lo = (halves[0], a) if len(halves[0]) >= len(halves[1]) else (halves[1], half)
            matched += [(x + lo, y + c) for x, y in best]
    return sorted(matched)


def densest(matched: list[tuple[int, int]], window: int) -> tuple[int, int, int]:
    """(number, first, last position) of the most matches within a window of the text; the earliest of equals."""
    best, lo = (0, -1, -1), 0
    for hi, (x, _) in enumerate(matched):
        while x - matched[lo][0] >= window:
            lo += 1
        if hi - lo + 1 > best[0]:
            best = (hi - lo + 1, matched[lo][0], x)
    return best


@dataclass
class Template:
    words: list[str]
    counts: Counter
    needles: dict[str, list[int]]  # with their places in the template
    bits: dict[str, int]  # of each word, its places as bits
    least: float  # matched words that are enough


def parse(text: str, min_coverage: float) -> Template | None:
    """None for a text without words."""
    words = words_of(text)
    if not words:
        return None
    own = needles_of(words, min_coverage)
    places = {w: [k for k, x in enumerate(words) if x == w] for w in set(words)}
    return Template(words, Counter(words), {w: places[w] for w in own}, {w: sum(1 << k for k in ks) for w, ks in places.items()}, min_coverage * len(words))


def _common(text: list[str], template: Template) -> list[int]:
    """By number of words of the text, a bit set for each place of the template; the zeros among the low j bits count a longest common subsequence with its first j words."""
    mask = (1 << len(template.words)) - 1
    row = mask
    rows = [row]
    for w in text:
        if hit := template.bits.get(w, 0) & row:
            row = (row + hit | row - hit) & mask
        rows.append(row)
    return rows


def _ends(rows: list[int], size: int) -> tuple[int, int]:
    """The text's first and last word of a longest common subsequence."""
    matched = lambda i, j: j - (rows[i] & (1 << j) - 1).bit_count()
    i, j, first, last = len(rows) - 1, size, -1, -1
    while matched(i, j):
        if matched(i - 1, j) == matched(i, j):
            i -= 1
        elif matched(i, j - 1) == matched(i, j):
            j -= 1
        else:
            i, j = i - 1, j - 1
            first, last = i, max(last, i)
    return first, last


def exact_window(text: list[str], template: Template, best: int) -> tuple[int, int, int]:
    """(matched, first, last word) of the best window, if it matches more than `best` words and enough; else (best, -1, -1)."""
    size = len(template.words)
    window = 2 * size
    held: Counter = Counter()
    shared, able = 0, []
    for k, w in enumerate(text):
        if w in template.counts:
            held[w] += 1
            shared += held[w] <= template.counts[w]
        out = k - window
        if out >= 0 and text[out] in template.counts:
            shared -= held[text[out]] <= template.counts[text[out]]
            held[text[out]] -= 1
        if (k >= window - 1 or k == len(text) - 1) and shared > best and shared >= template.least:
            able.append(max(0, k - window + 1))
    ranges: list[tuple[int, int]] = []
    for a in able:
        if ranges and a - ranges[-1][0] < size and a - ranges[-1][1] <= 1:
            ranges[-1] = (ranges[-1][0], a)
        else:
            ranges.append((a, a))
    found = (best, -1, -1)
    todo = ranges[::-1]
    while todo and found[0] < size:
        lo, hi = todo.pop()
        rows = _common(text[lo : hi + window], template)
        n = size - rows[-1].bit_count()
        if n <= found[0] or n < template.least:
            continue
        if lo == hi:
            first, last = _ends(rows, size)
            found = (n, lo + first, lo + last)
        else:
            middle = (lo + hi) // 2
            todo += [(middle + 1, hi), (lo, middle)]
    return found


def coverage_of(text: list[str], template: Template) -> tuple[float, int, int]:
    """(coverage, first, last word) of a template in a text: the best of the whole text's alignment and those of windows at every needle.

    A copy that is covered holds a needle: it lies within a window's length of it, and near the place that the needle's
    place in the template gives. Both ranges are aligned on their own, unless they hold too few of the words.
    """
    size = len(template.words)
    window = 2 * size
    n, first, last = densest(align(text, template.words), window)
    if n < size:
        # The whole text may have drawn anchors away from each other. Ranges that start close together are one.
        step, slack, ranges, done = size // 8, max(1, size // 5), set(), -1
        for k, w in enumerate(text):
            if w in template.needles:
                if k > done:
                    ranges.add((max(0, k - window), k + step + window))
                    done = k + step
                for at in template.needles[w]:
                    lo = (k - at) // slack * slack
                    ranges.add((max(0, lo - slack), lo + 2 * slack + size))
        for lo, hi in sorted(ranges):
            part = text[lo:hi]
            if n < size and sum((Counter(part) & template.counts).values()) > n:
                m, f, z = densest(align(part, template.words), window)
                if m > n:
                    n, first, last = m, f + lo, z + lo
    # Longer templates are checked only where they fall short: that a covered one could be covered still better says little.
    if n < size and (n < template.least or size <= SHORT):
        more = exact_window(text, template, n)
        if more[0] > n:
            n, first, last = more
    return n / size, first, last


def scan(text: str, templates: dict[str, Template], min_coverage: float) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, last word) of all templates that are covered."""
    words = words_of(text)
    distinct = set(words)
    out = []
    held = None
    for name, template in templates.items():
        least = min_coverage * len(template.words)
        if len(words) < least or template.needles.keys().isdisjoint(distinct):
            continue
        # No alignment matches more than the words that both have.
        if sum(map(template.counts.__getitem__, distinct & template.counts.keys())) < least:
            continue
        held = held or Counter(words)
        if sum((held & template.counts).values()) >= least:
            coverage, first, last = coverage_of(words, template)
            if coverage >= min_coverage:
                out.append((name, coverage, first, last))
    return out


def needles_of(template: list[str], min_coverage: float) -> list[str]:
    """Of these words a text must hold one: all occurrences of the longest words, until more than the share that may be missing."""
    counts, out, missing = Counter(template), [], 0
    for w in sorted(counts, key=lambda w: (-len(w), w)):
        out.append(w)
        missing += counts[w]
        if len(template) - missing < min_coverage * len(template):
            break
    return out


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, min_coverage: float = 0.8) -> DataFrame:
    """One row per document: the id, license (the template of highest coverage, the longer and then the first by name of equals; null if none is covered), coverage, first_word, last_word (positions among the text's words), licenses (all that are covered, by name).

    Null and empty texts hold no license. A text of any length is scanned whole. Rows that share an id are scanned each. An empty
    input gives an empty result. Only the id and the text are read. Templates without words are ignored.
    """
    parsed = {k: t for k, v in sorted((TEMPLATES if templates is None else templates).items()) if (t := parse(v, min_coverage))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1):
                found = scan(text.as_py() or "", parsed, min_coverage)
                best = min(found, key=lambda r: (-r[1], -len(parsed[r[0]].words), r[0]), default=(None, 0.0, None, None))
                rows.append((*best, [r[0] for r in found]))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[id_col, "license", "coverage", "first_word", "last_word", "licenses"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, license string, coverage double, first_word long, last_word long, licenses array<string>")
