"""License scans (operator 3).

The templates' words are cut into k-grams; winnowing keeps the least hash of every ``winnow`` k-grams
in a row, and an inverted index maps a kept hash to (template, place). A document's k-grams are all
looked up, so any run of ``k + winnow - 1`` words shared with a template meets the index. Hits of a
template that lie near one diagonal (document place minus template place) form a candidate;
a local alignment in a band around that diagonal gives the matched words, and the match is reported
if they cover ``coverage`` of the template and of the text's words between its ends; its words are then
taken out and the band is aligned again, until coverage is missed, so notices close to each other are all
found. Places where a template occurs word for word need no alignment.

Licences differ by a few words. A template marks these in braces: ``{GNU General Public License}`` must
occur in the match, its words in a row. A match that covers a template but lacks a marked phrase is
some other licence: it is reported as ``unknown`` unless a named match overlaps it. Of overlapping matches
a named one goes before an unknown one, then the one with more matched words, the higher coverage, the
earlier start, the first licence and template by name and number stays.

All work is inside a document, so nothing is shuffled; the index of the templates (a parameter, a
few thousand words) travels with the task.

Defined cases: a null or empty text has no match; repeated rows are scanned each; a null ``doc_id``
is carried; an empty table or no templates give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from namemine.llm.shared import only
from namemine.llm.textkit import mix

K = 3
WINNOW = 3
BAND = 8
COVERAGE = 0.8
MATCH, MISMATCH, GAP = 2, -1, -1

_WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")

UNKNOWN = "unknown"

#: Public license notices (fixed values), by SPDX identifier; phrases in braces tell a license from its neighbours.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-1.1": ("Licensed under the {Apache Software License, Version 1.1}.",),
    "Apache-2.0": (
        "Licensed under the {Apache License, Version 2.0}.",
        'Licensed under the {Apache License, Version 2.0} (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the {MIT} License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to {deal in the Software without restriction}, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "BSL-1.0": (
        "Distributed under the {Boost Software License, Version 1.0}.",
        "Permission is hereby granted, free of charge, to any {person or organization} obtaining a copy of the software and "
        'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, '
        "and transmit the Software, and to prepare derivative works of the Software",
    ),
    "BSD-2-Clause": (
        "Released under the {BSD 2-Clause} License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided {with the "
        "distribution. THIS SOFTWARE IS PROVIDED}",
    ),
    "BSD-3-Clause": (
        "Released under the {BSD 3-Clause} License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. {Neither the name of} the copyright holder {nor the names of its contributors} may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, {provided that the above copyright notice} and this permission notice appear in all copies.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. {In no event will the authors} be held liable "
        "for any damages arising from the use of this software.",
    ),
    "MPL-1.1": (
        'The contents of this file are subject to the {Mozilla Public License Version 1.1} (the "License"); you may not use this '
        "file except in compliance with the License.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the {Eclipse Public License 2.0}",),
    "Unlicense": ("This is {free and unencumbered software} released into the public domain.",),
    "CC0-1.0": (
        "Licensed under {CC0 1.0}.",
        "To the extent possible under law, the author has {waived all copyright} and related or neighboring rights to this work.",
    ),
}

#: Public names of the Creative Commons elements, the editions' names and the GNU licenses (fixed values).
CC_ELEMENTS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CC_EDITIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
GNU = {
    "GPL": ("GNU General Public License", ("2", "3")),
    "LGPL": ("GNU Lesser General Public License", ("2.1", "3")),
    "AGPL": ("GNU Affero General Public License", ("3",)),
}


def _templates() -> dict[str, tuple[str, ...]]:
    """``NOTICES`` and the notices of the two families, made from their names."""
    out = dict(NOTICES)
    for code, title in CC_ELEMENTS.items():
        for version, edition in CC_EDITIONS.items():
            named = title if version == "4.0" else title.replace("NoDerivatives", "NoDerivs")
            whole = f"This work is licensed under a {{Creative Commons {named} {version}}} {edition} License."
            out[f"CC-{code}-{version}"] = (f"Licensed under {{CC {code} {version}}}.", whole)
    for code, (title, versions) in GNU.items():
        for version in versions:
            out[f"{code}-{version if '.' in version else version + '.0'}"] = (
                f"This work is licensed under the {{{title}, version {version}}}.",
                f"This program is free software: you can redistribute it and/or modify it under the terms of the {{{title}}} as published "
                f"by the Free Software Foundation, either {{version {version}}} of the License, or (at your option) any later version.",
            )
    return out


TEMPLATES = _templates()


class Match(NamedTuple):
    """A reported match; bounds in code points, end exclusive. ``template`` is the notice's number within its
    license, -1 if that is unknown."""

    license: str
    template: int
    start: int
    end: int
    n_matched: int
    coverage: float


def _kgrams(ids: np.ndarray, k: int) -> np.ndarray:
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n].astype(np.uint64) + np.uint64(1)
    return mix(out)


def winnowed(hashes: np.ndarray, window: int) -> list[int]:
    """Places of the least hash (rightmost of equal ones) of every ``window`` in a row."""
    if not len(hashes):
        return []
    window = min(window, len(hashes))
    return sorted({i + window - 1 - int(np.argmin(hashes[i : i + window][::-1])) for i in range(len(hashes) - window + 1)})


def align(doc: np.ndarray, template: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, last + 1 word of the document) of the best local alignment whose
    diagonal is within ``band``; (0, 0, 0) if nothing matches."""
    before: dict[int, tuple[int, int, int]] = {}  # diagonal -> (score, matched, first word)
    best = (0, 0, 0, 0)
    for t in range(len(template)):
        now: dict[int, tuple[int, int, int]] = {}
        for d in range(diagonal - band, diagonal + band + 1):
            at = t + d
            if not 0 <= at < len(doc):
                continue
            same = doc[at] == template[t]
            s, m, f = before.get(d, (0, 0, at))  # diagonal step
            if s <= 0:
                s, m, f = 0, 0, at
            here = (s + MATCH, m + 1, f) if same else (s + MISMATCH, m, f)
            for s, m, f in (before.get(d + 1, (0, 0, at)), now.get(d - 1, (0, 0, at))):  # a gap in the document, in the template
                if s + GAP > here[0]:
                    here = (s + GAP, m, f)
            if here[0] > 0:
                now[d] = here
                if (here[0], here[1]) > best[:2]:
                    best = (here[0], here[1], here[2], at + 1)
        before = now
    return best[1], best[2], best[3]


class Template(NamedTuple):
    license: str
    number: int
    words: np.ndarray
    phrases: list[np.ndarray]
    times: np.ndarray  # of each known word's id


def _at(ids: np.ndarray, phrase: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places among ``first`` where ``phrase`` stands word for word."""
    first = first[(first >= 0) & (first <= len(ids) - len(phrase))]
    for i, word in enumerate(phrase):
        first = first[ids[first + i] == word]
    return first


def _holds(ids: np.ndarray, phrases: list[np.ndarray]) -> bool:
    return all(len(_at(ids, p, np.flatnonzero(ids == p[0]))) for p in phrases)


class Scanner:
    """The inverted index of the templates, and the scan of a text."""

    def __init__(self, templates: dict[str, tuple[str, ...]] | None = None, k: int = K, winnow: int = WINNOW, band: int = BAND, coverage: float = COVERAGE):
        self.k, self.band, self.coverage = k, band, coverage
        self.words: dict[str, int] = {}
        numbered = [(name, i, text) for name, texts in (TEMPLATES if templates is None else templates).items() for i, text in enumerate(texts)]
        made = [(name, i, self._ids(text), [self._ids(p) for p in re.findall(r"\{([^}]*)\}", text) if _WORD.search(p)]) for name, i, text in numbered]
        self.templates = [Template(*t, np.bincount(t[2], minlength=len(self.words) + 1)) for t in made]
        self.index: dict[int, list[tuple[int, int]]] = {}
        starts: set[int] = set()  # of the index's k-grams: cheap test
        for t, template in enumerate(self.templates):
            grams = _kgrams(template.words, k)
            for place in winnowed(grams, winnow):
                self.index.setdefault(int(grams[place]), []).append((t, place))
                starts.add(int(template.words[place]))
        self.keys = np.sort(np.fromiter(self.index, np.uint64, len(self.index)))
        cues = sorted((re.escape(w) for w, i in self.words.items() if i in starts), key=len, reverse=True)
        self.cue = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(cues) + r")(?![A-Za-z0-9])", re.IGNORECASE) if cues else None

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray([self.words.setdefault(w.lower(), len(self.words) + 1) for w in _WORD.findall(text)], dtype=np.int64)

    def scan(self, text: str) -> list[Match]:
        if not text or self.cue is None or not self.cue.search(text):
            return []
        spots = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        ids = np.fromiter((self.words.get(text[s:e].lower(), 0) for s, e in spots), np.int64, len(spots))
        known = ids > 0
        runs = np.convolve(known, np.ones(self.k, np.int64), "valid") == self.k if len(ids) >= self.k else np.zeros(0, bool)
        if not runs.any():
            return []
        places = np.flatnonzero(runs)
        grams = _kgrams(ids, self.k)[places]
        hit = np.isin(grams, self.keys)
        by_template: dict[int, list[tuple[int, int]]] = {}  # (place, diagonal)
        for place, gram in zip(places[hit].tolist(), grams[hit].tolist(), strict=True):
            for t, at in self.index[gram]:
                by_template.setdefault(t, []).append((place, place - at))
        hits = {t: np.asarray(x) for t, x in by_template.items()}
        found = [m for t, x in hits.items() for m in self._whole(ids, self.templates[t], np.unique(x[:, 1]))]
        taken = np.zeros(len(ids), np.int64)  # words of the longest notice that stands word for word here
        for m in sorted(found, key=lambda m: m.n_matched):
            taken[m.start : m.end] = m.n_matched
        for t, x in hits.items():
            left = np.where(taken >= len(self.templates[t].words), -1, ids)  # a match on other words would lose to that notice
            found += self._near(left, self.templates[t], np.unique(x[left[x[:, 0]] > 0, 1]))
        kept = _without_overlap(found)
        return [Match(m.license, m.template, spots[m.start][0], spots[m.end - 1][1], m.n_matched, m.coverage) for m in kept]

    def _whole(self, ids: np.ndarray, template: Template, diagonals: np.ndarray) -> Iterator[Match]:
        """The places (in words) where a template stands word for word."""
        n, end = len(template.words), -1
        for at in _at(ids, template.words, diagonals).tolist():
            if at >= end:
                end = at + n
                yield Match(template.license, template.number, at, end, n, 1.0)

    def _near(self, ids: np.ndarray, template: Template, diagonals: np.ndarray) -> Iterator[Match]:
        """Other matches of a template, of which one that lacks a marked phrase is unknown."""
        n = len(template.words)
        for d in _clusters(diagonals.tolist(), self.band):
            lo, hi = max(0, d - self.band), min(len(ids), d + n + self.band)
            part = ids[lo:hi].copy()
            while True:
                here = np.bincount(part[part > 0], minlength=len(template.times))
                if np.minimum(here, template.times).sum() < self.coverage * n:  # no alignment can match so many
                    break
                matched, first, last = align(part, template.words, d - lo, self.band)
                if matched < self.coverage * n:
                    break
                if matched >= self.coverage * (last - first):
                    named = _holds(part[first:last], template.phrases)
                    yield Match(template.license if named else UNKNOWN, template.number if named else -1, lo + first, lo + last, matched, matched / n)
                part[first:last] = -1  # a further notice may lie in the same band


def _clusters(diagonals: list[int], band: int) -> Iterator[int]:
    """Middle diagonals of runs that a band covers."""
    start = previous = None
    for d in diagonals:
        if start is not None and d - start <= band:
            previous = d
            continue
        if start is not None:
            yield (start + previous) // 2
        start = previous = d
    if start is not None:
        yield (start + previous) // 2


def _without_overlap(found: list[Match]) -> list[Match]:
    """The matches that no better one overlaps, by start."""
    kept: list[Match] = []
    for m in sorted(found, key=lambda m: (m.license == UNKNOWN, -m.n_matched, -m.coverage, m.start, m.license, m.template)):
        i = bisect_left(kept, m.start, key=lambda o: o.start)
        if (i == len(kept) or kept[i].start >= m.end) and (i == 0 or kept[i - 1].end <= m.start):
            insort(kept, m, key=lambda o: o.start)
    return kept


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, **how) -> DataFrame:
    """A row per match: ``doc_id, license, template, start, end, n_matched, coverage``."""
    scanner = Scanner(templates, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, value in enumerate(batch.column(1)):
                rows += [(ids[i], *m) for m in scanner.scan(value.as_py() or "")]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", *Match._fields])

    schema = "doc_id long, license string, template int, start long, end long, n_matched long, coverage double"
    return only(docs, doc_id="long", text="string").mapInArrow(run, schema)
