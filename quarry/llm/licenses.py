"""License scan: winnowed fingerprints pick candidate places, a banded alignment measures them.

Templates are word sequences.  The hashes of their word K-grams are winnowed (the smallest of every W in a
row; all of a short template) into an inverted index, which is small and travels with the code.  Every K-gram
of a document is looked up; hits of one template on nearby diagonals form a candidate place, which is aligned to
the template within a band of diagonals.  Of templates that compete for a place the one stays that agrees best,
unmatched words of template and document counted; names and versions must agree.  The report gives the share of
the template's words that match, and the span.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from quarry.llm.common import map_texts

# Notices of common licenses, as their texts or stewards word them.
NOTICES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT-line": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

#: Names that a one-line notice, or a passing mention, gives a license by.
TITLES = {
    "Apache-1.0": "Apache License, Version 1.0", "Apache-1.1": "Apache License, Version 1.1", "Apache-2.0": "Apache License, Version 2.0",
    "GPL-1.0": "GNU General Public License, version 1", "GPL-2.0": "GNU General Public License, version 2", "GPL-3.0": "GNU General Public License, version 3",
    "LGPL-2.0": "GNU Library General Public License, version 2", "LGPL-2.1": "GNU Lesser General Public License, version 2.1", "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "AGPL-3.0": "GNU Affero General Public License, version 3", "MPL-1.1": "Mozilla Public License, Version 1.1", "MPL-2.0": "Mozilla Public License, Version 2.0",
    "EPL-1.0": "Eclipse Public License, Version 1.0", "EPL-2.0": "Eclipse Public License, Version 2.0", "BSL-1.0": "Boost Software License, Version 1.0", "OFL-1.1": "SIL Open Font License, Version 1.1",
    "GFDL-1.2": "GNU Free Documentation License, Version 1.2", "GFDL-1.3": "GNU Free Documentation License, Version 1.3", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License",
    "MIT": "the MIT License", "ISC": "the ISC License", "Zlib": "the zlib License", "Unlicense": "under the Unlicense", "CC0-1.0": "CC0 1.0 Universal", "WTFPL": "Do What The Fuck You Want To Public License",
}
#: Licenses of the GNU family: what the notice calls the work and the license, and the version.
GNU = {
    "GPL-1.0": ("program", "General", "1"), "GPL-2.0": ("program", "General", "2"), "GPL-3.0": ("program", "General", "3"), "LGPL-2.0": ("library", "Library General", "2"),
    "LGPL-2.1": ("library", "Lesser General", "2.1"), "LGPL-3.0": ("program", "Lesser General", "3"), "AGPL-3.0": ("program", "Affero General", "3"),
}
CC_TERMS = {"BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives", "BY": "Attribution"}
SPDX = ("MIT", "ISC", "Zlib", "Unlicense", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "BSL-1.0", "CC0-1.0", *(f"{n}{x}" for n in GNU for x in ("", "-only", "-or-later")), *(f"CC-{t}-{v}" for t in CC_TERMS for v in ("3.0", "4.0")))


def all_templates() -> dict[str, str]:
    """NOTICES, what TITLES, GNU, CC_TERMS and SPDX spell out, and the full texts in license_texts (``-text``)."""
    out = dict(NOTICES)
    for name, title in TITLES.items():
        plain = title.removeprefix("under ").removeprefix("the ")
        out |= {f"{name}-name": title, f"{name}-licensed": f"Licensed under the {plain}.", f"{name}-released": f"Released under the {plain}.", f"{name}-work": f"This work is licensed under the {plain}."}
    for name, (work, kind, version) in GNU.items():
        start = f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License"
        out[f"{name}-or-later"] = f"{start} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
        out[f"{name}-only"] = f"{start} as published by the Free Software Foundation, version {version} of the License."
        out[f"{name}-only-short"] = f"{start} version {version} as published by the Free Software Foundation."
    for terms, title in CC_TERMS.items():
        for version, kind in (("4.0", "International "), ("3.0", "Unported "), ("2.5", "Generic "), ("2.0", "Generic ")):
            name = f"CC-{terms}-{version}"
            out |= {name: f"This work is licensed under a Creative Commons {title} {version} {kind}License.", f"{name}-line": f"Licensed under CC {terms} {version}.", f"{name}-name": f"Creative Commons {title} {version}", f"{name}-short": f"CC {terms} {version}"}
    out |= {f"{name}-spdx": f"SPDX-License-Identifier: {name}" for name in SPDX}
    out |= {f"{path.stem}-text": path.read_text() for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    known: dict[tuple[str, ...], str] = {}
    return {name: text for name, text in out.items() if known.setdefault(tuple(WORD.findall(text.lower())), name) == name}


#: Words of a fingerprint, fingerprints of a winnowing window, half-width of the alignment's band in words.
K, WINDOW, BAND = 3, 3, 8
#: Least share of a template's words that must match in order.
LEAST_COVERAGE = 0.8
#: Templates of fewer words have all grams in the index; under LINE words every word but GENERIC decides; from TEXT on
#: a template is a full text, in which numbers of sections and a single mention decide nothing.
FEW, LINE, TEXT = 120, 14, 150
WORD = re.compile(r"[a-z0-9]+")
VERSION = re.compile(r"\d+(?:\.\d+)*")
MARKS = frozenset("affero lesser library noncommercial sharealike noderivatives noderivs nc sa nd only later".split())
GENERIC = frozenset("this work is licensed released under the a an of license terms version v international unported generic".split())


#: All of them, by the name that is reported.
TEMPLATES = all_templates()


def winnow(hashes: list[int], window: int) -> list[int]:
    """Places of the smallest hash (the last of equals) of each window of consecutive hashes."""
    if len(hashes) <= window:
        return [min(range(len(hashes)), key=lambda i: (hashes[i], -i))] if hashes else []
    return sorted({min(range(i, i + window), key=lambda j: (hashes[j], -j)) for i in range(len(hashes) - window + 1)})


def marks(low: str) -> dict[str, int]:
    """How often each name word stands in a text."""
    out: dict[str, int] = {}
    for w in WORD.findall(low):
        if w in MARKS:
            out[w] = out.get(w, 0) + 1
    return out


def versions(low: str) -> frozenset[str]:
    """Version numbers of a text; 2.0 is 2."""
    return frozenset(re.sub(r"(\.0)+$", "", v) for v in VERSION.findall(low))


def agrees(template: str, low: str, start: int, end: int) -> bool:
    """Names and versions of the place low[start:end] are those of the template (lower case)."""
    more = re.match(r"(?:\.\d+)+", low[end:])
    place = low[start : end + (more.end() if more else 0)]
    words = WORD.findall(template)
    have, want = marks(place), marks(template)
    if len(words) >= TEXT:
        return all(want.get(w, 0) / 2 <= have.get(w, 0) <= want.get(w, 0) + 2 for w in have | want)
    if have.keys() != want.keys() or versions(place) != versions(template):
        return False
    return len(words) >= LINE or (set(words) - GENERIC).issubset(WORD.findall(place))


@dataclass
class Index:
    """Templates as word ids, and fingerprint -> [(template, place)]."""

    names: list[str]
    words: dict[str, int] = field(default_factory=dict)
    templates: list[np.ndarray] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    places: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    @classmethod
    def build(cls, templates: dict[str, str]) -> Index:
        index = cls(list(templates))
        for text in templates.values():
            index.texts.append(text.lower())
            index.templates.append(np.array([index.words.setdefault(w, len(index.words) + 1) for w in WORD.findall(text.lower())], np.int64))
        for t, ids in enumerate(index.templates):
            grams = index.grams(ids)
            for i in range(len(grams)) if len(ids) < FEW else winnow([zlib.crc32(int(g).to_bytes(8, "little")) for g in grams], WINDOW):
                index.places.setdefault(int(grams[i]), []).append((t, i))
        return index

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """A number for each K consecutive words (exact: it is no hash), 0 if one is in no template."""
        if len(ids) < K:
            return np.zeros(0, np.int64)
        base, n = len(self.words) + 1, len(ids) - K + 1
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(K):
            out, known = out * base + ids[k : k + n], known & (ids[k : k + n] > 0)
        return np.where(known, out, 0)


def band_of(template: np.ndarray) -> int:
    """Half-width of the band: what is added or left out shifts the rest, in a long text by more."""
    return max(BAND, min(4 * BAND, len(template) // 32))


def most_matches(template: np.ndarray, words: np.ndarray, diagonal: int, band: int = BAND) -> int:
    """An upper bound of align's matches: template words that occur in the document within the band."""
    padded = np.full(len(template) + 2 * band, -1, np.int64)
    lo, hi = max(0, diagonal - band), min(len(words), diagonal + len(template) + band)
    if lo >= hi:
        return 0
    padded[lo - diagonal + band : hi - diagonal + band] = words[lo:hi]
    return int((np.lib.stride_tricks.sliding_window_view(padded, 2 * band + 1) == template[:, None]).any(1).sum())


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matches, first word, last word + 1) of the best alignment near words[i + diagonal] ~ template[i].

    Longest common subsequence within the band; of equally good ones, the one that ends first and then begins
    last is taken.
    """
    width = 2 * band + 1
    best = [(0, 0)] * (width + 2)
    top = (0, 0, 0)
    for i, want in enumerate(template.tolist()):
        row = [(0, 0)] * (width + 2)
        for d in range(width):
            j = i + diagonal + d - band
            if 0 <= j < len(words):
                row[d + 1] = max(row[d], best[d + 2])
                if words[j] == want:
                    matches, begin = best[d + 1]
                    here = (matches + 1, begin if matches else j)
                    row[d + 1] = max(row[d + 1], here)
                    if row[d + 1] == here and here[0] > top[0]:
                        top = (here[0], here[1], j + 1)
            else:
                row[d + 1] = best[d + 2] if j >= len(words) else (0, 0)
        best = row
    return top


def find(index: Index, text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, template, coverage) in code points, by start.

    Of overlapping places the one stays that agrees best: matches less unmatched words of template and document.
    """
    low = text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)
    get = index.words.get
    ids = np.array([get(w, 0) for w in WORD.findall(low)], np.int64)
    grams = index.grams(ids)
    hits = np.flatnonzero(grams)
    by: dict[int, list[int]] = {}
    for place in hits.tolist():
        for t, at in index.places.get(int(grams[place]), ()):
            by.setdefault(t, []).append(place - at)
    if not by:
        return []
    spans = [m.span() for m in WORD.finditer(low)]
    found = []
    for t, diagonals in sorted(by.items()):
        template, last = index.templates[t], None
        band = band_of(template)
        for diagonal in sorted(set(diagonals)):
            if last is not None and diagonal - last <= band // 2:
                continue
            last = diagonal
            if most_matches(template, ids, diagonal, band) < LEAST_COVERAGE * len(template):
                continue
            lo = max(0, diagonal - band)
            near = ids[lo : diagonal + len(template) + band]
            matches, first, end = align(template, near, diagonal - lo, band)
            if matches >= LEAST_COVERAGE * len(template):
                a, b = spans[lo + first][0], spans[lo + end - 1][1]
                if agrees(index.texts[t], low, a, b):
                    found.append((len(template) + (end - first) - 3 * matches, a, b, t, matches / len(template)))
    kept: list[tuple[int, int, int, int, float]] = []
    for place in sorted(found):
        if all(place[2] <= a or b <= place[1] for _, a, b, *_ in kept):
            kept.append(place)
    return sorted((a, b, index.names[t], share) for _, a, b, t, share in kept)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License notices of every whole text: id_col, n_matches, licenses, spans.

    ``licenses`` lists the templates found, sorted and joined by commas; ``spans`` has name:start:end:coverage
    by start.  Null and empty texts have none; repeated rows give repeated results; an empty table no rows.
    """
    index = Index.build(templates or TEMPLATES)

    def run(ids, texts):
        found = [find(index, t) for t in texts]
        return {
            id_col: ids, "n_matches": [len(f) for f in found], "licenses": [",".join(sorted({n for _, _, n, _ in f})) for f in found],
            "spans": [",".join(f"{n}:{a}:{b}:{c:.3f}" for a, b, n, c in f) for f in found],
        }

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, id_col, text_col, run, f"{id_col} {kind}, n_matches long, licenses string, spans string")
