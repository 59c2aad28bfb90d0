"""Licence notices in documents: Dice coefficient over word bigrams against templates.

A notice may stand anywhere, inside a longer sentence too: windows of words begin and end with a bigram of the template.
The Dice coefficient of sizes a and b is at most 2 min(a, b) / (a + b), which bounds the size of the windows a template
can match, and the bigrams of the template that a window must hold before it is counted.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

THRESHOLD = 0.85
WORD = re.compile(r"[^\W_]+")
FOUND = "doc_id long, license string, dice double, first long, last long"

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
    "shall be included in all copies or substantial portions of the Software."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as "
    "published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
)
# Public notices, by SPDX name; GPL, LGPL and AGPL stand for notices that give no version.
_NOTICES = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("BSD-2-Clause", _BSD),
    (
        "BSD-3-Clause",
        _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL.format("", 3)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GPL.format("", 2)),
    ("LGPL-3.0", _GPL.format("Lesser ", 3)),
    ("LGPL-2.1", _GPL.format("Lesser ", 2.1)),
    ("AGPL-3.0", _GPL.format("Affero ", 3)),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # short forms
    ("MIT", "under the MIT License"),
    ("MIT", "under the terms of the MIT License"),
    ("Apache-2.0", "under the Apache License 2.0"),
    ("Apache-2.0", "under the Apache License, Version 2.0"),
    ("Apache-2.0", "under the terms of the Apache License, Version 2.0"),
    ("BSD-2-Clause", "under the BSD 2-Clause License"),
    ("BSD-3-Clause", "under the BSD 3-Clause License"),
    ("ISC", "under the ISC License"),
    ("MPL-2.0", "under the Mozilla Public License 2.0"),
    ("MPL-2.0", "under the Mozilla Public License, Version 2.0"),
    ("GPL", "This work is licensed under the GNU General Public License."),
    ("GPL", "under the GNU General Public License"),
    ("GPL-2.0", "under the GNU General Public License v2.0"),
    ("GPL-2.0", "under the GNU General Public License, version 2"),
    ("GPL-3.0", "under the GNU General Public License v3.0"),
    ("GPL-3.0", "under the GNU General Public License, version 3"),
    ("LGPL", "under the GNU Lesser General Public License"),
    ("AGPL", "under the GNU Affero General Public License"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    # titles and openings of the licence texts
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
# every licence also by its tag
TEMPLATES = _NOTICES + tuple((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(n for n, _ in _NOTICES))


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


class Scanner:
    """Templates by bigram, and the comparison of one document with them."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.names, self.grams, self.by_gram = [], [], {}
        for name, text in templates:
            w = words_of(text)
            grams = Counter(zip(w, w[1:]))
            if not grams:
                raise ValueError(f"template of {name} has no two words")
            for g in grams:
                self.by_gram.setdefault(g, []).append(len(self.names))
            self.names.append(name)
            self.grams.append(grams)
        self.sizes = [sum(g.values()) for g in self.grams]

    def bounds(self, size: int) -> tuple[float, float]:
        """Sizes of runs that can reach the threshold; the lower one is also the least number of shared bigrams."""
        t = self.threshold
        return size * t / (2 - t) - 1e-9, size * (2 - t) / t + 1e-9

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, dice, first, last) of windows of words that match, characters of the text, last excluded.

        Of the windows that begin at one word, a template's best counts, the longest of equal ones. Of overlapping matches the
        one of the higher coefficient counts, then the longer, the earlier, the template listed first.
        """
        words = words_of(text)
        at: dict[int, list[int]] = {}
        for i, g in enumerate(zip(words, words[1:])):
            for t in self.by_gram.get(g, ()):
                at.setdefault(t, []).append(i)
        matches = [m for t in at if len(at[t]) >= self.bounds(self.sizes[t])[0] for m in self.matches(t, words, at[t])]
        if not matches:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        out: list[tuple[str, float, int, int]] = []
        taken = bytearray(len(words))
        for dice, size, a, e, t in sorted(matches, key=lambda m: (-m[0], -m[1], m[2], m[4])):
            if not any(taken[a:e]):
                taken[a:e] = b"\x01" * (e - a)
                out.append((self.names[t], dice, spans[a][0], spans[e - 1][1]))
        return sorted(out, key=lambda m: m[2])

    def matches(self, t: int, words: list[str], at: list[int]) -> list[tuple[float, int, int, int, int]]:
        """(dice, bigrams, first word, last word, template): the best window from each bigram of the template that reaches the threshold.

        at: the places of its bigrams. A window that begins or ends with another bigram is worse than the one without it.
        """
        grams, size = self.grams[t], self.sizes[t]
        low, high = self.bounds(size)
        need = max(1, -int(-low // 1)) - 1  # enough of its bigrams must follow within the longest window
        out = []
        for h, a in enumerate(at):
            if h + need >= len(at):
                break
            if at[h + need] - a + 1 > high:
                continue
            left, both, best = dict(grams), 0, (0.0, 0)
            for k in range(h, len(at)):
                n = at[k] - a + 1
                if n > high:
                    break
                g = words[at[k]], words[at[k] + 1]
                if left[g]:
                    left[g] -= 1
                    both += 1
                best = max(best, (2 * both / (n + size), n))
            if best[0] >= self.threshold:
                out.append((*best, a, a + best[1] + 1, t))
        return out


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """-> FOUND: the licence notices in documents of (doc_id, text, ...), with the place of each in its text.

    Words are compared in lower case without marks; a notice may stand inside a sentence or take up several. Null, empty and other texts without a notice give no row;
    repeated notices give one each. Other columns are not read; an empty table gives no rows.
    """
    scanner = Scanner(templates, threshold)

    def run(batch: pa.RecordBatch) -> dict:
        rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in scanner.scan(t or "")]
        return dict(zip(("doc_id", "license", "dice", "first", "last"), zip(*rows) if rows else [[]] * 5))

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, FOUND)
