"""Licence scan: windows of a text's words compared with licence notices by the Dice coefficient of their word bigrams.

Text and notice are normalised to lower-case words of letters and digits, so line ends and comment markers part
nothing. 2 |A and B| / (|A| + |B|) can reach the threshold t only if the smaller set has at least t / (2 - t) of the
larger's size, and so only if the text has that share of the notice's bigrams: other notices are passed over. For the
rest, windows slide over the whole text from each bigram of the notice up to that size.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

LEAST_DICE = 0.8
#: Licence, kind, notice.
TEMPLATES = (
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Licensed under the MIT License."),
    ("MIT", "permissive", "This project is licensed under the terms of the MIT license."),
    ("MIT", "permissive", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", "Released under the Apache License 2.0."),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "permissive", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "permissive", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "permissive", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "permissive", "Released under the BSD 2-Clause License."),
    ("ISC", "permissive", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-2.0", "copyleft", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "copyleft", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "copyleft", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "copyleft", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "permissive", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "copyleft", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "noderivatives", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "permissive", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("proprietary", "proprietary", "All rights reserved."),
)

def _creative_commons() -> tuple:
    """Short and long notices of the six licences in each version; those of 4.0 that stand above are not repeated."""
    kinds = {"BY": ("permissive", "Attribution"), "BY-SA": ("copyleft", "Attribution-ShareAlike"), "BY-NC": ("noncommercial", "Attribution-NonCommercial"), "BY-ND": ("noderivatives", "Attribution-NoDerivatives"), "BY-NC-SA": ("noncommercial", "Attribution-NonCommercial-ShareAlike"), "BY-NC-ND": ("noncommercial", "Attribution-NonCommercial-NoDerivatives")}
    out = []
    for code, (kind, long) in kinds.items():
        for version, port in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
            out += [(f"CC-{code}-{version}", kind, t) for t in (f"Licensed under CC {code} {version}.", f"This work is licensed under a Creative Commons {long} {version} {port} License.", f"Creative Commons {long} {version} {port} Public License")]
    return tuple(out)


_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GNU = "you can redistribute it and/or modify it under the terms of the"
#: More notices, and what the licences' own texts begin with.
MORE = (
    ("GPL-1.0", "copyleft", "This work is licensed under the GNU General Public License, version 1."),
    ("GPL-1.0", "copyleft", f"This program is free software; {_GNU} GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version."),
    ("GPL-2.0", "copyleft", f"This program is free software; {_GNU} GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "copyleft", f"This program is free software; {_GNU} GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-2.0", "copyleft", "This work is licensed under the GNU Library General Public License, version 2."),
    ("LGPL-2.0", "copyleft", f"This library is free software; {_GNU} GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "copyleft", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "copyleft", f"This library is free software; {_GNU} GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "copyleft", f"This program is free software: {_GNU} GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "copyleft", f"This program is free software: {_GNU} GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-1.1", "copyleft", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "permissive", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS"),
    ("BSD-3-Clause", "permissive", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS"),
    ("Apache-2.0", "permissive", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("Artistic-1.0", "permissive", "The Artistic License Preamble The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package"),
    ("GPL-1.0", "copyleft", f"GNU GENERAL PUBLIC LICENSE Version 1, February 1989 Copyright (C) 1989 Free Software Foundation, Inc. {_VERBATIM} Preamble The license agreements of most software companies try to keep users at the mercy of those companies."),
    ("GPL-2.0", "copyleft", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_VERBATIM} Preamble The licenses for most software are designed to take away your freedom to share and change it."),
    ("GPL-3.0", "copyleft", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM} Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("LGPL-2.1", "copyleft", f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. {_VERBATIM} [This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1.]"),
    ("LGPL-3.0", "copyleft", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM} This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("AGPL-3.0", "copyleft", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM} Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("MPL-2.0", "copyleft", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("CC0-1.0", "permissive", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES."),
)
TEMPLATES += tuple(t for t in (*_creative_commons(), *MORE) if t not in TEMPLATES)
_WORD = re.compile(r"[^\W_]+")
_CLOSING = re.compile(r"[^\w\s]*")
#: Comment markers made of letters; all others are no words.
_MARKER = re.compile(r"^[ \t]*(?:rem|dnl)(?=[ \t])", re.I | re.M)


def bigrams(text: str) -> frozenset:
    words = _WORD.findall(text.lower())
    return frozenset(zip(words, words[1:], strict=False))


class Scanner:
    """Notices by size, for texts of any length."""

    def __init__(self, templates: tuple, least: float) -> None:
        self.least = least
        self.templates = [(name, kind, bigrams(notice)) for name, kind, notice in templates]
        self.bound = least / (2 - least)
        self.by_bigram: dict = defaultdict(list)
        for k, (_, _, grams) in enumerate(self.templates):
            for g in grams:
                self.by_bigram[g].append(k)
        self.any = frozenset(self.by_bigram)

    def best(self, unit: frozenset) -> tuple[float, str, str] | None:
        """The notice with the highest coefficient, the first of equals; None if none reaches the threshold."""
        found, n, bound = None, len(unit), self.bound
        for name, kind, notice in self.templates:
            if min(n, len(notice)) < bound * max(n, len(notice)):
                continue
            dice = 2 * len(unit & notice) / (n + len(notice))
            if dice >= self.least and (found is None or dice > found[0]):
                found = dice, name, kind
        return found

    def windows(self, grams: list, k: int) -> list[tuple[int, float, int, int, int]]:
        """(-bigrams shared, -coefficient, k, first, end) of the best window from each bigram of notice k that reaches the threshold."""
        notice, out = self.templates[k][2], []
        most = len(notice) / self.bound
        for i, first in enumerate(grams):
            if first not in notice:
                continue
            seen, shared, best = {first}, 1, (2 / (1 + len(notice)), 1, i + 1)
            for j in range(i + 1, len(grams)):
                g = grams[j]
                if g == first:  # the window from there has no more to it
                    break
                if g not in seen:
                    seen.add(g)
                    if len(seen) > most:
                        break
                    if g in notice:
                        shared += 1
                        best = max(best, (2 * shared / (len(seen) + len(notice)), shared, j + 1), key=lambda x: x[:2])
            if best[0] >= self.least:
                out.append((-best[1], -best[0], k, i, best[2]))
        return out

    def scan(self, text: str | None) -> list[tuple[str, str, float, str]]:
        """(licence, kind, dice, unit) for each licence found in a text: its best window, by falling coefficient.

        Of windows that overlap by half, the one that shares most bigrams with its notice says the licence.
        """
        text = _MARKER.sub(lambda m: " " * len(m[0]), text or "")
        hits = bigrams(text) & self.any
        counts = Counter(k for g in hits for k in self.by_bigram[g])
        likely = [k for k, n in counts.items() if n >= self.bound * len(self.templates[k][2]) - 1e-9]
        if not likely:
            return []
        spans = [(w, *m.span()) for m in _WORD.finditer(text) for w in _WORD.findall(m[0].lower())]
        grams = [(x[0], y[0]) for x, y in zip(spans, spans[1:], strict=False)]
        owner: list = [None] * len(grams)
        found: dict = {}
        for _, dice, k, i, j in sorted(w for k in likely for w in self.windows(grams, k)):
            name, kind, _ = self.templates[k]
            over = Counter(x for x in owner[i:j] if x is not None)
            if 2 * over.total() >= j - i:
                if over.most_common(1)[0][0] != name:
                    continue
            else:
                owner[i:j] = [name] * (j - i)
            if name not in found or -dice > found[name][2]:
                end = _CLOSING.match(text, spans[j][2]).end()
                found[name] = (name, kind, -dice, text[spans[i][1] : end])
        return sorted(found.values(), key=lambda x: (-x[2], x[0]))


def scan(docs: DataFrame, templates: tuple = TEMPLATES, least: float = LEAST_DICE) -> DataFrame:
    """Every row of docs (doc_id, text, more) with the licences its whole text names.

    Returns doc_id, license (that of the highest coefficient; null if none), kind, dice, n_licenses, licenses (names,
    sorted, joined by commas) and unit (the matching text). Null and empty texts name none. Equal coefficients go to
    the name that sorts first. Repeated rows repeat their result. One pass, no shuffle.
    """
    scanner = Scanner(templates, least)

    def found(ids, texts):
        rows = [scanner.scan(t) for t in texts]
        first = [r[0] if r else (None, None, None, None) for r in rows]
        return ids, [x[0] for x in first], [x[1] for x in first], [x[2] for x in first], [len(r) for r in rows], [",".join(sorted(x[0] for x in r)) for r in rows], [x[3] for x in first]

    return map_columns(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), found, "doc_id long, license string, kind string, dice double, n_licenses long, licenses string, unit string", size_of=1)
