"""License scans by conditional compression.

Words that license texts use mark candidate blocks. A block's words are aligned with each template's
at every place where enough of them are, and what is missing or added is listed. A place is confirmed
if most of the template is there and none of the words that tell licenses apart (numbers, names)
differ. Where confirmed places overlap, the closest wording of each license is taken, and of several
licenses the one whose template saves most: overlapping windows of the block are compressed alone and
with each template as a raw zstandard dictionary, by the same parameters. Identifiers of SPDX lines
are read as they stand.

Each text is worked on alone, whole: no shuffle.

Defined results: null and empty texts have no blocks, an empty table no rows. Rows alike give equal
rows. Every place that holds a license gives a row, in the order of saved bytes within its block; of
equally close wordings of one license, or licenses that save equally much, the one that stands first in
TEMPLATES, then the earlier place, is taken. A block that no template holds for is returned with license
null, so no candidate gets lost.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, map_rows, table

#: The notices by which licenses are commonly granted.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Distributed under the MIT License."),
    ("GPL-2.0", "Licensed under the GNU General Public License v2."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License v2.1."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License v3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License v3."),
    ("GPL-2.0", "Licensed under the GNU GPL v2."),
    ("GPL-3.0", "Licensed under the GNU GPL v3."),
    ("LGPL-2.1", "Licensed under the GNU LGPL v2.1."),
    ("LGPL-3.0", "Licensed under the GNU LGPL v3."),
    ("AGPL-3.0", "Licensed under the GNU AGPL v3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Words that mark a candidate (written so that Python and the JVM read it alike: letters of ASCII only), and words whose difference makes another license.
MARKS = re.compile(r"(?i)(?<![a-z0-9_])(?:licen[sc]e[ds]?|copyright|warranty|warranties|redistribut[a-z0-9_]*|permissions?|unencumbered|cc0|spdx[^ \t\n\r]*)(?![a-z0-9_])", re.ASCII)
TELLING = {"apache", "mit", "gnu", "lesser", "affero", "general", "public", "mozilla", "bsd", "cc", "cc0", "by", "nc", "sa", "nd", "isc", "unencumbered", "clause", "gpl", "lgpl", "agpl", "creative", "commons", "attribution", "sharealike", "noncommercial", "noderivatives"}
AROUND, LEAST_SHARE, LEVEL = 60, 0.85, 10
_SPDX = re.compile(r"\b(?i:spdx-license-identifier)[ \t]*:[ \t]*(\(*[A-Za-z0-9][\w.+-]*\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9][\w.+-]*\)*)*)")
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def _compressors() -> list:
    """One without and one for each template with a dictionary, all with the parameters for a window's size."""
    if not _made:
        fixed = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=8 * WINDOW)
        _made.append(zstandard.ZstdCompressor(compression_params=fixed))
        _made.extend(zstandard.ZstdCompressor(compression_params=fixed, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in TEMPLATES)
    return _made


_made: list = []


def _word(m: re.Match) -> str:
    """A word in lower case; version numbers alike however written (v3, 3, 3.0)."""
    return re.sub(r"^v?([0-9]+(?:\.[0-9]+)*?)(?:\.0)*$", r"\1", m[0].lower())


def _words(text: str) -> list[str]:
    return [_word(m) for m in _WORD.finditer(text)]


_TEMPLATE_WORDS = [_words(t) for _, t in TEMPLATES]
#: Words of a window and by which windows follow each other: any aligned part is whole in one of them.
STRETCH = 2 * max(map(len, _TEMPLATE_WORDS))
WINDOW, STEP = 2 * STRETCH, STRETCH


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of candidates: marked words with AROUND words on each side, merged where they meet."""
    marks = [m.start() for m in MARKS.finditer(text)]
    if not marks:
        return []
    spots = [m.span() for m in re.finditer(r"\S+", text)]
    out, k = [], 0
    for at in marks:
        while spots[k][1] <= at:
            k += 1
        a, b = max(0, k - AROUND), min(len(spots), k + AROUND + 1)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(spots[a][0], spots[b - 1][1]) for a, b in out]


def differences(part: list[str], template: list[str]) -> tuple[list[str], list[str], int, int, int]:
    """(missing, added, words of the template that are there, first and end word of the aligned part).
    Added words are those within the aligned part."""
    same = [m for m in SequenceMatcher(None, part, template, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return template, [], 0, 0, 0
    first, end = same[0].a, same[-1].a + same[-1].size
    there = {k for m in same for k in range(m.b, m.b + m.size)}
    taken = {k for m in same for k in range(m.a, m.a + m.size)}
    return [w for k, w in enumerate(template) if k not in there], [w for k, w in enumerate(part[:end]) if k not in taken and k >= first], len(there), first, end


def _tells(words: list[str]) -> bool:
    return any(w in TELLING or w[0].isdigit() for w in words)


def places(block: list[str], template: list[str]) -> list[tuple[int, int, list[str], list[str]]]:
    """(first word, end word, missing, added) of all places of the block that hold the template, apart from
    each other. Parts of twice the template's length are aligned from each word that it has, if they
    have enough of its words in any order."""
    length, least = len(template), LEAST_SHARE * len(template)
    left = Counter(template)  # minus the words from lo to hi
    at = [p for p, w in enumerate(block) if w in left]
    if len(at) < least:
        return []
    found, hi, common, after, aligned = [], 0, 0, 0, {}
    for lo, p in enumerate(at):
        while hi < len(at) and at[hi] < p + 2 * length:
            common += left[block[at[hi]]] > 0
            left[block[at[hi]]] -= 1
            hi += 1
        if common >= least and p >= after:
            part = tuple(block[p : p + 2 * length])
            if part not in aligned:  # texts that repeat themselves are aligned once
                aligned[part] = differences(list(part), template)
            missing, added, n, i, j = aligned[part]
            if n >= least and not _tells(missing) and not _tells(added):
                found.append((-n, len(added), p + i, p + j, missing, added))
                if not missing and not added:
                    after = p + j
        left[block[p]] += 1
        common -= left[block[p]] > 0
    out, used = [], set()
    for _, _, i, j, missing, added in sorted(found):
        if used.isdisjoint(range(i, j)):
            used.update(range(i, j))
            out.append((i, j, missing, added))
    return sorted(out)


def _savings(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """For each window of words at spans, the bytes that each template saves."""
    plain, *dictionaries = _compressors()
    out = []
    for x in range(0, max(1, len(spans) - WINDOW + STEP), STEP):
        raw = text[spans[x][0] if x else 0 : spans[x + WINDOW - 1][1] if x + WINDOW < len(spans) else len(text)].encode()
        size = len(plain.compress(raw))
        out.append([size - len(c.compress(raw)) for c in dictionaries])
    return out


def spdx(text: str) -> list[tuple[int, str]]:
    """(place, license) of each license that the text's SPDX lines name; exceptions (WITH) are no licenses."""
    out = []
    for m in _SPDX.finditer(text):
        names = re.sub(r"WITH\s+\S+", "", m[1])
        out += [(m.start(), w.strip("().-")) for w in names.split() if w not in ("AND", "OR", "NONE", "NOASSERTION")]
    return out


def scan(text: str | None) -> list[tuple]:
    """(start, end, license, saved bytes, words missing, words added, exact) of each license in each
    candidate block; license None where nothing is confirmed. SPDX lines are exact and save nothing."""
    rows = []
    text = text or ""
    named = spdx(text)
    for a, b in blocks(text):
        part = text[a:b]
        matches = list(_WORD.finditer(part))
        words = list(map(_word, matches))
        saved = _savings(part, [m.span() for m in matches])
        candidates = []
        for k, template in enumerate(_TEMPLATE_WORDS):
            for i, j, missing, added in places(words, template):
                whole = range(max(0, -((WINDOW - j) // STEP)), min(len(saved) - 1, i // STEP) + 1)  # windows with all of i to j
                fit = len(template) - 2 * len(missing) - len(added)
                candidates.append((TEMPLATES[k][0], -fit, -max(saved[x][k] for x in whole), k, i, j, missing, added))
        best, used = [], {}
        for name, _, gain, k, i, j, missing, added in sorted(candidates):  # of one license the closest wording
            if used.setdefault(name, set()).isdisjoint(range(i, j)):
                used[name].update(range(i, j))
                best.append((gain, k, i, j, missing, added))
        held, taken = [], set()
        for gain, k, i, j, missing, added in sorted(best):  # of several the one that saves most
            if taken.isdisjoint(range(i, j)):
                taken.update(range(i, j))
                held.append((a, b, TEMPLATES[k][0], max(0, -gain), " ".join(missing), " ".join(added), not missing and not added))
        held += [(a, b, name, 0, "", "", True) for _, name in named[bisect_left(named, (a,)) : bisect_left(named, (b,))]]
        rows += held or [(a, b, None, max(0, *map(max, saved)), "", "", False)]
    return rows


def license_hits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, block_start, block_end, license, saved_bytes, missing, added, exact), one row per license found."""
    picked = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter(F.col("text").rlike(MARKS.pattern))
    schema = fields("block_start int, block_end int, license string, saved_bytes int, missing string, added string, exact boolean")

    def hits(ids, texts):
        rows = [(i, *h) for i, t in zip(ids, texts) for h in scan(t)]
        return list(zip(*rows)) or [[]] * 8

    return map_rows(picked, hits, type(schema)([picked.schema["id"], *schema.fields]))


def op5_license_scan(spark, sf_dir):
    return license_hits(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
