"""License scans: winnowed template fingerprints in an inverted index pick candidates, and banded alignment reports coverage and spans."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, slices
from .shingles import chunks, mix64, word_hashes

#: Words of a fingerprint; fingerprints of a window of which one is kept; words of an alignment's band on either side.
GRAM, WINDOW, BAND = 3, 4, 8
#: The templates are broadcast; more words than these are refused.
MOST_TEMPLATE_WORDS = 2_000_000

_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_MIT_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_TWO = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'
_BSD_THIRD = '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU_HOPE = 'This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details.'
_GNU_FREE = 'you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version.'

#: Texts of public licences, as fixed values: whole ones of short licences, and the notices that long ones ask for.
TEMPLATES = {
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "agpl-3.0": "This program is free software: " + _GNU_FREE.format("Affero General Public License", "3").replace("Foundation;", "Foundation,") + " " + _GNU_HOPE.format("program", "Affero General Public License"),
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "boost-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "bsd-2-clause": f"{_BSD_TWO} {_BSD_WARRANTY}",
    "bsd-3-clause": f"{_BSD_TWO} {_BSD_THIRD} {_BSD_WARRANTY}",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-sa-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-2.0": "This program is free software; " + _GNU_FREE.format("General Public License", "2") + " " + _GNU_HOPE.format("program", "General Public License"),
    "gpl-3.0": "This program is free software: " + _GNU_FREE.format("General Public License", "3").replace("Foundation;", "Foundation,") + " " + _GNU_HOPE.format("program", "General Public License"),
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "lgpl-2.1": "This library is free software; " + _GNU_FREE.format("Lesser General Public License", "2.1") + " " + _GNU_HOPE.format("library", "Lesser General Public License"),
    "lgpl-3.0": "This library is free software: " + _GNU_FREE.format("Lesser General Public License", "3").replace("Foundation;", "Foundation,") + " " + _GNU_HOPE.format("library", "Lesser General Public License"),
    "mit": f"{_MIT_GRANT} {_MIT_WARRANTY}",
    "mit-grant": _MIT_GRANT,
    "mit-short": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "postgresql": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.',
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def _grams(words: np.ndarray) -> np.ndarray:
    out = np.zeros(max(0, len(words) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(out)]
    return mix64(out)


def winnow(grams: np.ndarray) -> list[int]:
    """The places of the least hash, the last of equal ones, of each window of WINDOW; of fewer hashes of all of them."""
    if len(grams) == 0:
        return []
    if len(grams) <= WINDOW:
        return [len(grams) - 1 - int(np.argmin(grams[::-1]))]
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    return np.unique(np.arange(len(windows)) + WINDOW - 1 - np.argmin(windows[:, ::-1], axis=1)).tolist()


def _places(hashes: np.ndarray, keys: np.ndarray, places: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """(template, place in the text less place in the template, place in the text) of every hash of a text that is a key of places; keys are sorted."""
    if len(hashes) == 0 or len(keys) == 0:
        return []
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return [(k, int(p) - place, int(p)) for p in np.flatnonzero(keys[at] == hashes) for k, place in places[int(hashes[p])]]


class Index:
    """The templates' words, for each winnowed fingerprint the templates and places that have it, and the same for anchors.

    Where a match may lack m of a template's words, any m + 1 of its places are anchors of which a match has one at least. The longest
    words are taken, as rarer ones.
    """

    def __init__(self, templates: list[tuple[str, str]], least: float = 0.8):
        self.names = [name for name, _ in templates]
        hashes, owner, starts, ends = word_hashes([text.encode() for _, text in templates]) if templates else (np.zeros(0, np.uint64), *[np.zeros(0, int)] * 3)
        self.words = [hashes[owner == k] for k in range(len(templates))]
        if len(hashes) > MOST_TEMPLATE_WORDS:
            raise ValueError("the templates are too large to broadcast")
        short = [self.names[k] for k, w in enumerate(self.words) if len(w) < GRAM]
        if short:
            raise ValueError(f"templates of fewer than {GRAM} words: {short}")
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, w in enumerate(self.words):
            grams = _grams(w)
            for at in winnow(grams):
                self.places[int(grams[at])].append((k, at))
        self.sorted = np.array(sorted(self.places), np.uint64)
        self.anchors: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, w in enumerate(self.words):
            lacking = sum(len(w) - m >= least * len(w) for m in range(1, len(w) + 1))
            for at in np.argsort((starts - ends)[owner == k], kind="stable")[: lacking + 1].tolist():
                self.anchors[int(w[at])].append((k, at))
        self.sorted_anchors = np.array(sorted(self.anchors), np.uint64)

    def hits(self, grams: np.ndarray) -> list[tuple[int, int, int]]:
        """_places() of every fingerprint that a text shares with the index."""
        return _places(grams, self.sorted, self.places)

    def anchored(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """_places() of every anchor in a text."""
        return _places(words, self.sorted_anchors, self.anchors)


def align(template: np.ndarray, text: np.ndarray, shifts: list[int]) -> list[tuple[int, int, int]]:
    """For each shift the words of a template that a band of a text matches in order at most, and the first and after the last matched word of the text.

    The text's word j may match the template's word i if |j - i - shift| <= BAND: a longest common subsequence within the band. Of
    equally long ones one that ends first. A row of all bands at a time: a cell is one number of the length, what is
    left to the greatest end, and the start, both from the band's first place on.
    """
    if not len(text):
        return [(0, 0, 0)] * len(shifts)
    bits = 21
    low = (1 << bits) - 1
    none = low << bits
    places = np.arange(2 * BAND + 1)
    row = np.full((len(shifts), len(places)), none, np.int64)
    base = np.array(shifts)[:, None] - BAND
    for i, word in enumerate(template):
        at = i + places  # from the base on
        j = base + at
        inside = (j >= 0) & (j < len(text))
        match = inside & (text[np.where(inside, j, 0)] == word)
        n, first = row >> 2 * bits, row & low
        here = (n + 1 << 2 * bits) | (low - (at + 1) << bits) | np.where(n > 0, first, at)
        best = np.where(match, here, none)
        best[:, :-1] = np.maximum(best[:, :-1], row[:, 1:])  # skip the template's word
        row = np.maximum.accumulate(best, axis=1)  # skip the text's word
    best = row.max(axis=1)
    return [(int(x >> 2 * bits), int(b + (x & low)), int(b + low - (x >> bits & low))) if x != none else (0, 0, 0) for x, b in zip(best.tolist(), base[:, 0].tolist())]


def scan_words(index: Index, words: np.ndarray, least: float) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, end word) of the matches of a text: of overlapping ones the template with most matched words, then the greatest share."""
    groups: dict[int, list[int]] = defaultdict(list)
    for k, shift, _ in index.hits(_grams(words)):
        groups[k].append(shift)
    found = set()
    for k, shifts in groups.items():
        done: int | None = None
        for shift in sorted(set(shifts)):
            if done is not None and shift <= done:
                continue
            done = shift + BAND  # shifts this close are within one band
            n, first, end = align(index.words[k], words, [shift + BAND // 2])[0]
            if n >= least * len(index.words[k]):
                found.add((k, n, first, end))
    tried = set()
    for k, shift, at in index.anchored(words):
        template = index.words[k]
        if any(f[0] == k and f[2] <= at < f[3] for f in found):
            continue
        around = words[max(0, shift - 2 * BAND) : shift + len(template) + 2 * BAND]
        if np.isin(template, around).sum() < least * len(template):
            continue
        centres = [c for c in range(shift - BAND, shift + BAND + 1) if (k, c) not in tried]  # all bands that hold the anchor
        if centres:
            tried |= {(k, c) for c in centres}
            found |= {(k, n, first, end) for n, first, end in align(template, words, centres) if n and n >= least * len(template)}
    chosen: list[tuple[int, int, int, int]] = []
    for c in sorted(found, key=lambda c: (-c[1], -c[1] / len(index.words[c[0]]), c[2], c[0])):
        if all(c[3] <= a[2] or a[3] <= c[2] for a in chosen):
            chosen.append(c)
    return sorted(chosen, key=lambda c: (c[2], c[0]))


def templates_frame(spark: SparkSession) -> DataFrame:
    """The built-in licence texts and notices as (template, text)."""
    return spark.createDataFrame(pa.table({"template": list(TEMPLATES), "text": list(TEMPLATES.values())}))


def scan(docs: DataFrame, templates: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, template, matched, coverage, start, end): a row for each match in each row of docs.

    A template's winnowed fingerprints are looked up among all fingerprints of a text, and its anchors among all words, so that a text that holds a
    match, whatever words of it are changed, always has it as a candidate. Each candidate place is aligned; a match has at least the share `least` of
    the template's words in order, all within BAND words of their place. coverage is that share; start and end are code points of the
    first matched word and after the last. Words are runs without ASCII white space, A-Z as a-z.

    templates has columns template and text and is broadcast, at most MOST_TEMPLATE_WORDS words; one with fewer than GRAM words raises ValueError, a null one is dropped. Null and empty texts have no
    match. Ids may be null or repeat. Other columns are ignored. No rows, or no templates, give no rows.
    """
    rows = templates.where("template IS NOT NULL AND text IS NOT NULL").select("template", "text").distinct().orderBy("template", "text").limit(MOST_TEMPLATE_WORDS // GRAM + 1).collect()
    held = docs.sparkSession.sparkContext.broadcast(Index([(r["template"], r["text"]) for r in rows], least))
    frame = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = frame.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in slices(batches, "text"):
            texts, ids = batch.column("text").to_pylist(), batch.column("id")
            at, names, matched, share, begin, stop = [], [], [], [], [], []
            for part in chunks([len(t) for t in texts]):
                own = texts[part]
                hashes, owner, starts, ends = word_hashes(own)
                bounds = np.searchsorted(owner, np.arange(len(own) + 1))
                offset = 0
                for k, text in enumerate(own):
                    a, b = bounds[k], bounds[k + 1]
                    for template, n, first, end in scan_words(index, hashes[a:b], least):
                        at.append(part.start + k)
                        names.append(index.names[template])
                        matched.append(n)
                        share.append(n / len(index.words[template]))
                        begin.append(len(text[: starts[a + first] - offset].decode()))
                        stop.append(len(text[: ends[a + end - 1] - offset].decode()))
                    offset += len(text) + 1
            if at:
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(names), pa.array(matched, pa.int64()), pa.array(share, pa.float64()), pa.array(begin, pa.int64()), pa.array(stop, pa.int64())], ["id", "template", "matched", "coverage", "start", "end"]
                )
        let_go()

    return frame.mapInArrow(run, f"id {kind}, template string, matched long, coverage double, start long, end long").withColumnRenamed("id", id_col)
