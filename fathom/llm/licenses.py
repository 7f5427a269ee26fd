"""License scans: MinHash retrieval, then exact shingle containment.

A template's shingles of five words are cut into parts; a text's shingles into
windows twice as long as a part, each overlapping the next by half, so that a part
that stands in the text lies whole in some window.  A part and its window share
at least an eighth of their shingles, and with 64 MinHash bands of one row the
two agree in at least one with probability 1 - (7/8)**64 > 0.9998.  One agreement of
any of its parts makes a template a candidate for the text, and then all the
shingles of the template are looked up in all the text.  So a template of which four
fifths of the shingles are left after edits is missed only if each of its parts is.

Shingles found are dealt to occurrences by where the template would have to begin
for them to stand where they do.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import prepare, text_bytes

SHINGLE = 5
BANDS = 64
#: Longest part of each scale, in shingles; a window has twice as many.
SCALES = (4, 16, 64)
#: Share of a template's shingles that must stand in an occurrence.
CONTAINED = 0.8
#: Words (or this share of the template, if that is more) by which edits may shift
#: neighbouring shingles of one occurrence against each other.
SHIFT = 16
SHIFT_SHARE = 0.1
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")

# Notices and texts of public licenses; the long ones are files.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."
    ),
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-3.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License."
    ),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
        "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause-third": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."
    ),
    "BSD-opening": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not "
        "be misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution."
    ),
    "GPL-2.0-only-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License version 2 as published by the Free Software Foundation."
    ),
    "GPL-2.0-or-later-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version."
    ),
    "GPL-3.0-or-later-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "LGPL-2.1-or-later-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version."
    ),
    "LGPL-3.0-or-later-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version."
    ),
    "AGPL-3.0-or-later-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."
    ),
    "WTFPL-grant": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
}


def templates_in(folder: str | Path) -> dict[str, str]:
    """Whole texts from files of a folder, by their names without ``.txt``."""
    return {f"{p.stem}-text": p.read_text(encoding="utf-8", errors="replace") for p in sorted(Path(folder).glob("*.txt"))}


TEMPLATES = NOTICES | templates_in(Path(__file__).parent / "license_texts")

_rng = np.random.default_rng(10)
FACTORS = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MATCHES = "array<struct<license:string,contained:double,first_word:int,last_word:int>>"


def tokens(text: bytes) -> list[bytes]:
    return WORDS.findall(text.lower())


def shingles(words: list[bytes]) -> list[bytes]:
    return [b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def hashes(found: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s) for s in found], np.uint64)


def minima(h: np.ndarray, ends_of_runs: np.ndarray) -> np.ndarray:
    """The bands' MinHash values of runs of shingles, (bands, runs)."""
    with np.errstate(over="ignore"):
        return np.stack([np.minimum.reduceat((h * f) >> np.uint64(17), ends_of_runs) for f in FACTORS])


class Scanner:
    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        #: Of each template: its distinct shingles and where each first stands in it; how often
        #: each place's shingle comes; how many words it has.
        self.places: list[dict[bytes, int]] = []
        self.often: list[Counter] = []
        self.words: list[int] = []
        parts: dict[int, list[tuple[int, list[bytes]]]] = {s: [] for s in SCALES}
        for t, name in enumerate(self.names):
            found = shingles(tokens(templates[name].encode()))
            if not found:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            self.places.append({})
            for i, x in enumerate(found):
                self.places[t].setdefault(x, i)
            self.often.append(Counter(self.places[t][x] for x in found))
            self.words.append(len(found) + SHINGLE - 1)
            for i in range(0, len(found), SCALES[-1]):
                part = found[i : i + SCALES[-1]]
                parts[next(s for s in SCALES if len(part) <= s)].append((t, part))
        self.hashes = [np.sort(hashes(list(p))) for p in self.places]
        self.keys: dict[int, np.ndarray] = {}
        self.owners: dict[int, np.ndarray] = {}
        self.quick: dict[int, np.ndarray] = {}
        for scale, own in parts.items():
            found = np.concatenate([np.zeros((BANDS, 0), np.uint64), *(minima(hashes(p), np.zeros(1, np.int64)) for _, p in own)], axis=1)
            band = np.repeat(np.arange(BANDS, dtype=np.uint64), found.shape[1])
            key = self.key(band, found.ravel())
            order = np.argsort(key, kind="stable")
            self.keys[scale] = key[order]
            self.owners[scale] = np.tile(np.array([t for t, _ in own], np.int64), BANDS)[order]
            self.quick[scale] = np.zeros((BANDS, 1 << 16), bool)
            self.quick[scale][band.astype(np.int64), (found.ravel() & np.uint64(0xFFFF)).astype(np.int64)] = True

    @staticmethod
    def key(band: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Band and value (of 47 bits) in one number."""
        return band << np.uint64(47) | value

    def candidates(self, h: np.ndarray) -> list[int]:
        """Templates of which a part agrees with a window in a band."""
        base, met = SCALES[0], set()
        blocks = minima(h, np.arange(0, len(h), base))
        rows = np.arange(BANDS)[:, None]
        for scale in SCALES:
            keys = self.keys[scale]
            if not len(keys):
                continue
            mine = np.minimum.reduceat(blocks, np.arange(0, blocks.shape[1], scale // base), axis=1)
            windows = np.minimum(mine[:, :-1], mine[:, 1:]) if mine.shape[1] > 1 else mine
            hit = self.quick[scale][rows, (windows & np.uint64(0xFFFF)).astype(np.int64)]
            band, w = np.nonzero(hit)
            asked = np.unique(self.key(band.astype(np.uint64), windows[band, w]))
            low, high = np.searchsorted(keys, asked), np.searchsorted(keys, asked, side="right")
            for a, b in zip(low[high > low].tolist(), high[high > low].tolist(), strict=True):
                met.update(self.owners[scale][a:b].tolist())
        return sorted(met)

    def parted(self, t: int, run: np.ndarray, in_template: np.ndarray) -> list[np.ndarray]:
        """A run in order of the text, cut where a shingle comes more often than the
        template has it."""
        cuts, met = [0], Counter()
        for k, place in enumerate(in_template[run].tolist()):
            met[place] += 1
            if met[place] > self.often[t][place]:
                cuts.append(k)
                met = Counter([place])
        return np.split(run, cuts[1:])

    def scan(self, text: bytes) -> list[dict]:
        """A row for each occurrence of a license: the share of its shingles that the
        occurrence contains, and the words from the first to the last found."""
        found = shingles(tokens(text))
        if not found:
            return []
        h = hashes(found)
        rows = []
        for t in self.candidates(h):
            places, known = self.places[t], self.hashes[t]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            there = [i for i in np.flatnonzero(known[at] == h).tolist() if found[i] in places]
            if len(there) < CONTAINED * len(places):
                continue
            in_template = np.array([places[found[i]] for i in there])
            there = np.array(there)
            begin = there - in_template
            order = np.lexsort((there, begin))
            shift = max(SHIFT, SHIFT_SHARE * self.words[t])
            short = shift >= self.words[t]  # occurrences may stand as near as edits shift words
            cuts = np.r_[0, np.flatnonzero(np.diff(begin[order]) > min(shift, self.words[t] - 1)) + 1, len(order)].tolist()
            runs = [np.sort(order[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            for own in (x for run in runs for x in (self.parted(t, run, in_template) if short else [run])):
                share = len(set(in_template[own].tolist())) / len(places)
                if share >= CONTAINED:
                    first, last = int(there[own].min()), int(there[own].max()) + SHINGLE - 1
                    rows.append({"license": self.names[t], "contained": share, "first_word": first, "last_word": last})
        return sorted(rows, key=lambda r: (r["license"], r["first_word"]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, into: str = "licenses") -> DataFrame:
    """``docs`` with an array column ``into`` (replaced if there) of the licenses
    found, one entry for each place: license, contained, first_word, last_word.

    Needs ``text``; texts of fewer than five words, null and empty ones have none.
    An occurrence counts if it holds at least CONTAINED of the template's shingles.
    Templates (by default TEMPLATES) are a fixed small table.  Rows stand alone,
    other columns pass untouched, an empty table gives none.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(dict(TEMPLATES if templates is None else templates))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gc.disable()
        scanner = Scanner(shared.value)
        kind = pa.list_(
            pa.struct(
                [("license", pa.string()), ("contained", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32())]
            )
        )
        for column in batches:
            yield pa.array([scanner.scan(x) for x in text_bytes(column)], kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    made = F.arrow_udf(run, MATCHES).asNondeterministic()
    return docs.withColumn(into, made(F.col("text").cast("string")))
