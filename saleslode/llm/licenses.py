"""License scan: MinHash bands over overlapping windows, verified by shingle containment.

Templates are cut into shingles of two words. A text is read in overlapping windows of twice a
template class's words (a power of two at least the template's own words), one every half
class, so each occurrence lies whole in a window. Window and template then have a Jaccard
similarity of at least about an eighth; ``BANDS`` bands of one MinHash row each meet with
probability 1 - (1 - J) ** BANDS (over 0.999 for J of an eighth). Windows with fewer places of
the class's shingles than ``CONTAINMENT`` asks of its smallest template cannot pass the
verification and are not hashed. Retrieved templates are verified exactly: some stretch of
words, at most a quarter longer than the template, must hold ``CONTAINMENT`` of its shingles,
and must have the template's ``MARKS``: words that tell sibling licenses apart. Of these, the
stretch holds all that the template has and no other; version digits are compared only where
the template has some.

Templates are a bounded parameter and travel with the tasks. The fixed ones below are short
licenses as a whole, and the notices by which longer ones are applied; other texts can be passed.

Edge cases: NULL, empty and short texts match nothing; a template found several times in a text
is one row per place; overlapping hits are one, that which holds the most shingles; repeated
rows give repeated results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, Words, byte_blocks, gram_hashes, id_and_text, map_arrow, mix, table

GRAM = 2
BANDS = 64
CONTAINMENT = 0.8
_U = np.uint64

# Public licenses and license notices, by SPDX name.
_NO_WARRANTY_BSD = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS "
    "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED "
    "OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are "
             "permitted provided that the following conditions are met")
# List numbers are left out, as copies differ in them.
_BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions "
    "and the following disclaimer. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written "
    "permission."
)
_NO_WARRANTY_ISC = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
    "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
    "OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT_HEAD = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
    "software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, "
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
)
_GNU = {
    "GPL-2.0": ("General", "2"), "GPL-3.0": ("General", "3"),
    "LGPL-2.0": ("Library General", "2"), "LGPL-2.1": ("Lesser General", "2.1"),
    "LGPL-3.0": ("Lesser General", "3"), "AGPL-3.0": ("Affero General", "3"),
}
_CC_ELEMENTS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_CC_VERSIONS = {"4.0": "International", "3.0": "Unported"}
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", _MIT_HEAD,
            _MIT_HEAD + ", and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission "
            "notice shall be included in all copies or substantial portions of the Software. THE "
            "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
            "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
            "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
            "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
            "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
            "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
                   "use this file except in compliance with the License. You may obtain a copy of "
                   "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
                   "applicable law or agreed to in writing, software distributed under the License "
                   "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
                   "KIND, either express or implied. See the License for the specific language "
                   "governing permissions and limitations under the License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, "
                "v. 2.0.", "licensed under the Mozilla Public License, version 2.0."],
    "EPL-2.0": ["made available under the terms of the Eclipse Public License 2.0",
                "licensed under the Eclipse Public License, version 2.0."],
    "EPL-1.0": ["made available under the terms of the Eclipse Public License v1.0",
                "licensed under the Eclipse Public License, version 1.0."],
    "BSD-2-Clause": ["licensed under the BSD 2-Clause License.",
                     f"{_BSD_HEAD}: {_BSD_TWO} {_NO_WARRANTY_BSD}"],
    "BSD": [_BSD_HEAD],     # which of the two the rest of the text would tell
    "BSD-3-Clause": ["licensed under the BSD 3-Clause License.",
                     f"{_BSD_HEAD}: {_BSD_TWO} {_BSD_THIRD} {_NO_WARRANTY_BSD}"],
    "ISC": ["licensed under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with "
            "or without fee is hereby granted, provided that the above copyright notice and this "
            f"permission notice appear in all copies. {_NO_WARRANTY_ISC}"],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with "
             f"or without fee is hereby granted. {_NO_WARRANTY_ISC}"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is "
                  "free to copy, modify, publish, use, compile, sell, or distribute this software, "
                  "either in source code form or as a compiled binary, for any purpose, commercial "
                  "or non-commercial, and by any means."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    **{f"CC-{code}-{version}": [
        f"Licensed under CC {code} {version}.",
        f"licensed under a Creative Commons {name} {version} {scope} License."]
       for code, name in _CC_ELEMENTS.items() for version, scope in _CC_VERSIONS.items()},
    **{spdx: [
        f"This work is licensed under the GNU {name} Public License, version {version}.",
        f"licensed under the GNU {name} Public License, version {version}.",
        f"under the terms of the GNU {name} Public License as published by the Free Software "
        f"Foundation, either version {version} of the License, or (at your option) any later "
        "version."]
       for spdx, (name, version) in _GNU.items()},
}
# Words that tell a license from its siblings, and digits of versions.
MARKS = ("affero", "lesser", "library", "sharealike", "alike", "sa", "noncommercial", "commercial",
         "nc", "noderivatives", "noderivs", "nd", "endorse", "appear")
VERSION_MARKS = ("0", "1", "2", "3", "4", "5", "v1", "v2", "v3")

# Words are runs of ASCII letters and digits and of bytes above 0x7F; case is ignored.
BREAK = np.ones(256, bool)
BREAK[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B))] = False
BREAK[0x80:] = False


@dataclass
class Library:
    names: list[str]
    shingles: list[np.ndarray]   # distinct shingles of each template
    words: list[int]
    classes: list[int]           # power of two of each template's words
    marks: list[int]             # bits of the marks each template has
    minima: np.ndarray           # BANDS x templates
    known: np.ndarray            # all shingles, sorted
    member: np.ndarray           # bits of the classes that have each known shingle
    least: dict[int, int]        # shingles that a hit of a class has at least


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block of documents, and each document's first word."""
    words = Words(LOWER[data], offsets, BREAK)
    return words.hashes(), words.first


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]))[0]


_MARK_HASHES = np.concatenate([_hashes(word) for word in MARKS + VERSION_MARKS])
_MARK_ORDER = np.argsort(_MARK_HASHES)
NAMED = (1 << len(MARKS)) - 1
VERSIONS = ((1 << len(VERSION_MARKS)) - 1) << len(MARKS)


def mark_bits(hashes: np.ndarray) -> np.ndarray:
    """One bit for each word that is a mark."""
    ordered = _MARK_HASHES[_MARK_ORDER]
    at = np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)
    return np.where(ordered[at] == hashes, np.int64(1) << _MARK_ORDER[at], 0)


def same_marks(bits: int, own: int) -> bool:
    compared = NAMED | (VERSIONS if own & VERSIONS else 0)
    return bits & compared == own


def band_values(shingles: np.ndarray) -> np.ndarray:
    """One row of hashes per band."""
    seeds = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    return mix(shingles[None, :] ^ seeds[:, None])


def needed(shingles: int) -> int:
    """Fewest of so many shingles that reach ``CONTAINMENT``."""
    return next(n for n in range(shingles + 1) if n / shingles >= CONTAINMENT)


def build_library(templates: dict[str, list[str]]) -> Library:
    names, shingles, words, classes, marks, minima = [], [], [], [], [], []
    for name, texts in templates.items():
        for text in texts:
            hashes = _hashes(text)
            grams = np.unique(gram_hashes(hashes, GRAM))
            if not len(grams):
                raise ValueError(f"a template needs {GRAM} words: {text!r}")
            names.append(name)
            shingles.append(grams)
            words.append(len(hashes))
            classes.append(1 << (len(hashes) - 1).bit_length())
            marks.append(int(np.bitwise_or.reduce(mark_bits(hashes))))
            minima.append(band_values(grams).min(1))
    known = np.unique(np.concatenate(shingles))
    member = np.zeros(len(known), np.int64)
    least: dict[int, int] = {}
    for grams, width in zip(shingles, classes, strict=True):
        member[np.searchsorted(known, grams)] |= width
        least[width] = min(least.get(width, len(grams)), needed(len(grams)))
    return Library(names, shingles, words, classes, marks, np.stack(minima, 1), known, member,
                   least)


def retrieve(grams: np.ndarray, bounds: np.ndarray, library: Library) -> list[tuple]:
    """(document, template, first gram, end gram) of the windows whose bands meet a template.

    ``grams`` are those of a block of documents, whose first words are ``bounds``.
    """
    lengths = np.maximum(np.diff(bounds) - GRAM + 1, 0)
    first, end = bounds[:-1], bounds[:-1] + lengths
    at = np.minimum(np.searchsorted(library.known, grams), len(library.known) - 1)
    member = np.where(library.known[at] == grams, library.member[at], 0)
    found = []
    for width in sorted(library.least):
        of = [t for t, c in enumerate(library.classes) if c == width]
        step = max(1, width // 2)
        places = np.zeros(len(grams) + 1, np.int64)
        np.cumsum(member & width != 0, out=places[1:])
        windows = -(-lengths // step)
        doc = np.repeat(np.arange(len(lengths)), windows)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        low = first[doc] + number * step
        high = np.minimum(low + 2 * width - GRAM + 1, end[doc])
        for i in np.flatnonzero(places[high] - places[low] >= library.least[width]).tolist():
            lowest = band_values(grams[low[i]:high[i]]).min(1)
            for t in of:
                if (lowest == library.minima[:, t]).any():
                    found.append((int(doc[i]), t, int(low[i]), int(high[i])))
    return found


def verify(grams: np.ndarray, marks: np.ndarray, t: int, low: int, high: int,
           library: Library) -> tuple | None:
    """(first word, words, containment) of the window's fullest stretch with the template's marks.

    Of equally full stretches the shortest, then the first.
    """
    own = library.shingles[t]
    inside = low + np.flatnonzero(np.isin(grams[low:high], own))
    most = library.words[t] + max(1, library.words[t] // 4) - GRAM + 1
    best = None
    for i, start in enumerate(inside.tolist()):
        stop = int(np.searchsorted(inside, start + most))
        if (stop - i) / len(own) < CONTAINMENT:
            continue
        _, new = np.unique(grams[inside[i:stop]], return_index=True)
        share = len(new) / len(own)
        words = int(inside[i + new.max()]) - start + GRAM
        if share < CONTAINMENT or best is not None and (-share, words, start) >= best:
            continue
        if same_marks(int(np.bitwise_or.reduce(marks[start:start + words])), library.marks[t]):
            best = (-share, words, start)
    return best and (best[2], best[1], -best[0])


def scan(hashes: np.ndarray, bounds: np.ndarray, library: Library) -> list[tuple]:
    """(document, template, first word, words, containment) of the licenses in a block."""
    grams, marks = gram_hashes(hashes, GRAM), mark_bits(hashes)
    hits: dict[int, set] = {}
    for doc, t, low, high in retrieve(grams, bounds, library):
        place = verify(grams, marks, t, low, high, library)
        if place:
            hits.setdefault(doc, set()).add((t, *place))
    rows = []
    for doc in sorted(hits):
        kept: list[tuple] = []
        for t, low, count, share in sorted(hits[doc],
                                           key=lambda x: (-round(x[3] * len(library.shingles[x[0]])),
                                                          -x[3], x[1], x[0])):
            if all(low >= a + n or low + count <= a for _, a, n, _ in kept):
                kept.append((t, low, count, share))
        rows += [(doc, t, low - int(bounds[doc]), count, share)
                 for t, low, count, share in sorted(kept, key=lambda x: x[1])]
    return rows


def license_hits(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, license, first_word, n_words, containment) of every license notice found."""
    library = build_library(templates or TEMPLATES)

    def run(batch):
        rows = {n: [] for n in ("doc", "license", "first_word", "n_words", "containment")}
        for low, _, block, offsets in byte_blocks(batch["text"]):
            hashes, bounds = word_hashes(block, offsets)
            for doc, t, first, count, share in scan(hashes, bounds, library):
                for column, value in zip(rows.values(), (low + doc, library.names[t], first,
                                                         count, share), strict=True):
                    column.append(value)
        taken = batch["doc_id"].take(pa.array(rows.pop("doc"), pa.int64()))
        yield {"doc_id": taken} | rows

    return map_arrow(docs, run, "doc_id long, license string, first_word long, n_words long, "
                                "containment double")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_hits(id_and_text(table(spark, sf_dir, "documents")))
