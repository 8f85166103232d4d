"""License scan: normalised text against templates by the Dice coefficient over word bigrams.

Words are runs of letters, digits and non-ASCII characters in lower case; what is compared is the set of
bigrams of a line, of a paragraph (lines up to an empty one), of the whole text and of every window of as many
words as the template, wherever it begins.  With a
Dice coefficient of at least t a segment of a bigrams and a template of b share
t (a + b) / 2 of them, so a lies between b t / (2 - t) and b (2 - t) / t: templates outside these
bounds are pruned, and a document is only compared with the templates of which it has enough bigrams,
which are found for whole batches at once.  Sliding windows cost a few array operations over the document
for each of these templates.

Templates are short notices, the standard headers that sources carry and the whole texts in license_texts.

Defined results: null and empty texts have no license; a text without two words in a row has none;
equal coefficients go to the template that is first by name; repeated rows give one result each.
"""

from __future__ import annotations

import pkgutil
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from changeloom.llm.words import ALNUM, LOWER, ngrams, ragged, words

LEAST = 0.8


def _whole(name: str) -> str:
    return pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()


def _gnu(name: str, version: str, work: str = "program") -> tuple[str, str]:
    """The header of the GNU licenses: its first paragraph, and the whole of it."""
    first = f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    rest = f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {work}. If not, see <https://www.gnu.org/licenses/>."
    return first, f"{first} {rest}"


#: Short notices by which texts and sources name their license, standard headers, and whole texts.
TEMPLATES = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", *_gnu("Affero General Public License", "3"), _whole("AGPL-3.0")),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        _whole("Apache-2.0"),
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", _whole("BSD-2-Clause")),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", _whole("BSD-3-Clause")),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", _whole("CC-BY-4.0")),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0.", _whole("CC0-1.0")),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", *_gnu("General Public License", "2"), _whole("GPL-2.0")),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", *_gnu("General Public License", "3"), _whole("GPL-3.0")),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        _whole("ISC"),
    ),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.", *_gnu("Lesser General Public License", "2.1", "library"), _whole("LGPL-2.1")),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", *_gnu("Lesser General Public License", "3", "library"), _whole("LGPL-3.0")),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        _whole("MIT"),
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        _whole("MPL-2.0"),
    ),
}
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    found = [w.encode().lower().decode() for w in _WORD.findall(text)]
    return frozenset(zip(found, found[1:], strict=False))


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Template(NamedTuple):
    size: int  # distinct bigrams
    name: str
    pairs: frozenset
    hashes: np.ndarray  # of the distinct bigrams, sorted
    length: int  # bigrams, repeated ones included


@lru_cache(maxsize=4)
def _compiled(templates: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[list[Template], np.ndarray, np.ndarray, np.ndarray]:
    """Templates by number of bigrams; the sorted hashes of all their bigrams, and the templates that have each, with offsets."""
    own = []
    for name, texts in templates:
        for text in texts:
            found = np.concatenate([ngrams(w.hash, 2, w.first)[0] for w in words(pa.array([text]), ALNUM, LOWER)] or [np.zeros(0, np.uint64)])
            if len(found):
                own.append(Template(len(b := bigrams(text)), name, b, np.unique(found), len(found)))
    own.sort(key=lambda t: (t.size, t.name))
    every, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t.hashes for t in own)]), return_inverse=True)
    owner = np.repeat(np.arange(len(own)), [len(t.hashes) for t in own])
    return own, every, owner[np.argsort(at, kind="stable")], np.searchsorted(np.sort(at), np.arange(len(every) + 1))


def segments(text: str) -> Iterator[str]:
    lines = text.split("\n")
    yield from lines
    if len(lines) > 1:
        yield from re.split(r"\n[ \t\r]*\n", text)
        yield text


def sliding(found: np.ndarray, template: Template) -> float:
    """The largest coefficient of the template and a window of its length in a text of these bigram hashes; 0 if it has no room to slide."""
    size = template.length
    if len(found) <= size:
        return 0.0
    order = np.argsort(found, kind="stable")
    before = np.full(len(found), -1)
    before[order[1:]] = np.where(found[order[1:]] == found[order[:-1]], order[:-1], -1)

    def distinct(at: np.ndarray) -> np.ndarray:
        """For each window, how many of these places are the first of their bigram in it."""
        first = np.maximum(np.maximum(before[at] + 1, at - size + 1), 0)
        return np.cumsum(np.bincount(first, minlength=len(found) + 1) - np.bincount(at + 1, minlength=len(found) + 1))[: len(found) - size + 1]

    shared = distinct(np.flatnonzero(np.isin(found, template.hashes)))
    return float((2 * shared / (distinct(np.arange(len(found))) + template.size)).max())


def best(text: str, hashes: np.ndarray, own: list[Template], least: float) -> list[tuple[float, str]]:
    """(coefficient, name) of every license found in a text with these bigram hashes, the best first."""
    sizes = [t.size for t in own]
    found: dict[str, float] = {}
    for segment in segments(text):
        a = bigrams(segment)
        low, high = len(a) * least / (2 - least), len(a) * (2 - least) / least
        for t in own[int(np.searchsorted(sizes, low - 1e-9)) : int(np.searchsorted(sizes, high + 1e-9, "right"))]:
            d = dice(a, t.pairs)
            if d >= least:
                found[t.name] = max(d, found.get(t.name, 0.0))
    for t in own:
        d = sliding(hashes, t)
        if d >= least:
            found[t.name] = max(d, found.get(t.name, 0.0))
    return sorted(((d, name) for name, d in found.items()), key=lambda x: (-x[0], x[1]))


def scan(documents: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license (the best, or null), dice (0 without), licenses (all found, best first, comma-joined) for each row."""
    fixed = tuple(templates.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, every, owner, offsets = _compiled(fixed)
        enough = np.array([max(1, np.ceil(t.size * least / (2 - least) - 1e-9)) for t in own])
        for batch in batches:
            n, texts = batch.num_rows, batch.column(1)
            name, value, names = [None] * n, np.zeros(n), [""] * n
            for w in words(texts, ALNUM, LOWER) if len(every) else ():
                found, inside = ngrams(w.hash, 2, w.first)
                at = np.minimum(np.searchsorted(every, found), len(every) - 1)
                hit = np.flatnonzero(inside & (every[at] == found))
                several = np.diff(offsets)[at[hit]]
                which = np.repeat(w.doc[hit], several) * len(own) + owner[ragged(offsets[at[hit]], several)]
                close = np.bincount(which, minlength=(len(w.first) - 1) * len(own)).reshape(-1, len(own)) >= enough
                for k in np.flatnonzero(close.any(axis=1)):
                    got = best(texts[w.row + int(k)].as_py(), found[w.first[k] : w.first[k + 1] - 1], [own[t] for t in np.flatnonzero(close[k])], least)
                    if got:
                        value[w.row + k], name[w.row + k] = got[0]
                        names[w.row + k] = ",".join(x for _, x in got)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(value), pa.array(names, pa.string())], ["doc_id", "license", "dice", "licenses"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, dice double, licenses string")
