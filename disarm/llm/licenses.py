"""License scans by conditional compression.

A license template is given to the compressor as a raw dictionary. A text that has the template's wording then
shrinks more than by itself, so the bytes saved rank the templates that may stand at a place. They are confirmed,
or not, by the exact differences in wording; what is confirmed is taken out and the rest is looked at again.

Places are counted in words, so line wrapping and comment marks do not matter. Documents without any cue word are
passed over by byte searches before their text leaves the JVM.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wordings of common license notices, by name and form.
TEMPLATES: dict[tuple[str, str], str] = {
    ("Apache-2.0", "statement"): "Licensed under the Apache License, Version 2.0.",
    ("Apache-2.0", "header"): """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    ("MIT", "statement"): "Released under the MIT License.",
    ("MIT", "text"): """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ("BSD-2-Clause", "text"): """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.""",
    ("ISC", "text"): """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.""",
    ("GPL-3.0", "statement"): "This work is licensed under the GNU General Public License, version 3.",
    ("GPL-3.0", "header"): """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ("GPL-2.0", "statement"): "This work is licensed under the GNU General Public License, version 2.",
    ("LGPL-2.1", "header"): """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    ("MPL-2.0", "header"): """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ("Unlicense", "text"): "This is free and unencumbered software released into the public domain.",
    ("CC-BY-4.0", "statement"): "Licensed under CC BY 4.0.",
    ("CC-BY-SA-4.0", "statement"): "Licensed under CC BY-SA 4.0.",
    ("CC-BY-NC-4.0", "statement"): "Licensed under CC BY-NC 4.0.",
    ("CC-BY-4.0", "sentence"): "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ("CC0-1.0", "sentence"): "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ("proprietary", "statement"): "All rights reserved.",
}
#: Every template has one of these, lower-cased, within a word, so that no line break can part it.
CUES = ("licen", "permi", "redistribut", "reserved", "domain", "copyright", "warrant", "conditions", "software", "mozilla")

_WORD = re.compile(r"\w+(?:[-.]\w+)*")
#: What is told of a notice.
FINDING = {
    "license": "string", "form": "string", "start": "long", "length": "long", "saved_bytes": "int", "plain_bytes": "int", "share": "double",
    "missing": "array<string>", "extra": "array<string>", "exact": "boolean"}


def cues_of(templates: dict[tuple[str, str], str], share: float) -> list[str]:
    """Parts of words of which every notice has one: the fixed ones, and for templates without any so many of their longest
    words that not all of them can be missing."""
    cues = list(CUES)
    for text in templates.values():
        words = _WORD.findall(text.lower())
        may_miss = len(words) - max(1, math.ceil(share * len(words) - 1e-9))
        if not any(c in w for w in words for c in CUES):
            counts, taken = Counter(words), 0
            for word in sorted(counts, key=lambda w: (-len(w), w)):
                cues.append(word)
                taken += counts[word]
                if taken > may_miss:
                    break
    return list(dict.fromkeys(cues))


class Scanner:
    """Templates with their compressors; made once in a task."""

    def __init__(self, templates: dict[tuple[str, str], str], share: float, longest: int) -> None:
        self._share, self._longest = share, longest
        self._cue = re.compile("|".join(map(re.escape, cues_of(templates, share))))
        self._plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self._templates = []
        for (name, form), text in templates.items():
            raw = zstandard.ZstdCompressionDict(" ".join(text.lower().split()).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            given = zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_dict_id=False)
            words = _WORD.findall(text.lower())
            self._templates.append((name, form, words, Counter(words), given))
        #: a notice, with the words that may stand in between, is no longer than this
        self._reach = max(len(words) + len(words) // 4 for _, _, words, _, _ in self._templates)

    def blocks(self, lower: str) -> Iterator[tuple[list[re.Match], int]]:
        """Words that a notice with a cue may reach, and how many of them are the block's own.

        A block's last words are also the next one's first: a notice that starts among the own words, and any
        other that overlaps it, are in the block as a whole.
        """
        cues = self._cue.finditer(lower)
        cue = next(cues, None)
        held: list[re.Match] = []
        left = 0  # words that a notice starting within the last cue's reach may have
        for word in _WORD.finditer(lower):
            while cue and cue.end() <= word.start():
                cue = next(cues, None)
            if cue and cue.start() < word.end():
                left = 2 * self._reach + 1
            held.append(word)
            if left:
                left -= 1
                if len(held) >= self._longest + 2 * self._reach:
                    yield held, self._longest
                    held = held[self._longest:]
                if not left:
                    yield held, len(held) - self._reach
                    held = held[-self._reach:]
            elif len(held) > self._reach:
                del held[0]
        if left:
            yield held, len(held)

    def _confirmed(self, words: list[str], template: list[str], need: int) -> tuple[int, int, list[str], list[str]] | None:
        """Where the template's words stand in order, and the wording that differs; a stray word at an end is not part of it."""
        same = [m for m in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if m.size]
        best = None
        for i in range(len(same)):
            have = 0
            for j in range(i, len(same)):
                have += same[j].size
                more = same[j].b + same[j].size - same[i].b - have
                if have >= need and more <= len(template) // 4 and (best is None or have - more > best[0]):
                    best = have - more, same[i:j + 1]
        if best is None:
            return None
        run = best[1]
        kept = {k for m in run for k in range(m.a, m.a + m.size)}
        extra = [w for m, n in zip(run, run[1:]) for w in words[m.b + m.size:n.b]]
        return run[0].b, run[-1].b + run[-1].size, [w for k, w in enumerate(template) if k not in kept], extra

    def _places(self, words: list[str], template: list[str], counts: Counter) -> Iterator[tuple[int, int, list[str], list[str]]]:
        """Confirmed places of one template that do not overlap. Only windows with enough of its words are compared."""
        size, need = len(template), max(1, math.ceil(self._share * len(template) - 1e-9))
        present = set(words)
        if sum(n for w, n in counts.items() if w in present) < need:
            return
        width = size + size // 4
        seen: Counter = Counter()
        have, starts = 0, []
        for k in range(len(words) + width - 1):  # the window ends at k
            if k < len(words) and (w := words[k]) in counts:
                seen[w] += 1
                have += seen[w] <= counts[w]
            if (gone := k - width) >= 0 and (w := words[gone]) in counts:
                have -= seen[w] <= counts[w]
                seen[w] -= 1
            if have >= need and (first := k - width + 1) >= 0:
                starts.append((first, have))
            elif have >= need and k == len(words) - 1:
                starts.append((0, have))
        tried: set[int] = set()
        at = free = 0
        while at < len(starts):
            first = starts[at][0]
            if first in tried:
                at += 1
                continue
            last = at
            while last < len(starts) and starts[last][0] < first + width:
                last += 1
            start = max((s for s in starts[at:last] if s[0] not in tried), key=lambda s: s[1])[0]
            tried.add(start)
            found = self._confirmed(words[max(start, free):start + width], template, need)
            if found:
                begin = max(start, free)
                a, z, missing, extra = found
                yield begin + a, begin + z, missing, extra
                free = begin + z
                while at < len(starts) and starts[at][0] < free:
                    at += 1

    def _gains(self, words: list[str]) -> list[tuple[int, int]]:
        """Templates by how many bytes they save, as dictionaries, on what is left of a block: (bytes, template), most first."""
        data = " ".join(filter(None, words)).encode()
        plain = len(self._plain.compress(data))
        gains = [(plain - len(given.compress(data)), k) for k, (*_, given) in enumerate(self._templates)]
        return sorted(gains, key=lambda g: (-g[0], -len(self._templates[g[1]][2]), g[1]))

    def _notices(self, text: str, block: list[re.Match], words: list[str]) -> list[tuple]:
        """All notices of a block; ``words`` loses what they hold.

        The template that saves most is looked for first. Where it is confirmed, its words are taken out and the templates are
        ranked again by what is left. None is left untried before a block is done, so the rank decides which of several that fit
        a place has it, and never whether a notice is found.
        """
        found = []
        while True:
            for _, k in self._gains(words):
                places = list(self._places(words, *self._templates[k][2:4]))
                for lo, hi, *differences in places:
                    # forms that differ in a few words fit each other's places: there the one that saves most on the place's own words has it
                    best, (a, z, missing, extra) = next(
                        ((j, p) for _, j in self._gains(words[lo:hi]) for p in self._places(words[lo:hi], *self._templates[j][2:4])),
                        (k, (0, hi - lo, *differences)))
                    name, form, template, _, given = self._templates[best]
                    start, end = block[lo + a].start(), block[lo + z - 1].end()
                    data = " ".join(text[start:end].lower().split()).encode()
                    plain = len(self._plain.compress(data))
                    found.append((lo + a, (name, form, start, end - start, plain - len(given.compress(data)), plain, 1 - len(missing) / len(template), missing, extra, not missing and not extra)))
                    words[lo + a:lo + z] = [""] * (z - a)
                if places:
                    break
            else:
                return found

    def scan(self, text: str) -> list[tuple]:
        lower = text.lower()
        if len(lower) != len(text):  # some letters grow when lower-cased; places must not move
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        made, done = [], 0
        for block, own in self.blocks(lower):
            words = ["" if w.start() < done else w[0] for w in block]
            for a, notice in sorted(self._notices(text, block, words), key=lambda n: n[0]):
                if a < own:  # the next block has the others
                    made.append(notice)
                    done = max(done, notice[2] + notice[3])
        return made


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[tuple[str, str], str] | None = None,
    share: float = 0.85, longest: int = 4096,
) -> DataFrame:
    """One row per confirmed notice: id and FINDING.

    ``share`` of a template's words must be there, in order, and at most a quarter as many others between them.
    ``missing`` and ``extra`` are the exact differences. Notices of one text do not overlap; ``start`` and ``length``
    are the notice's own, and the bytes are of its text alone. Null and empty texts have no notice. Each row is
    scanned, repeated ones alike; other columns are ignored. Texts are read whole, ``longest`` words at a time and as
    many more as two notices can have.
    """
    templates = templates or TEMPLATES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, share, longest)
        for batch in batches:
            made = [(i, *f) for i, t in zip(batch["id"], batch["text"]) for f in scanner.scan(t)]
            yield pd.DataFrame(made, columns=[id_col, *FINDING])

    lower = F.lower(F.col(text_col))
    cued = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(c)) for c in cues_of(templates, share)])
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in FINDING.items())
    return docs.where(cued).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema)
