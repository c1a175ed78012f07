"""License scans by conditional compression.

Words around the stems of license notices are candidates: a block takes as many words before and after each
stem as the longest text of a template can have, so that lines that hold none are in. A stretch of a block
as long as a text of a template is compressed without and with the template as raw zstandard dictionary. What the
template saves, in bytes, tells how much of its wording the stretch has; templates that save
less than ``MIN_SAVED`` of what they save on the shortest of their own texts are out, the others are ranked by
what they save.

Winners are confirmed in this order by exact wording differences. The texts of a template are aligned with all
stretches of the block's words: a stretch has a text's wording if no key word (a name or version that tells the
template from the others) is missing, no other template's was put in, and the differing words stay under
``MAX_DIFFERENCE`` of the text's. A confirmed template claims its stretches; one ranked below it that fits
the same words (a license that is part of a longer one, or differs by a clause) doesn't get them.

Defined cases: null and blank texts have no candidates and no license; a text may hold several licenses and each is
reported once; equal savings go by template name; repeated rows are scanned alike, also such with a null id;
other columns are not read; an empty table gives an empty result.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:")
_BSD_TWO = (
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.")
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission.")
_BSD_END = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.")
#: Notices and whole texts by SPDX identifier, and the key words of each license.
TEMPLATES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "Apache-2.0": (("apache", "2.0"), (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.')),
    "BSD-2-Clause": (("redistribution",), (_BSD + _BSD_TWO + _BSD_END,)),
    "BSD-3-Clause": (("redistribution",), (_BSD, _BSD + _BSD_TWO + _BSD_THIRD + _BSD_END)),
    "CC-BY-4.0": (("by", "4.0"), (
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.")),
    "CC-BY-NC-4.0": (("by-nc", "4.0"), ("Licensed under CC BY-NC 4.0.",)),
    "CC-BY-SA-4.0": (("by-sa", "4.0"), ("Licensed under CC BY-SA 4.0.",)),
    "AGPL-3.0": (("affero", "3"), (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")),
    "CC0-1.0": (("cc0", "1.0"), ("Licensed under CC0 1.0.",)),
    "EPL-2.0": (("eclipse", "2.0"), (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",)),
    "GPL-2.0": (("general", "2"), ("This work is licensed under the GNU General Public License, version 2.",)),
    "GPL-3.0": (("general", "3"), (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")),
    "LGPL-3.0": (("lesser", "3"), ("This work is licensed under the GNU Lesser General Public License, version 3.",)),
    "ISC": (("isc",), (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.")),
    "MIT": (("mit",), (
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")),
    "MPL-2.0": (("mozilla", "2.0"), (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",)),
}
#: Every notice above holds one of these.
STEMS = ("licens", "redistribut", "copyright", "permission")
MIN_SAVED, MAX_DIFFERENCE = 0.4, 0.25
#: The price of a difference that rules a match out.
NEVER = 10_000
SCHEMA = "doc_id long, n_candidates long, licenses array<string>, best_license string, saved long, n_differences long"
_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def is_stem(word: str) -> bool:
    return any(stem in word for stem in STEMS)


class Scanner:
    def __init__(self, templates: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> None:
        self.templates = {k: (keys, [words(n) for n in notices]) for k, (keys, notices) in templates.items()}
        self.named = {key for keys, _ in templates.values() for key in keys}
        every = {w for _, notices in self.templates.values() for notice in notices for w in notice} | self.named
        self.number = {w: at for at, w in enumerate(sorted(every))}
        self.plain = zstandard.ZstdCompressor(level=9, write_content_size=False)
        self.primed = {
            name: zstandard.ZstdCompressor(level=9, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
                "\n".join(" ".join(n) for n in notices).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for name, (_, notices) in self.templates.items()}
        # a match with all the differences allowed is no longer than this
        self.reach = max((int((1 + MAX_DIFFERENCE) * len(n)) for _, notices in self.templates.values() for n in notices), default=0)
        self.least = {
            name: MIN_SAVED * min(self.size(data) - self.size(data, name) for data in (" ".join(n).encode() for n in notices))
            for name, (_, notices) in self.templates.items()}

    def size(self, data: bytes, name: str | None = None) -> int:
        """Compressed, with a template as dictionary or without."""
        return len((self.plain if name is None else self.primed[name]).compress(data))

    def blocks(self, text: str) -> list[str]:
        """The words around stems, so far that the lines of a notice that hold none are in; what overlaps is one block."""
        if not any(stem in text.lower() for stem in STEMS):
            return []
        found = words(text)
        spans: list[list[int]] = []
        for at, word in enumerate(found):
            if is_stem(word):
                first, last = max(0, at - self.reach), at + self.reach + 1
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = last
                else:
                    spans.append([first, last])
        return [" ".join(found[a:b]) for a, b in spans]

    def ranked(self, block: str) -> list[tuple[str, int]]:
        """(template, bytes it saves) of the templates that save enough of a candidate, the most first.

        Candidates of a template are the stretches where one of its texts may stand: as long as the text, with
        a stem where the text has one. So what a block repeats elsewhere doesn't hide what the template knows.
        """
        found = words(block)
        stems = [at for at, word in enumerate(found) if is_stem(word)]
        plain: dict[bytes, int] = {}
        out = []
        for name, (_, notices) in self.templates.items():
            tried: set[bytes] = set()
            for notice in notices:
                width = len(notice) + len(notice) // 4
                firsts = {max(0, at - offset) for at in stems for offset, word in enumerate(notice) if is_stem(word)}
                tried |= {" ".join(found[first : first + width]).encode() for first in firsts}
            best = 0
            for data in tried:
                if data not in plain:
                    plain[data] = self.size(data)
                best = max(best, plain[data] - self.size(data, name))
            if best >= self.least[name]:
                out.append((name, best))
        return sorted(out, key=lambda x: (-x[1], x[0]))

    def scan(self, block: str) -> list[tuple[str, int, int]]:
        """(license, bytes saved, differing words) of each confirmed license of a block, in the order of the ranking."""
        text = words(block)
        numbers = np.array([self.number.get(w, -1) for w in text], np.int64)
        held, found = set(text), []
        claimed = np.zeros(len(text), bool)
        for name, saved in self.ranked(block):
            keys, notices = self.templates[name]
            hits = [
                hit for notice in notices if not any(k in notice and k not in held for k in keys)
                for hit in self.stretches(numbers, notice, keys) if not claimed[hit[0] : hit[1]].any()]
            for first, last, _ in hits:
                claimed[first:last] = True
            if hits:
                found.append((name, saved, min(apart for _, _, apart in hits)))
        return found

    def stretches(self, text: np.ndarray, notice: list[str], keys: tuple[str, ...]) -> Iterator[tuple[int, int, int]]:
        """(first, last, words missing or put in) of the stretches of a text that have the notice's wording."""
        wanted = np.array([self.number[w] for w in notice])
        # no key word may be missing, and no other license's name be put in
        missing = np.where(np.isin(notice, keys), NEVER, 1)
        others = [self.number[w] for w in self.named if w not in notice]
        added = np.where(np.isin(text, others), NEVER, 1)
        apart = aligned(wanted, missing, text, added, False)
        after = np.append(apart[1:], NEVER)
        before = np.append(NEVER, apart[:-1])
        for last in np.flatnonzero((apart <= MAX_DIFFERENCE * len(notice)) & (apart <= before) & (apart < after)):
            part = slice(max(0, last - 2 * len(notice)), last)
            back = aligned(wanted[::-1], missing[::-1], text[part][::-1], added[part][::-1], True)
            yield int(last - np.argmin(back)), int(last), int(apart[last])


def aligned(notice: np.ndarray, missing: np.ndarray, text: np.ndarray, added: np.ndarray, anchored: bool) -> np.ndarray:
    """For each place of the text, the least cost of the notice in a stretch that ends there and starts anywhere (``anchored``: at 0)."""
    put_in = np.concatenate(([0], np.cumsum(added)))
    cost = put_in if anchored else np.zeros(len(text) + 1, np.int64)
    for word, price in zip(notice, missing, strict=True):
        here = cost + price
        same = np.flatnonzero(text == word)
        here[same + 1] = np.minimum(here[same + 1], cost[same])
        cost = np.minimum.accumulate(here - put_in) + put_in
    return cost


def scanned(docs: DataFrame, templates: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = TEMPLATES) -> DataFrame:
    """doc_id, number of candidate blocks, licenses found, and the one that saves most with its figures, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            counts, names, best = [], [], []
            for text in batch.column("text").to_pylist():
                blocks = scanner.blocks(text or "")
                found = sorted((hit for block in blocks for hit in scanner.scan(block)), key=lambda x: (-x[1], x[0]))
                counts.append(len(blocks))
                names.append(sorted({name for name, _, _ in found}))
                best.append(found[0] if found else (None, None, None))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array([b[0] for b in best], pa.string()),
                 pa.array([b[1] for b in best], pa.int64()), pa.array([b[2] for b in best], pa.int64())],
                ["doc_id", "n_candidates", "licenses", "best_license", "saved", "n_differences"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
