"""License scan by conditional compression.

Candidate blocks are the words around licensing cues, as far on both sides as the longest template with as many foreign
words can reach, and the cues' sentences; blocks that meet are one.  Each block is compressed alone and with every
template as a zstandard raw dictionary; the bytes that a template saves rank the templates, and in that order they claim
places in the block.  A claim holds only where the wording confirms it: the shortest runs of words that hold the template's
words in order (none missing for a short notice, one in fifty for a long one), fewest differences first.  Foreign words may
stand between them inside one sentence or line; in a longer run there are none for a short notice and no more than its own
words for a long one.  The whole ranking is gone through.  What is left of the block before, between and after the claimed
places is a block of its own, compressed and ranked again, until nothing more is confirmed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Wordings of common public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released to the public domain under CC0 1.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
CUES = ("licen", "copyright", "redistribut", "warrant", "hereby granted", "public domain", "public license", "cc by", "cc0")
CUE = re.compile("|".join(re.escape(c).replace(r"\ ", r"\s+") for c in CUES), re.I)
# A full stop after an abbreviation that stands before a digit ends no sentence.
ENDS = re.compile(r"\n+|(?<=[.!?])(?!(?:(?<=\b[vV]\.)|(?<=\b[vV]er\.)|(?<=\b[vV]ers\.)|(?<=\b[nN]o\.))[ \t]+\d)[ \t]+")
WORD = re.compile(r"\w+(?:[.+/-]\w+)*")
SHORT = 20


def _words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def sentences(text: str) -> list[tuple[int, int]]:
    """Extents of the sentences and lines of a text."""
    edges = [(m.start(), m.end()) for m in ENDS.finditer(text)]
    starts, ends = [0, *(b for _, b in edges)], [*(a for a, _ in edges), len(text)]
    return [(a, b) for a, b in zip(starts, ends, strict=True) if a < b]


class Template:
    """Words of a template and where they stand in it."""

    def __init__(self, text: str):
        self.words = _words(text)
        self.counts, self.allowed = Counter(self.words), len(self.words) // 50
        self.at: dict[str, list[int]] = {}
        for i in reversed(range(len(self.words))):
            self.at.setdefault(self.words[i], []).append(i)

    def within(self, held: Mapping[str, int]) -> bool:
        """Whether so many words of each kind can hold the template."""
        return bool(self.words) and sum(max(0, n - held.get(w, 0)) for w, n in self.counts.items()) <= self.allowed

    def runs(self, own: list[str], first: int, last: int) -> Iterator[tuple[int, int, int]]:
        """Shortest runs of the words from `first` to before `last` that hold the template in order: (first word, last word, words missing).

        `latest[q][i]` is the latest start of a run up to here that holds the first i words but at most q of them.
        """
        size, most = len(self.words), self.allowed
        latest = [[-1] * (size + 1) for _ in range(most + 1)]
        given: dict[tuple[int, int], int] = {}
        for j in range(first, last):
            for i in self.at.get(own[j], ()):
                for q in range(most + 1):
                    latest[q][i + 1] = max(j if s == i else latest[q - s][i - s] for s in range(min(q, i) + 1))
                rest = size - 1 - i
                for q in range(most - rest + 1):
                    start = latest[q][i + 1]
                    if start > max(given.get((q, i), -1), latest[q - 1][i + 1] if q else -1):
                        given[q, i] = start
                        yield start, j, q + rest


class Matcher:
    def __init__(self, templates: Mapping[str, str]):
        import zstandard

        self.names = sorted(templates)
        self.templates = {n: Template(templates[n]) for n in self.names}
        self.reach = 2 * max((len(t.words) for t in self.templates.values()), default=0)
        frame = {"level": 3, "write_content_size": False}
        self.plain = zstandard.ZstdCompressor(**frame)
        self.given = {n: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(templates[n].lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **frame) for n in self.names}
        self.ranked: dict[str, list[str]] = {}

    def saved(self, name: str, block: str) -> tuple[int, int]:
        """Bytes that the template saves of a block's compressed size, and that size."""
        raw = block.lower().encode()
        alone = len(self.plain.compress(raw))
        return alone - len(self.given[name].compress(raw)), alone

    def ranking(self, block: str) -> list[str]:
        """All templates, that which saves most bytes of the block first."""
        if block in self.ranked:
            return self.ranked[block]
        order = sorted(self.names, key=lambda n: (-self.saved(n, block)[0], n))
        if len(block) < 4096:  # copies of a notice are many, so short blocks are remembered: some 50 MB at most
            if len(self.ranked) >= 10_000:
                self.ranked.clear()
            self.ranked[block] = order
        return order

    def confirmed(self, text: str, places: list[tuple[int, int]], own: list[str], line: list[int], first: int, last: int) -> list[tuple]:
        """Runs of the words from `first` to before `last` with a template's wording that do not meet: (first word, last word, template, share saved, words missing, words added)."""
        held = Counter(own[first:last])
        if not any(t.within(held) for t in self.templates.values()):
            return []
        out: list[tuple] = []
        free = bytearray(b"\1") * (last - first)
        for name in self.ranking(text[places[first][0]:places[last - 1][1]]):
            template = self.templates[name]
            if not template.within(held):
                continue
            size, found = len(template.words), []
            for a, b, missing in template.runs(own, first, last):
                added = b - a + 1 - (size - missing)
                if line[a] == line[b] or added <= (0 if size <= SHORT else size):
                    found.append((missing + added, a, b, missing, added))
            for _, a, b, missing, added in sorted(found):
                if all(free[a - first:b + 1 - first]):
                    free[a - first:b + 1 - first] = bytes(b + 1 - a)
                    fewer, alone = self.saved(name, text[places[a][0]:places[b][1]])
                    out.append((a, b, name, fewer / alone, missing, added))
        return sorted(out)

    def blocks(self, text: str, places: list[tuple[int, int]], line: list[int]) -> list[tuple[int, int]]:
        """Extents of the candidate blocks in words."""
        starts, out = [a for a, _ in places], []
        for m in CUE.finditer(text):
            at = max(bisect_right(starts, m.start()) - 1, 0)
            first = min(max(at - self.reach, 0), bisect_right(line, line[at] - 1))
            last = max(min(at + self.reach + 1, len(places)), bisect_right(line, line[at]))
            if out and first <= out[-1][1]:
                out[-1] = (min(first, out[-1][0]), max(last, out[-1][1]))
            else:
                out.append((first, last))
        return out

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int, int, float, int, int]]]:
        """Number of candidate blocks; (template, start, end, saved, missing, added) of confirmed ones, in order."""
        if not text or not CUE.search(text):
            return 0, []
        places = [m.span() for m in WORD.finditer(text)]
        own = [text[a:b].lower() for a, b in places]
        begins = [a for a, _ in sentences(text)]
        line = [bisect_right(begins, a) for a, _ in places]
        blocks = self.blocks(text, places, line)
        out, todo = [], list(blocks)
        while todo:
            first, last = todo.pop()
            runs = self.confirmed(text, places, own, line, first, last)
            out += runs
            if runs:
                edges = [first, *(e for a, b, *_ in runs for e in (a, b + 1)), last]
                todo += [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]
        return len(blocks), [(name, places[a][0], places[b][1], *rest) for a, b, name, *rest in sorted(out)]


MATCH = "array<struct<license:string,start:int,end:int,saved:double,missing:int,added:int>>"


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_blocks, n_licenses, licenses, matches), one per input row.

    `matches` are confirmed blocks with their extent in code points, `licenses` their distinct names, comma-joined.
    Null and empty texts have none; null ids and repeated rows stay; other columns are ignored; an empty table gives
    no rows.  A text of any length is read whole, one at a time; templates that save the same are tried by name.
    """

    @pandas_udf(f"n_blocks int, matches {MATCH}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(templates)
        keys = ("license", "start", "end", "saved", "missing", "added")
        for texts in batches:
            found = [matcher.scan(t) for t in texts]
            yield pd.DataFrame({"n_blocks": [n for n, _ in found], "matches": [[dict(zip(keys, m, strict=True)) for m in ms] for _, ms in found]})

    rows = docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("x")).select("doc_id", "x.*")
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return rows.select("doc_id", "n_blocks", F.size(names).alias("n_licenses"), F.array_join(names, ",").alias("licenses"), "matches")
