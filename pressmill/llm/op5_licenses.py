"""License scans by conditional compression.

A block is the span of a text around a cue word of licensing that a template aligns with best, within a line or over
several. Words around the span do not count. A span that lacks and adds at most MAX_DIFFERENCE of the template's words is
compressed by Zstandard alone and with the template as raw dictionary; it must save MIN_REDUCTION, and of all templates
the one that saves most bytes is reported, with its exact wording: the words that the block lacks and those it adds.

Nulls, empties, ties: null and empty texts have no candidates; equal savings go to the template first by name; a
block repeated in a text is reported at each place, by its first line; repeated rows are reported as often as they come;
letter case and comment marks do not matter; an empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import ship, table

MIN_REDUCTION, MAX_DIFFERENCE, LEVEL = 0.25, 0.34, 3

# The usual wording of license notices.
SPDX_IDS = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "All rights reserved. No part of this work may be reproduced without written permission.",
    **{f"spdx-{k.lower()}": f"SPDX-License-Identifier: {k}" for k in SPDX_IDS},
}
CUES = r"(?i)licen[sc]e|copyright|all[\s#*/]+rights[\s#*/]+reserved|permission[\s#*/]+is|creative[\s#*/]+commons|\bCC[\s#*/-]+BY|\bSPDX|public[\s#*/]+domain|free[\s#*/]+software|waived[\s#*/]+all"
_CUE, _WRAP = re.compile(CUES), re.compile(r"\s*\n[\s#*/;%>-]*|\s+")
_TOKEN = re.compile(r"\w+(?:[.-]\w+)*")

FOUND = "doc_id bigint, block_no int, template string, reduction double, alone_bytes int, given_bytes int, missing array<string>, added array<string>, exact boolean, n_lines int"


def align(words: list[str], own: list[str], at: int) -> tuple[int, int, list[str], list[str]] | None:
    """(first, end, missing, added) of the span of `own` with word `at` in it that is fewest edits from `words`; words
    before and after the span are free. None: no span has that word."""
    rows = [[(0, -j) for j in range(len(own) + 1)]]  # (edits, first word of the span, negated): ties start late
    for i, w in enumerate(words):
        above, row = rows[-1], [(i + 1, 0)]
        for j, x in enumerate(own):
            (c, f), (d, g), (e, h) = above[j], above[j + 1], row[j]
            row.append(min((c + (w != x), f), (d + 1, g), (e + 1, h)))
        rows.append(row)
    ends = [(rows[-1][j][0], j + rows[-1][j][1] != len(words), j) for j in range(at + 1, len(own) + 1) if -rows[-1][j][1] <= at]
    if not ends:
        return None
    end = j = min(ends)[2]
    i, missing, added = len(words), [], []
    while i:
        cost, first = rows[i][j]
        if j and rows[i - 1][j - 1] == (cost - (words[i - 1] != own[j - 1]), first):
            if words[i - 1] != own[j - 1]:
                missing.append(words[i - 1])
                added.append(own[j - 1])
            i, j = i - 1, j - 1
        elif rows[i - 1][j] == (cost - 1, first):
            missing.append(words[i - 1])
            i -= 1
        else:
            added.append(own[j - 1])
            j -= 1
    return j, end, missing[::-1], added[::-1]


class Scanner:
    def __init__(self, templates: dict[str, str]):
        import zstandard

        self.words = {k: _TOKEN.findall(v.lower()) for k, v in sorted(templates.items())}
        self.counts = {k: Counter(v) for k, v in self.words.items()}
        self.reach = 2 * max(map(len, self.words.values()), default=0)
        # No checksum, content size or dictionary id: the frame's fixed bytes would hide small savings.
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = zstandard.ZstdCompressor(**plain)
        self.given = {k: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(v.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **plain) for k, v in sorted(templates.items())}

    def scan(self, block: str) -> tuple | None:
        """(template, reduction, sizes, missing, added, exact) of the first notice."""
        return next((hit[1:-1] for hit in self.notices(block)), None)

    def notices(self, text: str) -> Iterator[tuple]:
        """(line number, template, reduction, sizes, missing, added, exact, number of lines) of every notice."""
        tokens = list(_TOKEN.finditer(text))
        own, starts = [t.group().lower() for t in tokens], [t.start() for t in tokens]
        done = 0  # tokens before this one are settled
        for cue in _CUE.finditer(text):
            at = bisect_right(starts, cue.start()) - 1
            if at < done:
                continue
            low = max(done, at - self.reach)
            near, best = own[low : at + self.reach], None
            held = Counter(near)
            for name, words in self.words.items():
                allowed = MAX_DIFFERENCE * len(words)
                if sum((self.counts[name] - held).values()) > allowed:
                    continue
                span = align(words, near, at - low)
                if span is None or len(span[2]) + len(span[3]) > allowed:
                    continue
                first, end = low + span[0], low + span[1]
                stop = tokens[end - 1].end()
                raw = _WRAP.sub(" ", text[starts[first] : stop + (text[stop : stop + 1] in (".", ","))]).lower().encode()
                alone, given = len(self.alone.compress(raw)), len(self.given[name].compress(raw))
                if 1 - given / alone >= MIN_REDUCTION and (best is None or alone - given > best[0]):
                    best = alone - given, first, end, name, 1 - given / alone, alone, given, *span[2:]
            if best:
                _, first, done, *hit, missing, added = best
                lines = text.count("\n", starts[first], starts[done - 1]) + 1
                yield text.count("\n", 0, starts[first]), *hit, missing, added, not missing and not added, lines


def _scan_batches(templates: dict[str, str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                rows += [(doc_id, *hit) for hit in scanner.notices(text)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each confirmed license notice in `docs`; block_no is its first line."""
    ship(docs.sparkSession)
    texts = docs.where(F.col("text").rlike(CUES)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.mapInPandas(_scan_batches(templates or TEMPLATES), FOUND)


def query(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))
