"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A passage is a run of whole lines. Its words are lower-cased and stripped of everything but letters and digits;
its set of word bigrams is compared with each template's. A passage and a template of a and b bigrams can reach
the bound t only when a is between b * t / (2 - t) and b * (2 - t) / t, so a document is looked at for a template
only when it holds enough of the template's bigrams, and a run of lines is grown only while its size fits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

THRESHOLD = 0.8

# Names and wordings of licence notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the'
        " specific language governing permissions and limitations under the License."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this"
        " list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above"
        " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other"
        " materials provided with the distribution."
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY"
        " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU"
        " General Public License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated'
        ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
        " to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above"
        " copyright notice and this permission notice shall be included in all copies or substantial portions of the"
        " Software."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}

#: Letters and digits stay, A-Z lower-cased; a line feed stays; all else separates.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 10 else 32 for b in range(256))


def bigrams(words: list) -> set:
    """The set of neighbouring words."""
    return set(zip(words, words[1:], strict=False))


def dice(a: set, b: set) -> float:
    """2 |a & b| / (|a| + |b|), 0 for two empty sets."""
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Scanner:
    """Finds the best run of lines for each template; made once, then sent to the executors."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold, self.names = threshold, sorted(templates)
        words = {k: templates[k].encode().translate(_TABLE).split() for k in self.names}
        self.sets = [bigrams(words[k]) for k in self.names]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for x in words.values() for w in x}))}
        n = len(self.vocabulary) + 1
        # For each pair of known words: whether any template has them side by side.
        self.known = np.zeros(n * n, bool)
        self.width = n
        for s in self.sets:
            for a, b in s:
                self.known[self.vocabulary[a] * n + self.vocabulary[b]] = True
        t = threshold
        self.least = [max(1, int(np.ceil(t / (2 - t) * len(s) - 1e-9))) for s in self.sets]  # shared bigrams, and size
        self.most = [int((2 - t) / t * len(s) + 1e-9) for s in self.sets]

    def texts(self, texts: list[bytes]) -> list[list[tuple[str, float, int, int]]]:
        """For each text (name, dice, first line, last line) of each template reached, in order of name."""
        get, flat, starts = self.vocabulary.get, [], [0]
        for x in texts:
            flat += [get(w, 0) for w in x.translate(_TABLE).split()]
            flat.append(0)
            starts.append(len(flat))
        ids = np.array(flat or [0], np.int64)
        pair = np.zeros(len(ids), bool)
        pair[:-1] = self.known[ids[:-1] * self.width + ids[1:]]
        few = min(self.least)
        enough = np.add.reduceat(pair, starts[:-1]) >= few if texts else []
        return [self.one(x) if ok else [] for x, ok in zip(texts, enough, strict=True)]

    def one(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """As ``texts``, for one text.

        Starts of runs are taken from the last line to the first, with a linked list of the places where a bigram occurs
        first from there on. A run grows only at these, so lines that say nothing new, however many, cost a start nothing, and a
        start follows the list no further than the largest template's bounds allow.
        """
        lines = [x.split() for x in text.translate(_TABLE).split(b"\n")]
        full = [i for i, x in enumerate(lines) if x]
        words = [w for i in full for w in lines[i]]
        grams = list(zip(words, words[1:], strict=False))
        own = set(grams)
        open_ = [k for k, s in enumerate(self.sets) if len(s & own) >= self.least[k]]
        best: dict[int, tuple[float, int, int]] = {}
        if not open_:
            return []
        holders = {g: [k for k in open_ if g in self.sets[k]] for g in set().union(*(self.sets[k] for k in open_)) & own}
        most = max(self.most[k] for k in open_)
        spare = max(int(self.most[k] - len(self.sets[k])) for k in open_)  # bigrams of no template
        starts = np.cumsum([0, *[len(lines[i]) for i in full]]).tolist()
        line_of = [a for a, i in enumerate(full) for _ in lines[i]]
        n = len(grams)
        later, seen = [n] * n, {}
        after, before, head, p = [n] * (n + 1), [-1] * (n + 1), n, n
        for a in reversed(range(len(full))):
            while p > starts[a] and p > 0:
                p -= 1
                later[p] = out = seen.get(grams[p], n)
                seen[grams[p]] = p
                if out < n:  # no longer the first
                    if before[out] >= 0:
                        after[before[out]] = after[out]
                    else:
                        head = after[out]
                    before[after[out]] = before[out]
                after[p], before[p], before[head], head = head, -1, p, p
            first = range(starts[a], min(starts[a + 1], n))  # its bigrams, the one that leads to the next line included
            if not any(grams[q] in holders for q in first) and any(later[q] == n for q in first):
                continue  # without this foreign line a run is better
            size, foreign, shared, found, node, line = 0, 0, dict.fromkeys(open_, 0), {}, head, -1
            while True:
                if line >= 0 and (node == n or line_of[node + 1] != line):
                    for k in open_:
                        if self.least[k] <= size <= self.most[k]:
                            d = 2 * shared[k] / (size + len(self.sets[k]))
                            if d >= self.threshold and (k not in found or d > found[k][0]):
                                found[k] = (d, full[line])
                if node == n:
                    break
                line, size = line_of[node + 1], size + 1
                own_by = holders.get(grams[node])
                for k in own_by or ():
                    shared[k] += 1
                foreign += own_by is None
                if size > most or foreign > spare:
                    break
                node = after[node]
            for k, (d, j) in found.items():
                if k not in best or d >= best[k][0]:
                    best[k] = (d, full[a], j)
        return [(self.names[k], *best[k]) for k in sorted(best)]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, matches) for every row of ``docs`` (doc_id, text).

    matches: array of (license, dice, first_line, last_line), sorted by name: for each template that a run of
    whole lines reaches with ``threshold`` or more, the run with the largest coefficient (of equal ones the first,
    then the shortest). Lines end at line feeds and count from 0; lines without words are never the first or last
    of a run. Null and empty texts and texts of one word match nothing. Repeated rows come back as often; null ids
    are kept; an empty table gives no rows; other columns are ignored. Texts are read whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates, threshold))
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())]))

    def scan(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = sent.value.texts([b"" if x is None else x.encode() for x in part.column("text").to_pylist()])
                rows = [[dict(zip(("license", "dice", "first_line", "last_line"), m, strict=True)) for m in x] for x in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], ["doc_id", "matches"])

    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {dict(docs.dtypes)['doc_id']}, matches array<struct<license:string,dice:double,first_line:int,last_line:int>>"
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against the templates above."""
    found = scan_licenses(read(spark, sf_dir, "documents"))
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["dice"].alias("dice"), m["license"].alias("license"))))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_licenses"),
        F.array_join(F.transform("matches", lambda m: m["license"]), ",").alias("licenses"),
        best["license"].alias("best"),
        best["dice"].alias("best_dice"),
    )
