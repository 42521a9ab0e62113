"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

What is compared of a file: each line, each sentence (over wrapped lines), each paragraph, the header (the
leading run of comment lines, or the first paragraph), and of a licence file the whole text. Each is a
sparse vector of term counts times idf, where idf is that among the templates; terms of no template only
add to the norm. A file's own licence is that of its best part, if the cosine reaches the threshold; all licences that
parts of it are like are listed too.

Each text is cut into terms once, by segments (the pieces of a line between ends of sentences); lines, sentences,
paragraphs and headers are runs of segments, so their known terms and numbers of unknown ones are sums. Parts that
cannot reach the threshold are left out by a proof, not by a guess: of a part's squared norm, unknown terms make at least their
number times the square of their idf, and its cosine is at most the root of the share that known terms have.

Own licences are found in one pass, map only. Files named like licence files speak for their directory. Every
other file takes the licence of the nearest directory at or above its own that has one: directories,
not files, are exploded to their ancestors and joined on path. Directories with a licence are
broadcast if they are few (counted); else ancestors that many directories share are dealt over sub-keys
by their counts. Files are joined to their directory last; adaptive execution splits hot directories.

Defined results
* null and empty texts have no licence of their own; null paths belong to no directory.
* ties: among templates by cosine, then name; among licence files of a directory by cosine, then path.
* every row gives a row, repeated ones too; other columns are ignored; an empty table gives none.
* very long texts, lines and words are compared like any other.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_map, checkpoint

#: A part needs this cosine to a template.
THRESHOLD = 0.6
#: Directories with a licence up to which they are broadcast; directories below one ancestor that meet in one task.
FEW_DIRECTORIES, TOGETHER = 1 << 16, 1 << 18
#: Parts up to this length whose results a worker keeps, and how many.
KEPT_LENGTH, KEPT = 400, 1 << 14

# What two licences share.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
# Statements by which licences are usually named in headers and licence files.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "BSD 3-Clause License. " + _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "BSD 2-Clause License. " + _BSD + _BSD_END),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited."),
)
LICENCE_FILE = re.compile(r"(licen[cs]e|copying|copyright|notice|unlicense)\b", re.I)
_TERM = re.compile(r"[a-z0-9]++(?:\.[0-9]++)*+")
_COMMENT = re.compile(r"^[ \t]*+(?:#++|//++|/?\*++/?|--++|;++|%++|<!--|\.\.)[ \t]*+")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t]+")


#: Of a segment: the terms that some template has, the sum of their squared idf, and how many others there are.
Terms = tuple[list[str], float, int]


class Index:
    """The templates' weights by term, and what parts are like them."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        counts = [Counter(_TERM.findall(text.lower())) for _, text in templates]
        within = Counter(t for c in counts for t in c)
        n = len(templates)
        self.threshold = threshold
        self.names = [licence for licence, _ in templates]
        self.idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in within.items()}
        self.square = {t: x * x for t, x in self.idf.items()}
        self.unknown = math.log(1 + n) + 1
        self.weights: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.kept: dict[str, tuple[float, str] | None] = {}
        for k, c in enumerate(counts):
            norm = math.sqrt(sum((f * self.idf[t]) ** 2 for t, f in c.items()))
            for t, f in c.items():
                self.weights[t].append((k, f * self.idf[t] / norm))

    def best(self, part: str) -> tuple[float, str] | None:
        """(-cosine, licence) of the best template, if it reaches the threshold."""
        if part in self.kept:
            return self.kept[part]
        counts = Counter(_TERM.findall(part.lower()))
        norm = math.sqrt(sum((f * self.idf.get(t, self.unknown)) ** 2 for t, f in counts.items()))
        dots: dict[int, float] = defaultdict(float)
        for t, f in counts.items():
            for k, w in self.weights.get(t, ()):
                dots[k] += f * self.idf[t] * w
        found = min(((-round(d / norm, 6), self.names[k]) for k, d in dots.items()), default=None)
        if found and -found[0] < self.threshold:
            found = None
        if len(part) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[part] = found
        return found

    def terms(self, segment: str) -> Terms:
        every = _TERM.findall(segment.lower())
        known = [t for t in every if t in self.idf]
        return known, sum([self.square[t] for t in known]), len(every) - len(known)

    def reaches(self, own: list[Terms]) -> bool:
        """Whether segments with these terms together can be like a template."""
        share = self.threshold**2 - 1e-5
        count, squares, outside = 0, 0.0, 0.0
        for known, s, n in own:
            count, squares, outside = count + len(known), squares + s, outside + n
        outside *= self.unknown**2 * share
        # a term that stands f times counts f * f squares, which is at most the number of all terms for each
        if not count or count * squares * (1 - share) < outside:
            return False
        counts = Counter([t for known, _, _ in own for t in known])
        return sum([f * f * self.square[t] for t, f in counts.items()]) * (1 - share) >= outside

    def own(self, text: str, whole: bool) -> list[tuple[float, str]]:
        """(-cosine, licence) of each licence that a part of the text is like, the best first."""
        best: dict[str, float] = {}
        for part in parts(text, whole, self.terms, self.reaches):
            if found := self.best(part):
                best[found[1]] = min(best.get(found[1], 0.0), found[0])
        return sorted((c, name) for name, c in best.items())


def parts(text: str, whole: bool, terms: Callable[[str], Terms], reaches: Callable[[list[Terms]], bool]) -> Iterator[str]:
    """What is compared of a text: those of its lines, sentences and paragraphs, its header and the text that `reaches` lets pass."""
    lines = text.split("\n")
    bare = [_COMMENT.sub("", x).strip() for x in lines]
    cut = [_SENTENCE.split(x) if x else [] for x in bare]
    own = [[terms(x) for x in segments] for segments in cut]
    yield from (x for x, t in zip(bare, own) if x and reaches(t))
    header = 0
    while header < len(lines) and _COMMENT.match(lines[header]):
        header += 1
    every = lambda a, b: [t for line in own[a:b] for t in line]
    if header and reaches(every(0, header)):
        yield " ".join(bare[:header])
    start = 0
    for k, x in enumerate([*bare, ""]):
        if x:
            continue
        if start < k:
            if reaches(every(start, k)):
                yield " ".join(bare[start:k])
            # a sentence goes on over lines until a segment ends it; one that is its line has been looked at
            open_: list[tuple[str, Terms]] = []
            for n in range(start, k):
                for j, segment in enumerate(cut[n]):
                    open_.append((segment, own[n][j]))
                    if j + 1 < len(cut[n]) or segment[-1:] in (".", "!", "?") or n + 1 == k:
                        if (len(open_) > 1 or len(cut[n]) > 1) and reaches([t for _, t in open_]):
                            yield " ".join(x for x, _ in open_)
                        open_ = []
        start = k + 1
    if whole and reaches(every(0, len(lines))):
        yield " ".join(bare)


def own_licences(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files(key, path, text) -> key, path, licence, similarity, licences (all, by name) for every row; null and empty where no part is
    like a template."""
    kind = files.schema["key"].dataType.simpleString()
    held: list[Index] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Index(templates, threshold))
        found = []
        for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
            name = (path or "").rpartition("/")[2]
            found.append(held[0].own(text, bool(LICENCE_FILE.match(name))) if text else [])
        best = [x[0] if x else (None, None) for x in found]
        licence, similarity = pa.array([x for _, x in best], pa.string()), pa.array([c and -c for c, _ in best], pa.float64())
        every = pa.array([sorted(x for _, x in own) for own in found], pa.list_(pa.string()))
        return pa.record_batch([batch.column("key"), batch.column("path"), licence, similarity, every], names=["key", "path", "licence", "similarity", "licences"])

    return arrow_map(files.select("key", F.col("path").cast("string"), F.col("text").cast("string")), run, f"key {kind}, path string, licence string, similarity double, licences array<string>", "text")


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _nearest(dirs: DataFrame, speaks: DataFrame) -> DataFrame:
    """dirs(dir), speaks(at, licence, path, similarity, licences), one row each -> dir and the nearest `at` of dir or above it."""
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth"), steps.alias("steps"))
    above = above.select("dir", "depth", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice("steps", F.lit(1), F.col("depth")), "/")).alias("at"))
    if speaks.count() <= FEW_DIRECTORIES:
        both = above.join(F.broadcast(speaks), "at")
    else:
        dealt = above.groupBy("at").agg(F.ceil(F.count("*") / TOGETHER).alias("groups")).where("groups > 1")
        dealt = F.broadcast(checkpoint(dealt))  # one row for each TOGETHER directories of one ancestor at most
        salted = above.join(dealt, "at", "left").withColumn("salt", F.pmod(F.xxhash64("dir"), F.coalesce("groups", F.lit(1))).cast("int")).drop("groups")
        spread = speaks.join(dealt, "at", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("groups", F.lit(1)).cast("int") - 1))).drop("groups")
        both = salted.join(spread, ["at", "salt"])
    return both.groupBy("dir").agg(F.max_by(F.struct("licence", "path", "similarity", "licences"), "depth").alias("n")).select(F.col("dir").alias("d"), F.col("n.licence").alias("dir_licence"), F.col("n.path").alias("dir_path"), F.col("n.similarity").alias("dir_similarity"), F.col("n.licences").alias("dir_licences"))


def scan(files: DataFrame, key: str = "key", path: str = "path", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of files: key, path, licence, similarity (of the best part), licences (all of the file by name, or
    all that the licence files of the directory name), origin (own, inherited, none), licence_path (the file that the best comes from)."""
    base = files.select(F.col(key).alias("key"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    owned = checkpoint(own_licences(base, templates, threshold)).withColumn("dir", _directory(F.col("path")))
    speaks = F.regexp_extract("path", r"([^/]*)$", 1).rlike("(?i)^" + LICENCE_FILE.pattern) & F.col("licence").isNotNull()
    # all licences of a directory's files: no more than there are templates' names
    said = owned.where(speaks).withColumn("each", F.explode("licences"))
    by_dir = said.groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("order"), "path", "licence")).alias("b"), F.array_sort(F.collect_set("each")).alias("licences"))
    by_dir = checkpoint(by_dir.select(F.col("dir").alias("at"), F.col("b.licence").alias("licence"), F.col("b.path").alias("path"), (-F.col("b.order")).alias("similarity"), "licences"))
    nearest = _nearest(owned.where(F.col("path").isNotNull()).select("dir").distinct(), by_dir)
    both = owned.join(nearest, (F.col("dir") == F.col("d")) & F.col("path").isNotNull(), "left")
    has, inherits = F.col("licence").isNotNull(), F.col("dir_licence").isNotNull()
    return both.select(
        F.col("key").alias(key),
        F.col("path"),
        F.coalesce("licence", "dir_licence").alias("licence"),
        F.coalesce("similarity", "dir_similarity").alias("similarity"),
        F.when(has, F.col("licences")).when(inherits, F.col("dir_licences")).otherwise(F.array().cast("array<string>")).alias("licences"),
        F.when(has, "own").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(has, F.col("path")).when(inherits, F.col("dir_path")).alias("licence_path"),
    )
