"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Each line, clause and paragraph and the whole of a text is a segment: a vector of term frequency times inverse document frequency, with the document
frequencies of all terms over all documents.  It is compared with every template of a licence: short statements, made of names and frames, and the customary
headers, titles and texts.  The best cosine of ``least`` or more is the file's own licence.

The terms of the templates are few, so their frequencies go to all tasks, and those of all other terms by BUCKETS hashed places: terms that share a place have its sum, so
no frequency is below the true one and no weight above.  With them the cosine of a segment is bounded from above, however many documents there are: the product is exact, and
the norm is at least that of the weights of the places.  Segments whose bound is below ``least`` are no licence and leave no trace; of the others, each different one once, all
terms are joined to their frequencies and the cosine is made.

A directory's licence is that of its licence files (LICENSE, COPYING and the like), or else the one that most of its files state.
A file without its own inherits from the nearest directory at or above its own that has one: distinct directories are joined to their ancestors
by path and the deepest hit is joined back to the files.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import join_hot, table, text_batches, written

LEAST = 0.6
TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
LICENCE_FILE = r"(?i)^(?:licen[cs]e|copying|unlicense|notice)(?:[.-].*)?$"
#: Where clauses part.
CLAUSE = re.compile(r"[,;:()\[\]\"]+|[.!?](?=\s|$)|\s[-|*#/]+\s")
FLUSH_TERMS = 200_000
#: Places of the frequencies that bound the weights of terms of no template.
BUCKETS = 1 << 18

FRAMES = [
    "{}", "License: {}", "SPDX-License-Identifier: {}", "Licensed under the {}", "Licensed under {}", "Released under the {}", "Distributed under the terms of the {}", "Available under the {}",
    "This work is licensed under the {}", "This project is licensed under the terms of the {}", "This library is distributed under the {}", "See the {} for details",
]

#: Licence -> names by which statements refer to it.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License", "MIT", "Expat License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license", "ASL 2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL-3.0", "GPL-3.0-or-later", "GPL-3.0-only", "GPL version 3"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2", "GPL-2.0", "GPL-2.0-or-later", "GPL-2.0-only", "GPL version 2"],
    "GPL": ["GNU General Public License", "GNU GPL", "GPL"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3", "LGPL-3.0", "LGPL-3.0-or-later", "LGPL-3.0-only", "LGPL version 3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL-2.1", "LGPL-2.1-or-later", "LGPL-2.1-only", "LGPL version 2.1"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL", "LGPL"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3", "AGPL-3.0", "AGPL-3.0-or-later", "AGPL-3.0-only", "Affero GPL"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause", "3-clause BSD license", "New BSD license", "Modified BSD license"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause", "2-clause BSD license", "Simplified BSD license", "FreeBSD license"],
    "BSD": ["BSD license", "BSD-style license"],
    "ISC": ["ISC License", "ISC"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0-1.0", "CC0"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "Zlib": ["zlib License", "zlib/libpng license"],
    "Proprietary": [],
}
#: Names that are words of other languages or too short to stand alone.
NOT_ALONE = frozenset(["MIT", "ISC", "GPL", "LGPL", "CC0"])

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_2 = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."

#: Licence -> customary headers, titles and texts.
TEXTS: dict[str, list[str]] = {
    "MIT": [_MIT, _MIT_2, f"MIT License {_MIT} {_MIT_2} {_WARRANTY}"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "GPL-3.0": [_GNU.format("program", ":", "", ",", "3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "GPL-2.0": [_GNU.format("program", ";", "", ";", "2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-3.0": [_GNU.format("library", ":", "Lesser ", ",", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1": [_GNU.format("library", ";", "Lesser ", ";", "2.1"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "AGPL-3.0": [_GNU.format("program", ":", "Affero ", ",", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0"],
    "BSD-3-Clause": [f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_3}", _BSD_3],
    "BSD-2-Clause": [f"{_BSD} {_BSD_1} {_BSD_2}"],
    "BSD": [_BSD, "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC0-1.0": ["Released under CC0 1.0, dedicated to the public domain.", "CC0 1.0 Universal Public Domain Dedication"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part may be reproduced without written permission.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}


def templates() -> dict[str, list[str]]:
    """Licence -> all forms of its statement."""
    framed = {k: [f.format(n) for n in names for f in FRAMES if f != "{}" or n not in NOT_ALONE] for k, names in NAMES.items()}
    return {k: [*forms, *TEXTS.get(k, [])] for k, forms in framed.items()}


def terms(text: str) -> Counter:
    """Terms and how often they come; both spellings of the noun are one."""
    return Counter(t.replace("licence", "license") for t in TERM.findall(text.lower()))


def segments(text: str) -> dict[str, None]:
    """The different lines, clauses, paragraphs and the whole of a text, in order."""
    lines = text.split("\n")
    return dict.fromkeys([*lines, *(c for line in lines for c in CLAUSE.split(line)), *re.split(r"\n\s*\n", text), text])


def bucket(term: str) -> str:
    """The hashed place of a term; no term has its sign."""
    return f"#{zlib.crc32(term.encode()) % BUCKETS}"


def _count_terms(shared=None, places: bool = False):
    """term, n: in how many texts of the partition each term is (of the shared ones, if given); the number of texts under the empty term.

    With ``places``, terms that aren't shared are counted under their hashed place.
    """

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if shared is None else shared.value
        seen: Counter = Counter()

        def placed() -> Counter:
            out: Counter = Counter()
            for t, k in seen.items():
                out[t if t == "" or t in wanted else bucket(t)] += k
            return out

        for b in batches:
            for t in b.column(0):
                seen[""] += 1
                found = terms(t.as_py() or "").keys()
                seen.update(found if wanted is None or places else wanted.intersection(found))
                if len(seen) > FLUSH_TERMS:
                    yield rows(placed() if places else seen)
                    seen = Counter()
        yield rows(placed() if places else seen)

    return run


def frequencies(files: DataFrame, wanted: frozenset[str] | None = None, places: bool = False) -> DataFrame:
    """term, df: the number of ``files`` whose text has each term; only of the wanted ones, if given, or with ``places`` of the hashed places of all others too."""
    shared = None if wanted is None else files.sparkSession.sparkContext.broadcast(wanted)
    return files.select("text").mapInArrow(_count_terms(shared, places), "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def idf(n: int, found: int) -> float:
    """At least 1, for a term that is in every text."""
    return math.log((n + 1) / (found + 1)) + 1


class Templates:
    """The templates' unit vectors over their own terms, the weights of these terms, and the least weight of every other term by its hashed place."""

    def __init__(self, forms: dict[str, list[str]], frequency: dict[str, int], n: int, least: float = LEAST):
        each = [(name, terms(f)) for name, fs in sorted(forms.items()) for f in fs]
        self.names = [name for name, _ in each]
        self.number = {t: k for k, t in enumerate(sorted({t for _, c in each for t in c}))}
        self.idf = np.array([idf(n, frequency.get(t, 0)) for t in self.number])
        self.unit = np.zeros((len(each), len(self.number)))
        for k, (_, c) in enumerate(each):
            for t, m in c.items():
                self.unit[k, self.number[t]] = (1 + math.log(m)) * self.idf[self.number[t]]
        self.unit /= np.linalg.norm(self.unit, axis=1, keepdims=True)
        places = np.zeros(BUCKETS)
        for t, k in frequency.items():
            if t.startswith("#"):
                places[int(t[1:])] = min(k, n)
        self.least = np.log((n + 1) / (places + 1)) + 1
        self._known: dict[str, float] = {}
        # a template's heaviest terms, without which the rest of it is shorter than ``least``: a text with none of them is no statement of it
        self.keys: set[str] = set()
        by_number = list(self.number)
        for u in self.unit:
            order = np.argsort(-u, kind="stable")
            rest = 1 - np.cumsum(u[order] ** 2)
            self.keys.update(by_number[k] for k in order[: int(np.argmax(rest < least * least)) + 1].tolist())

    def vector(self, counts: Counter) -> np.ndarray:
        v = np.zeros(len(self.number))
        for t, m in counts.items():
            if t in self.number:
                v[self.number[t]] = (1 + math.log(m)) * self.idf[self.number[t]]
        return v

    def bound(self, segment: str) -> float:
        """No cosine of the segment with a template is above this."""
        found = self._known.get(segment)
        if found is None:
            counts = terms(segment)
            if self.keys.isdisjoint(counts):
                return 0.0
            own = self.vector(counts)
            square = float(own @ own)
            others = sum(((1 + math.log(m)) * float(self.least[int(bucket(t)[1:])])) ** 2 for t, m in counts.items() if t not in self.number) if square else 0.0
            found = float((self.unit @ own).max()) / math.sqrt(square + others) + 1e-9 if square else 0.0
            if len(self._known) < 100_000 and len(segment) < 1000:
                self._known[segment] = found
        return found

    def best(self, segment: str, square: float) -> tuple[float, str | None]:
        """The best cosine of a segment whose terms outside of the templates have this square of their norm; equal ones go to the name that sorts first."""
        own = self.vector(terms(segment))
        cosines = np.round(self.unit @ own / math.sqrt(float(own @ own) + square), 9)
        k = int(np.argmax(cosines))
        return float(cosines[k]), self.names[k]


def _likely(shared, least: float):
    """Rows with ``segments``: those of the text whose bound reaches ``least``, by their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Templates = shared.value
        for b in batches:
            texts, out = b.column(b.schema.get_field_index("text")), []
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                hopeful = not t.keys.isdisjoint(terms(text))
                kept = (" ".join(sorted(terms(s).elements())) for s in segments(text) if t.bound(s) >= least) if hopeful else ()
                out.append(list(dict.fromkeys(kept)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.string()))], ["uid", "file_id", "path", "segments"])

    return run


def _best(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Templates = shared.value
        for b in batches:
            found = [t.best(s.as_py(), q.as_py()) for s, q in zip(b.column(1), b.column(2), strict=True)]
            keep = pa.array([c >= least for c, _ in found], pa.bool_())
            out = [b.column(0), b.column(3), pa.array([c for c, _ in found], pa.float64()), pa.array([n for _, n in found], pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["sid", "n", "score", "licence"]).filter(keep)

    return run


def stated(files: DataFrame, forms: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """file_id, path, licence, score: each file's own licence, null where no segment reaches ``least``."""
    forms = templates() if forms is None else forms
    spark = files.sparkSession
    own = frozenset(t for fs in forms.values() for f in fs for t in terms(f))
    counted = frequencies(files, own, places=True).toArrow()  # a row for each term of the templates and for each hashed place
    few = dict(zip(counted["term"].to_pylist(), counted["df"].to_pylist(), strict=True))
    n = few.pop("", 0)
    shared = spark.sparkContext.broadcast(Templates(forms, few, n, least))  # the templates
    rows = files.select(F.monotonically_increasing_id().alias("uid"), "file_id", "path", "text")
    likely = written(rows.mapInArrow(_likely(shared, least), "uid long, file_id long, path string, segments array<string>"), "licence-segments")
    each = likely.select("uid", F.explode("segments").alias("segment")).withColumn("sid", F.unhex(F.md5("segment")))
    distinct = written(each.groupBy("sid", "segment").agg(F.count("*").alias("n")), "licence-distinct")
    # of each different segment: the square of the norm of its terms outside of the templates, with their frequencies
    words = distinct.select("sid", F.explode(F.split("segment", " ")).alias("term")).groupBy("sid", "term").agg(F.count("*").alias("m"))
    known = spark.createDataFrame([(t,) for t in sorted(own)], "term string")
    words = words.join(F.broadcast(known), "term", "left_anti")
    needed = written(words.groupBy("term").agg(F.count("*").alias("n")), "licence-needed")
    # up to FLUSH_TERMS terms are sent to where the texts lie and only they are counted; beyond that all terms are
    small = needed.count() <= FLUSH_TERMS
    by_term = needed.join(frequencies(files, frozenset(r["term"] for r in needed.select("term").collect()) if small else None), "term")
    weight = (1 + F.log("m")) * (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1)
    squares = join_hot(words, by_term, "term").groupBy("sid").agg(F.sum(weight * weight).alias("square"))
    scored = distinct.join(squares, "sid", "left").select("sid", "segment", F.coalesce("square", F.lit(0.0)).alias("square"), "n")
    best = scored.mapInArrow(_best(shared, least), "sid binary, n long, score double, licence string")
    found = join_hot(each.select("uid", "sid"), best, "sid").groupBy("uid").agg(F.max(F.struct("score", F.translate("licence", _LETTERS, _LETTERS[::-1]).alias("back"), "licence")).alias("top"))
    return likely.join(found, "uid", "left").select("file_id", "path", F.col("top.licence").alias("licence"), F.col("top.score").alias("score"))


#: In order, to turn the order of names round.
_LETTERS = "-.0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def with_inherited(found: DataFrame) -> DataFrame:
    """file_id, path, licence, score, origin (own, inherited, none), from_dir."""
    folder = F.regexp_replace("path", F.lit("/?[^/]*$"), F.lit(""))
    rows = found.withColumns({"dir": folder, "named": F.regexp_like(F.regexp_extract("path", "[^/]*$", 0), F.lit(LICENCE_FILE))})
    votes = rows.where("licence IS NOT NULL").groupBy("dir", "licence").agg(F.count_if("named").alias("files"), F.count("*").alias("n"))
    best = F.min_by("licence", F.struct((-F.col("files")).alias("f"), (-F.col("n")).alias("n"), "licence"))
    declared = votes.groupBy("dir").agg(best.alias("dir_licence"))
    # directories and their ancestors: the root is the empty path
    dirs = rows.select("dir").distinct()
    steps = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(F.array_join(F.slice(steps, 1, k), "/").alias("dir"), k.alias("depth")))
    above = dirs.select(F.col("dir").alias("own"), F.explode(F.array_distinct(up)).alias("a")).select("own", F.col("a.dir").alias("dir"), F.col("a.depth").alias("depth"))
    nearest = above.join(declared, "dir").groupBy("own").agg(F.max_by(F.struct("dir", "dir_licence"), "depth").alias("near"))
    out = rows.join(nearest, F.coalesce(rows["dir"], F.lit("")) == nearest["own"], "left")
    inherits = F.col("licence").isNull() & F.col("near").isNotNull()
    return out.select(
        "file_id",
        "path",
        F.coalesce("licence", "near.dir_licence").alias("licence"),
        "score",
        F.when(F.col("licence").isNotNull(), "own").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(inherits, F.col("near.dir")).alias("from_dir"),
    )


def scan(files: DataFrame, forms: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """Own and inherited licences of each row of ``files`` (file_id, path, text).

    ``forms`` has the templates (``templates()``, if none are given).  Null and empty texts state nothing and may inherit; a null path is a file in the root directory.  Repeated rows each have a row.  Ties between
    a directory's licences go to the name that sorts first.  An empty table gives an empty result; other columns are not read.
    """
    own = text_batches(files).select(F.col("file_id").cast("long").alias("file_id"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"))
    return with_inherited(written(stated(own, forms, least), "licence-stated"))


def document_path() -> F.Column:
    """Where a document lies: its source, and two levels of folders by its number."""
    n = F.col("doc_id")
    return F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.concat(F.lit("d"), F.expr("doc_id div 2048")), F.concat(F.lit("s"), F.expr("doc_id div 64")), F.concat(n.cast("string"), F.lit(".txt")))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scan(docs.select(F.col("doc_id").alias("file_id"), document_path().alias("path"), "text"))
    return out.select(F.col("file_id").alias("doc_id"), "path", "licence", F.round("score", 6).alias("score"), "origin", "from_dir")
