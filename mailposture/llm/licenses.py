"""Licences of files: notices compared with templates, and inheritance from the nearest licence file up the directories.

A notice is a line or a paragraph that names a licence matter.  It and the templates are sparse TF-IDF vectors over words and word pairs; terms that occur in
templates are weighted by the number of documents that have them, counted over all documents, all other terms as if they were in one.  A file has the licence of its closest notice
if the cosine reaches the bound.  A file without a notice takes the licence of the nearest directory above it that has a licence file: directories, not files, are
joined with their ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailposture.llm.blocks import tidy
from mailposture.session import store

#: Notices as they are commonly written.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("proprietary", "All rights reserved."),
]
#: A notice names one of these.
MATTER = re.compile(r"(?i)licen[sc]|copyright|permission|redistribution|rights reserved|public domain")
#: Least cosine.
BOUND = 0.6

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def terms(text: str) -> Counter[str]:
    words = _WORD.findall(text.lower())
    return Counter([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])


def vocabulary() -> list[str]:
    return sorted({t for _, text in TEMPLATES for t in terms(text)})


def notices(text: str | None) -> list[str]:
    """Lines and paragraphs of a text that name a licence matter."""
    if not text or not MATTER.search(text):
        return []
    out: dict[str, None] = {}
    for paragraph in re.split(r"\n\s*\n", text):
        if MATTER.search(paragraph):
            lines = paragraph.split("\n")
            for k, line in enumerate(lines):
                if MATTER.search(line):
                    out[line] = None
                    out["\n".join(lines[k : k + 4])] = None
    return list(out)


class Matcher:
    """Closest template by cosine of TF-IDF vectors."""

    def __init__(self, n_docs: int, frequency: dict[str, int]):
        self.rare = math.log((n_docs + 1) / 2) + 1
        self.idf = {t: math.log((n_docs + 1) / (frequency.get(t, 0) + 1)) + 1 for t in vocabulary()}
        self.templates = [(name, self.vector(text)) for name, text in TEMPLATES]
        self.cache: dict[str, tuple[float, str]] = {}

    def vector(self, text: str) -> dict[str, float]:
        raw = {t: (1 + math.log(n)) * self.idf.get(t, self.rare) for t, n in terms(text).items()}
        norm = math.sqrt(sum(v * v for v in raw.values())) or 1.0
        return {t: v / norm for t, v in raw.items()}

    def closest(self, notice: str) -> tuple[float, str]:
        """(cosine, licence); of equal cosines the first licence by name."""
        if (known := self.cache.get(notice)) is not None:
            return known
        vector = self.vector(notice)
        best = min((-sum(v * vector[t] for t, v in template.items() if t in vector), name) for name, template in self.templates)
        if len(self.cache) > 50_000:
            self.cache.clear()
        self.cache[notice] = (-best[0], best[1])
        return self.cache[notice]


@tidy
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, found, n = set(vocabulary()), Counter(), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            n += 1
            words = _WORD.findall((text or "").lower())
            mine = known.intersection(words)
            if len(mine) > 1:
                mine |= known.intersection(f"{a} {b}" for a, b in zip(words, words[1:]) if a in mine and b in mine)
            found.update(mine)
    found[""] = n
    yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], ["term", "n"])


def matcher(df: DataFrame, text_col: str = "text") -> Matcher:
    """Counts documents by term of the templates (a fixed vocabulary) over all of ``df``."""
    counted = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_frequencies, "term string, n bigint")
    counts = {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return Matcher(counts.pop("", 0), counts)


@tidy
def _matched(batches: Iterator[pa.RecordBatch], match: Matcher, bound: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, cosines = [], []
        for text in batch.column(2).to_pylist():
            cosine, name = min(((-c, n) for c, n in map(match.closest, notices(text))), default=(0.0, None))
            names.append(name if -cosine >= bound else None)
            cosines.append(-cosine if -cosine >= bound else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(cosines, pa.float64())], ["id", "path", "own", "cosine"])


def scan(df: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", bound: float = BOUND) -> DataFrame:
    """(id, path, license, cosine, origin) of every row: ``origin`` is notice, inherited or none.

    A file named LICENSE or COPYING (with any ending) that has a licence lends it to its directory and to all below that have no nearer one; of several in a directory the closest to
    its template counts, then the first name.  Null texts have no notice; rows without a path inherit nothing.  Repeated rows stay.
    """
    match = matcher(df, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    own = store(rows.mapInArrow(lambda b: _matched(b, match, bound), f"id {kind}, path string, own string, cosine double"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    filed = own.withColumn("folder", folder)
    is_file = F.regexp_extract("path", r"([^/]*)$", 1).rlike(r"(?i)^(licen[sc]e|copying)(\.[a-z]+)?$")
    lent = filed.filter(is_file & F.col("own").isNotNull()).groupBy("folder").agg(F.min_by("own", F.struct((-F.col("cosine")).alias("c"), "own")).alias("lent"))
    lent = lent.select(F.col("folder").alias("ancestor"), "lent")
    needed = filed.filter(F.col("own").isNull() & F.col("path").isNotNull()).select("folder").distinct()
    depth = F.size(F.split("folder", "/"))
    upward = needed.select("folder", F.explode(F.sequence(F.lit(0), depth)).alias("depth"))
    upward = upward.withColumn("ancestor", F.expr("array_join(slice(split(folder, '/'), 1, depth), '/')"))
    nearest = store(upward.join(lent, "ancestor").groupBy("folder").agg(F.max_by("lent", "depth").alias("lent")))
    joined = filed.join(nearest, "folder", "left")
    origin = F.when(F.col("own").isNotNull(), "notice").when(F.col("path").isNotNull() & F.col("lent").isNotNull(), "inherited").otherwise("none")
    license_ = F.coalesce("own", F.when(F.col("path").isNotNull(), F.col("lent")))
    return joined.select(F.col("id").alias(id_col), F.col("path").alias(path_col), license_.alias("license"), "cosine", origin.alias("origin"))
