"""License scans: sparse TF-IDF cosine of notices and licence files to templates, then inheritance from directories."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, n_words, short_batches

#: Licence identifiers and the wording of their usual notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
     "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
THRESHOLD, HEADER_LINES = 0.6, 25
#: Without file names, a licence file is a text of which notices of its licence are at least this share, whatever its length.
FILE_SHARE = 0.5
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying)s?([._-][^/]*)?$"
_HINT = re.compile(r"licen[cs]|copyright|public domain|redistribut|permission is hereby|\bcc0?\b", re.I)
_TOKEN = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")


class Matcher:
    """Cosines of a text to all templates over an inverted index of the templates' terms."""

    def __init__(self, templates=TEMPLATES):
        bags = [Counter(_TOKEN.findall(t.lower())) for _, t in templates]
        seen = Counter(w for b in bags for w in b)
        self.names = [n for n, _ in templates]
        self.idf = {w: math.log((1 + len(bags)) / (1 + c)) + 1 for w, c in seen.items()}
        self.unseen = math.log(1 + len(bags)) + 1
        self.sizes = sorted({b.total() for b in bags})
        self.terms: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, b in enumerate(bags):
            weights = {w: c * self.idf[w] for w, c in b.items()}
            norm = math.sqrt(sum(v * v for v in weights.values()))
            for w, v in weights.items():
                self.terms[w].append((k, v / norm))

    def best(self, text: str) -> tuple[float, str | None]:
        """The largest cosine and its licence; of equal ones the first template's."""
        bag = Counter(_TOKEN.findall(text.lower()))
        dots, norm = defaultdict(float), 0.0
        for w, c in bag.items():
            v = c * self.idf.get(w, self.unseen)
            norm += v * v
            for k, t in self.terms.get(w, ()):
                dots[k] += v * t
        if not dots:
            return 0.0, None
        k = min(dots, key=lambda k: (-dots[k], k))
        return dots[k] / math.sqrt(norm), self.names[k]

    def windows(self, text: str) -> tuple[list[str], list[tuple[float, str, int, int]]]:
        """The terms of a text, and (cosine, licence, from, to) of the windows near hints that reach the threshold.

        Windows are as long as the templates and slide term by term; their dot products and norms are kept up to date.
        """
        spots = [(x.start(), x.group()) for x in _TOKEN.finditer(text.lower())]
        starts, terms = [s for s, _ in spots], [t for _, t in spots]
        near: list[list[int]] = []
        for x in _HINT.finditer(text):
            at = max(0, bisect_right(starts, x.start()) - 1)
            low, high = max(0, at - self.sizes[-1]), min(len(terms), at + self.sizes[-1])
            if near and low <= near[-1][1]:
                near[-1][1] = high
            else:
                near.append([low, high])
        found = []
        for low, high in near:
            for size in self.sizes:
                bag, dots, norm = Counter(), defaultdict(float), 0.0
                for i in range(low, high):
                    for w, step in ((terms[i], 1), (terms[i - size], -1)) if i - size >= low else ((terms[i], 1),):
                        v = self.idf.get(w, self.unseen)
                        norm += v * v * ((bag[w] + step) ** 2 - bag[w] ** 2)
                        bag[w] += step
                        for k, t in self.terms.get(w, ()):
                            dots[k] += step * v * t
                    k = max(dots, key=lambda k: (dots[k], -k), default=None)
                    if k is not None and dots[k] > 0 and norm > 0 and dots[k] >= (THRESHOLD - 1e-9) * math.sqrt(norm):
                        a = max(low, i - size + 1)
                        score, name = self.best(" ".join(terms[a : i + 1]))
                        if score >= THRESHOLD:
                            found.append((score, name, a, i + 1))
        return terms, found

    def share(self, text: str, name: str) -> float:
        """The share of a text's terms that lie in windows of that licence; 1 if the whole text matches it."""
        score, whole = self.best(text)
        if whole == name and score >= THRESHOLD:
            return 1.0
        terms, found = self.windows(text)
        inside = np.zeros(len(terms), bool)
        for _, n, a, z in found:
            if n == name:
                inside[a:z] = True
        return float(inside.mean()) if len(terms) else 0.0

    def scan(self, text: str) -> tuple[float, str | None, bool]:
        """Best match over the lines with a hint, the header as one, and windows of the templates' lengths around all hints."""
        lines = text.split("\n")
        found = [x for x in lines if _HINT.search(x)]
        if not found:
            return 0.0, None, False
        units = found + ["\n".join(lines[:HEADER_LINES])] * (len(lines) > 1)
        scores = [self.best(u) for u in dict.fromkeys(units)] + [x[:2] for x in self.windows(text)[1]]
        score, name = max(scores, key=lambda x: (x[0], x[1] or ""))
        return score, name if score >= THRESHOLD else None, True


def notices(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, path, n_words, own_score, own_license, has_notice, share) of each whole text."""
    short_batches(docs.sparkSession)
    source = docs.select(
        F.col(id_col).alias("doc_id"), path.alias("path"), n_words(F.col(text_col)).alias("n_words"),
        F.coalesce(F.col(text_col), F.lit("")).alias("t"),
    )
    schema = T.StructType(
        [source.schema[c] for c in ("doc_id", "path", "n_words")]
        + [T.StructField("own_score", T.DoubleType()), T.StructField("own_license", T.StringType()), T.StructField("has_notice", T.BooleanType()), T.StructField("share", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher()
        for b in batches:
            texts = [t.as_py() for t in b.column(3)]
            got = [(*x, m.share(t, x[1]) if x[1] else 0.0) for t in texts for x in (m.scan(t),)]
            cols = list(zip(*got, strict=True)) or [(), (), (), ()]
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.float64(), pa.string(), pa.bool_(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *arrays], names=schema.names)

    return source.mapInArrow(run, schema)


def _parent(path: Column) -> Column:
    """The directory of a path; of a name without a slash, the root ''."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/+$", "")


def inherit(found: DataFrame, named: bool = True) -> DataFrame:
    """found with license, inherited_from and distance: a file without a notice takes its nearest ancestor's licence.

    Licence files state their directory's licence; they are known by name (LICENSE, COPYING), or where paths hold no file
    names, by the share of the text that matches, at any length: of several, the one with the best score, then the least path. Distinct
    directories are joined with their ancestors, so files are not multiplied by depth; a hot directory is one row on the
    small side. Null paths have no directory and inherit nothing.
    """
    found = found.withColumn("directory", _parent(F.col("path")))
    rank = F.struct((-F.col("own_score")).alias("s"), F.col("path").alias("p"), F.col("own_license").alias("l"))
    states = F.col("path").rlike(FILE_NAME) if named else F.col("share") >= FILE_SHARE
    stated = found.where(F.col("own_license").isNotNull() & states & F.col("directory").isNotNull())
    stated = stated.groupBy(F.col("directory").alias("ancestor")).agg(F.min(rank).alias("best")).select(
        "ancestor", F.col("best.l").alias("stated"), F.col("best.p").alias("stated_in")
    )
    dirs = found.where(F.col("directory").isNotNull()).select("directory").distinct()
    parts = F.split("directory", "/")
    depth = F.when(F.col("directory") == "", 0).otherwise(F.size(parts))
    up = dirs.select("directory", depth.alias("depth"), F.explode(F.sequence(F.lit(0), depth)).alias("d"))
    up = up.withColumn("ancestor", F.array_join(F.slice(parts, F.lit(1), F.col("d")), "/"))
    nearest = up.join(stated, "ancestor").groupBy("directory").agg(
        F.max_by(F.struct("stated", "stated_in", (F.col("depth") - F.col("d")).alias("distance")), "d").alias("near")
    )
    nearest = Scratch(found.sparkSession, "directories").keep(nearest)
    out = found.join(nearest, "directory", "left")
    mine = F.col("has_notice")
    return out.select(
        *[c for c in found.columns if c != "directory"],
        F.when(mine, F.coalesce("own_license", F.lit("unknown"))).otherwise(F.col("near.stated")).alias("license"),
        F.when(~mine, F.col("near.stated_in")).alias("inherited_from"),
        F.when(~mine, F.col("near.distance")).alias("distance"),
    )


def op10(docs: DataFrame) -> DataFrame:
    """Licences of all documents, laid out as source/lang/doc_id since the table has no paths.

    A null part of the path is the empty name. Null and empty texts have no notice and inherit; repeated rows give equal
    rows; an empty table gives none.
    """
    path = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang", "doc_id")])
    found = Scratch(docs.sparkSession, "licenses").keep(notices(docs, path))
    return inherit(found, named=False).select(
        "doc_id", "path", "own_license", F.round("own_score", 6).alias("own_score"), "license", "inherited_from", "distance"
    )
