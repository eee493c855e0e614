"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory with a licence file."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm import text as tx
from stratalog.llm.shared import Workspace

#: Header statements by licence; fixed values, in the licences' own usual words. Whole notices stand after the short statements.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
}
#: What the GNU AGPL has in place of its sister's section 13, and CC BY-NC beside CC BY.
NETWORK = """
Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer
all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity
to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server
at no charge, through some standard or customary means of facilitating copying of software. """
NONCOMMERCIAL = """
NonCommercial means not primarily intended for or directed towards commercial advantage or monetary compensation. reproduce
and Share the Licensed Material, in whole or in part, for NonCommercial purposes only; and produce, reproduce, and Share
Adapted Material for NonCommercial purposes only. """


def licence_bodies() -> dict[str, list[str]]:
    """Whole licence texts by licence, from the folder beside this file.

    No copy of the AGPL, CC BY and CC BY-NC was at hand: they are made of their sisters' texts by the passages in which
    they differ, which sets them apart from those but is not their wording throughout.
    """
    bodies = {p.stem: p.read_text("utf-8") for p in sorted((Path(__file__).parent / "licence_bodies").glob("*.txt"))}
    affero = re.sub(r"(?i)\b(GNU )(?=General Public License)", r"\1Affero ", bodies["GPL-3.0"])
    bodies["AGPL-3.0"] = affero + NETWORK
    passages = re.split(r"\n\s*\n", re.sub(r"Attribution-ShareAlike", "Attribution", bodies["CC-BY-SA-4.0"]))
    by = "\n\n".join(p for p in passages if not re.search(r"BY-SA|Share ?Alike|Adapter's License", p))
    bodies["CC-BY-4.0"] = by
    bodies["CC-BY-NC-4.0"] = re.sub(r"(?<=Attribution)(?= 4\.0)", "-NonCommercial", by) + NONCOMMERCIAL
    return {name: [text] for name, text in bodies.items()}


#: A line that begins so (after white space) is a comment; a block between the first pair of bytes may go on without marks.
COMMENT = np.isin(np.arange(256), np.frombuffer(b"#/*;%", np.uint8))
#: A line is a licence header from this cosine on; a text whose lines are headers for this share of words is a licence file.
LEAST_COSINE, LEAST_SHARE = 0.75, 0.5
SALTS = 16


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, line and hash of each word, and the row of each line; lines end at line feeds and at rows."""
    low = tx.LOWER[data]
    start, end, row = tx.split_words(low, offsets, tx.ALNUM)
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    line = feeds[start] + row
    return row, line, tx.hash_spans(low, start, end), feeds


def _document_counts(vocabulary, text: str):
    """In how many texts each word of the vocabulary occurs, and how many texts there are (word -1), summed by partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = vocabulary.value, 0
        counts = np.zeros(len(words), np.int64)
        for batch in batches:
            data, offsets = tx.column_bytes(batch.column(text))
            n += len(offsets) - 1
            for low, high in tx.pieces(offsets):
                row, _, hashes, _ = _words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                place, known = _places(words, hashes)
                once = np.unique(row[known].astype(np.int64) * len(words) + place[known])
                counts += np.bincount(once % len(words), minlength=len(words))
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(counts[there], n))], ["word", "n"])

    return run


def _places(vocabulary: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each word in the vocabulary, and whether it is there."""
    place = np.searchsorted(vocabulary, hashes)
    place[place == len(vocabulary)] = 0
    return place, vocabulary[place] == hashes


def template_words(*templates: dict[str, list[str]]) -> np.ndarray:
    data, offsets = tx.column_bytes(pa.array([t for named in templates for texts in named.values() for t in texts], pa.string()))
    return np.unique(_words(data, offsets)[2])


class Templates:
    """Templates as sparse unit vectors over their words, weighted by in how many of the corpus's texts a word occurs.

    A word that no template has counts as one of no text: it only adds to a vector's length.
    """

    def __init__(self, vocabulary: np.ndarray, counts: np.ndarray, n_docs: int, templates: dict[str, list[str]]) -> None:
        self.vocabulary, self.other = vocabulary, np.log(n_docs + 1) + 1
        self.idf = np.log((n_docs + 1) / (counts + 1)) + 1
        self.names = [name for name, texts in templates.items() for _ in texts]
        data, offsets = tx.column_bytes(pa.array([t for texts in templates.values() for t in texts], pa.string()))
        row, _, hashes, _ = _words(data, offsets)
        weights = np.zeros((len(vocabulary), len(self.names)))
        np.add.at(weights, (_places(vocabulary, hashes)[0], row), 1.0)
        weights = np.where(weights > 0, 1 + np.log(np.maximum(weights, 1)), 0) * self.idf[:, None]
        self.weights = weights / np.sqrt((weights**2).sum(0))

    def cosines(self, at: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Best template and cosine of each of ``n`` units; ``at`` is the unit of each word."""
        order = np.lexsort((hashes, at))
        a, h = at[order], hashes[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (h[1:] != h[:-1])])
        firsts = np.flatnonzero(new)
        tf = np.diff(np.append(firsts, len(a)))
        a, h = a[firsts], h[firsts]
        place, known = _places(self.vocabulary, h)
        weight = (1 + np.log(tf)) * np.where(known, self.idf[place], self.other)
        norm = np.sqrt(np.bincount(a, weights=weight**2, minlength=n))
        a, weight, place = a[known], weight[known], place[known]
        cosine = np.zeros((n, len(self.names)))
        for k in range(len(self.names)):
            cosine[:, k] = np.bincount(a, weights=weight * self.weights[place, k], minlength=n)
        cosine /= norm[:, None]
        best = cosine.argmax(1)
        return best, cosine[np.arange(n), best]


def _blocks(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, line: np.ndarray, feeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paragraph and comment of each line with words, given by row and number; comments are negative where there is none.

    A paragraph ends at a line without words and where comment marks begin or end; a comment goes on over such lines.
    """
    starts = np.sort(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    numbers = feeds[starts] + np.searchsorted(offsets[1:], starts, "right")
    begin = starts[np.searchsorted(numbers, line)]
    shown = np.flatnonzero(tx.NOT_SPACE[data])
    first = shown[np.searchsorted(shown, begin)]
    after = np.minimum(first + 1, len(data) - 1)
    flag = COMMENT[data[first]] | ((data[first] == 45) & (data[after] == 45)) | ((data[first] == 60) & (data[after] == 33))
    opens = ((data[first] == 47) & (data[after] == 42)) | ((data[first] == 60) & (data[after] == 33))
    other = row[1:] != row[:-1]
    turned = (flag[1:] != flag[:-1]) & ~(opens[:-1] & ~flag[1:])
    paragraph = np.cumsum(np.concatenate([[0], other | turned | (line[1:] != line[:-1] + 1)]))
    comment = np.cumsum(np.concatenate([[0], other | (flag[1:] != flag[:-1])]))
    return paragraph, np.where(flag, comment, -1)


def _scan(model, text: str, kept: list[str], least: float, share: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        headers, bodies = model.value
        for batch in batches:
            data, offsets = tx.column_bytes(batch.column(text))
            for low, high in tx.pieces(offsets):
                n = high - low
                names, top, file = _judge(headers, bodies, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], least, share)
                part = batch.slice(low, n)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in kept), pa.array(names, pa.string()), pa.array(np.round(top, 6)), pa.array(file)],
                    [*kept, "own_license", "cosine", "license_file"],
                )

    return run


def _judge(headers: Templates, bodies: Templates, data: np.ndarray, offsets: np.ndarray, least: float, share: float) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """License, highest cosine and licence-file flag of each text of a piece."""
    n = len(offsets) - 1
    top, names, file = np.zeros(n), [None] * n, np.zeros(n, bool)
    row, line, hashes, feeds = _words(data, offsets)
    if not len(row):
        return names, top, file
    lines, first, at, words = np.unique(line, return_index=True, return_inverse=True, return_counts=True)
    of = row[first]
    covered = np.zeros(len(lines), bool)

    def take(templates: Templates, rows: np.ndarray, best: np.ndarray, cosine: np.ndarray) -> None:
        before = top.copy()
        np.maximum.at(top, rows, cosine)
        for k in np.flatnonzero((cosine >= least) & (cosine == top[rows]) & (cosine > before[rows]))[::-1].tolist():
            names[rows[k]] = templates.names[best[k]]

    best, cosine = headers.cosines(at, hashes, len(lines))
    covered |= cosine >= least
    take(headers, of, best, cosine)
    for block in _blocks(data, offsets, of, lines, feeds):
        ids, back, size = np.unique(block, return_inverse=True, return_counts=True)
        several = (ids >= 0) & (size > 1)
        if not several.any():
            continue
        number = np.cumsum(several) - 1
        inside = several[back]
        rows = np.zeros(several.sum(), np.int64)
        rows[number[back[inside]]] = of[inside]
        among = inside[at]
        for templates in (headers, bodies):
            best, cosine = templates.cosines(number[back[at[among]]], hashes[among], len(rows))
            passed = np.flatnonzero(cosine >= least)
            covered[inside] |= (cosine >= least)[number[back[inside]]]
            take(templates, rows[passed], best[passed], cosine[passed])
    total = np.bincount(of, weights=words, minlength=n)
    file = np.bincount(of[covered], weights=words[covered], minlength=n) >= share * np.maximum(1, total)
    there, unit = np.unique(row, return_inverse=True)
    best, cosine = bodies.cosines(unit, hashes, len(there))
    for k in np.flatnonzero(cosine >= least).tolist():
        names[there[k]], top[there[k]], file[there[k]] = bodies.names[best[k]], cosine[k], True
    return names, top, file


def scan_licenses(
    docs: DataFrame,
    space: Workspace,
    path: str = "path",
    text: str = "text",
    key: str = "doc_id",
    templates: dict[str, list[str]] | None = None,
    least: float = LEAST_COSINE,
    share: float = LEAST_SHARE,
    bodies: dict[str, list[str]] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: key, path, own_license, cosine, license_file, license, inherited_from.

    Every line of the whole text is compared, as a sparse TF-IDF vector with document counts over the whole corpus, to
    every template (words that no template has weigh as much as one that no document has); the best line of cosine ``least`` or more names the text's own license (the first of equals, in text and
    template order). Paragraphs and comments of several lines are compared as wholes too, to the header statements and to
    the whole licences in ``bodies`` (default ``licence_bodies``), and name the license where they have a higher cosine.
    A text whose header lines and blocks hold ``share`` of its words is a licence file and speaks for its directory; so is
    one that as a whole has cosine ``least`` to a whole licence, which then names it, whatever its lines say;
    of several in one directory, that of highest cosine, then smallest key, does. A text without a license of its own
    inherits that of the nearest directory at or above its own.

    A line or text of any length is compared whole. A null path has no directory and inherits nothing; null and empty texts have no license of their own. Rows are kept
    one to one; extra columns are ignored; an empty table gives no rows.

    Plan: two scans (counts, then cosines), no text is shuffled. Directories are narrow rows: each distinct one looks up
    its ancestors once, and files meet their directory in a salted join, as one may hold a third of them.
    """
    base = docs.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(text).alias("text"))
    named = [templates or TEMPLATES, licence_bodies() if bodies is None else bodies]
    words = template_words(*named)
    context = space.spark.sparkContext
    parts = base.select("text").mapInArrow(_document_counts(context.broadcast(words), "text"), "word long, n long")
    # A row for each word of the templates, whatever the corpus.
    found = {r["word"]: r["n"] for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    counts = np.array([found.get(k, 0) for k in range(len(words))], np.int64)
    model = context.broadcast([Templates(words, counts, found.get(-1, 0), t) for t in named])
    fields = [base.schema["key"], base.schema["path"], T.StructField("own_license", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("license_file", T.BooleanType())]
    found = base.mapInArrow(_scan(model, "text", ["key", "path"], least, share), T.StructType(fields))
    found = space.write(found.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")), "found")
    speaks = found.where("license_file AND own_license IS NOT NULL AND path IS NOT NULL").groupBy("dir")
    speaks = speaks.agg(F.max_by("own_license", F.struct("cosine", -F.col("key"))).alias("dir_license"))
    levels = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(levels)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(levels, 1, n), "/").alias("ancestor")))
    dirs = found.where("path IS NOT NULL").select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.ancestor")
    nearest = dirs.join(speaks.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir")
    nearest = nearest.agg(F.max_by(F.struct("dir_license", "ancestor"), "depth").alias("best"))
    salted = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = found.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["dir", "salt"], "left")
    return met.select(
        F.col("key").alias(key),
        "path",
        "own_license",
        "cosine",
        "license_file",
        F.coalesce("own_license", "best.dir_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("best.ancestor")).alias("inherited_from"),
    )
