"""License scans by diagonal voting.

All rolling k-grams of words of the texts are joined to the positions where the license templates hold
them. A hit votes for the diagonal (position in the text less that in the template) on which a copy of
the template would lie; diagonals that are close merge, as a word more or less shifts the rest; and
what they span is verified word by word against the template.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vec
from .store import Scratch

#: Notices by which texts state their license, and the openings of the common license texts.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
#: Template k-grams up to this many bytes are also sent to the tasks, to leave out texts that hold none.
SENT_BYTES = 64 << 20


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """``(license, text)`` of the notices above, or of ``texts``."""
    return spark.createDataFrame(list((TEMPLATES if texts is None else texts).items()), "license string, text string")


def templates_of_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``(license, text)`` of a folder of license files, whole, each named by its license (an ending .txt is left out)."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1)
    return spark.read.text(folder, wholetext=True).select(F.url_decode(name).alias("license"), F.col("value").alias("text"))


def common_subsequence(a: list[int], b: list[int]) -> int:
    """The length of the longest common subsequence, by bit-parallel rows."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        u = row & at.get(y, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def find_licenses(docs: DataFrame, known: DataFrame, k: int = 3, gap: int = 3, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, license, first_word, n_words, votes, similarity)``, one row per copy of a template in a text.

    ``known`` has ``(license, text)``. The k-gram hashes of texts are joined to template positions in
    Spark; where the templates' hashes fit SENT_BYTES, texts that hold none of them are left out before the join,
    which changes nothing. Diagonals of at most ``gap`` words apart merge. A merged span is
    extended to the template's length and verified: its longest common subsequence with the
    template, in words, must be at least ``similarity`` of the template's. ``first_word`` and ``n_words`` give the
    span in words; ``votes`` the distinct template positions hit.

    Ids may be of any type that can be grouped by, text included. Rows with a null id, which is no key, and null or empty texts have no result. Templates of
    fewer than k words, or null, match nothing. Repeated rows (the same id and text) give one result; each
    copy within a text gives one. Of templates that match overlapping words the one of most words in common is
    reported, of these the most similar, or all that tie: so a whole license goes before the line that it begins with.
    Very long texts are taken whole. Empty tables give an empty result; other columns are never read.
    """
    spark = docs.sparkSession
    s = Scratch(spark, "licenses")

    def hashed(id_kind: str, known_hashes=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent = known_hashes.value if known_hashes is not None else None
            if sent is not None:
                bits = np.zeros(1 << 20, bool)
                bits[(sent >> vec.U(44)).astype(np.int64)] = True
            for batch in batches:
                for a, b in vec.slices(vec.as_strings(batch.column(1))):
                    part = batch.slice(a, b - a)
                    w = vec.words(part.column(1))
                    h, first = vec.kgrams(w.hash, w.first, k)
                    keep = np.diff(first) > 0
                    if sent is not None:
                        at = np.flatnonzero(bits[(h >> vec.U(44)).astype(np.int64)])
                        at = at[np.isin(h[at], sent)]
                        keep = np.zeros(len(first) - 1, bool)
                        keep[np.searchsorted(first, at, side="right") - 1] = True
                    if keep.any():
                        cols = [part.column(0), vec.lists(w.hash.view(np.int64), w.first, pa.int64()), vec.lists(h.view(np.int64), first, pa.int64())]
                        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in cols], names=["id", "words", "grams"])

        return run, f"id {id_kind}, words array<long>, grams array<long>"

    model = s.keep(known.where("license IS NOT NULL").select("license", "text").mapInArrow(*hashed("string")), "templates")
    places = model.select(F.col("id").alias("license"), F.size("words").alias("t_words"), F.posexplode("grams").alias("t_pos", "gram"))
    sent = None
    if 8 * places.count() <= SENT_BYTES:
        sent = spark.sparkContext.broadcast(np.unique(places.select("gram").distinct().toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)))
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.where(F.col(doc_id).isNotNull()).select(doc_id, text).mapInArrow(*hashed(kind, sent))
    texts = s.keep(texts.withColumn("version", F.xxhash64("words")), "texts")

    key = ["doc_id", "version", "license"]
    grams = texts.select(F.col("id").alias("doc_id"), "version", F.posexplode("grams").alias("pos", "gram")).distinct()
    votes = grams.join(places, "gram").groupBy(*key, (F.col("pos") - F.col("t_pos")).alias("diagonal"), "t_words").agg(F.collect_set("t_pos").alias("hit"))
    along = Window.partitionBy(*key).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > gap, F.lit(True)).cast("int")
    merged = (
        votes.withColumn("apart", apart)
        .withColumn("span", F.sum("apart").over(along))
        .groupBy(*key, "t_words", "span")
        .agg(F.min("diagonal").alias("lo"), F.max("diagonal").alias("hi"), F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("votes"))
    )
    # Every span is verified: words between those of the template spoil k-grams without making it less similar, so votes give no bound.
    inside = texts.select(F.col("id").alias("doc_id"), "version", "words").dropDuplicates(["doc_id", "version"])
    pairs = merged.join(inside, ["doc_id", "version"]).join(model.select(F.col("id").alias("license"), F.col("words").alias("template")), "license")
    lo = F.greatest(F.lit(0), F.col("lo"))
    pairs = pairs.select("doc_id", "license", lo.cast("int").alias("first_word"), F.expr("slice(words, cast(greatest(0, lo) as int) + 1, greatest(1, cast(hi - greatest(0, lo) as int) + t_words))").alias("words"), "template", F.col("votes").cast("int"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for r, (lic, first, words, template, n) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                same = common_subsequence(template, words)
                if same >= similarity * len(template) - 1e-9:
                    # the span proper: without words before and after that the template doesn't have
                    have = set(template)
                    hits = [i for i, x in enumerate(words) if x in have]
                    at.append(r)
                    rows.append((lic, first + hits[0], hits[-1] - hits[0] + 1, n, round(same / len(template), 6), same))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(cols, kinds))], names=["doc_id", "license", "first_word", "n_words", "votes", "similarity", "same"])

    spans = s.keep(pairs.mapInArrow(verify, f"doc_id {kind}, license string, first_word int, n_words int, votes int, similarity double, same int").distinct(), "spans")
    s.drop("texts", "templates")
    x, y = spans.alias("x"), spans.alias("y")
    overlap = (F.col("x.first_word") < F.col("y.first_word") + F.col("y.n_words")) & (F.col("y.first_word") < F.col("x.first_word") + F.col("x.n_words"))
    better = F.struct("y.same", "y.similarity") > F.struct("x.same", "x.similarity")
    return x.join(y, (F.col("x.doc_id") == F.col("y.doc_id")) & overlap & better, "left_anti").drop("same")
