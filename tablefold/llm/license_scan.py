"""License scan by diagonal voting.

Every run of consecutive words of every text is joined, by hash, to its
positions in the license templates: runs of two words for phrases, of ``k`` for
the others. A match at text word p and template word t votes for the diagonal
p - t. Votes are counted for each diagonal, and neighbouring diagonals are
merged (a word more or less in the text moves the rest of the passage to the
next diagonal).

A merged span is then verified word by word, not by its number of votes: its
matches are followed in text order, each one counts only if it goes on in the
template beyond all before it, and the match of a template's first run begins
anew. Equal hashes of 64 bits mean equal words, so the matches followed say
which of the template's words stand in the text in their order; a span counts
if these are ``min_share`` of the template's words, with no more other words
among them than ``extra`` of its length.

Null and empty texts have no words and no labels. A row is one document:
repeated rows give repeated results, equal spans of one text are all given, and
extra columns of the input are ignored, whatever their names. A text of any
length is one document; an empty table gives an empty result. Of phrases that
overlap each is counted.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .shipping import checkpointed

#: Short phrases that are reported wherever their words stand (fixed values).
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Lines by which a license is named, in words of the scan.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "released under the mit license": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this work is licensed under the gnu general public license": "gpl",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "copyright all rights reserved no part of this publication may be reproduced": "reserved",
}

#: Whole license texts and standard headers, as published (fixed values); the scan takes their words.
TEXTS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
    (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
    distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
    following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
    Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
    MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
    CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
    SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
    are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
    the above copyright notice and this permission notice appear in all copies.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
    You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
    software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
    implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
    by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the
    hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
    See the GNU General Public License for more details.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
    this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
    sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
    any means.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
    arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
    and to alter it and redistribute it freely, subject to the following restrictions""",
}


def words_of(text: str) -> list[str]:
    """A template's words, as the scan splits them."""
    return re.findall("[0-9a-z]+", text.lower())


TEMPLATES = NOTICES | {" ".join(words_of(t)): label for label, t in TEXTS.items()}

_EMITTED = "uid long, doc_id long, n_words int, pos int, gram long"
PHRASE_RUN = 2


def gram_table(spark: SparkSession, templates: dict[str, tuple[str, bool]], k: int) -> DataFrame:
    """(gram, template, tpos, n_grams, size, label, is_base) for each run of words of each template; its rows are the templates' words."""
    rows = []
    for number, (text, (label, base)) in enumerate(templates.items()):
        words = tk.Texts(pa.array([text]), tk.alnum_classes(), tk.folded())
        grams = _runs(words, words.hashes(), PHRASE_RUN if base else k)
        if not len(grams[0]):
            raise ValueError(f"template {text!r} has too few words")
        rows += [(int(g), number, int(s), len(grams[0]), len(words.starts), label, base) for s, g in zip(grams[0], tk.as_long(grams[1]))]
    return spark.createDataFrame(rows, "gram long, template int, tpos int, n_grams int, size int, label string, is_base boolean")


def _runs(words: tk.Texts, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words and hashes of runs of k words; runs of another length have other hashes."""
    starts, grams = words.grams(hashes, k)
    return starts, tk.mix64(grams + np.uint64(k))


def _emit(k: int):
    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in tk.steps(batches, "text"):
            words = tk.Texts(tk.column(batch, "text"), tk.alnum_classes(), tk.folded())
            hashes = words.hashes()
            starts, grams = (np.concatenate(x) for x in zip(*(_runs(words, hashes, length) for length in {PHRASE_RUN, k})))
            counts, n = words.counts, batch.num_rows
            doc = np.searchsorted(words.first, starts, "right") - 1
            uids = uid + np.arange(n)
            uid += n
            ids = tk.column(batch, "doc_id")
            # a row for the document itself, with no gram, and one for each run
            take = pa.array(np.concatenate([np.arange(n), doc]))
            nulls = np.concatenate([np.ones(n, bool), np.zeros(len(doc), bool)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([uids, uids[doc]])),
                    ids.take(take),
                    pa.array(np.concatenate([counts, np.zeros(len(doc), np.int64)]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(n, np.int64), starts - words.first[doc]]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(n, np.int64), tk.as_long(grams)]), mask=nulls),
                ],
                names=["uid", "doc_id", "n_words", "pos", "gram"],
            )

    return run


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    phrases: dict[str, str] = BASE_PHRASES,
    k: int = 3,
    drift: int = 2,
    gap: int = 12,
    min_share: float = 0.8,
    extra: float = 0.3,
) -> DataFrame:
    """One row per document with the spans of its license passages.

    Diagonals up to ``drift`` apart merge while the text between their matches
    is at most ``gap`` words. A span counts if it holds ``min_share`` of the
    template's words in their order, among no more other words than ``extra`` of
    the template's; a phrase counts at each place where it stands whole.
    Returns doc_id, n_words, base (array of start, label) and
    spans (array of start, end, label, share).
    """
    spark = docs.sparkSession
    named = {t: (label, False) for t, label in templates.items()} | {t: (label, True) for t, label in phrases.items()}
    table = gram_table(spark, named, k)  # a row a word of the templates, which are fixed: safe to broadcast
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_emit(k), _EMITTED)
    hit = F.struct("pos", "tpos")
    votes = (
        runs.join(F.broadcast(table), "gram", "left")
        .where(F.col("template").isNotNull() | F.col("gram").isNull())
        .groupBy("uid", "doc_id", "template", "label", "is_base", "n_grams", "size", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .agg(
            F.max("n_words").alias("n_words"),
            F.count("gram").alias("hits"),
            F.min("pos").alias("start"),
            F.max("pos").alias("last"),
            F.collect_list(F.when(F.col("gram").isNotNull() & ~F.col("is_base"), hit)).alias("matches"),  # no more than the template has words
        )
    )
    # neighbouring diagonals of a document and template
    by = Window.partitionBy("uid", "doc_id", "template").orderBy("diagonal")
    between = F.greatest("start", F.lag("start").over(by)) - F.least("last", F.lag("last").over(by))
    apart = F.col("is_base") | F.lag("last").over(by).isNull() | (F.col("diagonal") - F.lag("diagonal").over(by) > drift) | (between > gap + k)
    whose = ["uid", "doc_id", "template", "label", "is_base", "size", "span"]
    merged = checkpointed(votes.withColumn("span", F.sum(F.when(apart, 1).otherwise(0)).over(by)))  # a row a document, and the matches
    # matches in text order: the template's first run begins a chain, and in a chain each goes on in the template
    chains = Window.partitionBy(*whose, "chain")
    inside = chains.orderBy("pos", "tpos")
    followed = (
        merged.where("NOT is_base")
        .select(*whose, F.explode("matches").alias("m"))
        .select(*whose, "m.*")
        .withColumn("chain", F.sum(F.when(F.col("tpos") == 0, 1).otherwise(0)).over(Window.partitionBy(*whose).orderBy("pos", "tpos")))
        .withColumn("beyond", F.max("tpos").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
        .where(F.col("beyond").isNull() | (F.col("tpos") > F.col("beyond")))
        .groupBy(*whose, "chain")
        .agg(F.sum(F.least(F.lit(k), F.col("tpos") - F.coalesce("beyond", F.lit(-k)))).alias("held"), F.min("pos").alias("start"), (F.max("pos") + k).alias("end"))
        .withColumn("share", F.col("held") / F.col("size"))
        .where((F.col("share") >= min_share) & (F.col("end") - F.col("start") - F.col("held") <= F.col("size") * extra))
    )
    base = F.when(F.col("is_base") & (F.col("hits") == F.col("n_grams")), F.struct("start", "label"))
    phrases_at = merged.groupBy("uid", "doc_id").agg(F.max("n_words").cast("long").alias("n_words"), F.sort_array(F.collect_list(base)).alias("base"))
    spans = followed.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "share"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,label:string,share:double>>)")
    return phrases_at.join(spans, "uid", "left").select("doc_id", "n_words", "base", F.coalesce("spans", none).alias("spans"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_licenses(docs)
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"),
        F.array_max("base.start").cast("long").alias("last_word"),
        labels(F.col("base.label")).alias("base_labels"),
        labels(F.concat("base.label", "spans.label")).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"),
    )
