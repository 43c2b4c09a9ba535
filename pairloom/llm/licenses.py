"""License texts in documents by diagonal voting.

All rolling word k-gram hashes of the documents are joined with the positions
of the same k-grams in the license templates. A place of a template in a
document gives votes on one diagonal (document position less template
position); inserted or missing words move the rest to a neighbouring one. Votes
are summed by diagonal, neighbouring diagonals are merged, and a merged span of
about the length of its template is verified: the longest chain of its places
that goes forward in both texts, an alignment within the merged diagonals, has
to cover enough of the template.

Documents are told apart by id and text: rows that share an id have their own
labels.
"""

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairloom.llm.frames import id_and_text, int_lists, mapped, tuned
from pairloom.llm.words import ALPHANUMERIC, column_bytes, hash_of, windows, word_hashes

K = 4
MAX_SHIFT = 3
MIN_COVER = 0.6
MAX_STRETCH = 1.5

# Phrases that name a license.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of public licenses and of common notices.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License, see the LICENSE file for details."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
    ),
    (
        "apache",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    (
        "bsd",
        "This software is provided by the copyright holders and contributors as is and any express or implied "
        "warranties, including, but not limited to, the implied warranties of merchantability and fitness for a "
        "particular purpose are disclaimed.",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at",
    ),
)


def words_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]), ALPHANUMERIC)[0]


def template_positions(spark: SparkSession, templates, k: int = K) -> DataFrame:
    """(gram, template, label, place, grams): a few rows for each word of the templates."""
    rows = []
    for number, (label, text) in enumerate(templates):
        grams = windows(words_of(text), k).view(np.int64).tolist()
        rows += [(g, number, label, place, len(grams)) for place, g in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, template int, label string, place long, grams long")


def _grams(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_key, gram, at): every rolling k-gram of every text."""

    def run(batch: pa.RecordBatch):
        hashes, counts = word_hashes(*column_bytes(batch.column(1)), ALPHANUMERIC)
        grams = windows(hashes, k)
        whole = np.ones(len(hashes), bool)
        ends = np.cumsum(counts)
        for back in range(1, k):
            at = ends - back
            whole[at[(at >= 0) & (counts >= back)]] = False
        whole = whole[: len(grams)]
        lists = int_lists(grams[whole].view(np.int64), np.maximum(counts - k + 1, 0))
        return {"doc_id": batch.column(0), "text_key": batch.column(2), "grams": lists}

    whole = mapped(docs.select("doc_id", "text", "text_key"), "doc_id long, text_key long, grams array<long>", run)
    return whole.select("doc_id", "text_key", F.posexplode("grams").alias("at", "gram"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))


def longest_chain(pairs: list[tuple[int, int]]) -> int:
    """Most of the pairs (at, place) that can be taken with both growing."""
    ends: list[int] = []
    for _, place in sorted(pairs, key=lambda p: (p[0], -p[1])):
        i = bisect_left(ends, place)
        ends[i : i + 1] = [place]
    return len(ends)


def in_order(diagonals: str) -> F.Column:
    """The longest chain of each list of (diagonal, places)."""

    @F.arrow_udf("long")
    def chains(column: pa.Array) -> pa.Array:
        pairs = ([(d["diagonal"] + place, place) for d in one or () for place in d["places"]] for one in column.to_pylist())
        return pa.array([longest_chain(p) for p in pairs], pa.int64())

    return chains(F.col(diagonals))


def license_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates=TEMPLATES,
    k: int = K,
    max_shift: int = MAX_SHIFT,
    min_cover: float = MIN_COVER,
) -> DataFrame:
    """(doc_id, text_key, template, label, first_word, end_word, cover): verified places of templates, in words from 0.

    ``text_key`` is the hash of the text: equal rows of one id have their spans
    once. Null and empty texts have none; a null id stays null.
    """
    spark = tuned(docs.sparkSession)
    docs = _keyed(docs, id_col, text_col).where("text IS NOT NULL")
    positions = template_positions(spark, templates, k)
    hits = _grams(docs, k).join(F.broadcast(positions), "gram")
    document = ["doc_id", "text_key"]
    votes = hits.groupBy(*document, "template", "label", "grams", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.min("at").alias("first"),
        F.max("at").alias("last"),
        F.collect_set("place").alias("places"),  # at most the grams of the template
    )
    along = Window.partitionBy(*document, "template").orderBy("diagonal", "first")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > max_shift
    island = F.sum(F.when(apart, 1).otherwise(0)).over(along)
    merged = (
        votes.withColumn("island", island)
        .groupBy(*document, "template", "label", "grams", "island")
        .agg(
            F.min("first").alias("first_word"),
            (F.max("last") + k).alias("end_word"),
            F.collect_list(F.struct("diagonal", "places")).alias("diagonals"),
        )
    )
    covered = F.size(F.array_distinct(F.flatten(F.col("diagonals.places"))))
    length = F.col("end_word") - F.col("first_word")
    likely = merged.where((covered >= min_cover * F.col("grams")) & (length <= MAX_STRETCH * (F.col("grams") + k - 1) + max_shift))
    verified = likely.withColumn("cover", in_order("diagonals") / F.col("grams")).where(F.col("cover") >= min_cover)
    return verified.select(*document, "template", "label", "first_word", "end_word", "cover")


def phrase_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES) -> DataFrame:
    """(doc_id, text_key, n_words, n_base, first_word, last_word, base_labels) of every document row."""
    tuned(docs.sparkSession)
    wanted = [([hash_of(w) for w in phrase.split()], label) for phrase, label in phrases.items()]

    def run(batch: pa.RecordBatch):
        hashes, counts = word_hashes(*column_bytes(batch.column(1)), ALPHANUMERIC)
        ends = np.cumsum(counts)
        owner_of = lambda at: np.searchsorted(ends, at, "right")
        places, owners, labels = [], [], []
        for words, label in wanted:
            n = len(hashes) - len(words) + 1
            ok = hashes[: max(n, 0)] == np.uint64(words[0])
            at = np.flatnonzero(ok)
            for step, w in enumerate(words[1:], 1):
                at = at[hashes[at + step] == np.uint64(w)]
            owner = owner_of(at)
            inside = at + len(words) <= ends[owner] if len(at) else np.zeros(0, bool)
            places.append(at[inside])
            owners.append(owner[inside])
            labels += [label] * int(inside.sum())
        place, owner = np.concatenate(places), np.concatenate(owners)
        rows = len(counts)
        n_base = np.bincount(owner, minlength=rows)
        first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
        place = place - (ends - counts)[owner] if len(place) else place
        np.minimum.at(first, owner, place)
        np.maximum.at(last, owner, place)
        named: dict[int, set] = {}
        for o, label in zip(owner.tolist(), labels):
            named.setdefault(o, set()).add(label)
        none = n_base == 0
        return {
            "doc_id": batch.column(0),
            "text_key": batch.column(2),
            "n_words": pa.array(counts, pa.int64()),
            "n_base": pa.array(n_base, pa.int64()),
            "first_word": pa.array(first, pa.int64(), mask=none),
            "last_word": pa.array(last, pa.int64(), mask=none),
            "base_labels": pa.array([",".join(sorted(named.get(i, ()))) for i in range(rows)]),
        }

    schema = "doc_id long, text_key long, n_words long, n_base long, first_word long, last_word long, base_labels string"
    return mapped(_keyed(docs, id_col, text_col), schema, run)


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row per document row: its phrases, its labels from phrases and templates, and a score.

    The score is the best cover of a template, raised half way to 1 where a
    phrase names a license, and 0 where nothing is found. Null and empty texts
    have no words. Rows that share an id are labelled by their own texts.
    """
    base = phrase_places(docs, id_col, text_col, phrases)
    found = license_spans(docs, id_col, text_col, templates).groupBy("doc_id", "text_key").agg(
        F.collect_set("label").alias("_found"), F.max("cover").alias("_cover")
    )
    named = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    every = F.array_sort(F.array_union(named, F.coalesce("_found", F.array().cast("array<string>"))))
    missing = 1 - F.least(F.lit(1.0), F.coalesce("_cover", F.lit(0.0)))
    found = found.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    return base.join(found, same, "left").select(
        *(c for c in base.columns if c != "text_key"),
        F.array_join(every, ",").alias("labels"),
        (1 - missing * F.when(F.col("n_base") > 0, 0.5).otherwise(1.0)).alias("score"),
    )
