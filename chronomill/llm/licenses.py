"""License scans: diagonal voting of word k-grams against templates, then verification of the spans."""

from __future__ import annotations

import pyarrow as pa
import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import narrowed, slices, stored, text_or_empty
from .words import WordHashes, rolling, words_of

K = 3

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Template texts of public licenses, as notices spell them.
TEMPLATES = {
    "mit-line": "Released under the MIT License",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-line": "Licensed under the Apache License, Version 2.0",
    "apache": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0",
    "cc-by-line": "Licensed under CC BY 4.0",
    "cc-attribution": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "reserved-line": "Copyright. All rights reserved",
}


def vote_rule(size: int, k: int = K, least: float = 0.8) -> tuple[int, int]:
    """Width of the grams that vote for a template of `size` words, and the votes a span needs: one or two.

    A span that verification accepts may lack a share 1 - `least` of the words; each kills up to
    `width` grams, and words put in at one place kill width - 1. Widths go from `k` down to 2 until a vote is sure to be left.
    """
    lacking = int((1 - least) * size + 1e-9)
    for width in range(k, 1, -1):
        left = size - width + 1 - width * lacking - (width - 1)
        if left >= 1:
            break
    return min(width, size), min(2, max(1, left))


#: The one gram of width 0 of every document.
_END = -1


def phrase_rows(phrases: dict[str, str]) -> list[tuple]:
    """Like template_rows: a phrase is one gram as wide as itself, so that its one vote is all its words in a row."""
    rows, hashes = [], WordHashes()
    for phrase in phrases:
        words = phrase.encode().split()
        rows.append((int(rolling(hashes.of(words), len(words)).view(np.int64)[0]), phrase, 0, len(words), len(words), 1, 0))
    return rows


def template_rows(templates: dict[str, str], k: int = K, drift: int = 3, share: float | None = None, least: float = 0.8) -> list[tuple]:
    """(gram, template, position, template length in words, width, votes needed, drift) for every gram of every template."""
    hashes, rows = WordHashes(), []
    for name, text in templates.items():
        words = words_of(text)
        if len(words) < k:
            raise ValueError(f"template {name} has fewer than {k} words")
        width, need = vote_rule(len(words), k, least) if share is None else (k, max(1, int(np.ceil(share * (len(words) - k + 1)))))
        grams = rolling(hashes.of(words), width).view(np.int64)
        rows += [(int(h), name, i, len(words), width, need, slack(len(words), drift, least)) for i, h in enumerate(grams)]
    return rows


def slack(size: int, drift: int, least: float) -> int:
    """Words by which a span may shift within one template: the words it may lack, `drift` at least."""
    return max(drift, int(np.ceil((1 - least) * size - 1e-9)))


def word_grams(docs: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, text_key, width and grams: the hashes of all rolling runs of that many words of the whole text, in order.

    Each document has one row more, of width 0, with the gram `_END` and n_words.
    """

    def run(batches):
        hashes = WordHashes()
        for part in slices(batches, "text", 1_000_000):
            words = [hashes.of(words_of(x)) for x in part.column("text").to_pylist()]
            for width in widths:
                grams = [rolling(w, width).view(np.int64) for w in words]
                ends = np.cumsum([0, *map(len, grams)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams) if grams else np.empty(0, np.int64)))
                same, none = pa.array(np.full(len(words), width, np.int32)), pa.nulls(len(words), pa.int64())
                columns = [part.column("doc_id"), part.column("text_key"), same, lists, none]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "width", "grams", "n_words"])
            ends = pa.array([[_END]] * len(words), pa.list_(pa.int64()))
            counts = pa.array([len(w) for w in words], pa.int64())
            columns = [part.column("doc_id"), part.column("text_key"), pa.array(np.zeros(len(words), np.int32)), ends, counts]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "width", "grams", "n_words"])

    return docs.mapInArrow(run, "doc_id long, text_key long, width int, grams array<long>, n_words long")


def gram_hits(docs: DataFrame, rows: list[tuple]) -> DataFrame:
    """doc_id, text_key, width, pos, n_words and a template's (template, place, size, need, slack) for each gram of a text that it holds.

    Each document has one row more, of width 0 with n_words, whatever its text. `rows` are template_rows and phrase_rows: their
    number is fixed by the templates given, so the table is broadcast, and no gram is shuffled that matches nothing.
    """
    fields = "gram long, template string, place int, size int, width int, need int, slack int"
    table = docs.sparkSession.createDataFrame([*rows, (_END, None, 0, 0, 0, 0, 0)], fields)
    grams = word_grams(docs, sorted({r[4] for r in rows})).select("doc_id", "text_key", "width", "n_words", F.posexplode("grams").alias("pos", "gram"))
    return grams.join(F.broadcast(table), ["gram", "width"]).drop("gram")


def voted_spans(hits: DataFrame) -> DataFrame:
    """Candidate spans (doc_id, text_key, template, first, last, votes, size) by diagonal voting over `gram_hits`.

    Every gram of a document that a template holds votes for the diagonal document position -
    template position. Diagonals that lie close (see `slack`) and belong to one template merge
    (words put in or left out shift the diagonal); the span is where their votes lie and where the
    whole template would lie from them. Voting only has to miss nothing that verification accepts:
    a span stays with one or two of the template's grams (see `vote_rule`), or with `share` of them if that is
    given. A phrase's diagonals never merge: each of its places is a span.
    """
    hits = hits.where("width > 0").withColumn("diagonal", F.col("pos") - F.col("place"))
    whose = ["doc_id", "text_key", "template", "size", "need", "slack"]
    hits = hits.select(*whose, "width", "pos", "diagonal").distinct()  # rows that repeat a document vote once
    diagonals = hits.groupBy(*whose, "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"), F.max(F.col("pos") + F.col("width") - 1).alias("last")
    )
    line = Window.partitionBy(*whose).orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > F.col("slack")).cast("int"), F.lit(1))
    merged = diagonals.withColumn("run", fresh).withColumn("run", F.sum("run").over(line))
    spans = merged.groupBy(*whose, "run").agg(
        F.least(F.min("first"), F.min("diagonal")).alias("first"),
        F.greatest(F.max("last"), F.max("diagonal") + F.col("size") - 1).alias("last"),
        F.sum("votes").alias("votes"),
    )
    return spans.where("votes >= need").drop("run", "need", "slack")


def alignment(found: list[bytes], wanted: list[bytes]) -> float:
    """Share of the template's words that stand in the span in order (longest common subsequence)."""
    return _aligned(found, wanted)[0] / len(wanted)


def _aligned(found: list[bytes], wanted: list[bytes]) -> tuple[int, int]:
    """Length of the longest common subsequence, and how many words of `found` it takes from the start."""
    row, most, end = np.zeros(len(wanted) + 1, np.int64), 0, 0
    places = {w: np.array([w == x for x in wanted]) for w in set(wanted)}
    for i, w in enumerate(found):
        if w in places:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(places[w], row[:-1] + 1, 0)))
            if row[-1] > most:
                most, end = int(row[-1]), i + 1
    return most, end


def verified(words: list[bytes], voted: list[dict], wanted: dict[str, list[bytes]], drift: int = 3, least: float = 0.8) -> list[dict]:
    """Spans in which at least `least` of the template's words stand in order, from the first such word to the last.

    Of spans that share half of the words of one of them, that stays which is most like its template
    (words in order, by all words of both): CC BY-NC 4.0 holds all words of CC BY 4.0 in order, but is not it.
    """
    kept = []
    for v in voted:
        name = v["template"]
        reach = max(slack(len(wanted[name]), drift, least), len(wanted[name]) // 2)
        first, last = max(0, v["first"] - reach), min(len(words) - 1, v["last"] + reach)
        found = words[first : last + 1]
        most, end = _aligned(found, wanted[name])
        if most >= least * len(wanted[name]) - 1e-9:
            start = end - _aligned(found[:end][::-1], wanted[name][::-1])[1]
            like = most / (len(wanted[name]) + end - start - most)
            kept.append((like, {"template": name, "first": first + start, "last": first + end - 1, "score": most / len(wanted[name])}))
    best: list[dict] = []
    near: dict[int, list[tuple[float, dict]]] = {}  # the spans that stay, by stretches of words
    for like, s in sorted(kept, key=lambda x: (-x[0], x[1]["first"], x[1]["template"])):
        stretches = range(s["first"] // 64, s["last"] // 64 + 1)

        def beaten(like_t, t):
            both = min(s["last"], t["last"]) - max(s["first"], t["first"]) + 1
            close = 2 * both >= min(s["last"] - s["first"], t["last"] - t["first"]) + 1
            return both > 0 and close and (like < like_t or s["template"] == t["template"])

        if not any(beaten(*x) for n in stretches for x in near.get(n, ())):
            best.append(s)
            for n in stretches:
                near.setdefault(n, []).append((like, s))
    return sorted(best, key=lambda s: (s["first"], s["template"]))


def confirmed(words: list[bytes], voted: list[dict], phrases: dict[str, list[bytes]]) -> list[dict]:
    """Places (label, pos) of voted spans of phrases whose words really stand there."""
    found = sorted({(v["first"], v["template"]) for v in voted})
    return [{"label": BASE[name], "pos": at} for at, name in found if words[at : at + len(phrases[name])] == phrases[name]]


def licensed(docs: DataFrame, templates: dict[str, str] = TEMPLATES, k: int = K, drift: int = 3, share: float | None = None, least: float = 0.8) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, base (phrase label, position), spans (template, first, last, score).

    Voted spans are read again, word by word: a span stays if at least `least` of its template's
    words stand there in order; that share is its score. A span may begin before its first vote and
    end after its last, by `drift` words or half of the template's. Base phrases vote as templates of one gram, and their places stay
    where all their words stand. Null text counts as empty: no words, no spans.
    Rows that repeat an id are scanned each by its own text. Other columns are not read. Only documents with a voted
    span are read a second time.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    read = read.withColumn("text_key", F.xxhash64("text"))
    hits = stored(gram_hits(read, template_rows(templates, k, drift, share, least) + phrase_rows(BASE)), "license-hits")
    # At most one span a diagonal run: bounded by the document's own length.
    spans = voted_spans(hits).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("template", "first", "last")).alias("voted"))
    listed = stored(spans.select(F.col("doc_id").alias("v_id"), F.col("text_key").alias("v_key"), "voted"), "license-spans")
    whose = (F.col("text_key") == F.col("v_key")) & F.col("doc_id").eqNullSafe(F.col("v_id"))
    texts = narrowed(read, "text_key", listed.select(F.col("v_key").alias("text_key"))).join(listed, whose).select("doc_id", "text_key", "text", "voted")
    wanted = {name: words_of(text) for name, text in templates.items()}
    phrases = {phrase: phrase.encode().split() for phrase in BASE}
    fields = "r_id long, r_key long, base array<struct<label:string,pos:long>>, spans array<struct<template:string,first:long,last:long,score:double>>"
    base_type = pa.list_(pa.struct([("label", pa.string()), ("pos", pa.int64())]))
    span_type = pa.list_(pa.struct([("template", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for part in slices(batches, "text"):
            bases, spans = [], []
            for text, voted in zip(part.column("text").to_pylist(), part.column("voted").to_pylist()):
                words = words_of(text)
                bases.append(confirmed(words, [v for v in voted if v["template"] in phrases], phrases))
                spans.append(verified(words, [v for v in voted if v["template"] in wanted], wanted, drift, least))
            yield pa.record_batch(
                [part.column("doc_id"), part.column("text_key"), pa.array(bases, base_type), pa.array(spans, span_type)],
                names=["r_id", "r_key", "base", "spans"],
            )

    # Rows that repeat a document were read each; one of them speaks for all.
    found = texts.mapInArrow(run, fields).groupBy("r_id", "r_key").agg(F.first("base").alias("base"), F.first("spans").alias("spans"))
    own = hits.where("width = 0").select("doc_id", "text_key", "n_words")
    same = (F.col("text_key") == F.col("r_key")) & F.col("doc_id").eqNullSafe(F.col("r_id"))
    none = lambda kind: F.array().cast(found.schema[kind].dataType)
    return own.join(found, same, "left").select("doc_id", "n_words", *[F.coalesce(c, none(c)).alias(c) for c in ("base", "spans")])


def license_digest(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 where a base phrase stands, else the best span's, else 0.
    """
    found = licensed(docs, **settings)
    labels = F.concat(F.col("base.label"), F.col("spans.template"))
    join = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.pos").alias("first_word"),
        F.array_max("base.pos").alias("last_word"),
        join(F.col("base.label")).alias("base_labels"),
        join(labels).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.score"), F.lit(0.0))).alias("score"),
    )
