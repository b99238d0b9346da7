"""License scans by diagonal voting: where the texts of license templates stand in documents, whole or edited.

Words are runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. Every run of GRAM words of every
document is hashed (runs of two words for templates shorter than GRAM) and Spark joins the hashes with the positions of
all templates, a table that is broadcast after a count. A hit of place p in the document and place t in the template is a
vote for the diagonal p - t. Votes are counted by document, template and diagonal before they move; diagonals next to each
other, as an inserted or missing word makes them, are merged in bands that overlap by half, so that any diagonals within
SLACK words share a band. What a band covers is verified on the words themselves: a template of fewer than GRAM words
must stand there as it is, of a longer one the longest common subsequence must hold MIN_SHARE of its words.

A document with a verified span has its template's label; its score is the largest share of a template that it holds (1
for a whole one, 0 without any). Of spans of longer templates that overlap the best stays (by share of matched words, then
by their number, then the first), so that a license is not taken for another whose words it also holds; phrases stay all.
A notice is found as long as one run of GRAM words of it is intact.

Null texts are empty. Rows that repeat an id and text have the same spans, each its own row; null ids are ids of their
own text. Templates without two words are refused. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import map_arrow, materialise, small

#: Words of a run, of a run of short templates, by how much diagonals of one place may differ, and what must be found.
GRAM, SHORT, SLACK, MIN_SHARE = 5, 2, 8, 0.8
#: Arrays of hashes are cut into rows of so many places: a row stays small however long its text is.
PLACES = 4096
#: Documents with bands or spans, and how many of these, up to which they are broadcast.
FEW = (20_000, 200_000)
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Template(NamedTuple):
    name: str
    label: str
    text: str


# The phrases that the base labels ask for.
PHRASES = (
    Template("phrase-mit", "mit", "mit license"),
    Template("phrase-apache", "apache", "apache license"),
    Template("phrase-gpl", "gpl", "general public license"),
)

# Notices of public licenses, as their publishers word them.
NOTICES = (
    Template("mit-grant", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    Template("isc-grant", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("apache-notice", "apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("gpl-notice", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("lgpl-notice", "lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    Template("mpl-notice", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    Template("bsd-conditions", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    Template("unlicense", "unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    Template("cc-by", "cc-by", "licensed under CC BY 4.0"),
    Template("cc-by-sa", "cc-by-sa", "licensed under CC BY-SA 4.0"),
    Template("cc-by-nc", "cc-by-nc", "licensed under CC BY-NC 4.0"),
    Template("cc-by-nd", "cc-by-nd", "licensed under CC BY-ND 4.0"),
    Template("cc-by-long", "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa-long", "cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by-nc-long", "cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)
TEMPLATES = (*PHRASES, *NOTICES)

GRAMS = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("width", pa.int32()), ("at", pa.int64()), ("hashes", pa.list_(pa.int64()))])
_SPAN = pa.struct([("template", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("matched", pa.int64())])
FOUND = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("spans", pa.list_(_SPAN))])


def words(text: str) -> list[bytes]:
    """The words of one text."""
    data = np.frombuffer(text.encode(), np.uint8)
    w = kernels.find_words(data, np.array([0, len(data)]), lower=True, breaks=_BREAK)
    held = w.data.tobytes()
    return [held[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())]


def _runs(w: kernels.Words, h: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the hashes of its runs of so many words."""
    runs, of = kernels.shingles(w, h, width)
    n = np.diff(w.of)
    return [runs[of[i] : of[i + 1]] if n[i] >= width else runs[:0] for i in range(len(w))]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """GRAMS of the rows (id, text_hash, text); a text of many places has several rows."""
    for batch in batches:
        for a, b, data, offsets in kernels.slices(batch.column(2)):
            w = kernels.find_words(data, offsets, lower=True, breaks=_BREAK)
            h = kernels.hash_words(w)
            of, width, at, hashes = [], [], [], []
            for k in (SHORT, GRAM):
                for i, runs in enumerate(_runs(w, h, k)):
                    for p in range(0, len(runs), PLACES):
                        of.append(a + i)
                        width.append(k)
                        at.append(p)
                        hashes.append(kernels.signed(runs[p : p + PLACES]))
            if of:
                rows, ends = pa.array(of, pa.int64()), np.concatenate([[0], np.cumsum([len(x) for x in hashes])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(width, pa.int32()), pa.array(at, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(hashes)))], schema=GRAMS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text_hash, n_words of the rows (id, text_hash, text)."""
    for batch in batches:
        for a, b, data, offsets in kernels.slices(batch.column(2)):
            n = np.diff(kernels.find_words(data, offsets, breaks=_BREAK).of)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int64())], names=["id", "text_hash", "n_words"])


def common_words(text: Sequence[bytes], template: Sequence[bytes]) -> tuple[int, int, int]:
    """(length of the longest common subsequence, where in text its first and last words stand).

    By bits: a set bit of row marks a word of the template at which the length grows; each word of the text is one
    addition. The end is where the length is reached first; the start is found the same way from the end backwards.
    """

    def reach(one: Sequence[bytes], other: Sequence[bytes]) -> tuple[int, int]:
        where: dict[bytes, int] = {}
        for i, x in enumerate(other):
            where[x] = where.get(x, 0) | 1 << i
        full = row = (1 << len(other)) - 1
        best, end = 0, 0
        for j, x in enumerate(one):
            if m := where.get(x):
                hit = row & m
                row = (row + hit | row - hit) & full
                if (length := len(other) - row.bit_count()) > best:
                    best, end = length, j
        return best, end

    best, end = reach(text, template)
    if not best:
        return 0, 0, 0
    part = text[: end + 1]
    return best, end - reach(part[::-1], template[::-1])[1], end


def _verify(batches: Iterator[pa.RecordBatch], templates: list[list[bytes]], share: float) -> Iterator[pa.RecordBatch]:
    """FOUND of the rows (id, text_hash, text, bands): the spans that hold, none twice."""
    for batch in batches:
        out = []
        for text, bands in zip(batch.column(2), batch.column(3), strict=True):
            held, found = words(text.as_py()), []
            for k, low, high in sorted((x["template"], x["low"], x["high"]) for x in bands.as_py()):
                t = templates[k]
                if len(t) < GRAM:
                    found += [(k, d, len(t), len(t)) for d in range(max(0, low), high + 1) if held[d : d + len(t)] == t]
                    continue
                start = max(0, low - SLACK)
                matched, first, last = common_words(held[start : high + len(t) + SLACK], t)
                if matched >= share * len(t):
                    found.append((k, start + first, last - first + 1, matched))
            kept = [x for x in dict.fromkeys(found) if len(templates[x[0]]) < GRAM]
            starts: list[int] = []
            held_by: dict[int, tuple] = {}
            for x in sorted({x for x in found if len(templates[x[0]]) >= GRAM}, key=lambda x: (-x[3] / max(x[2], len(templates[x[0]])), -x[3], x[1], x[0])):
                i = bisect(starts, x[1])
                before = starts[i - 1] + held_by[starts[i - 1]][2] if i else 0
                if before <= x[1] and (i == len(starts) or x[1] + x[2] <= starts[i]):
                    starts.insert(i, x[1])
                    held_by[x[1]] = x
            kept += [held_by[i] for i in starts]
            out.append([dict(zip(("template", "start", "length", "matched"), x)) for x in kept])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, FOUND.field("spans").type)], schema=FOUND)


def positions(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """width, hash, template, place, n: every run of words of every template. As many rows as the templates have words."""
    rows = []
    for k, t in enumerate(templates):
        data = np.frombuffer(t.text.encode(), np.uint8)
        w = kernels.find_words(data, np.array([0, len(data)]), lower=True, breaks=_BREAK)
        if len(w.start) < SHORT:
            raise ValueError(f"template {t.name} has fewer than {SHORT} words")
        width = GRAM if len(w.start) >= GRAM else SHORT
        rows += [(width, int(x), k, i, len(w.start)) for i, x in enumerate(kernels.signed(_runs(w, kernels.hash_words(w), width)[0]))]
    return spark.createDataFrame(rows, "width int, hash long, template int, place int, n int")


def _few(df: DataFrame, lists: str) -> DataFrame:
    """df with a broadcast hint if it has at most FEW rows and items in their lists."""
    rows, items = df.agg(F.count("*"), F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()
    return F.broadcast(df) if rows <= FEW[0] and items <= FEW[1] else df


class Scan:
    """One scan of a table of documents for templates; intermediate tables lie in the shared folder."""

    def __init__(self, docs: DataFrame, templates: Sequence[Template] = TEMPLATES, share: float = MIN_SHARE, id_col: str = "doc_id", text_col: str = "text"):
        self.templates, self.spark = list(templates), docs.sparkSession
        text = F.coalesce(F.col(text_col), F.lit(""))
        self.rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
        self.share = share
        self.grams = map_arrow(self.rows, _grams, "id long, text_hash long, width int, at long, hashes array<long>")

    def bands(self) -> DataFrame:
        """id, text_hash, template, low, high: the merged diagonals of each document and template."""
        known = small(positions(self.spark, self.templates))
        each = self.grams.select("id", "text_hash", "width", "at", F.posexplode("hashes").alias("pos", "hash"))
        hits = each.join(known, ["width", "hash"])
        hits = hits.select("id", "text_hash", "template", (F.col("at") + F.col("pos") - F.col("place")).alias("diagonal"), "n")
        votes = hits.groupBy("id", "text_hash", "template", "diagonal", "n").agg(F.count("*").alias("votes"))
        # Short templates must stand as they are: each diagonal is a band of its own.
        band = F.expr(f"diagonal div {SLACK}")
        near = votes.withColumn("band", F.explode(F.when(F.col("n") < GRAM, F.array("diagonal")).otherwise(F.array(band, band + 1))))
        return near.groupBy("id", "text_hash", "template", "band").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high")).drop("band")

    def found(self) -> DataFrame:
        """id, text_hash, spans: array of (template, start, length, matched), of the documents that have any. A row each
        for different ids and texts."""
        # The bands of a document are no more than its own words give.
        bands = self.bands().distinct().groupBy("id", "text_hash").agg(F.collect_list(F.struct("template", "low", "high")).alias("bands"))
        bands = materialise(bands, "license-bands")
        wanted = _few(bands.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "bands"), "bands")
        pairs = self.rows.join(wanted, self.rows.id.eqNullSafe(wanted["_id"]) & (self.rows.text_hash == wanted["_hash"]))
        check = partial(_verify, templates=[words(t.text) for t in self.templates], share=self.share)
        spans = map_arrow(pairs.select("id", "text_hash", "text", "bands"), check, "id long, text_hash long, spans array<struct<template int, start long, length long, matched long>>")
        return materialise(spans, "license-spans").dropDuplicates(["id", "text_hash"])

    def spans(self) -> DataFrame:
        """id, text_hash, template, label, start_word, n_words, share: one row for each verified span."""
        names = self.spark.createDataFrame([(k, t.name, t.label, len(words(t.text))) for k, t in enumerate(self.templates)], "k int, template string, label string, size int")
        each = self.found().select("id", "text_hash", F.inline("spans")).withColumnRenamed("template", "k").join(F.broadcast(names), "k")
        return each.select("id", "text_hash", "template", "label", F.col("start").alias("start_word"), F.col("length").alias("n_words"), (F.col("matched") / F.greatest("size", "length")).alias("share"))

    def labelled(self) -> DataFrame:
        """id, text_hash, n_words, spans, labels (sorted), score: one row for each row of the documents."""
        label, size = (F.array(*map(F.lit, x)) for x in ([t.label for t in self.templates], [len(words(t.text)) for t in self.templates]))
        of = lambda s: F.get(label, s["template"])
        held = self.found().select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "spans")
        held = _few(held, "spans")
        counted = map_arrow(self.rows, _counted, "id long, text_hash long, n_words long")
        both = counted.join(held, counted.id.eqNullSafe(held["_id"]) & (counted.text_hash == held["_hash"]), "left").withColumn("spans", F.coalesce("spans", F.expr("array()").cast("array<struct<template int, start long, length long, matched long>>")))
        share = F.transform("spans", lambda s: s["matched"] / F.greatest(F.get(size, s["template"]), s["length"]))
        return both.select("id", "text_hash", "n_words", "spans", F.array_sort(F.array_distinct(F.transform("spans", of))).alias("labels"), F.coalesce(F.array_max(share), F.lit(0.0)).alias("score"))
