"""Licence scan by a positional index of rare words.

Templates of licence texts are indexed as word -> (template, position). Document frequencies of the index's words over the
whole corpus give each word's weight. A template is judged if its mandatory key phrase stands in the document: its rarest
words are looked up, each of their places votes for (template, place minus position), and an alignment with enough votes
is compared word by word with its template. Neither the number of licences in a document nor their frequency is capped.

Words are runs of characters other than ASCII non-alphanumerics, with A-Z lower-cased.

Null and edge cases: a null text is empty: no words, no labels, score 0; repeated rows are labelled each on its own; extra
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, bound_batches, table

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label, opening of the public licence text or short notice, mandatory key phrase.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "permission is hereby granted free of charge"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License", "apache license version 2 0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general public license"),
    ("gpl", "This work is licensed under the GNU General Public License", "gnu general public license"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser general public license"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one", "mozilla public license"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    ("cc-by", "Licensed under CC BY 4.0", "cc by"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "attribution sharealike"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights", "to the public domain"),
    ("reserved", "All rights reserved", "all rights reserved"),
    # Short notices and headings. A lone "mit license" is no name of a licence in German, so its neighbours count.
    ("mit", "Licensed under the MIT License", "mit license"),
    ("mit", "MIT License Copyright (c)", "mit license"),
    ("mit", "SPDX-License-Identifier: MIT", "license identifier mit"),
    ("apache", "Apache License", "apache license"),
    ("apache", "Apache 2.0 License", "apache 2 0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0", "license identifier apache"),
    ("bsd", "BSD License", "bsd license"),
    ("bsd", "BSD 2-Clause License", "bsd 2 clause"),
    ("bsd", "BSD 3-Clause License", "bsd 3 clause"),
    ("bsd", "2-Clause BSD License", "2 clause bsd"),
    ("bsd", "3-Clause BSD License", "3 clause bsd"),
    ("bsd", "SPDX-License-Identifier: BSD", "license identifier bsd"),
    ("gpl", "GNU General Public License", "gnu general public license"),
    ("gpl", "GNU GPL", "gnu gpl"),
    ("gpl", "SPDX-License-Identifier: GPL", "license identifier gpl"),
    ("lgpl", "Lesser General Public License", "lesser general public license"),
    ("lgpl", "GNU LGPL", "gnu lgpl"),
    ("lgpl", "SPDX-License-Identifier: LGPL", "license identifier lgpl"),
    ("mpl", "Mozilla Public License", "mozilla public license"),
    ("mpl", "SPDX-License-Identifier: MPL", "license identifier mpl"),
    ("isc", "ISC License", "isc license"),
    ("isc", "SPDX-License-Identifier: ISC", "license identifier isc"),
    ("unlicense", "The Unlicense", "the unlicense"),
    ("unlicense", "Released into the public domain", "released into the public domain"),
    ("unlicense", "SPDX-License-Identifier: Unlicense", "license identifier unlicense"),
    ("cc-by", "Creative Commons Attribution 4.0", "creative commons attribution"),
    ("cc-by-nc", "CC BY-NC", "cc by nc"),
    ("cc-by-nc", "Attribution-NonCommercial 4.0", "attribution noncommercial"),
    ("cc-by-sa", "CC BY-SA", "cc by sa"),
    ("cc-by-sa", "Attribution-ShareAlike 4.0", "attribution sharealike"),
    ("cc0", "CC0 1.0 Universal", "cc0 1 0"),
    ("cc0", "Licensed under CC0", "cc0"),
    ("cc0", "SPDX-License-Identifier: CC0", "license identifier cc0"),
)

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class RareWordIndex:
    def __init__(self, templates=TEMPLATES):
        self.templates = [(label, words(t.encode()), b" " + b" ".join(words(k.encode())) + b" ") for label, t, k in templates]
        self.places: list[dict[bytes, list[int]]] = []
        for _, ws, _ in self.templates:
            at: dict[bytes, list[int]] = {}
            for i, w in enumerate(ws):
                at.setdefault(w, []).append(i)
            self.places.append(at)
        self.vocabulary = frozenset(w for at in self.places for w in at)

    def lookups(self, idf: dict[bytes, float], top: int, least_words: int, least_score: float, min_idf: float) -> list[tuple[dict[bytes, list[int]], int]]:
        """For each template its looked-up words with their places, and the votes that an alignment needs. The rarest
        words are taken until an alignment with least_score of the template can't have fewer than least_words votes."""
        out = []
        for (_, template, _), at in zip(self.templates, self.places, strict=True):
            spare = len(template) - next(n for n in range(len(template) + 1) if n / len(template) >= least_score)
            chosen: dict[bytes, list[int]] = {}
            held = 0
            for w in sorted(at, key=lambda w: (-idf.get(w, math.inf), w)):
                if held >= spare + least_words and (len(chosen) >= top or idf.get(w, math.inf) < min_idf):
                    break
                chosen[w] = at[w]
                held += len(at[w])
            out.append((chosen, max(held - spare, 1)))
        return out

    def labels(self, ws: list[bytes], spaced: bytes, lookups: list[tuple[dict[bytes, list[int]], int]], least_words: int, least_score: float) -> tuple[set[str], float]:
        """Labels and the best aligned share of a template. All templates whose key phrase stands in the document are judged."""
        present = self.vocabulary.intersection(ws)
        standing = [t for t, (_, _, key) in enumerate(self.templates) if present.issuperset(key.split()) and key in spaced]
        if not standing:
            return set(), 0.0
        postings: dict[bytes, list[tuple[int, int]]] = {}
        for t in standing:
            for w, at in lookups[t][0].items():
                postings.setdefault(w, []).extend((t, q) for q in at)
        votes: Counter = Counter()
        for i, w in enumerate(ws):
            if w in postings:
                votes.update((t, i - q) for t, q in postings[w])
        found, best = set(), 0.0
        for (t, offset), n in votes.items():
            label, template, _ = self.templates[t]
            if n < lookups[t][1]:
                continue
            same = [w for i, w in enumerate(template) if 0 <= offset + i < len(ws) and ws[offset + i] == w]
            if len(same) / len(template) >= least_score and len(set(same)) >= min(least_words, len(set(template))):
                found.add(label)
                best = max(best, len(same) / len(template))
        return found, best


_INDEX = RareWordIndex()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    n = 0
    for big in batches:
        for batch in batches_of(pa.Table.from_batches([big]), 1024):
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                n += 1
                seen.update(_INDEX.vocabulary.intersection(words(text or b"")))
    seen[b""] = n
    yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})


def word_weights(docs: DataFrame) -> dict[bytes, float]:
    """Inverse document frequency of each index word over all documents: as many rows as the templates have words."""
    rows = docs.select("text").mapInArrow(_frequencies, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r["word"].encode(): r["n"] for r in rows}
    total = df.pop(b"", 0)
    return {w: math.log((1 + total) / (1 + df.get(w, 0))) for w in _INDEX.vocabulary}


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label: string, word: long>>"


def _label(idf: dict[bytes, float], top: int, least_words: int, least_score: float, min_idf: float):
    base = [(b" " + p.encode() + b" ", label) for p, label in BASE]
    place = pa.struct([("label", pa.string()), ("word", pa.int64())])
    lookups = _INDEX.lookups(idf, top, least_words, least_score, min_idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in batches_of(pa.Table.from_batches([big]), 1024):
                out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")}
                for text in batch.column("text").cast(pa.binary()).to_pylist():
                    ws = words(text or b"")
                    spaced = b" " + b" ".join(ws) + b" "
                    places = []
                    for phrase, label in base:
                        at = spaced.find(phrase)
                        while at >= 0:
                            places.append((spaced.count(b" ", 0, at), label))
                            at = spaced.find(phrase, at + 1)
                    found, score = _INDEX.labels(ws, spaced, lookups, least_words, least_score)
                    own = {label for _, label in places}
                    row = (len(ws), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted(own)), ",".join(sorted(own | found)), score, [{"label": b, "word": a} for a, b in sorted(places)])
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
                kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "score": pa.float64(), "places": pa.list_(place)}
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})

    return run


def scan_licenses(docs: DataFrame, top: int = 8, least_words: int = 3, least_score: float = 0.6, min_idf: float = 2.0) -> DataFrame:
    """Words, base places, labels and score of each document. Of every template whose key phrase stands in a document the
    rarest words are looked up, as many as it takes to miss no alignment; an alignment needs least_words different words
    and least_score of its template. Beyond these, up to top words of min_idf at least are looked up, which saves comparisons."""
    bound_batches(docs.sparkSession)
    idf = word_weights(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_label(idf, top, least_words, least_score, min_idf), SCAN)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("places")
