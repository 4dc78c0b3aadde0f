"""License scans: an exact containment join between the blocks of all texts and license templates.

A template is a set of words.  A text block is any run of as many consecutive words as the template has;
it matches when it contains at least ``PERCENT`` of the template's distinct words.  All blocks of all texts are covered:

* words are ordered by how many documents of the whole corpus have them, rarest first.  A block that matches
  must have one of the first k - ceil(0.8 k) + 1 words of a template of k words (prefix filter), so only texts with such a word
  go on, and only blocks that cover a place of it;
* a text with fewer template words than must be found cannot match (length filter);
* a place whose prefix word has rank i leaves at most k - i words for a block in which it is the first of the
  prefix; ranks that leave too few are just those outside the prefix, so this position filter refutes nothing more;
* what remains is counted word by word.

Besides, a few phrases count wherever their words stand consecutively.  The templates are a fixed list, so the
corpus is read by maps; only word counts of the templates' vocabulary are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERCENT = 80

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices as the licenses' publishers give them, without names and dates.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "apache": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "agpl": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "cc-by": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
}

# Bytes that separate words: all of ASCII but digits and small letters; capitals are lower-cased first.
_SEPARATORS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text, A-Z lower-cased; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS).split() if text else []


@dataclass(frozen=True)
class Template:
    label: str
    length: int
    needed: int
    rank: dict[bytes, int]
    prefix: frozenset[bytes]


def templates_by(frequency: dict[bytes, int], percent: int = PERCENT, texts: dict[str, str] | None = None) -> tuple[Template, ...]:
    """The templates with their words ranked by document frequency, rarest first, ties by the word."""
    out = []
    for label, text in (TEMPLATES if texts is None else texts).items():
        words = words_of(text)
        order = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
        needed = -(-percent * len(order) // 100)
        out.append(Template(label, len(words), needed, {w: i for i, w in enumerate(order)}, frozenset(order[: len(order) - needed + 1])))
    return tuple(out)


def best_block(words: list[bytes], template: Template) -> int:
    """The most distinct template words that a block of the template's length has, if enough for a match, else 0."""
    rank, k = template.rank, len(template.rank)
    ids = np.fromiter((rank.get(w, -1) for w in words), np.int64, len(words))
    at = np.flatnonzero(ids >= 0)
    found = ids[at]
    if len(np.unique(found)) < template.needed:
        return 0
    first = at[found <= k - template.needed]
    best, left, right, have = 0, 0, 0, np.zeros(k, np.int64)
    distinct = 0
    # A window slides over the template words alone; only its positions near a prefix word can match.
    for right in range(len(at)):
        have[found[right]] += 1
        distinct += have[found[right]] == 1
        while at[right] - at[left] >= template.length:
            have[found[left]] -= 1
            distinct -= have[found[left]] == 0
            left += 1
        if distinct > best and distinct >= template.needed:
            place = np.searchsorted(first, at[left])
            if place < len(first) and first[place] <= at[right]:
                best = distinct
    return int(best)


def document_frequency(docs: DataFrame, text: str = "text") -> dict[bytes, int]:
    """In how many texts of the whole corpus each word of the templates occurs; the driver gets one row per such word."""
    vocabulary = frozenset(w for t in TEMPLATES.values() for w in words_of(t))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for value in batch.column(0):
                for word in vocabulary.intersection(words_of(value.as_py())):
                    found[word] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(row.word): row.n for row in rows}


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of ``docs``.

    ``n_base`` counts all places of the phrases, overlapping ones too; ``first_word`` and ``last_word`` are the
    smallest and largest start among them, null without any.  ``labels`` has the phrases' labels and those of the templates that
    some block of the text matches.  ``score`` is 1 with a phrase, else the share of words that the best
    matching block has of its template, 0 without a match.  Null and empty texts have no words and match nothing; rows that
    repeat give equal rows; no rows give no rows; other columns are not read.
    """
    session = docs.sparkSession
    shared = session.sparkContext.broadcast(templates_by(document_frequency(docs, text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = [(f" {phrase} ".encode(), label) for phrase, label in PHRASES.items()]
        prefixes = frozenset(w for t in shared.value for w in t.prefix)
        for batch in batches:
            rows = []
            for doc, value in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(value.as_py())
                line = b" " + b" ".join(words) + b" "
                starts, base = [], set()
                for phrase, label in phrases:
                    at, before, counted = line.find(phrase), 0, 0
                    while at >= 0:
                        # Words before this place: blanks are counted on from the place before.
                        before, counted = before + line.count(b" ", counted, at), at
                        starts.append(before)
                        base.add(label)
                        at = line.find(phrase, at + 1)
                labels, score = set(base), 1.0 if base else 0.0
                if not prefixes.isdisjoint(words):
                    own = set(words)
                    for template in shared.value:
                        if not template.prefix.isdisjoint(own) and (best := best_block(words, template)):
                            labels.add(template.label)
                            score = max(score, best / len(template.rank))
                rows.append((doc.as_py(), len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 8, RESULT.types, strict=True)], schema=RESULT)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
)
