"""Licence scans over a positional index of licence texts.

Templates are short licence notices and phrases. The index holds, for every template word, its
postings (template, position). The document frequencies of template words are counted over the
whole table, so that the rarest are known. A text's template words are looked up; its ``ANCHORS``
rarest (highest IDF) distinct ones vote: every place of an anchor in the text and every posting of
it give an alignment (template, start = place - position). So do those rarest words of each template
without which the rest of it weighs less than ``COVER``: no match stands without one of them, so the
number of anchors loses none. Of an alignment, the words of the
template that stand at their relative places are counted by intersecting postings; it is a match
if they weigh (by IDF) at least ``COVER`` of the template and a mandatory key phrase stands in the
aligned stretch. Base phrases are templates that must match whole; all their places count, and
their rarest word is always looked up.

Defined cases: a null or blank text has no words, no labels and score 0; repeated rows each give
a row; of several notices every label is given, and the highest cover is the score; a very long text
is scanned whole; carried columns may have any name but those of the results; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, small_batches

ANCHORS, COVER = 24, 0.8
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, notice or paragraph of a licence's body, mandatory key phrases (one of them must stand in the text).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("deal in the software without restriction",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("copies or substantial portions",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain",)),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce",)),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license",)),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("agreed to in writing software distributed under the license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("redistribute it and or modify it under the terms of the gnu general public license",)),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("copy of the mpl was not distributed",)),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ("alter it and redistribute it freely",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache", "licensed under the apache license", ("apache license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("free of charge to any person",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by", "licensed under a creative commons attribution license", ("creative commons attribution",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ("waived all copyright",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("into the public domain",)),
)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(lower_ascii(text)) if text else []


class Index:
    """Positional postings of all templates; idf may come from a corpus."""

    def __init__(self, templates=TEMPLATES, base=BASE, frequency: dict[str, int] | None = None, texts: int = 0):
        self.entries = [(label, phrase.split(), [k.split() for k in keys], False) for label, phrase, keys in templates]
        self.entries += [(label, phrase.split(), [phrase.split()], True) for phrase, label in base.items()]
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, words, _, _) in enumerate(self.entries):
            for i, w in enumerate(words):
                self.postings[w].append((t, i))
        frequency = frequency or {}
        self.idf = {w: math.log((texts + 1) / (frequency.get(w, 0) + 1)) + 0.1 for w in self.postings}
        self.weight = [sum(self.idf[w] for w in words) for _, words, _, _ in self.entries]
        self.rarest = [max(range(len(words)), key=lambda i, ws=words: self.idf[ws[i]]) for _, words, _, _ in self.entries]
        self.needed = [self._needed(words, weight) for (_, words, _, _), weight in zip(self.entries, self.weight, strict=True)]

    def _needed(self, words: list[str], weight: float) -> set[str]:
        """The rarest words of a template that weigh more than a match may lack."""
        found, rest = set(), weight
        for w in sorted(set(words), key=lambda w: (-self.idf[w], w)):
            if rest < (COVER - 1e-9) * weight:
                break
            found.add(w)
            rest -= self.idf[w] * words.count(w)
        return found

    def scan(self, words: list[str]) -> tuple[list[int], list[str], list[str], float]:
        """(starts of base phrases, base labels, labels, score) of the words of a text."""
        vocabulary = self.postings.keys() & set(words)
        if not vocabulary:
            return [], [], [], 0.0
        places: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in vocabulary:
                places[w].append(i)
        held = {w: set(p) for w, p in places.items()}
        anchors = set(sorted(vocabulary, key=lambda w: (-self.idf[w], w))[:ANCHORS])
        starts, base, labels, best = [], set(), set(), 0.0
        for t, (label, phrase, keys, whole) in enumerate(self.entries):
            at = self.rarest[t]
            if whole:
                found = [p - at for p in places.get(phrase[at], ()) if all(p - at + i in held.get(w, ()) for i, w in enumerate(phrase))]
                if found:
                    starts += found
                    base.add(label)
                    labels.add(label)
                    best = 1.0
                continue
            votes = {p - i for i, w in enumerate(phrase) if (w in anchors or w in self.needed[t]) and w in vocabulary for p in places[w]}
            # Only aligned words can reach the cover, so a template needs most of its words somewhere.
            if not votes or sum(self.idf[w] for w in phrase if w in vocabulary) < COVER * self.weight[t]:
                continue
            for s in votes:
                cover = sum(self.idf[w] for i, w in enumerate(phrase) if s + i in held.get(w, ())) / self.weight[t]
                if cover >= COVER and any(self._stands(k, s, len(phrase), held) for k in keys):
                    labels.add(label)
                    best = max(best, cover)
        return sorted(starts), sorted(base), sorted(labels), min(1.0, best)

    @staticmethod
    def _stands(key: list[str], start: int, length: int, held: dict[str, set[int]]) -> bool:
        return any(all(p + i in held.get(w, ()) for i, w in enumerate(key)) for p in range(start, start + length - len(key) + 1))


def frequencies(documents: DataFrame, index: Index) -> tuple[dict[str, int], int]:
    """In how many texts of the whole table each template word stands, and how many texts there are."""
    vocabulary = set(index.postings)

    def run(batches: Iterator[pa.RecordBatch]):
        count, rows = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows += 1
                count.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([*count, ""], pa.string()), pa.array([*count.values(), rows], pa.int64())], ["word", "n"])

    small_batches(documents.sparkSession)
    rows = documents.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    count = {r["word"]: r["n"] for r in rows}
    return count, count.pop("", 0)


def scanned(documents: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The carried columns with n_words, n_base, first_word, last_word, base_labels, labels, score."""
    carry = ["doc_id"] if carry is None else carry
    index = Index()
    index = Index(TEMPLATES, BASE, *frequencies(documents, index))
    schema = documents.select(*carry).schema
    for name, kind in (("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for text in batch.column("__text").to_pylist():
                words = words_of(text)
                starts, base, labels, score = index.scan(words)
                rows.append((len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(base), ",".join(labels), score))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()], strict=True))], schema.names)

    return documents.select(*carry, F.col("text").alias("__text")).mapInArrow(run, schema)
