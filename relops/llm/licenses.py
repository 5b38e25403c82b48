"""License notices in texts, by a positional index of rare words.

The words of all templates are the index's vocabulary; how many documents hold each is counted over the whole
corpus. Of each template the words of the highest inverse document frequency that a copy cannot lack are looked up
wherever they stand: their postings say in which template and where the word stands, and the difference of the two
positions is where a copy would begin. Postings are intersected by that difference: only where all looked-up words of
a template agree, a copy is verified: the mandatory key phrases must stand in their places, and the share of equal
words is the score.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relops.columns import col
from relops.llm import bytewise as B
from relops.llm.rowwise import annotate

# Phrases that name a licence by themselves.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public licence notices; square brackets mark the key phrases that must be there.
TEMPLATES = {
    "agpl-3.0": "licensed under the [gnu affero general public license] version 3",
    "all-rights-reserved": "[all rights reserved]",
    "apache-2.0": "licensed under the [apache license version 2 0]",
    "bsd": "[redistribution and use in source and binary forms] with or without modification [are permitted provided that the following conditions are met]",
    "cc-by-4.0": "licensed under [cc by 4 0]",
    "cc-by-nc-4.0": "licensed under [cc by nc 4 0]",
    "cc-by-sa-4.0": "licensed under [cc by sa 4 0]",
    "gpl-2.0": "this work is licensed under the [gnu general public license version 2]",
    "gpl-3.0": "this work is licensed under the [gnu general public license version 3]",
    "isc": "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted",
    "lgpl-3.0": "licensed under the [gnu lesser general public license] version 3",
    "mit-notice": "released under the [mit license]",
    "mit-text": "[permission is hereby granted free of charge] to any person obtaining a copy of this software [to deal in the software without restriction]",
    "mpl-2.0": "this source code form is subject to the terms of the [mozilla public license] v 2 0",
    "unlicense": "this is free and unencumbered software [released into the public domain]",
    "agpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the [gnu affero general public license] as published by the "
        "free software foundation either version 3 of the license or at your option any later version"
    ),
    "apache-2.0-notice": (
        "licensed under the [apache license version 2 0] the license [you may not use this file except in compliance with the license] you may obtain a copy of the license at"
    ),
    "apache-2.0-terms": (
        "[unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis] without warranties or "
        "conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
    ),
    "boost-1.0": (
        "permission is hereby granted free of charge to any person [or organization obtaining a copy of the software and accompanying documentation covered by this license] "
        "the software to use reproduce display distribute execute and transmit the software"
    ),
    "bsd-binary": (
        "[redistributions in binary form must reproduce the above copyright notice] this list of conditions and the following disclaimer in the documentation and or "
        "other materials provided with the distribution"
    ),
    "bsd-endorsement": (
        "neither the name of the copyright holder nor the names of its contributors may be used to [endorse or promote products derived from this software without "
        "specific prior written permission]"
    ),
    "bsd-source": "[redistributions of source code must retain the above copyright notice] this list of conditions and the following disclaimer",
    "cc0-1.0": (
        "the person who associated a work with this deed has [dedicated the work to the public domain by waiving all of his or her rights to the work] worldwide under copyright law"
    ),
    "epl-2.0": "this program and the accompanying materials are made available under the terms of the [eclipse public license 2 0] which is available at",
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the [gnu general public license as published by the free software foundation] "
        "either version 3 of the license or at your option any later version"
    ),
    "gpl-warranty": (
        "this program is distributed in the hope that it will be useful but [without any warranty without even the implied warranty of merchantability or fitness for a particular purpose]"
    ),
    "isc-notice": (
        "[permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted] provided that the above copyright notice and "
        "this permission notice appear in all copies"
    ),
    "lgpl-notice": (
        "you can redistribute it and or modify it under the terms of the [gnu lesser general public license] as published by the free software foundation either version "
        "2 1 of the license or at your option any later version"
    ),
    "mit-conditions": "[the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software]",
    "mit-grant": (
        "[permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files] the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions"
    ),
    "mpl-2.0-notice": (
        "this source code form is subject to the terms of the [mozilla public license v 2 0] if a copy of the mpl was not distributed with this file you can obtain one at"
    ),
    "unlicense-grant": (
        "[anyone is free to copy modify publish use compile sell or distribute this software] either in source code form or as a compiled binary for any purpose commercial or "
        "non commercial and by any means"
    ),
    "warranty": (
        "[the software is provided as is without warranty of any kind express or implied] including but not limited to the warranties of merchantability fitness for a "
        "particular purpose and noninfringement"
    ),
    "zlib": (
        "[this software is provided as is without any express or implied warranty] in no event will the authors be held liable for any damages arising from the use of this software"
    ),
}

# Share of a template's words that must stand in their places.
LEAST_MATCH = 0.6
# Words of a template looked up, as far as a copy must hold that many.
LOOKED_UP = 3


@dataclass
class Template:
    label: str
    words: np.ndarray
    phrases: list[tuple[int, int]]


@dataclass
class Postings:
    """Templates and positions, those of word ``i`` of the vocabulary from ``first[i]`` to ``first[i + 1]``.

    ``agree`` says of how many of its postings a copy of each template holds at least.
    """

    owner: np.ndarray
    position: np.ndarray
    first: np.ndarray
    agree: np.ndarray


class Index:
    """Vocabulary of the templates and where each word stands in them (template, position)."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.templates = []
        for label in sorted(templates):
            marked = re.findall(r"\[|\]|[^\s\[\]]+", templates[label])
            words, phrases = [], []
            for token in marked:
                if token == "[":
                    phrases.append((len(words), 0))
                elif token == "]":
                    phrases[-1] = (phrases[-1][0], len(words))
                else:
                    words.append(token)
            self.templates.append(Template(label, word_hashes(words), phrases))
        every = np.concatenate([t.words for t in self.templates])
        self.vocabulary, place = np.unique(every, return_inverse=True)
        owner = np.repeat(np.arange(len(self.templates)), [len(t.words) for t in self.templates])
        position = np.concatenate([np.arange(len(t.words)) for t in self.templates])
        order = np.argsort(place, kind="stable")
        self.word, self.owner, self.position = place[order], owner[order], position[order]

    def look_up(self, idf: np.ndarray) -> Postings:
        """Postings of the rarest words of each template, of which a verified copy holds a known number.

        With key phrases these are the ``LOOKED_UP`` rarest words in them, and a copy holds all. Without any they are so
        many of the rarest that a copy, which may lack a share of the template, still holds ``LOOKED_UP`` of them.
        """

        chosen, agree = np.zeros(len(self.owner), bool), np.zeros(len(self.templates), np.int64)
        for kind, form in enumerate(self.templates):
            weight = idf[np.searchsorted(self.vocabulary, form.words)]
            keyed = [at for a, b in form.phrases for at in range(a, b)]
            among = np.array(keyed or range(len(form.words)), np.int64)
            lacking = 0 if keyed else int((np.arange(len(among) + 1) >= LEAST_MATCH * len(among)).sum()) - 1
            agree[kind] = max(1, min(LOOKED_UP, len(among) - lacking))
            among = among[np.argsort(-weight[among], kind="stable")[: lacking + agree[kind]]]
            chosen |= (self.owner == kind) & np.isin(self.position, among)
        times = np.bincount(self.word[chosen], minlength=len(self.vocabulary))
        return Postings(self.owner[chosen], self.position[chosen], np.concatenate([[0], np.cumsum(times)]), agree)

    def find(self, words: B.Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of licence words, and the word's number in the vocabulary."""

        at = np.searchsorted(self.vocabulary, words.hashes)
        at[at == len(self.vocabulary)] = 0
        known = np.flatnonzero(self.vocabulary[at] == words.hashes)
        return known, at[known]


def word_hashes(words: Sequence[str]) -> np.ndarray:
    data, offsets = B.text_bytes(pa.array([" ".join(words)]))
    return B.words_of(data, offsets, B.ALNUM).hashes


def document_frequencies(docs: DataFrame, index: Index, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Over all documents: how many hold each licence word, and how many documents there are."""

    size = len(index.vocabulary)

    def count(batches):
        for batch in batches:
            data, offsets = B.text_bytes(batch["text"])
            held = np.zeros(size + 1, np.int64)
            held[size] = len(offsets) - 1
            for begin, end in B.pieces(offsets):
                at = offsets[begin]
                words = B.words_of(B.LOWER[data[at : offsets[end]]], offsets[begin : end + 1] - at, B.ALNUM)
                places, number = index.find(words)
                pairs = np.unique(words.doc[places] * size + number)
                held[:size] += np.bincount(pairs % size, minlength=size)
            yield pa.RecordBatch.from_pydict({"word": np.arange(size + 1), "docs": held})

    counted = docs.select(col(text_col).cast("string").alias("text")).mapInArrow(count, "word long, docs long")
    table = np.zeros(size + 1, np.int64)
    for row in counted.groupBy("word").agg(F.sum("docs").alias("docs")).collect():
        table[row["word"]] = row["docs"]
    return table[:size], int(table[size])


FIELDS = [
    ("n_words", "bigint"),
    ("n_base", "bigint"),
    ("first_word", "bigint"),
    ("last_word", "bigint"),
    ("base_labels", "array<string>"),
    ("found_labels", "array<string>"),
    ("found_spans", "array<struct<start:bigint,end:bigint>>"),
    ("score", "double"),
]


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), templates: dict[str, str] | None = None) -> DataFrame:
    """License notices of every whole text.

    Adds ``n_words``; ``n_base`` (places where a naming phrase stands), ``first_word`` and ``last_word`` (smallest
    and largest start of one, else null) and ``base_labels``; ``found_labels`` and ``found_spans`` (verified
    templates and the word ranges of their copies, merged); ``score`` (largest share of a verified template's words
    in place, at least 0.5 with a base label, else 0). Labels are distinct and sorted. Null and empty texts have no
    words. Words are runs of digits, letters and non-ASCII characters after A-Z are lower-cased.
    """

    index = Index(TEMPLATES if templates is None else templates)
    held, total = document_frequencies(docs, index, text_col)
    idf = np.log((total + 1) / (held + 1)) + 1e-9
    postings = index.look_up(idf)
    phrases = [(word_hashes(p.split()), label) for p, label in BASE.items()]

    def compute(texts: pa.Array) -> list[pa.Array]:
        data, offsets = B.text_bytes(texts)
        parts = [_scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], index, postings, phrases) for a, b in B.pieces(offsets)]
        if not parts:
            parts = [_scan(data, offsets, index, postings, phrases)]
        return [pa.concat_arrays(column) for column in zip(*parts)]

    return annotate(docs, text_col, compute, FIELDS, keep)


def _scan(data, offsets, index: Index, postings: Postings, phrases) -> list[pa.Array]:
    words = B.words_of(B.LOWER[data], offsets, B.ALNUM)
    rows, doc = len(offsets) - 1, words.doc
    base_places, base_names = [np.zeros(0, np.int64)], [[] for _ in range(rows)]
    for hashes, label in phrases:
        at = _stands(words, hashes, np.flatnonzero(words.hashes == hashes[0]))
        base_places.append(at)
        for row in np.unique(doc[at]).tolist():
            base_names[row].append(label)
    at = np.sort(np.concatenate(base_places))
    n_base = np.bincount(doc[at], minlength=rows)
    some = np.flatnonzero(n_base)
    edges = np.searchsorted(doc[at], some), np.searchsorted(doc[at], some, "right") - 1
    first, last = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    first[some] = at[edges[0]] - words.first[some]
    last[some] = at[edges[1]] - words.first[some]
    score = np.where(n_base > 0, 0.5, 0.0)
    names, hit = [set() for _ in range(rows)], np.zeros(len(doc), bool)
    for row, template, begin, share in _copies(words, index, postings):
        names[row].add(index.templates[template].label)
        score[row] = max(score[row], share)
        hit[max(begin, words.first[row]) : min(begin + len(index.templates[template].words), words.first[row + 1])] = True
    return [
        pa.array(words.counts, pa.int64()),
        pa.array(n_base, pa.int64()),
        pa.array(first, pa.int64(), mask=n_base == 0),
        pa.array(last, pa.int64(), mask=n_base == 0),
        pa.array([sorted(set(x)) for x in base_names], pa.list_(pa.string())),
        pa.array([sorted(x) for x in names], pa.list_(pa.string())),
        B.run_lists(hit, words.first),
        pa.array(score, pa.float64()),
    ]


def _stands(words: B.Words, phrase: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those places of one document each at which all words of the phrase follow."""

    end = words.first[1:][words.doc[at]]
    at = at[at + len(phrase) <= end]
    for step in range(1, len(phrase)):
        at = at[words.hashes[at + step] == phrase[step]]
    return at


def _repeated(row: np.ndarray, start: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs that stand there ``least`` times or more, in order."""

    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1])
    begins = np.flatnonzero(fresh)
    times = np.diff(np.append(begins, len(row)))
    begins = begins[times >= least]
    return row[begins], start[begins]


def _copies(words: B.Words, index: Index, postings: Postings):
    """Verified copies of templates: document, template, where the copy begins, share of its words in place."""

    places, number = index.find(words)
    times = postings.first[number + 1] - postings.first[number]
    posting = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - postings.first[number], times)
    kinds, begins = postings.owner[posting], np.repeat(places, times) - postings.position[posting]
    rows = np.repeat(words.doc[places], times)
    for kind, form in enumerate(index.templates):
        start, row = begins[kinds == kind], rows[kinds == kind]
        if not len(start):
            continue
        # A word and a posting meet once for each begin, so what repeats is agreed on by as many postings.
        row, start = _repeated(row, start, postings.agree[kind])
        low, high = words.first[row], words.first[row + 1]
        equal = np.zeros((len(start), len(form.words)), bool)
        for step, word in enumerate(form.words):
            at = start + step
            inner = (at >= low) & (at < high)
            equal[inner, step] = words.hashes[at[inner]] == word
        share = equal.sum(1) / len(form.words)
        sure = share >= LEAST_MATCH
        for a, b in form.phrases:
            sure &= equal[:, a:b].all(1)
        for i in np.flatnonzero(sure).tolist():
            yield int(row[i]), kind, int(start[i]), float(share[i])
