"""License scans: an exact set-similarity join of text blocks with license templates.

A block is any run of words a quarter longer than the template. Words are ordered by how rare they are in the whole
corpus. A block that holds a template's share of words must hold one of its rarest words, as many as the share leaves
room to miss; texts without one, or with too few of the template's words at all, are passed over. Around each such
word lie the blocks that can hold enough: where its rank and the words near it leave too little they are passed over
too, and in the rest the distinct words of every block are counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import lean
from .decontaminate import _slots, counts

#: Words of a block for each word of its template.
SPREAD = 1.25
#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.8
#: Templates of fewer words must stand word after word: as sets they would be found in texts that say something else.
ORDERED = 8
#: Phrases whose words must stand one after another, and the labels they give.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Label and words of each template.
TEMPLATES = [
    ("agpl-3", "affero general public license"),
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl-3", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of "
        "conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "apache-2",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the "
        "license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your "
        "option any later version",
    ),
]
FOUND = "doc_id long, n_words long, places array<struct<start: int, label: string>>, blocks array<struct<start: int, label: string, containment: double>>"


def hashes(words: list[str]) -> np.ndarray:
    data, off = X.buffers(pa.array([" ".join(words)]))
    return X.words(data, off, X.ALNUM).hash


class Index:
    """Templates as sorted sets of word numbers, rarest first, with their prefixes inverted."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], frequency: dict[int, int]):
        self.ordered = [(hashes(text.split()), label) for label, text in templates if len(text.split()) < ORDERED]
        templates = [(label, text) for label, text in templates if len(text.split()) >= ORDERED]
        words = [hashes(text.split()) for _, text in templates]
        sets = [sorted(set(h.tolist()), key=lambda h: (frequency.get(h, 0), h)) for h in words]
        self.length = [math.ceil(SPREAD * len(h)) for h in words]
        self.vocabulary = np.array(sorted({h for s in sets for h in s}), np.uint64)
        self.slots = _slots(self.vocabulary)
        number = {h: k for k, h in enumerate(self.vocabulary.tolist())}
        self.labels, self.need = [label for label, _ in templates], [math.ceil(CONTAINMENT * len(s) - 1e-9) for s in sets]
        self.size = [len(s) for s in sets]
        #: The rank of each word of the vocabulary in each template, rarest first; -1 for none.
        self.rank = np.full((len(templates), len(self.vocabulary)), -1, np.int32)
        for t, s in enumerate(sets):
            self.rank[t, [number[h] for h in s]] = np.arange(len(s))
        self.phrases = [(hashes(p.split()), label) for p, label in phrases.items()]


def places(w: X.Words, phrase: np.ndarray) -> np.ndarray:
    """Numbers of the words where ``phrase`` begins, inside one text."""
    n = len(w.hash) - len(phrase) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at = np.flatnonzero(w.hash[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[w.hash[at + k] == phrase[k]]
    of = lambda i: np.searchsorted(w.first, i, "right")
    return at[of(at) == of(at + len(phrase) - 1)]


def blocks(index: Index, w: X.Words) -> Iterator[tuple[int, int, int, float]]:
    """(text, first word, template, containment) of each run of overlapping blocks that hold enough of a template:
    the first word of the run and the greatest containment in it."""
    at = np.flatnonzero(index.slots[w.hash & np.uint64(len(index.slots) - 1)])
    number = np.minimum(np.searchsorted(index.vocabulary, w.hash[at]), len(index.vocabulary) - 1)
    known = index.vocabulary[number] == w.hash[at]
    at, number = at[known], number[known]
    of = np.searchsorted(w.first, at, "right") - 1
    for t, (need, size, length) in enumerate(zip(index.need, index.size, index.length, strict=True)):
        rank = index.rank[t, number]
        mine = np.flatnonzero(rank >= 0)
        # Texts with a word of the prefix, and with enough of the template's words anywhere.
        leads = np.unique(of[mine[rank[mine] <= size - need]])
        pairs = np.unique(of[mine].astype(np.int64) * size + rank[mine])
        full, held = np.unique(pairs // size, return_counts=True)
        for d in np.intersect1d(leads, full[held >= need]).tolist():
            own = mine[np.searchsorted(of[mine], d) : np.searchsorted(of[mine], d, "right")]
            yield from _runs(t, need, size, length, at[own] - w.first[d], rank[own], d)


def _runs(t: int, need: int, size: int, length: int, at: np.ndarray, rank: np.ndarray, d: int) -> Iterator[tuple[int, int, int, float]]:
    """The runs of one text: ``at`` and ``rank`` are the places and ranks of its template words, in order."""
    lead = at[rank <= size - need]
    near = np.searchsorted(lead, at + length) > np.searchsorted(lead, at)  # a block that begins here holds a prefix word
    end = np.searchsorted(at, at + length)
    before = np.full(len(at), -1)
    order = np.lexsort((at, rank))
    again = rank[order][1:] == rank[order][:-1]
    before[order[1:][again]] = order[:-1][again]
    last, start, best = -1, 0, 0
    for i in np.flatnonzero(near & (end - np.arange(len(at)) >= need)).tolist():
        here = slice(i, int(end[i]))
        fresh = before[here] < i
        # By position: the rarest word here leaves room for the words of higher rank only.
        if size - int(rank[here].min()) < need:
            continue
        both = int(fresh.sum())
        if both < need:
            continue
        if last >= 0 and at[i] < last:
            best = max(best, both)
        else:
            if last >= 0:
                yield d, start, t, best / size
            start, best = int(at[i]), both
        last = int(at[i]) + length
    if last >= 0:
        yield d, start, t, best / size


def find(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, places, blocks for every row of ``docs``; a null text has no words.

    ``places``: where a phrase's words stand consecutively, in order. ``blocks``: the runs of overlapping blocks that hold
    a share of :data:`CONTAINMENT` of a template's distinct words, and places of templates of fewer than :data:`ORDERED`
    words. Templates and phrases are parameters and small.
    Rows of any doc_id, null or repeated, are judged each by its own text; other columns are not read.
    """
    lean(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary = np.unique(np.concatenate([hashes(t.split()) for _, t in templates])) if templates else np.empty(0, np.uint64)
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, phrases, dict(zip(vocabulary.tolist(), counts(docs, vocabulary).tolist(), strict=True))))
    kinds = [pa.list_(pa.struct([("start", pa.int32()), ("label", pa.string())])), pa.list_(pa.struct([("start", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))]

    def run(batches):
        ix = index.value
        for batch in batches:
            for a, b, data, off in X.slices(batch.column(1)):
                w = X.words(data, off, X.ALNUM)
                at: list[list] = [[] for _ in range(b - a)]
                held: list[list] = [[] for _ in range(b - a)]
                for phrase, label in ix.phrases:
                    for p in places(w, phrase).tolist():
                        d = int(np.searchsorted(w.first, p, "right")) - 1
                        at[d].append({"start": p - int(w.first[d]), "label": label})
                for phrase, label in ix.ordered:
                    for p in places(w, phrase).tolist():
                        d = int(np.searchsorted(w.first, p, "right")) - 1
                        held[d].append({"start": p - int(w.first[d]), "label": label, "containment": 1.0})
                if len(ix.vocabulary) and len(w.hash):
                    for d, start, t, share in blocks(ix, w):
                        held[d].append({"start": start, "label": ix.labels[t], "containment": share})
                at = [sorted(x, key=lambda p: (p["start"], p["label"])) for x in at]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(w.first), pa.int64()), pa.array(at, kinds[0]), pa.array(held, kinds[1])], ["doc_id", "n_words", "places", "blocks"])

    return docs.mapInArrow(run, FOUND)


def op10(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``.

    ``score``: 1 where a phrase stands, else the greatest containment of a block found, else 0. Without labels
    the label columns are empty texts.
    """
    names = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    some = F.size("places") > 0
    return find(docs).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.when(some, F.col("places")[0]["start"]).cast("long").alias("first_word"), F.when(some, F.element_at("places", -1)["start"]).cast("long").alias("last_word"),
        joined(names("places")).alias("base_labels"), joined(F.concat(names("places"), names("blocks"))).alias("labels"),
        F.when(some, 1.0).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda x: x["containment"])), F.lit(0.0))).alias("score"),
    )
