"""License scans by a positional index of rare words.

The index is made from license texts and notices.  A first pass over all documents counts how many hold each word of theirs; the ``RARE`` words of a
template that the fewest documents hold are its postings, each with its positions in the template.  A second pass reads every text whole:

1.  Words become numbers.  The file's licence words are looked up in the postings, rarest first; a template goes on if the file has half of its rare words.
2.  A word at place p of the file and q of the template speaks for a start at p - q.  Starts that half of the rare words agree on, give or take the
    template's slack, are candidates: an intersection of postings by relative position, which inserted names and dates don't disturb.
3.  A candidate counts if every mandatory phrase of the template stands in its window word by word, none of the phrases that exclude it does, and the words in
    the window cover ``SHARE`` of the template's weight (the sum of its words' inverse document frequencies, repeated words once each time).

Base phrases are found by the same postings, exactly: the places of a phrase's rarest word, less its own, that all its other words confirm.

A text is kept as one number a word, and nothing depends on other rows but the word counts, of which the driver gets one for each word of the templates.

Defined cases: null counts as empty text, without words, labels or places, score 0.  An empty table gives an empty result.  Texts are scanned one by one, so ties, repeated
rows and null ids need no care.  Places count words from 0; ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BLOCK_BYTES, fresh, sliced, text_or_empty, tidied

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
RARE, SHARE = 8, 0.6
#: How many words past a window an excluding phrase is looked for.
PAST = 64

#: Fixed base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Template:
    """A license text or notice, phrases that must stand in it and phrases that mean another license."""

    label: str
    text: str
    keys: tuple[str, ...]
    unless: tuple[str, ...] = ()


AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
#: Fixed texts: the licenses' own words.
TEMPLATES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        f"subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {AS_IS}",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template("mit", "Released under the MIT License.", ("the mit license",)),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template("bsd-2", REDISTRIBUTION, ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce"), ("neither the name",)),
    Template(
        "bsd-3",
        f"{REDISTRIBUTION} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ("redistribution and use in source and binary forms", "used to endorse or promote products derived from this software"),
    ),
    Template(
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at. "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        ("you may not use this file except in compliance with the license",),
    ),
    Template(
        "gpl-2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        f"either version 2 of the License, or (at your option) any later version. {HOPE} See the GNU General Public License for more details.",
        ("gnu general public license", "version 2 of the license"),
    ),
    Template(
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        f"either version 3 of the License, or (at your option) any later version. {HOPE} See the GNU General Public License for more details.",
        ("gnu general public license", "version 3 of the license"),
    ),
    Template("gpl-2", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license version 2",)),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    Template(
        "lgpl-3",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        f"either version 3 of the License, or (at your option) any later version. {HOPE.replace('program', 'library')} See the GNU Lesser General Public License for more details.",
        ("gnu lesser general public license", "version 3 of the license"),
    ),
    Template(
        "lgpl-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        f"either version 2.1 of the License, or (at your option) any later version. {HOPE.replace('program', 'library')} See the GNU Lesser General Public License for more details.",
        ("gnu lesser general public license", "version 2 1 of the license"),
    ),
    Template(
        "agpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        f"either version 3 of the License, or (at your option) any later version. {HOPE} See the GNU Affero General Public License for more details.",
        ("gnu affero general public license", "version 3 of the license"),
    ),
    Template(
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("mozilla public license v 2 0",),
    ),
    Template("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", ("eclipse public license",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    Template("cc-by", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative commons attribution sharealike",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc by sa",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative commons attribution noncommercial",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ("waived all copyright and related or neighboring rights",)),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("free and unencumbered software released into the public domain",),
    ),
    Template(
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
        ("permission is granted to anyone to use this software for any purpose",),
    ),
    Template(
        "bsl-1",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software.",
        ("any person or organization obtaining a copy of the software",),
    ),
    Template("all-rights-reserved", "All rights reserved.", ("all rights reserved",)),
)


class Numbers(dict):
    """Numbers of the templates' words; -1 for any other."""

    def __missing__(self, word):
        return -1


def words_of(text: str | bytes) -> list[bytes]:
    return WORD.findall((text.encode() if isinstance(text, str) else text).translate(LOWER))


@lru_cache(maxsize=1)
def numbers() -> Numbers:
    """The words of all templates and base phrases, numbered in order."""
    every = {w for t in TEMPLATES for x in (t.text, *t.keys, *t.unless) for w in words_of(x)} | {w for p, _ in BASE for w in words_of(p)}
    return Numbers((w, k) for k, w in enumerate(sorted(every)))


def numbered(text: bytes) -> np.ndarray:
    """The number of each word of a text, which is read in parts cut between words."""
    get, found, at = numbers().__getitem__, [], 0
    while at < len(text):
        cut = BREAK.search(text, at + BLOCK_BYTES)
        end = cut.start() if cut else len(text)
        found.append(np.array(list(map(get, WORD.findall(text[at:end].translate(LOWER)))), dtype=np.int16))
        at = end
    return np.concatenate(found) if found else np.empty(0, dtype=np.int16)


def places(ids: np.ndarray, phrase: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Where ``phrase`` begins in ``ids``: postings of its rarest word, met by the others at their relative positions."""
    order = sorted(range(len(phrase)), key=lambda k: (-weights[phrase[k]], k))
    starts = np.flatnonzero(ids == phrase[order[0]]) - order[0]
    starts = starts[(starts >= 0) & (starts + len(phrase) <= len(ids))]
    for k in order[1:]:
        starts = starts[ids[starts + k] == phrase[k]]
    return starts


class Index:
    """Postings, phrases and weights of the templates, given inverse document frequencies."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        as_ids = lambda text: np.array([numbers()[w] for w in words_of(text)], dtype=np.int16)
        self.base = [(as_ids(p), label) for p, label in BASE]
        self.templates = []
        for t in TEMPLATES:
            ids = as_ids(t.text)
            rare = sorted(set(ids.tolist()), key=lambda w: (-weights[w], w))[:RARE]
            postings = {w: np.flatnonzero(ids == w) for w in rare}
            counts = np.bincount(ids, minlength=len(weights))
            slack = max(4, len(ids) // 8)
            self.templates.append((t.label, len(ids), slack, rare, postings, counts, float((counts * weights).sum()), [as_ids(x) for x in t.keys], [as_ids(x) for x in t.unless]))

    def matches(self, ids: np.ndarray) -> Iterator[tuple[str, int, int, float]]:
        """(label, start, end, share of the weight) of each template that stands in ``ids``; of candidates that overlap, the best."""
        there = np.flatnonzero(np.bincount(ids[ids >= 0], minlength=len(self.weights)))
        have = set(there.tolist())
        for label, size, slack, rare, postings, counts, total, keys, unless in self.templates:
            own, need = [w for w in rare if w in have], (len(rare) + 1) // 2
            if len(own) < need:
                continue
            stand = [(k, places(ids, k, self.weights)) for k in keys]
            if not all(len(x) for _, x in stand):
                continue
            votes = []
            for k, w in enumerate(own):
                start = (np.flatnonzero(ids == w)[:, None] - postings[w]).ravel() // slack
                votes.append(np.unique(np.concatenate((start, start - 1))) * RARE + k)
            bins, agree = np.unique(np.sort(np.concatenate(votes)) // RARE, return_counts=True)
            last = None
            for b in bins[agree >= need].tolist():
                low, high = max(b * slack, 0), min((b + 2) * slack + size, len(ids))
                if high <= low or not all(_inside(x, low, high - len(k)) for k, x in stand):
                    continue
                window = ids[low:high]
                share = float((np.minimum(np.bincount(window[window >= 0], minlength=len(counts)), counts) * self.weights).sum()) / total if total else 0.0
                beyond = ids[low : high + PAST]
                if share < SHARE or any(len(places(beyond, x, self.weights)) for x in unless):
                    continue
                found = (label, low, high, round(min(share, 1.0), 6))
                if last and low < last[2]:
                    last = max(last, found, key=lambda x: (x[3], -x[1]))
                else:
                    if last:
                        yield last
                    last = found
            if last:
                yield last

    def scanned(self, text: bytes) -> dict:
        ids = numbered(text)
        starts = [(label, places(ids, phrase, self.weights)) for phrase, label in self.base]
        every = np.concatenate([x for _, x in starts])
        base = {label for label, x in starts if len(x)}
        found = sorted(self.matches(ids), key=lambda x: (x[1], x[2], x[0]))
        return {
            "n_words": len(ids), "n_base": len(every), "first_word": int(every.min()) if len(every) else None, "last_word": int(every.max()) if len(every) else None,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {x[0] for x in found})), "score": 1.0 if base else max((x[3] for x in found), default=0.0),
            "found": [{"label": x[0], "start": x[1], "end": x[2], "score": x[3]} for x in found],
        }


def _inside(starts: np.ndarray, low: int, last: int) -> bool:
    """Is one of the ascending ``starts`` from ``low`` to ``last``?"""
    k = np.searchsorted(starts, low)
    return bool(k < len(starts) and starts[k] <= last)


def word_weights(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The inverse document frequency of each word of the templates, over all rows of ``docs``, and 1, so that none weighs nothing."""

    def run(batches):
        import pyarrow as pa

        held, n = np.zeros(len(numbers()), dtype=np.int64), 0
        for batch in sliced(batches):
            for x in batch.column(0).cast(pa.binary()):
                ids = numbered(x.as_py())
                held += np.bincount(ids[ids >= 0], minlength=len(held)) > 0
                n += 1
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *there], pa.int32()), pa.array([n, *held[there]], pa.int64())], names=["word", "n"])

    found = docs.select(text_or_empty(text_col).alias("t")).mapInArrow(tidied(run), "word int, n long").groupBy("word").agg(F.sum("n"))
    n = dict(found.collect())  # one row for each word of the templates
    return np.array([1 + log((n.get(-1, 0) + 1) / (n.get(k, 0) + 1)) for k in range(len(numbers()))])


FIELDS = "n_words:long, n_base:long, first_word:long, last_word:long, base_labels:string, labels:string, score:double, found:array<struct<label:string,start:long,end:long,score:double>>"


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one more column, the last: a struct of word and base counts, labels, score and what was found where."""
    index, out, at = Index(word_weights(docs, text_col)), fresh("licenses", docs), docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        found = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        longs = [(x, pa.int64()) for x in ("n_words", "n_base", "first_word", "last_word")]
        kind = pa.struct([*longs, ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("found", found)])
        for batch in sliced(batches):
            made = [index.scanned(x.as_py() or b"") for x in batch.column(at).cast(pa.string()).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], names=[f"c{k}" for k in range(batch.num_columns + 1)])

    typed = [f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema)]
    flat = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return flat.mapInArrow(tidied(run), ", ".join([*typed, f"c{len(typed)} struct<{FIELDS}>"])).toDF(*docs.columns, out)
