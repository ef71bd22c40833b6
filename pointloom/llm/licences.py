"""Licence scans: a trained paragraph classifier, confirmed by templates.

Paragraphs (lines) are classified by a multinomial logistic regression on
sparse word n-grams (one and two words).  It is trained here, on notices built
from the templates below with words dropped, swapped or added, and on texts of
no licence; so there is a class ``unknown``, and probabilities are calibrated by
a temperature fitted on held-out notices.  A prediction counts once the words
of the family's best template are found in the paragraph.

A notice inside a long paragraph, or wrapped over lines, is found by windows of
about a notice's length, across single line ends.  Only windows with the share of
a template's word pairs that a notice needs are classified; no other could count.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import textnum as tn

CHUNK = 2 << 20
#: Least calibrated probability, and least share of a template's pairs of following words.
SURE, ALIKE = 0.6, 0.7
#: Words that a window may have besides a template's, and words around it that its class must agree with.
SPARE, AROUND = 6, 2
UNKNOWN = "unknown"
#: Words: digits, a-z (after lower-casing A-Z), full stops inside numbers are separators.
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True

#: Short notices of each family.
TEMPLATES = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "This project is available under the terms of the MIT licence"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License", "Distributed under the Apache License 2.0"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL v3", "either version 3 of the License, or (at your option) any later version"],
    "gpl-2.0": ["Licensed under the GNU General Public License, version 2.", "This program is free software; GNU GPL v2", "either version 2 of the License, or (at your option) any later version"],
    "lgpl": ["Licensed under the GNU Lesser General Public License", "under the terms of the LGPL version 2.1"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the BSD 3-Clause License", "Licensed under the two clause BSD license"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License", "This work is licensed under a Creative Commons Attribution NonCommercial license"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License"],
    "cc0": ["Dedicated to the public domain under CC0 1.0.", "CC0 1.0 Universal Public Domain Dedication"],
    "isc": ["Licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "all-rights-reserved": ["All rights reserved.", "Copyright 2020. All rights reserved.", "No part of this publication may be reproduced without prior written permission"],
}

#: Short identifiers of the families; a notice of each is a template too.
IDENTIFIERS = {
    "mit": "MIT", "apache-2.0": "Apache-2.0", "gpl-3.0": "GPL-3.0-or-later", "gpl-2.0": "GPL-2.0-only", "lgpl": "LGPL-2.1-or-later", "bsd": "BSD-3-Clause",
    "mpl-2.0": "MPL-2.0", "cc-by-nc": "CC-BY-NC-4.0", "cc-by-sa": "CC-BY-SA-4.0", "cc-by": "CC-BY-4.0", "cc0": "CC0-1.0", "isc": "ISC",
}
for _family, _name in IDENTIFIERS.items():
    TEMPLATES[_family].append(f"SPDX-License-Identifier: {_name}")

#: Sentences with words of notices that grant nothing.
PLAIN = [
    "The driver renewed the license of the car last week.",
    "A version of the story was released in the morning.",
    "Public transport is free of charge for any person over seventy.",
    "The general asked for permission to use the bridge.",
    "This work was done by hand and with great care.",
    "The apache helicopter flew over the valley.",
    "Students at MIT built a robot in four days.",
    "Creative people work in common rooms.",
    "The source of the river is in the mountains.",
    "All rights and duties of members are listed in the statutes.",
    "The software was sold without any warranty card.",
    "A copy of the letter was sent to the public library.",
    "He reserved all seats in the first row.",
    "The terms of the contract were subject to approval.",
    "International trade grew by 4 percent in the year 2020.",
    "Version 3 of the plan was better than version 2.",
]


def _words(text: str) -> list[str]:
    low = text.translate({k: k + 32 for k in range(65, 91)})
    return "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in low).split()


def _noise(rng: random.Random) -> str:
    return "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9)))


def examples(seed: int, each: int = 60) -> list[tuple[list[str], str]]:
    """(words, family) of varied notices and of paragraphs without one."""
    rng = random.Random(seed)
    out = []
    for family, templates in TEMPLATES.items():
        for _ in range(each):
            words = [w for w in _words(rng.choice(templates)) if rng.random() > 0.06]
            extra = [_noise(rng) for _ in range(rng.choice([0, 0, 0, 2, 6]))]
            out.append((words + extra if rng.random() < 0.5 else extra + words, family))
    pool = sorted({w for ts in TEMPLATES.values() for t in ts for w in _words(t)})
    for _ in range(each * len(TEMPLATES) // 2):
        kind = rng.random()
        if kind < 0.4:
            words = [w for w in _words(rng.choice(PLAIN)) if rng.random() > 0.1]
        else:
            words = [rng.choice(pool) if rng.random() < 0.25 else _noise(rng) for _ in range(rng.randint(1, 40))]
        out.append((words, UNKNOWN))
    return out


def hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    start, end, _ = tn.words(data, np.array([0, len(data)]), INSIDE)
    return tn.Sums(data).spans(start, end)


def pairs_of(hashes: np.ndarray) -> np.ndarray:
    """Hash of each word and the next."""
    return tn.mix(hashes[:-1] * tn.U(3) + hashes[1:] * tn.U(0x9E3779B97F4A7C15))


class Model:
    """n-grams (sorted hashes), weights by n-gram and class, and the temperature."""

    def __init__(self, seed: int = 11, rounds: int = 300):
        self.families = [*TEMPLATES, UNKNOWN]
        rows = [(hash_words(w), f) for w, f in examples(seed)]
        held = [(hash_words(w), f) for w, f in examples(seed + 1, 30)]
        grams = [np.concatenate((h, pairs_of(h))) for h, _ in rows]
        known, counts = np.unique(np.concatenate(grams), return_counts=True)
        self.grams = known[counts > 1]
        x = np.stack([self._vector(h) for h, _ in rows])
        y = np.array([self.families.index(f) for _, f in rows])
        self.weights = np.zeros((len(self.grams), len(self.families)))
        self.bias = np.zeros(len(self.families))
        hot = np.eye(len(self.families))[y]
        for _ in range(rounds):
            miss = (_softmax(x @ self.weights + self.bias) - hot) / len(x)
            self.weights -= 30 * (x.T @ miss + 1e-5 * self.weights)
            self.bias -= 3 * miss.sum(0)
        hx, hy = np.stack([self._vector(h) for h, _ in held]), np.array([self.families.index(f) for _, f in held])
        logits = hx @ self.weights + self.bias
        losses = {t: -np.log(_softmax(logits / t)[np.arange(len(hy)), hy] + 1e-12).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
        self.temperature = min(losses, key=losses.get)
        self.templates = [[frozenset(pairs_of(hash_words(_words(t))).tolist()) for t in TEMPLATES[f]] for f in TEMPLATES]
        #: (family, words, pairs) of each template, all pairs in order, and which templates have a pair.
        self.notices = [(k, len(_words(t)), len(self.templates[k][j])) for k, f in enumerate(TEMPLATES) for j, t in enumerate(TEMPLATES[f])]
        flat = [t for ts in self.templates for t in ts]
        self.pairs = np.array(sorted(frozenset().union(*flat)), np.uint64)
        self.has = np.array([[p in t for t in flat] for p in self.pairs.tolist()])

    def _vector(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.grams))
        for part in (hashes, pairs_of(hashes)):
            at = np.minimum(np.searchsorted(self.grams, part), len(self.grams) - 1)
            out[at[self.grams[at] == part]] = 1
        return out / np.sqrt(max(2 * len(hashes) - 1, 1))

    def chances(self, hashes: np.ndarray, paragraph: np.ndarray, n: int) -> np.ndarray:
        """Calibrated probability of each class for each of ``n`` paragraphs."""
        logits = np.zeros((n, len(self.families)))
        seen = []
        near = paragraph[1:] == paragraph[:-1]
        for part, own in ((hashes, paragraph), (pairs_of(hashes)[near], paragraph[1:][near])):
            at = np.minimum(np.searchsorted(self.grams, part), len(self.grams) - 1)
            hit = np.flatnonzero(self.grams[at] == part)
            seen.append(own[hit].astype(np.int64) * len(self.grams) + at[hit])
        found = np.unique(np.concatenate(seen))
        np.add.at(logits, found // len(self.grams), self.weights[found % len(self.grams)])
        size = np.bincount(paragraph, minlength=n)
        logits = logits / np.sqrt(np.maximum(2 * size - 1, 1))[:, None] + self.bias
        return _softmax(logits / self.temperature)

    def classes(self, hashes: np.ndarray, paragraph: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Most probable class of each of ``n`` paragraphs, and its calibrated probability."""
        p = self.chances(hashes, paragraph, n)
        best = p.argmax(1)
        return best, p[np.arange(n), best]

    def windows(self, hashes: np.ndarray, block: np.ndarray, alike: float) -> list[tuple[int, int, int, float]]:
        """(first word, end, family, share) of the windows within a block that have enough of a template's pairs."""
        pairs = pairs_of(hashes)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        hit = np.flatnonzero((self.pairs[at] == pairs) & (block[1:] == block[:-1]))
        has = self.has[at[hit]]
        out = []
        for t, (family, words, size) in enumerate(self.notices):
            own = hit[has[:, t]]
            need = max(1, math.ceil(alike * size - 1e-9))
            if len(own) < need:
                continue
            span = words + SPARE
            first, last = own[: len(own) - need + 1], own[need - 1 :]
            for k in np.flatnonzero((last - first + 2 <= span) & (block[first] == block[last])).tolist():
                end = int(np.searchsorted(own, own[k] + span - 2, "right"))
                inner = own[k:end]
                inner = inner[block[inner] == block[own[k]]]
                share = len(np.unique(at[inner])) / size
                if share >= alike:
                    out.append((int(own[k]), int(inner[-1]) + 2, family, share))
        return out

    def notices_in(self, hashes: np.ndarray, block: np.ndarray, sure: float, alike: float) -> list[tuple[int, int, int, float, float]]:
        """(first word, end, family, probability, share) of all windows that count, the best first.

        A window and the words around it must speak for the same family; the more
        probable of the two gives the probability.
        """
        found = self.windows(hashes, block, alike)
        if not found:
            return []
        begin, end, family = (np.array(c) for c in list(zip(*found, strict=True))[:3])
        wide = np.searchsorted(block, block[begin]), np.searchsorted(block, block[begin], "right")
        chances = []
        for a, b in ((begin, end), (np.maximum(begin - AROUND, wide[0]), np.minimum(end + AROUND, wide[1]))):
            own = np.repeat(np.arange(len(a)), b - a)
            places = np.arange(len(own)) + np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a)
            chances.append(self.chances(hashes[places], own, len(a)))
        agree = np.all([c[:, : len(TEMPLATES)].argmax(1) == family for c in chances], axis=0)
        p = np.max([c[np.arange(len(family)), family] for c in chances], axis=0)
        rows = [(*found[k][:3], float(p[k]), found[k][3]) for k in np.flatnonzero(agree & (p >= sure)).tolist()]
        return sorted(rows, key=lambda r: (-r[4], -r[3], r[0], r[1]))

    def confirm(self, family: int, hashes: np.ndarray) -> float:
        """Largest share of a template's word pairs that the paragraph has."""
        own = set(pairs_of(hashes).tolist())
        return max((len(t & own) / len(t) for t in self.templates[family] if t), default=0.0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def model() -> Model:
    return Model()


FOUND = "n_paragraphs long, licences array<struct<paragraph:int,family:string,probability:double,alike:double>>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", sure: float = SURE, alike: float = ALIKE) -> DataFrame:
    """``n_paragraphs`` (lines with words) and the licence paragraphs of every document.

    Paragraphs are numbered from 0 by line; a wrapped notice has the number of its
    first line.  A paragraph has one entry for each of its families.  Null and empty
    texts have none; repeated rows and null keys each have their row.  Other columns
    are not looked at, whatever their names.
    """
    trained = model()
    sent = docs.sparkSession.sparkContext.broadcast(trained)  # some thousand n-grams
    unknown = len(TEMPLATES)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        struct = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("alike", pa.float64())]))
        for batch in tn.sliced(batches, "text", CHUNK):
            data, offsets = tn.packed(batch.column("text"))
            low = tn.lower_ascii(data)
            # a line is a row of its own: cut rows at line ends
            ends = np.flatnonzero(low == 10) + 1
            cuts = np.unique(np.concatenate((offsets, ends)))
            if not len(cuts) or cuts[0]:
                cuts = np.concatenate(([0], cuts))
            start, end, first = tn.words(low, cuts, INSIDE)
            hashes = tn.Sums(low).spans(start, end)
            line = tn.row_of(first)
            lines = len(cuts) - 1
            row = np.searchsorted(offsets, cuts[:-1], "right") - 1 if lines else np.zeros(0, np.int64)
            filled = np.diff(first) > 0
            n_paragraphs = np.bincount(row[filled], minlength=batch.num_rows)
            out: list[list] = [[] for _ in range(batch.num_rows)]
            if len(hashes):
                best, p = m.classes(hashes, line, lines)
                head = np.searchsorted(row, np.arange(batch.num_rows))
                # blocks: lines of a row that follow one another, all with words
                block = np.cumsum(np.concatenate(([0], (np.diff(line) > 1) | (np.diff(row[line]) > 0))))
                found: dict[tuple[int, int], tuple[float, float]] = {}
                for k in np.flatnonzero(filled & (best != unknown) & (p >= sure)).tolist():
                    share = m.confirm(int(best[k]), hashes[first[k] : first[k + 1]])
                    if share >= alike:
                        found[k, int(best[k])] = float(p[k]), share
                taken = np.zeros(len(hashes), bool)
                windows = m.notices_in(hashes, block, sure, alike)
                whole = {k for k, _ in found}
                left = []
                for window in windows:
                    a, b, family = window[:3]
                    lines_of = [k for k in range(int(line[a]), int(line[b - 1]) + 1) if (k, family) in found]
                    if lines_of:  # the notice of a line that was found
                        taken[a:b] = True
                        whole.difference_update(lines_of)
                    else:
                        left.append(window)
                for k in whole:
                    taken[first[k] : first[k + 1]] = True
                for a, b, family, chance, share in left:
                    if not taken[a:b].any():
                        taken[a:b] = True
                        found.setdefault((int(line[a]), family), (chance, share))
                for (k, family), (chance, share) in sorted(found.items()):
                    out[row[k]].append({"paragraph": int(k - head[row[k]]), "family": m.families[family], "probability": round(chance, 6), "alike": round(share, 6)})
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n_paragraphs, pa.int64()), pa.array(out, struct)], names=["key", "n_paragraphs", "licences"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, {FOUND}").withColumnRenamed("key", key)


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of all documents."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    families = F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"])))
    return found.select("doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"), F.array_join(families, ",").alias("families"))
