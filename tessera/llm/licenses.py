"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are lines; a line of more than SPAN words is read in overlapping spans. So is each run of
lines without a blank one between them, comment marks left out, so that notices wrapped over lines are
found; what such spans find counts for the line they begin in. A span's word
1- to 3-grams, lower-cased and hashed, feed a sparse multinomial logistic regression over licence
families, one class for licences of no family here, and one for everything else. It is trained on the
driver from varied copies of TEMPLATES and OTHER_LICENCES and a bounded sample of corpus spans that
resemble none. A temperature calibrates it, fitted on fresh variants and on corpus spans that the
training didn't see; a family is predicted only at CONFIDENCE or more. If a paragraph isn't plainly
other text and has no such family, it is "unknown". A prediction is confirmed if the paragraph holds
at least CONTAINMENT of the 2-grams of a template of that family.

Edge cases: null and empty texts have no paragraph; blank lines are none; repeated rows and ties
(equal confidence: the family first in the alphabet) give equal results; an empty table gives an empty table;
texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_bound, mix64, raw_texts, scan_words, slices

FEATURE_BITS = 16
SPAN = 48
STEP = 24
CONFIDENCE = 0.8
CONTAINMENT = 0.6
NEGATIVES = 4000
OTHER, UNKNOWN = "other", "unknown"
#: Longest corpus span, in characters, that serves as a counter-example.
SPAN_CHARS = 4096
#: Common public notices of each family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "This project is released under the Apache License 2.0.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "bsd": ("Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "This work is licensed under the BSD 3-Clause License.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "Released under the GPL v3.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "You should have received a copy of the GNU General Public License along with this program."),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License."),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "mpl": ("Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "proprietary": ("All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher.", "This document is confidential and proprietary."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
}
#: Common public notices of licences that have no family above; they teach the unknown class.
OTHER_LICENCES: tuple[str, ...] = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "You may distribute this package under the terms of the Artistic License.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License. You may not use this file except in compliance with the License.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "This program and the materials that accompany it are made available under the terms of the Common Public License, which is available at the following address.",
    "The author disclaims all warranties with regard to this software. In no event shall the author be liable for any special, direct, indirect or consequential damages.",
    "Use, copying, modification and distribution of this software and its documentation for any purpose are permitted without fee, provided that the above notice appears in all copies.",
    "Released under the terms of the Open Software License. See the file LICENSE for details of the license.",
)
FAMILIES = (OTHER, UNKNOWN, *sorted(TEMPLATES))
SCHEMA = "doc_id long, n_paragraphs long, n_licensed long, families string, n_unknown long, n_confirmed long, confidence double, first_paragraph long"


def wrapped_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As spans_of(), for spans that run over the ends of lines: those of each run of non-blank lines, by the line they begin in."""
    hashes, start, end, counts, joined = scan_words(texts, lower=True)
    z = np.zeros(0, np.int64)
    if not len(hashes):
        return hashes, z, z, z, z
    doc = np.repeat(np.arange(len(texts)), counts)
    data = np.frombuffer(joined, np.uint8)
    line = np.searchsorted(np.flatnonzero(data == 10), start)
    head = np.concatenate(([True], np.diff(line) != 0))
    number = np.cumsum(head) - 1
    number -= number[np.searchsorted(doc, doc)]
    # a word of comment marks alone that begins a line is none; a line of marks alone is blank
    letters = np.concatenate(([0], np.cumsum(~np.isin(data, np.frombuffer(b"#*/;-!%<>|", np.uint8)))))
    word = ~(head & (letters[end] == letters[start]))
    hashes, doc, line, number = hashes[word], doc[word], line[word], number[word]
    if not len(hashes):
        return hashes, z, z, z, z
    run = np.concatenate(([True], (np.diff(line) > 1) | (np.diff(doc) != 0)))
    at = np.flatnonzero(run)
    size = np.diff(np.concatenate((at, [len(hashes)])))
    lines = np.add.reduceat(np.concatenate(([1], (np.diff(line) != 0).astype(np.int64))) | run, at)
    at, size = at[lines > 1], size[lines > 1]  # a run of one line is a paragraph as it is
    pieces = np.maximum(1, -(-(size - SPAN) // STEP) + 1)
    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(at, pieces) + k * STEP
    return hashes, doc[first], number[first], first, np.minimum(SPAN, np.repeat(at + size, pieces) - first)


def spans_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, text, paragraph, first word, words) of each span of each non-blank line."""
    hashes, start, _, counts, joined = scan_words(texts, lower=True)
    n = len(hashes)
    z = np.zeros(0, np.int64)
    if not n:
        return hashes, z, z, z, z
    doc = np.repeat(np.arange(len(texts)), counts)
    breaks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
    line = np.searchsorted(breaks, start)
    at = np.flatnonzero(np.concatenate(([True], np.diff(line) != 0)))
    size = np.diff(np.concatenate((at, [n])))
    owner = doc[at]
    number = np.arange(len(at)) - np.searchsorted(owner, owner)
    pieces = np.maximum(1, -(-(size - SPAN) // STEP) + 1)
    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(at, pieces) + k * STEP
    words = np.minimum(SPAN, np.repeat(at + size, pieces) - first)
    return hashes, np.repeat(owner, pieces), np.repeat(number, pieces), first, words


def gram_features(hashes: np.ndarray, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature of each gram, grams of each span): all 1-, 2- and 3-grams inside the spans."""
    n = len(hashes)
    grams = [hashes]
    for size in (2, 3):
        g = np.zeros(n, np.uint64)
        if n >= size:
            for j in range(size):
                g[: n - size + 1] += hashes[j : n - size + 1 + j] * np.uint64(pow(0xA24BAED4963EE407, j + size, 1 << 64))
        grams.append(mix64(g + np.uint64(size)))
    ids = np.stack(grams, axis=1) >> np.uint64(64 - FEATURE_BITS)
    at = np.arange(words.sum()) - np.repeat(np.cumsum(words) - words, words)
    left = np.repeat(words, words) - at
    rows = ids[np.repeat(first, words) + at].astype(np.int64)
    inside = left[:, None] > np.arange(3)
    return rows[inside], np.maximum(1, 3 * words - 3 + (words == 1))


@dataclass
class LicenseModel:
    """Weights [features, families], bias, and the temperature that calibrates them."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Class probabilities of spans."""
        at = np.cumsum(sizes) - sizes
        logits = (np.add.reduceat(self.weights[features], at, axis=0) / np.sqrt(sizes)[:, None] + self.bias) / self.temperature
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _bigrams(hashes: np.ndarray) -> set[int]:
    return set((hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]).tolist())


def template_grams() -> list[tuple[int, frozenset[int]]]:
    """(family, 2-grams) of each template."""
    return [(k, frozenset(_bigrams(scan_words([x.encode()], lower=True)[0]))) for k, f in enumerate(FAMILIES) for x in TEMPLATES.get(f, ())]


def _variants(rng: np.random.Generator, noise: list[list[bytes]], copies: int) -> tuple[list[bytes], list[int]]:
    """Copies of the templates with words lost, exchanged or added around them."""
    texts, labels = [], []
    for k, family in enumerate(FAMILIES):
        for template in OTHER_LICENCES if family == UNKNOWN else TEMPLATES.get(family, ()):
            for c in range(copies):
                words = template.encode().split()
                if c and len(words) > 4:
                    words = [w for w in words if rng.random() > 0.06]
                if c % 3 == 1 and noise:
                    words = noise[rng.integers(len(noise))][: rng.integers(1, 12)] + words
                if c % 4 == 2 and noise:
                    words = words + noise[rng.integers(len(noise))][: rng.integers(1, 12)]
                texts.append(b" ".join(words))
                labels.append(k)
    return texts, labels


def fit(negatives: list[bytes], seed: int = 3) -> LicenseModel:
    """AdaGrad with an L1 shrink on varied templates and corpus spans; the temperature on fresh variants and every fifth span, which training leaves out."""
    rng = np.random.default_rng(seed)
    own = [*template_grams(), *((1, frozenset(_bigrams(scan_words([x.encode()], lower=True)[0]))) for x in OTHER_LICENCES)]
    plain = []
    for x in negatives:
        grams = _bigrams(scan_words([x], lower=True)[0])
        if grams and not any(len(grams & g) > 0.2 * len(g) for _, g in own):
            plain.append(x)
    unseen, plain = plain[::5], [x for k, x in enumerate(plain) if k % 5]
    noise = [x.split() for x in plain]
    texts, labels = _variants(rng, noise, 24)
    texts, labels = texts + plain, np.array(labels + [0] * len(plain))
    hashes, doc, _, first, words = spans_of(texts)
    labels = labels[doc]
    features, sizes = gram_features(hashes, first, words)
    ends = np.cumsum(sizes)
    m = LicenseModel(np.zeros((1 << FEATURE_BITS, len(FAMILIES))), np.zeros(len(FAMILIES)), 1.0)
    g, gb = np.full(m.weights.shape, 1e-6), np.full(len(FAMILIES), 1e-6)
    for epoch in range(8):
        order = rng.permutation(len(sizes))
        for a in range(0, len(order), 64):
            rows = order[a : a + 64]
            size = sizes[rows]
            f = features[np.repeat(ends[rows] - size - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            err = m.probabilities(f, size)
            err[np.arange(len(rows)), labels[rows]] -= 1
            used, where = np.unique(f, return_inverse=True)
            each = np.repeat(err / np.sqrt(size)[:, None], size, axis=0)
            grad = np.column_stack([np.bincount(where, each[:, k]) for k in range(len(FAMILIES))]) / len(rows)
            g[used] += grad**2
            stepped = m.weights[used] - 0.3 * grad / np.sqrt(g[used])
            m.weights[used] = np.sign(stepped) * np.maximum(0, np.abs(stepped) - 1e-5)
            db = err.mean(axis=0)
            gb += db**2
            m.bias -= 0.1 * db / np.sqrt(gb)
    fresh, truth = _variants(rng, [x.split() for x in unseen], 6)
    hashes, doc, _, first, words = spans_of(fresh + unseen)
    truth = np.array(truth + [0] * len(unseen))[doc]
    features, sizes = gram_features(hashes, first, words)

    def loss(t: float) -> float:
        m.temperature = t
        return -np.log(np.maximum(1e-12, m.probabilities(features, sizes)[np.arange(len(truth)), truth])).mean()

    m.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    return m


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LicenseModel:
    """Fit with at most NEGATIVES spans of the corpus: one of one line of each of the first documents by a hash, both chosen by it."""
    total = docs.count()
    # the hash bound comes first, so that only the documents it lets through are split
    keyed = docs.select(F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    some = keyed.where(hash_bound("key", total, NEGATIVES)).select("key", lines.alias("lines")).where(F.size("lines") > 0)
    words = F.filter(F.split(F.get("lines", F.pmod("key", F.greatest(F.lit(1), F.size("lines"))).cast("int")), r"[ \t\x0B\f\r]+"), lambda w: w != "")
    picked = some.select("key", words.alias("words")).where(F.size("words") > 0)
    span = F.slice("words", (F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), F.ceil(F.size("words") / STEP))) * STEP + 1).cast("int"), SPAN)
    spans = picked.select("key", F.array_join(span, " ").alias("span")).where(F.length("span") <= SPAN_CHARS)
    return fit([r["span"].encode() for r in spans.orderBy("key", "span").limit(NEGATIVES).collect()])  # NEGATIVES rows of SPAN_CHARS at most


def scan_licenses(docs: DataFrame, model: LicenseModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence findings of every whole text: families that were confirmed, and how many paragraphs were licensed or unknown."""
    model = model or train(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(LicenseModel(model.weights.astype(np.float32), model.bias.astype(np.float32), model.temperature))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, templates = shared.value, template_grams()
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
        for batch in slices(batches, 1, 1 << 20):
            raw = raw_texts(batch.column(1))
            found: dict[int, dict[int, tuple[float, int, bool]]] = {}
            for hashes, doc, number, first, words in (whole := spans_of(raw), wrapped_spans(raw)):
                if not len(doc):
                    continue
                p = m.probabilities(*gram_features(hashes, first, words))
                likely = np.flatnonzero(p[:, 0] < 0.5)
                for s in likely.tolist():
                    family = int(p[s, 1:].argmax()) + 1
                    sure, unknown = float(p[s, family]), family == 1 or p[s, family] < CONFIDENCE
                    grams = _bigrams(hashes[first[s] : first[s] + words[s]])
                    confirmed = not unknown and any(k == family and len(grams & g) >= CONTAINMENT * len(g) for k, g in templates)
                    of = found.setdefault(int(doc[s]), {})
                    if hashes is not whole[0] and not confirmed:
                        continue  # each line has been judged by itself; a wrapped span counts if it is confirmed
                    old = of.get(int(number[s]))
                    new = (sure, 0 if unknown else family, confirmed)
                    if old is None or (new[2], new[0]) > (old[2], old[0]):
                        of[int(number[s])] = new
            doc, number = whole[1], whole[2]
            paragraphs = np.bincount(doc[np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(number) != 0)))], minlength=batch.num_rows) if len(doc) else np.zeros(batch.num_rows, np.int64)
            rows = []
            for k, ident in enumerate(batch.column(0).to_pylist()):
                own = found.get(k, {})
                sure = [x for x in own.values() if x[2]]
                rows.append(
                    (ident, int(paragraphs[k]), len([x for x in own.values() if x[1]]), ",".join(sorted({FAMILIES[x[1]] for x in sure})), len([x for x in own.values() if not x[1]]), len(sure), max((x[0] for x in sure), default=None), min((n for n, x in own.items() if x[2]), default=None))
                )
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
