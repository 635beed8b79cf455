"""Licence scans with a trained paragraph classifier.

Sparse word n-grams (1 to 3 words) feed a multinomial logistic regression over
licence families, the class ``unknown`` (licence talk of no known family) and
``none``. Lines are judged first; neighbouring lines that are not ``none``, or of
which at least CONFIRM of the word triples are a template's, form a paragraph (a wrapped notice is one), which is judged as a whole. Two lines
that each hold most of a template, of different families, begin paragraphs of
their own.

It is trained on variants of the templates (crops, dropped and inserted words)
and on lines of a bounded sample of the corpus (NEGATIVE_DOCS documents by a
hash of doc_id); lines that share template wording are left out. Its confidence
is calibrated by a temperature fitted on variants it has not seen and on talk of
licences that it was not trained on (OTHER_HELD): a family that does not reach
CONFIDENT is reported as ``unknown`` instead, if all licence classes together
reach it.

A predicted family is confirmed by its templates: at least CONFIRM of the
paragraph's 3-word shingles, or of a template's, are shared by the two, and the
paragraph has a word that names the family (NAMES) or LONG shared shingles.
Words of a sister family (DENIED) and other versions than the family's (VERSIONS)
deny it; a version that a sister has makes it the sister. One
that is not confirmed is reported as ``unknown`` too. Paragraphs of class
``none`` are not reported.

Rows: null text has no paragraphs; missing or repeated doc_id pass through;
other columns are ignored; an empty corpus trains on the templates alone. The
time for a text grows with its length, however many findings it has.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WORD, balanced, packed, run_hashes, runs, shingle_hashes, steps, table, word_hashes

CONFIDENT, CONFIRM, LONG = 0.6, 0.5, 8
NEGATIVE_DOCS, NEGATIVE_PARAGRAPHS, VARIANTS = 1000, 2000, 60
NONE, UNKNOWN = "none", "unknown"

# Notices and characteristic sentences of public licences.
TEMPLATES = {
    "agpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "gpl-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "gpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This work is licensed under the GNU General Public License, version 3.", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "Released under the MIT License.", "Licensed under the MIT License.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", "SPDX-License-Identifier: MIT"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense"],
}
# Licence talk of no known family.
OTHER = [
    "All rights reserved. No part of this work may be reproduced without written permission of the publisher.",
    "This software is proprietary and confidential. Unauthorized copying is strictly prohibited.",
    "Your use of this software is governed by the end user license agreement accepted at installation.",
    "Licensed to subscribers only under the terms of the commercial license agreement.",
    "Distributed under the terms of the house license; ask the author for a copy of the license.",
    "The licensee shall not sublicense, rent or lease the licensed material to any third party.",
    "Released under a custom license, see the license file for terms.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Eclipse Public License - v 2.0",
    "Licensed under the Common Development and Distribution License, version 1.0.",
    "This package is free software under the Artistic License 2.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: LicenseRef-Custom",
]
# More of it, kept from training to fit and test the calibration.
OTHER_HELD = [
    "Licensed under the European Union Public Licence, version 1.2.",
    "This font software is licensed under the SIL Open Font License, Version 1.1.",
    "Released under the Microsoft Public License.",
    "Licensed under the Academic Free License version 3.0.",
    "Licensed under the Open Software License version 3.0.",
    "SPDX-License-Identifier: PostgreSQL",
    "This code is licensed under the terms of the Sleepycat License.",
    "All content is licensed to the publisher; reuse requires a separate license.",
]
# Words that name a family.
NAMES = {
    "agpl-3.0": {"affero", "agpl"}, "apache-2.0": {"apache"}, "bsd": {"bsd"}, "cc-by": {"cc", "commons"}, "cc-by-nc": {"nc", "noncommercial"},
    "cc-by-sa": {"sa", "sharealike"}, "cc0": {"cc0", "waived"}, "gpl-2.0": {"gnu", "gpl"}, "gpl-3.0": {"gnu", "gpl"}, "isc": {"isc"},
    "lgpl": {"lesser", "lgpl"}, "mit": {"mit"}, "mpl-2.0": {"mozilla", "mpl"}, "unlicense": {"unlicense", "unencumbered"},
}

# Words of a sister family, which deny one, and the version that a family has.
_DERIVATIVES, _COMMERCIAL, _ALIKE = {"nd", "noderivatives", "noderivs"}, {"nc", "noncommercial"}, {"sa", "sharealike"}
DENIED = {"cc-by": _DERIVATIVES | _COMMERCIAL | _ALIKE, "cc-by-nc": _DERIVATIVES | _ALIKE, "cc-by-sa": _DERIVATIVES | _COMMERCIAL, "gpl-2.0": {"affero", "lesser"}, "gpl-3.0": {"affero", "lesser"}}
VERSIONS = {"agpl-3.0": "3", "apache-2.0": "2", "gpl-2.0": "2", "gpl-3.0": "3", "mpl-2.0": "2"}
SISTERS = {"gpl-2.0": "gpl-3.0", "gpl-3.0": "gpl-2.0"}
_VERSION = re.compile(r"\b(?:version|v)\.?\s{0,3}([0-9]+)|\b[al]?gpl[-v ]{0,2}([0-9]+)")

_LINE = np.ones(256, dtype=bool)
_LINE[[10, 13]] = False
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_WORDS_TEXT = re.compile(r"[0-9a-z]+")


def grams(words: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The 1, 2 and 3 word n-gram hashes of each paragraph, with their bounds."""
    return [(words, bounds), shingle_hashes(words, bounds, 2), shingle_hashes(words, bounds, 3)]


def shingles(text: str) -> set[bytes]:
    w = _WORDS.findall(text.encode().lower())
    return {b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


class Classifier:
    """Weights of known n-grams (sorted by hash) for every class."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, bias: np.ndarray, classes: list[str], temperature: float = 1.0):
        self.vocabulary, self.weights, self.bias, self.classes, self.temperature = vocabulary, weights, bias, classes, temperature
        self.templates = {f: [shingles(t) for t in ts] for f, ts in TEMPLATES.items()}

    def known(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(paragraph, n-gram) pairs of the vocabulary's n-grams; each counts once."""
        rows, at = [], []
        for h, b in grams(words, bounds):
            pos = np.searchsorted(self.vocabulary, h)
            pos[pos == len(self.vocabulary)] = 0
            hit = np.flatnonzero(self.vocabulary[pos] == h)
            rows.append(np.searchsorted(b, hit, side="right") - 1)
            at.append(pos[hit])
        pair = np.unique(np.concatenate(rows) * len(self.vocabulary) + np.concatenate(at))
        return pair // len(self.vocabulary), pair % len(self.vocabulary)

    def logits(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(paragraphs with a known n-gram, their logits); the rest have the bias alone."""
        row, at = self.known(words, bounds)
        rows, index = np.unique(row, return_inverse=True)
        out = np.zeros((len(rows), len(self.classes)))
        np.add.at(out, index, self.weights[at])
        count = np.maximum(np.diff(bounds)[rows], 1)
        return rows, out / np.sqrt(count)[:, None] + self.bias

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        z = z / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def compared(self, family: str, text: str) -> tuple[float, float, bool]:
        """Shared shingles as a share of the paragraph's and of the most alike
        template's, and whether they confirm the family."""
        own = shingles(text)
        both = [(len(own & t), len(t)) for t in self.templates.get(family, []) if own and t]
        if not both:
            return 0.0, 0.0, False
        mine, theirs, shared = max(n for n, _ in both) / len(own), max(n / size for n, size in both), max(n for n, _ in both)
        named = not NAMES[family].isdisjoint(w.decode("utf-8", "replace") for w in _WORDS.findall(text.encode().lower()))
        return mine, theirs, max(mine, theirs) >= CONFIRM and (named or shared >= LONG)

    def told_apart(self, family: str, text: str, following: str) -> str | None:
        """The family, or the sister whose version the text names, or else the line
        below it; None if its words or versions are those of a licence that is neither."""
        low = text.lower()
        if not DENIED.get(family, set()).isdisjoint(_WORDS_TEXT.findall(low)):
            return None
        named = {a or b for a, b in _VERSION.findall(low) or _VERSION.findall(following.lower())}
        if family not in VERSIONS or not named or VERSIONS[family] in named:
            return family
        sister = SISTERS.get(family)
        return sister if sister and VERSIONS[sister] in named else None

    def scan(self, column: pa.Array) -> list[list[dict]]:
        data, ends = packed(column)
        low = LOWER[data]
        s, e, per_text = runs(low, ends, _LINE)
        ws, we, _ = runs(low, ends, WORD)
        h, bounds = run_hashes(low, ws, we), np.searchsorted(ws, np.append(s, len(low)))
        rows, z = self.logits(h, bounds)
        out: list[list[dict]] = [[] for _ in range(len(column))]
        none = self.classes.index(NONE)
        if not len(rows):
            return out
        told = self.probabilities(z).argmax(axis=1)
        # a piece of a wrapped notice may be no licence by itself, but its word triples are a template's
        triples, at = shingle_hashes(h, bounds, 3)
        pos = np.searchsorted(self.vocabulary, triples)
        pos[pos == len(self.vocabulary)] = 0
        known = np.concatenate(([0], np.cumsum(self.vocabulary[pos] == triples)))
        share = (known[at[1:]] - known[at[:-1]]) / np.maximum(np.diff(at), 1)
        taken = (told != none) | (share[rows] >= CONFIRM)
        lines = rows[taken].tolist()
        if not lines:
            return out
        # neighbouring lines make a paragraph: [first line, last line, family of a template held]
        parts: list[list] = []
        text_of = (np.searchsorted(per_text, lines, side="right") - 1).tolist()
        for at, t, c in zip(lines, text_of, told[taken].tolist()):
            a, b = int(s[at]), int(e[at])
            held = self.compared(self.classes[c], data[a:b].tobytes().decode())
            whole = c if held[1] >= CONFIRM and held[2] else None
            joins = parts and parts[-1][1] == at - 1 and parts[-1][3] == t and int(s[at]) - int(e[at - 1]) <= 2 and low[int(e[at - 1]) : a].tobytes() in (b"\n", b"\r\n", b"\r")
            if joins and (whole is None or parts[-1][2] in (None, whole)):
                parts[-1][1] = at
                parts[-1][2] = whole if parts[-1][2] is None else parts[-1][2]
            else:
                parts.append([at, at, whole, t])
        first, last = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
        size = bounds[last + 1] - bounds[first]
        own = np.concatenate(([0], np.cumsum(size)))
        words = h[np.repeat(bounds[first] - own[:-1], size) + np.arange(own[-1])]
        rows, z = self.logits(words, own)
        p = self.probabilities(z)
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        for i, row in enumerate(rows.tolist()):
            best = int(p[i].argmax())
            if best == none:
                continue
            a, b, t = int(s[first[row]]), int(e[last[row]]), parts[row][3]
            family, q, own_text = self.classes[best], float(p[i, best]), data[a:b].tobytes().decode()
            mine, theirs, confirmed = self.compared(family, own_text)
            below = int(last[row]) + 1
            following = data[int(s[below]) : int(e[below])].tobytes().decode() if below < per_text[t + 1] else ""
            family = self.told_apart(family, own_text, following) if confirmed else None
            if q < CONFIDENT or family is None:
                if 1 - p[i, none] < CONFIDENT:
                    continue
                family = UNKNOWN
            start = int(points[a] - points[ends[t]])
            out[t].append({"family": family, "start": start, "stop": start + int(points[b] - points[a]), "probability": round(q, 6), "similarity": round(max(mine, theirs), 6)})
        return out


def variants(texts: list[str], n: int, filler: list[str], rng: random.Random) -> list[str]:
    out = []
    for k in range(n):
        words = texts[k % len(texts)].split()
        if k >= len(texts):
            if len(words) > 12 and rng.random() < 0.5:
                at = rng.randrange(len(words) - 8)
                words = words[at : at + rng.randint(8, len(words) - at)]
            words = [w for w in words if len(words) < 7 or rng.random() > 0.05]
            for _ in range(rng.randint(0, 3)):
                words.insert(rng.choice([0, len(words)]), rng.choice(filler))
        out.append(" ".join(words))
    return out


def train(negatives: list[str], n: int = VARIANTS, seed: int = 5, epochs: int = 200, rate: float = 0.5, decay: float = 1e-4) -> Classifier:
    """Full-batch gradient descent; the last fifth of all paragraphs, and OTHER_HELD, fit the temperature."""
    rng = random.Random(seed)
    filler = sorted({w for t in negatives[:200] for w in t.split()[:20]}) or ["lorem", "ipsum", "dolor"]
    known = {s for ts in TEMPLATES.values() for t in ts for s in shingles(t)}
    plain = [t for t in negatives if len(own := shingles(t)) and len(own & known) < 0.2 * len(own)] or ["lorem ipsum dolor sit amet"]
    # salads of the templates' own words are no licence: single words must not suffice
    own_words = sorted({w for ts in [*TEMPLATES.values(), OTHER] for t in ts for w in t.split()})
    plain += [" ".join(rng.choices(own_words, k=rng.choice([1, 1, 2, 4, 9])) + rng.choices(filler, k=rng.randint(0, 9))) for _ in range(len(TEMPLATES) * n // 2)]
    classes = [*TEMPLATES, UNKNOWN, NONE]
    texts, label = [], []
    for c, family in enumerate(classes):
        own = plain if family == NONE else variants(OTHER if family == UNKNOWN else TEMPLATES[family], n, filler, rng)
        texts += own
        label += [c] * len(own)
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts, y = [texts[i] for i in order], np.array([label[i] for i in order])
    words, bounds = word_hashes(pa.array(texts))
    licence = np.concatenate([h for h, _ in grams(*word_hashes(pa.array([*OTHER, *(t for ts in TEMPLATES.values() for t in ts)])))])
    vocabulary = np.unique(licence)
    model = Classifier(vocabulary, np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes)), classes)
    # a bounded number of paragraphs and n-grams: a dense matrix will do
    x = np.zeros((len(texts), len(vocabulary)), dtype=np.float32)
    row, at = model.known(words, bounds)
    x[row, at] = (1 / np.sqrt(np.maximum(np.diff(bounds), 1)))[row]
    cut = len(texts) * 4 // 5
    weight = np.where(y[:cut] == classes.index(NONE), len(classes) * n / max(1, (y == classes.index(NONE)).sum()), 1.0)
    weight /= weight.sum()
    for _ in range(epochs):
        p = model.probabilities(x[:cut] @ model.weights.astype(np.float32) + model.bias)
        p[np.arange(cut), y[:cut]] -= 1
        p *= weight[:, None]
        model.weights -= rate * 40 * (x[:cut].T @ p.astype(np.float32) + decay * model.weights / len(classes))
        model.bias -= rate * p.sum(axis=0)
    held_words, held_bounds = word_hashes(pa.array(OTHER_HELD))
    held = np.zeros((len(OTHER_HELD), len(vocabulary)), dtype=np.float32)
    row, at = model.known(held_words, held_bounds)
    held[row, at] = (1 / np.sqrt(np.maximum(np.diff(held_bounds), 1)))[row]
    z = np.vstack([x[cut:], held]) @ model.weights.astype(np.float32) + model.bias
    truth = np.concatenate([y[cut:], np.full(len(held), classes.index(UNKNOWN))])
    if len(z):

        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(model.probabilities(z)[np.arange(len(z)), truth] + 1e-12).mean()

        model.temperature = min((0.05 * 1.25**k for k in range(20)), key=loss)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = NEGATIVE_DOCS) -> Classifier:
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = slim.select("doc_id").count()
    share = (1 << 32) if total <= most else int((1 << 32) * most / total)
    seed = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)), F.lit(0)) < F.lit(share)
    lines = slim.where(seed & F.col("doc_id").isNotNull()).select(F.explode(F.split("text", "\n")).alias("line")).where("length(trim(line)) between 1 and 5000")
    # at most NEGATIVE_PARAGRAPHS lines of at most 5,000 characters, by hash: bounded on the driver
    got = lines.distinct().orderBy(F.xxhash64("line"), "line").limit(NEGATIVE_PARAGRAPHS).collect()
    return train([r.line for r in got])


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, findings) for every row: family, start, stop (code points),
    probability and similarity of each reported paragraph."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("probability", pa.float64()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.scan(b.column("text")), kind)], names=["doc_id", "findings"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return balanced(slim).mapInArrow(run, "doc_id long, findings array<struct<family:string,start:long,stop:long,probability:double,similarity:double>>")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))
    span = lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["stop"].cast("string"))
    return found.select("doc_id", F.size("findings").cast("long").alias("n_findings"), F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda x: x["family"]))), ",").alias("families"), F.array_join(F.transform("findings", span), ",").alias("spans"))
