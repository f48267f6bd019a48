"""Licence scans with a trained paragraph classifier.

A paragraph is a line of a document or a block of several lines between blank ones,
so that a licence wrapped over lines is also seen whole. Its word n-grams (one to
three words, of those that occur in the templates) enter a logistic regression over
the licence families and the class "none". The classifier is fitted on variations of
the templates and on paragraphs of a bounded sample of documents. Its temperature,
and the probability below which a family is not named, come from classifiers
that were fitted without some of the templates: they are judged on those
templates, on variations of the others that they have not seen, and on paragraphs
left aside. A line that is no plain prose but names no family with that probability
is "unknown". A named family is confirmed when the paragraph covers enough of one of
its templates, and of what only that family says, and no template of another family
better.

Defined results: null and empty texts have no paragraphs; blank lines are none;
paragraphs of any length are scored whole; an empty table gives no rows and the
classifier is then fitted on the templates alone; repeated rows repeat their
result; families of equal probability go by name, and a template of another family
that is covered as well does not keep one from being confirmed; further columns are
not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.pieces import PieceHash

# The usual notices by which texts state a licence, and the paragraphs of short licences.
TEMPLATES: dict[str, list[str]] = {
    "AGPL": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "BSL": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0": ["Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "MIT": [
        "MIT License",
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced or distributed in any form without the prior written permission of the publisher."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "zlib": [
        "Released under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
}
# Sentences with words of licences that state none.
DECOYS = [
    "He lost his driving license on the way to the public library.", "The commission of the general assembly is free to modify the terms.", "The source of the river lies above the apache village.",
    "Permission to land was granted by the tower.", "The software was released in May and the code was modified later.", "A lesser general would have followed the old notice.",
    "Every person in the public square had a copy of the document.", "The foundation of the house is in good condition.", "The creative people of the commons met again, in writing or in person.",
]
ORDERS = (1, 2, 3)
SAMPLE_DOCS, VARIATIONS = 300, 24
#: Share of a template that a paragraph has to cover; classifiers fitted without some templates.
CONFIRM, FOLDS = 0.6, 6
#: A template of fewer word pairs, which prose may quote, has to make up a quarter of the paragraph.
SHORT = 4
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def _words(paragraph: str) -> list[bytes]:
    return _WORD.findall(paragraph.lower().encode("utf-8", "surrogatepass"))


def ngram_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of every paragraph of a lower-cased buffer with one per line, and their paragraphs."""
    flat = np.frombuffer(buffer, dtype=np.uint8)
    letter = (flat >= 0x80) | ((flat >= 97) & (flat <= 122)) | ((flat >= 48) & (flat <= 57))
    step = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).view(np.int8)))
    starts, ends = step[0::2], step[1::2]
    owner = np.cumsum(flat == 10)[starts] if len(starts) else np.zeros(0, dtype=np.int64)
    word = PieceHash(flat)(starts, ends)
    out, of = [], []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            m = max(0, len(word) - n + 1)
            h = np.full(m, n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ word[k : m + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
            inside = owner[:m] == owner[n - 1 : n - 1 + m] if m else np.zeros(0, dtype=bool)
            out.append(h[inside])
            of.append(owner[:m][inside])
    return np.concatenate(out), np.concatenate(of)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


@dataclass
class Classifier:
    families: list[str]
    features: np.ndarray  # sorted hashes
    weights: np.ndarray  # feature x class, the last class is "none"
    bias: np.ndarray
    temperature: float = 1.0
    sure: float = 0.9

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.features >> np.uint64(44)).astype(np.int64)] = True

    def matrix(self, paragraphs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Paragraph and feature of each n-gram that is known, once each."""
        hashes, owner = ngram_hashes("\n".join(p.replace("\n", " ") for p in paragraphs).lower().encode("utf-8", "surrogatepass"))
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.features, hashes[at]), len(self.features) - 1)
        ok = self.features[place] == hashes[at]
        pairs = np.unique(owner[at[ok]].astype(np.int64) * len(self.features) + place[ok])
        return pairs // len(self.features), pairs % len(self.features)

    def logits(self, paragraphs: list[str]) -> np.ndarray:
        row, feature = self.matrix(paragraphs)
        return np.stack([np.bincount(row, self.weights[feature, c], len(paragraphs)) for c in range(len(self.bias))], axis=1) + self.bias

    def probabilities(self, paragraphs: list[str]) -> np.ndarray:
        return softmax(self.logits(paragraphs) / self.temperature)


def vary(template: str, draw: np.random.Generator, count: int) -> list[str]:
    """Variations of a template: words dropped, years and names put in, cut at either end, upper case."""
    words = template.split()
    out = [template]
    while len(out) < count:
        w = [x for x in words if draw.random() > 0.06] if len(words) > 8 else list(words)
        if len(w) > 14 and draw.random() < 0.3:
            w = w[int(draw.integers(0, 5)) : len(w) - int(draw.integers(0, 5))]
        w = [str(max(1, int(x[0]) + int(draw.integers(-1, 2)))) + x[1:] if re.fullmatch(r"\d[\d.,]*", x) and draw.random() < 0.4 else x for x in w]
        text = " ".join(w)
        kind = draw.random()
        if kind < 0.2:
            text = f"Copyright (c) {int(draw.integers(1995, 2025))} the authors. {text}"
        elif kind < 0.3:
            text = text.upper()
        out.append(text)
    return out


def _bigrams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Pairs of neighbouring words, all numbers alike."""
    words = [b"0" if w.isdigit() else w for w in words]
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else {tuple(words)}


def covered(templates: list[tuple[str, str]]) -> dict[str, list[tuple[set, set]]]:
    """For each family the word pairs of its templates, and those of them that no other family has."""
    pairs = [(family, _bigrams(_words(text))) for family, text in templates]
    out: dict[str, list[tuple[set, set]]] = {}
    for family, own in pairs:
        others = set().union(*(p for f, p in pairs if f != family))
        out.setdefault(family, []).append((own, own - others))
    return out


COVERED = covered([(family, text) for family, texts in TEMPLATES.items() for text in texts])


def compare(paragraph: str, family: str, known: dict[str, list[tuple[set, set]]] = COVERED) -> tuple[float, bool]:
    """The greatest share of a template of ``family`` that a paragraph covers, and whether it confirms the family.

    It does when the share is large enough, no template of another family is covered
    better, half of what sets the family's template apart is there, and the paragraph
    does not just mention a very short template.
    """
    own = _bigrams(_words(paragraph))
    share = {f: max((len(own & pairs) / len(pairs), len(own & alone) >= 0.5 * len(alone) and (len(pairs) >= SHORT or len(own) <= 4 * len(pairs))) for pairs, alone in each) for f, each in known.items()}
    alike, apart = share.get(family, (0.0, False))
    return alike, apart and alike >= CONFIRM and alike >= max(a for a, _ in share.values())


def _regression(families: list[str], templates: list[str], texts: list[str], y: np.ndarray, steps: int, rate: float) -> Classifier:
    """Logistic regression on the n-grams of ``templates``, each class of equal weight; the last class is "none"."""
    features = np.unique(ngram_hashes("\n".join(templates).lower().encode())[0])
    classes = len(families) + 1
    model = Classifier(families, features, np.zeros((len(features), classes)), np.zeros(classes))
    row, feature = model.matrix(texts)
    x = np.zeros((len(texts), len(features) + 1), dtype=np.float32)
    x[row, feature] = 1.0
    x[:, -1] = 1.0  # for the bias
    goal = np.eye(classes, dtype=np.float32)[y]
    weight = (1 / np.maximum(np.bincount(y, minlength=classes), 1))[y, None].astype(np.float32) / classes
    w = np.zeros((len(features) + 1, classes), dtype=np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = x.T @ (weight * (p / p.sum(axis=1, keepdims=True) - goal)) + 1e-5 * w
        m += 0.1 * (g - m)
        v += 0.02 * (g * g - v)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-5)
    model.weights, model.bias = w[:-1].astype(float), w[-1].astype(float)
    return model


def fit_paragraphs(negatives: list[str], seed: int = 3, steps: int = 120, rate: float = 0.1) -> Classifier:
    """Train on template variations and negative paragraphs.

    Each of ``FOLDS`` further classifiers does without a share of the templates and of
    all other texts. What they say of the texts left out that are confirmed, or state
    no licence, shapes the temperature; the threshold is the smallest probability from
    which on 97 of 100 confirmed families are right.
    """
    draw = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    texts, y, template = [], [], []
    every = [(i, t) for i, f in enumerate(families) for t in TEMPLATES[f]]
    for k, (i, t) in enumerate(every):
        made = vary(t, draw, VARIATIONS)
        texts += made
        y += [i] * len(made)
        template += [k] * len(made)
    none = [*DECOYS * 5, *[""] * 20, *negatives]
    texts += none
    y = np.array(y + [len(families)] * len(none))
    template = np.array(template + [-1] * len(none))
    template_fold = draw.permutation(len(every)) % FOLDS
    text_fold = draw.integers(0, FOLDS, len(texts))
    logits, truth, confirmed = [], [], []
    for fold in range(FOLDS):
        unseen = (template >= 0) & (template_fold[template] == fold)
        learn = ~unseen & (text_fold != fold)
        seen = [(families[i], t) for (i, t), f in zip(every, template_fold, strict=True) if f != fold]
        part = _regression(families, [t for _, t in seen], [t for t, on in zip(texts, learn, strict=True) if on], y[learn], steps, rate)
        judged = [t for t, f in zip(texts, text_fold, strict=True) if f == fold]
        said, known = part.logits(judged), covered(seen)
        logits.append(said)
        truth.append(y[text_fold == fold])
        confirmed += [z.argmax() < len(families) and compare(t, families[int(z.argmax())], known)[1] for t, z in zip(judged, said, strict=True)]
    logits, truth = np.concatenate(logits), np.concatenate(truth)
    model = _regression(families, [t for _, t in every], texts, y, steps, rate)

    decided = np.flatnonzero(np.array(confirmed) | (truth == len(families)))

    def loss(temperature: float) -> float:
        return float(-np.log(np.maximum(softmax(logits[decided] / temperature)[np.arange(len(decided)), truth[decided]], 1e-12)).mean())

    model.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.5), key=loss)
    p = softmax(logits / model.temperature)
    shown = np.flatnonzero(confirmed)
    named, right = p[shown, :-1].max(axis=1), p[shown, :-1].argmax(axis=1) == truth[shown]
    order = np.argsort(-named, kind="stable")
    fine = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= 0.97)
    model.sure = float(max(0.5, named[order][fine[-1]])) if fine.size else 1.0
    return model


def split_paragraphs(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lines that are not blank, and the ranges of them that form a block of several."""
    lines: list[str] = []
    blocks, first = [], 0
    for line in [*text.split("\n"), ""]:
        if line.strip():
            lines.append(line)
            continue
        if len(lines) - first > 1:
            blocks.append((first, len(lines)))
        first = len(lines)
    return lines, blocks


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Classifier:
    """Fit with paragraphs of ``sample_docs`` documents, in a seeded order, as prose: ten for each document at most, by lot among all.

    Paragraphs of the sample that resemble a template are left out, as they may state a licence.
    """
    narrow = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = F.xxhash64(F.lit(5), "id").alias("o")
    ids = narrow.select("id", order).filter("id is not null").distinct().orderBy("o").limit(sample_docs)  # ids only; texts follow for those picked
    rows = narrow.join(F.broadcast(ids), "id").groupBy("o").agg(F.max("text").alias("text")).collect()
    texts = []
    for _, t in sorted((r.o, r.text or "") for r in rows)[:sample_docs]:
        lines, blocks = split_paragraphs(t)
        texts += lines + ["\n".join(lines[a:b]) for a, b in blocks]
    known = [pairs for each in COVERED.values() for pairs, _ in each]
    prose = [p for p in texts if not any(len(own & k) >= 0.25 * len(k) for own in (_bigrams(_words(p)),) for k in known)]
    if len(prose) > 10 * sample_docs:
        prose = [prose[i] for i in np.sort(np.random.default_rng(5).choice(len(prose), 10 * sample_docs, replace=False))]
    return fit_paragraphs(prose)


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """One row per document: doc_id, n_paragraphs and its findings.

    A finding is (paragraph, lines, family, probability, similarity, confirmed), where
    ``paragraph`` numbers the lines that are not blank and ``lines`` says how many of
    them it takes; ``n_paragraphs`` is their number. The family is "unknown" for a line
    that is not prose and names none surely. A block of several lines is a finding
    when it confirms a family that none of its lines does.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "struct<paragraph:int,lines:int,family:string,probability:double,similarity:double,confirmed:boolean>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for batch in batches:
            parts = np.cumsum([len(t) if isinstance(t, str) else 0 for t in batch.text]) // block_chars
            for part in np.unique(parts):
                rows = batch[parts == part]
                texts, owner, first, size, count = [], [], [], [], []
                for i, t in enumerate(rows.text):
                    lines, blocks = split_paragraphs(t) if isinstance(t, str) else ([], [])
                    texts += lines + ["\n".join(lines[a:b]) for a, b in blocks]
                    owner += [i] * (len(lines) + len(blocks))
                    first += [*range(len(lines)), *(a for a, _ in blocks)]
                    size += [1] * len(lines) + [b - a for a, b in blocks]
                    count.append(len(lines))
                found: list[list[dict]] = [[] for _ in range(len(rows))]
                p = net.probabilities(texts) if texts else np.zeros((0, 1))
                for k in np.flatnonzero(p[:, -1] < 0.5).tolist():
                    c = int(p[k, :-1].argmax())
                    named = bool(p[k, c] >= net.sure)
                    alike, sure = compare(texts[k], net.families[c])
                    family = net.families[c] if named else "unknown"
                    inside = range(first[k], first[k] + size[k])
                    if size[k] > 1 and (not (named and sure) or any(f["confirmed"] and f["family"] == family and f["paragraph"] in inside for f in found[owner[k]])):
                        continue
                    found[owner[k]].append({"paragraph": first[k], "lines": size[k], "family": family, "probability": float(p[k, c]), "similarity": alike, "confirmed": named and sure})
                yield pd.DataFrame({"doc_id": rows.doc_id, "n_paragraphs": count, "findings": found})

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInPandas(run, f"doc_id long, n_paragraphs long, findings array<{kind}>")
