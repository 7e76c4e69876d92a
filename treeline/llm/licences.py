"""Licence scans: a trained paragraph classifier with template confirmation.

Sparse word 1- and 2-gram multinomial logistic regression tells licence families from each other, from licence
talk of no family and from ordinary text. It is trained on varied and cut template texts against a bounded sample
of the corpus's own lines. Every line is classified; a line that no template confirms is joined with its
neighbours of the same kind, as notices are often wrapped, and the paragraph they make is classified again. The
`unknown` class, whose probability is calibrated on held-back examples, takes paragraphs that speak like a licence
but of no family with enough probability; a family is confirmed by comparing the paragraph with its templates.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import id_text, slices, tidy

# Notices and key sentences of well-known licences.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1 or later.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the 2-clause BSD license.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work; public domain dedication."],
}
#: Licence talk of no listed family, which trains the unknown class.
UNKNOWN = [
    "Licensed under the terms of our own commercial license agreement.",
    "All rights reserved. Copyright by the authors.",
    "Use of this software is governed by the licence agreement of the vendor.",
    "This license grants no rights to redistribute the software.",
    "Copyright (c) 2020 the contributors. Distributed under the company license.",
]
NONE, OTHER = "none", "unknown"
#: Paragraphs of the corpus in the training sample at most, from so many documents.
SAMPLE_DOCS = 500
SAMPLE_PARAGRAPHS = 4000
MIN_PROBABILITY = 0.5
MIN_SIMILARITY = 0.6
#: Training examples made of each template.
VARIANTS = 32
STEPS, RATE, RIDGE = 250, 2.0, 1e-5

_WORD = re.compile(r"[a-z0-9]+")
_TOKEN = re.compile(r"[a-z0-9]+|\n")


def words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(paragraph: str) -> set[str]:
    w = words(paragraph)
    return set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}


def similarity(paragraph: str, template: str) -> float:
    """Share of the template's 1- and 2-grams that the paragraph holds."""
    t = grams(template)
    return len(t & grams(paragraph)) / max(1, len(t))


def examples(background: list[str], seed: int = 5) -> list[tuple[str, int]]:
    """Training texts with their classes (0 ordinary, 1 unknown, then the families). Templates lose words, get
    ordinary words around them and are cut to pieces, as wrapped lines are. Licence talk of no family is UNKNOWN
    and templates whose family's own words (those of one family only) are replaced by ordinary ones."""
    r = random.Random(seed)
    filler = [w for p in background[:400] for w in p.split()[:20]] or ["text"]
    out = [(p, 0) for p in background]
    families = list(TEMPLATES)
    own = {f: {w for t in TEMPLATES[f] for w in words(t)} for f in families}
    own = {f: own[f] - set().union(*(own[g] for g in families if g != f)) for f in families}

    def vary(w: list[str], i: int) -> str:
        if i:
            w = [x for x in w if r.random() > 0.06] or w
        if i % 4 == 3 and len(w) > 12:
            n = r.randint(6, len(w))
            at = r.randint(0, len(w) - n)
            w = w[at : at + n]
        lead = r.randint(1, 6) if i % 3 == 2 else 0
        return " ".join(r.choices(filler, k=lead) + w + r.choices(filler, k=lead))

    for k, family in enumerate(families, 2):
        for template in TEMPLATES[family]:
            out += [(vary(template.split(), i), k) for i in range(VARIANTS)]
            masked = [r.choice(filler) if set(words(w)) & own[family] else w for w in template.split()]
            if " ".join(masked) != template:
                out += [(vary(masked, i), 1) for i in range(VARIANTS // 8)]
    for template in UNKNOWN:
        out += [(vary(template.split(), i), 1) for i in range(VARIANTS)]
    return out


class Model:
    """Vocabulary, weights and temperature; classes are NONE, OTHER, then the families."""

    def __init__(self, background: list[str], seed: int = 5):
        self.families = list(TEMPLATES)
        self.classes = [NONE, OTHER, *self.families]
        made = examples(background, seed)
        known = [words(t) for ts in [*TEMPLATES.values(), UNKNOWN] for t in ts]
        self.index = {w: i for i, w in enumerate(sorted({w for t in known for w in t}))}
        self.get = self.index.get
        self.pairs = np.unique(np.array([self.index[a] * len(self.index) + self.index[b] for t in known for a, b in zip(t, t[1:])], np.int64))
        x = np.zeros((len(made), len(self.index) + len(self.pairs) + 1), np.float32)
        for i, (t, _) in enumerate(made):
            x[i] = self.vector(t)
        label = np.array([y for _, y in made])
        y = np.eye(len(self.classes), dtype=np.float32)[label]
        weight = np.where(label == 0, 0.5 * (label > 0).sum() / max(1, (label == 0).sum()), 1.0)[:, None].astype(np.float32)
        held = np.arange(len(made)) % 5 == 4
        fit = ~held
        xf, yf, wf = x[fit], y[fit], weight[fit] / weight[fit].sum()
        self.weights = np.zeros((x.shape[1], len(self.classes)), np.float32)
        momentum = np.zeros_like(self.weights)
        for _ in range(STEPS):
            momentum = 0.9 * momentum + xf.T @ ((self._softmax(xf @ self.weights) - yf) * wf) + RIDGE * self.weights
            self.weights -= RATE * momentum
        # Calibration: the temperature that makes the held-back examples likeliest.
        logits, w = x[held] @ self.weights, weight[held][:, 0]
        loss = lambda t: -(w * np.log(np.maximum(1e-9, (self._softmax(logits / t) * y[held]).sum(1)))).sum()
        self.temperature = float(min(np.geomspace(0.1, 10, 81), key=loss))

    @staticmethod
    def _softmax(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line, feature) pairs, distinct and sorted, of all lines of texts one after another, the weight of a
        feature in each line, by all its words, known or not, and how many lines each text has."""
        found = [_TOKEN.findall(t.lower()) for t in texts]
        lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
        token = np.fromiter((self.get(w, -2 if w == "\n" else -1) for f in found for w in (*f, "\n")), np.int64)
        line = np.cumsum(token == -2) - (token == -2)
        pair = np.flatnonzero((token[:-1] >= 0) & (token[1:] >= 0))
        value = token[pair] * len(self.index) + token[pair + 1]
        at = np.minimum(np.searchsorted(self.pairs, value), len(self.pairs) - 1)
        known = self.pairs[at] == value
        one = np.flatnonzero(token >= 0)
        size = len(self.index) + len(self.pairs) + 1
        code = np.unique(np.r_[line[one] * size + token[one], line[pair[known]] * size + len(self.index) + at[known]])
        many = np.bincount(line[token != -2], minlength=int(lines.sum()))
        return code // size, code % size, (1 / np.sqrt(np.maximum(1, many))).astype(np.float32), lines

    def vector(self, paragraph: str) -> np.ndarray:
        v = np.zeros(len(self.index) + len(self.pairs) + 1, np.float32)
        _, at, weight, _ = self.features([paragraph.replace("\n", " ")])
        v[at] = weight[0]
        v[-1] = 1
        return v

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Class probabilities of every line of texts, one after another, and how many lines each text has."""
        line, feature, weight, lines = self.features(texts)
        n = int(lines.sum())
        many = np.bincount(line, minlength=n)
        logits = np.tile(self.weights[-1], (n, 1))
        some = np.flatnonzero(many)
        if len(some):
            first = np.r_[0, np.cumsum(many[some])[:-1]]
            logits[some] += np.add.reduceat(self.weights[feature] * weight[line][:, None], first, axis=0)
        return self._softmax(logits / self.temperature), lines

    def judge(self, paragraph: str, p: np.ndarray | None = None) -> tuple[str, float, float] | None:
        """(family or unknown, probability, similarity to the nearest template), or None for ordinary text."""
        if p is None:
            p = self.probabilities([paragraph.replace("\n", " ")])[0][0]
        if p[0] >= 0.5:
            return None
        own = grams(paragraph)
        near = np.array([max(len(g & own) / len(g) for g in map(grams, TEMPLATES[f])) for f in self.families])
        # Families that no template confirms are ruled out; the other classes share their probability.
        p = p * np.r_[1.0, 1.0, near >= MIN_SIMILARITY]
        p = p / max(1e-30, p.sum())
        k = int(np.argmax(p[2:]))
        if p[k + 2] >= MIN_PROBABILITY:
            return self.families[k], float(p[k + 2]), float(near[k])
        return (OTHER, float(1 - p[0]), float(near.max())) if p[0] < 0.5 else None

    def scan(self, texts: list[str]) -> list[tuple[int, list[dict]]]:
        """(paragraphs, matches) of every text."""
        p, lines = self.probabilities(texts)
        like = p[:, 0] < 0.5
        ends = np.cumsum(lines)
        out = []
        for text, a, b in zip(texts, (ends - lines).tolist(), ends.tolist()):
            if not text:
                out.append((0, []))
                continue
            spoken = np.flatnonzero(like[a:b])
            hits, runs, joined = [], [], 0
            if len(spoken):
                line = text.split("\n")
                for i in spoken.tolist():
                    got = self.judge(line[i], p[a + i])
                    if got and got[0] != OTHER:
                        hits.append((i, *got))
                    elif runs and runs[-1][-1] == i - 1:
                        runs[-1].append(i)
                    else:
                        runs.append([i])
                for run in runs:
                    if got := self.judge(" ".join(line[i] for i in run)):
                        joined += len(run) - 1
                        hits.append((run[0], *got))
            out.append((b - a - joined, [dict(zip(("paragraph", "family", "probability", "similarity"), h)) for h in sorted(hits)]))
        return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Background lines come from the documents smallest by hash of the id (a bounded sample); those that share
    most of their grams, or of a template's, with a template are left out of it."""
    texts = id_text(docs)
    chosen = texts.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    rows = texts.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", F.explode(F.split("text", "\n")).alias("p"))
    rows = rows.where("length(p) between 1 and 5000").select("p").distinct().orderBy(F.xxhash64("p"), "p").limit(SAMPLE_PARAGRAPHS).collect()
    known = [grams(t) for ts in [*TEMPLATES.values(), UNKNOWN] for t in ts]

    def ordinary(p: str) -> bool:
        own = grams(p)
        return all(2 * len(own & t) <= min(len(own), len(t)) for t in known)

    return Model([r["p"] for r in rows if ordinary(r["p"])])


def scan(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, n_paragraphs, n_licences, families, confirmed, matches) per row of docs; matches are
    (paragraph's first line from 0, family, probability, similarity).

    A paragraph is a line, or neighbouring lines that only speak like a licence together. Every line of a text
    is classified, however long text and line. Null and empty texts have no paragraph; equal texts get equal
    results; repeated rows get a row each; an empty table gives no rows; ties between classes go to the first
    listed; other columns are ignored.
    """
    model = train(docs, sample_docs)
    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                many, found = zip(*model.scan(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(many, pa.int32()), pa.array(found, kind)], names=["doc_id", "n_paragraphs", "matches"]
                )

    schema = "doc_id long, n_paragraphs int, matches array<struct<paragraph: int, family: string, probability: double, similarity: double>>"
    out = id_text(docs).mapInArrow(tidy(run), schema)
    families = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["family"])))
    return out.select(
        "doc_id",
        "n_paragraphs",
        F.size("matches").alias("n_licences"),
        families.alias("families"),
        F.exists("matches", lambda m: m["family"] != OTHER).alias("confirmed"),
        "matches",
    )
