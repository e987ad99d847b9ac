"""Licence scan by a trained paragraph classifier.

Templates of each family, varied (words dropped, added, cut off, mixed in with
prose), train a logistic regression on hashed word 1- to 3-grams, sparse: only
n-grams of the templates have weights. One more class, *unknown*, is trained on
paragraphs of other matter: generated prose about licences and copyright that
grants none, and stretches of at most ``STRETCH`` words from at most ``negatives``
documents (a bounded sample of them, which the classifier alone uses: those whose
texts hash least). A temperature fitted on held-out variants calibrates the
probabilities. A paragraph whose best class isn't unknown and has at least
``least`` probability is a finding; the share of the family's closest template
that the paragraph contains confirms it or not.

All paragraphs of all documents are scored, in full: a long one by stretches of
``STRETCH`` words, each half over the one before it, of which the surest counts,
so that a licence within other matter is found. Paragraphs are what blank lines
separate, or lines where a text has no blank line.

Defined cases: null and empty texts have no paragraph; a null id is kept as
null; equal rows give equal findings each; of equal probabilities the family first
in order wins; an empty table gives no rows (and the classifier is trained on
generated negatives alone); extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, Words, chunks, lean, mix

TEMPLATES: dict[str, list[str]] = {
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is released under the Apache 2.0 license.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This software is distributed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL version 2 or later.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal, public domain dedication."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear in all copies.", "Licensed under the ISC License."],
    "Proprietary": ["All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.", "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
_DECOYS = (
    "the driver lost a licence after the third offence and had to walk", "a fishing license is required on the lake from april to september", "the city council granted a liquor license to the new restaurant",
    "copyright law has changed a great deal since the version of the act that he knew", "the software was free and the general public liked it", "she read the terms of the contract twice before version two was signed",
    "poetic license allows the author to distribute blame without fee", "under the bridge the work was released to the public in the year of the flood", "the foundation published a copy of the report for any person who asked",
    "licensed plumbers may work in the county under the state code", "the restriction on use of water applies to all persons without limitation", "creative people share common ground and give attribution where it is due",
    "apache helicopters were seen over the base", "the mit campus is on the river", "mozilla opened an office in the city", "a gnu is a large antelope of the plains",
    "la licence de pêche est obligatoire", "die allgemeine öffentliche bibliothek ist frei", "el permiso de conducir se concede sin cargo", "this version is the second of the work and the first was lost",
)
FAMILIES = [*TEMPLATES, "unknown"]
NEGATIVES = 2000
LEAST = 0.5
#: Words that are classified at once, and of a document that is a negative.
STRETCH = 64
CONFIRM = 0.6
_SIZE = 1 << 18


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """(hash, text index) of the word 1- to 3-grams."""
    w = Words(texts, fold=True)
    out, doc = [], []
    for n in (1, 2, 3):
        g, at = w.ngrams(n)
        out.append(g * U64(2 * n + 1))
        doc.append(w.doc[at])
    return np.concatenate(out), np.concatenate(doc), w


def _vary(rng: np.random.Generator, text: str, noise: list[str]) -> str:
    words = text.split()
    keep = [w for w in words if rng.random() > 0.12] or words
    if len(keep) > 12 and rng.random() < 0.4:
        a = int(rng.integers(0, len(keep) // 3))
        keep = keep[a : a + int(rng.integers(8, len(keep)))]
    if rng.random() < 0.5:  # within other matter, up to a whole stretch of it
        room = len(keep) // 2 if rng.random() < 0.5 else STRETCH - len(keep)
        fill = [noise[int(k)] for k in rng.integers(0, len(noise), int(rng.integers(1, 1 + max(2, room))))]
        cut = int(rng.integers(0, len(fill) + 1))
        keep = fill[:cut] + keep + fill[cut:]
    return " ".join(keep)


class Classifier:
    """Sorted feature hashes, weights a class, bias, temperature."""

    def __init__(self, negatives: list[str], seed: int = 11, variants: int = 60, rounds: int = 150):
        rng = np.random.default_rng(seed)
        noise = " ".join(_DECOYS).split() + [w for t in negatives[:200] for w in t.split()[:20]]
        texts, labels = [], []
        for k, family in enumerate(TEMPLATES):
            for t in TEMPLATES[family]:
                for j in range(variants):
                    texts.append(t if j < 4 else _vary(rng, t, noise))
                    labels.append(k)
        vocabulary = " ".join(t for ts in TEMPLATES.values() for t in ts).split()
        for j in range(variants * 20):
            bag = [vocabulary[int(x)] if rng.random() < 0.5 else noise[int(y)] for x, y in zip(rng.integers(0, len(vocabulary), 14), rng.integers(0, len(noise), 14))]
            texts.append(" ".join(bag) if j % 2 else _vary(rng, _DECOYS[j // 2 % len(_DECOYS)], noise))
            labels.append(len(TEMPLATES))
        short = [" ".join(t.split()[: int(rng.integers(1, 9))]) for t in negatives]  # paragraphs of a few words too
        texts += negatives + short
        labels += [len(TEMPLATES)] * (len(negatives) + len(short))
        base, _, _ = grams(pa.array([t for ts in TEMPLATES.values() for t in ts] + list(_DECOYS)))
        self.features = np.unique(base)
        y = np.array(labels)
        held = rng.random(len(y)) < 0.2
        row, column, value = self._rows(pa.array(texts))
        n, f, c = len(y), len(self.features), len(FAMILIES)
        self.weights, self.bias = np.zeros((f, c)), np.zeros(c)
        hot = np.eye(c)[y]
        share = 1 / np.maximum(np.bincount(y[~held], minlength=c), 1)
        each = np.where(held, 0.0, share[y])
        each /= each.sum()
        grad2, bias2 = np.full((f, c), 1e-8), np.full(c, 1e-8)
        order = np.argsort(column, kind="stable")
        cs = column[order]
        first = np.flatnonzero(np.concatenate([[True], cs[1:] != cs[:-1]]))
        for _ in range(rounds):
            p = self._softmax(self._logits(row, column, value, n))
            d = (p - hot) * each[:, None]
            g = np.zeros_like(self.weights)
            g[cs[first]] = np.add.reduceat(d[row[order]] * value[order][:, None], first)
            g += 1e-6 * self.weights
            grad2 += g**2
            bias2 += d.sum(0) ** 2
            self.weights -= 0.5 * g / np.sqrt(grad2)
            self.bias -= 0.2 * d.sum(0) / np.sqrt(bias2)
        logits = self._logits(row, column, value, n)
        self.accuracy = float((logits[held].argmax(1) == y[held]).mean())
        grid = np.geomspace(0.25, 4, 25)
        loss = [-np.log(np.maximum(self._softmax(logits[held] * t)[np.arange(held.sum()), y[held]], 1e-12)).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        self.weights = self.weights.astype(np.float32)
        self.table = np.zeros(_SIZE, dtype=bool)
        self.table[(mix(self.features) & U64(_SIZE - 1)).astype(np.int64)] = True
        self.templates = {k: [self._set(t) for t in ts] for k, ts in TEMPLATES.items()}

    @staticmethod
    def _set(text: str) -> frozenset:
        w = re.findall(r"[^\W_]+", text.lower())
        return frozenset(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, doc, _ = grams(texts)
        total = np.bincount(doc, minlength=len(texts))
        at = np.minimum(np.searchsorted(self.features, g), len(self.features) - 1)
        hit = self.features[at] == g
        row, at = self._once(doc[hit], at[hit])
        return row, at, 1 / np.sqrt(total[row])

    def _once(self, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each feature once a text, however often it is repeated."""
        both = np.unique(row.astype(np.int64) * len(self.features) + at)
        return both // len(self.features), both % len(self.features)

    def _logits(self, row, column, value, n) -> np.ndarray:
        out = np.zeros((n, len(FAMILIES)))
        if len(row):
            order = np.argsort(row, kind="stable")
            r = row[order]
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            out[r[first]] = np.add.reduceat(self.weights[column[order]] * value[order][:, None], first)
        return out + self.bias

    def score(self, unit: np.ndarray, g: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
        """Probabilities of ``n`` paragraphs from their n-grams (in order of paragraph); those without a feature are the bias alone."""
        may = np.flatnonzero(self.table[(mix(g) & U64(_SIZE - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.features, g[may]), len(self.features) - 1)
        hit = self.features[at] == g[may]
        row, at = self._once(unit[may][hit], at[hit])
        return self._softmax(self.temperature * self._logits(row, at, 1 / np.sqrt(np.maximum(total[row], 1)), n))

    def similarity(self, family: str, text: str) -> float:
        """Share of a template's 1- to 3-grams in the text, of the closest one."""
        have = self._set(text)
        return max(len(t & have) / len(t) for t in self.templates[family])


_BLANK = re.compile(r"\n[ \t\r]*\n")


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(paragraphs, document of each, number of each in its document)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    blank = pc.match_substring_regex(texts, "\\n[ \\t\\r]*\\n").to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts, "\n")
    if blank.any():
        lists = pa.array([_BLANK.split(t) if b else t.split("\n") for t, b in zip(texts.to_pylist(), blank)], pa.large_list(pa.large_string()))
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), size)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    return lists.flatten(), doc, number


def _negatives(docs: DataFrame, limit: int) -> list[str]:
    """At most ``limit`` stretches, one from anywhere in each document whose text hashes least; none that speaks of licences."""
    text = F.col("text").cast("string")
    h = F.xxhash64(text)
    rows, want = docs.filter(text.isNotNull()), max(limit, 1)
    share = 4 * want / max(rows.count(), 1)  # about four times as many are sorted; where that leaves too few, all are
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    start = F.pmod(h, F.greatest(F.size("w") - STRETCH + 1, F.lit(1))).cast("int") + 1
    for low in ([h < int(-(1 << 63) + share * (1 << 64))] if share < 1 else []) + [F.lit(True)]:
        pick = rows.filter(low).select(h.alias("h"), text.alias("text")).orderBy("h").limit(limit).withColumn("w", words).select(F.array_join(F.slice("w", start, STRETCH), " ").alias("t"), F.col("h"))
        got = [r["t"] for r in pick.orderBy("h", "t").collect()]
        if len(got) == limit:
            break
    return [x for x in dict.fromkeys(got) if x and not re.search(r"(?i)licen[sc]|copyright|permission|rights reserved", x)]


def stretches(w: Words, at: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(paragraph of each stretch, n-grams of each, and for each order the n-grams' indices and their stretches), from the words where n-grams begin."""
    half = STRETCH // 2
    count = np.diff(w.first)
    parts = np.maximum(1, -(-(count - STRETCH) // half) + 1)
    first = np.concatenate([[0], np.cumsum(parts)])
    whose = np.repeat(np.arange(len(count)), parts)
    number = np.arange(first[-1]) - first[whose]
    length = np.clip(count[whose] - number * half, 0, STRETCH)
    total = sum(np.maximum(length - n + 1, 0) for n in range(1, len(at) + 1))
    index, where = [], []
    for n, a in enumerate(at, 1):
        doc = w.doc[a]
        p = a - w.first[doc]
        s = p // half
        one = np.flatnonzero((s < parts[doc]) & (p + n <= s * half + STRETCH))
        two = np.flatnonzero((s > 0) & (p + n <= (s - 1) * half + STRETCH))
        index.append(np.concatenate([one, two]))
        where.append(np.concatenate([first[doc[one]] + s[one], first[doc[two]] + s[two] - 1]))
    return whose, total, index, where


def scan(docs: DataFrame, negatives: int = NEGATIVES, least: float = LEAST, confirm: float = CONFIRM) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed) of each paragraph that the classifier names."""
    model = docs.sparkSession.sparkContext.broadcast(Classifier(_negatives(docs, negatives)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = model.value
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                texts, doc, number = units(part.column("text"))
                w = Words(texts, fold=True)
                kinds = [w.ngrams(n) for n in (1, 2, 3)]
                whose, total, index, where = stretches(w, [at for _, at in kinds])
                g = np.concatenate([x[i] * U64(2 * n + 1) for n, ((x, _), i) in enumerate(zip(kinds, index), 1)])
                p = c.score(np.concatenate(where), g, len(whose), total)
                best = p.argmax(1)
                sure = p[np.arange(len(p)), best]
                named = np.flatnonzero((best < len(FAMILIES) - 1) & (sure >= least) & (total > 0))
                named = named[np.lexsort((named, -sure[named], whose[named]))]
                named = named[np.concatenate([[True], whose[named][1:] != whose[named][:-1]])] if len(named) else named  # of a paragraph the surest
                found, best, sure = whose[named], best[named], sure[named]
                names = [FAMILIES[k] for k in best]
                alike = [c.similarity(f, t) for f, t in zip(names, texts.take(pa.array(found)).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc[found])), pa.array(number[found].astype(np.int32)), pa.array(names, pa.string()), pa.array(sure.astype(float)), pa.array(alike, pa.float64()), pa.array([x >= confirm for x in alike], pa.bool_())],
                    names=["doc_id", "paragraph", "family", "probability", "similarity", "confirmed"],
                )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(lean(run), "doc_id long, paragraph int, family string, probability double, similarity double, confirmed boolean")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
