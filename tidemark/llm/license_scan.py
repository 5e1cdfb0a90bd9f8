"""Licence scanning, in DataFrame functions only on the main path.

Paragraphs (lines, and blocks of lines between blank ones) are classified by a logistic
regression over sparse word n-grams, trained here on the templates below, on paragraphs of
the documents that are no template's, and on prose that only sounds like licences. A
paragraph without enough evidence is `unknown`: the softmax has that class, with a
temperature calibrated on templates and paragraphs that the model has not seen. A predicted
family is confirmed if enough of one of its templates' word pairs occur in the paragraph.
"""

from __future__ import annotations

import json

import numpy as np
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drawn, fresh

#: The notices and opening clauses by which the public licences are known.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released into the public domain under CC0 1.0 Universal."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited.", "Proprietary and confidential."],
}
#: How the families are named, and sentences that say by which of them a work is licensed.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License"],
    "MIT": ["MIT License", "MIT/Expat License"],
    "GPL": ["GNU General Public License, version 3", "GNU GPL version 2 or later", "GPL v3 License"],
    "LGPL": ["GNU Lesser General Public License, version 2.1", "GNU LGPL version 3"],
    "AGPL": ["GNU Affero General Public License, version 3", "GNU AGPL version 3"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "New BSD License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License (MPL) 2.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0 License", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC0": ["CC0 1.0 Universal", "Creative Commons Zero License"],
    "ISC": ["ISC License", "OpenBSD ISC License"],
    "Unlicense": ["Unlicense License", "The Unlicense"],
}
FRAMES = ["Released under the {}.", "Licensed under {}.", "This project is licensed under the terms of the {}.", "Distributed under the {}; see the LICENSE file.", "You may use this work under the {}.", "SPDX-License-Identifier: {}"]
#: Prose with words of licences that is none.
PROSE = [
    "You need a driving license to rent a car.", "The license plate was found near the river.", "The apache helicopter landed at noon.", "He studied at MIT and later moved to Boston.",
    "The general public is welcome to visit the museum.", "Version 3 of the report was published in May.", "Please see the file for any questions about the work.", "A free copy of the book is given to any person who asks.",
    "The software is distributed to schools in the region.", "The conditions are met in most of the cases.", "The terms of the agreement were kept under wraps.", "The author has been granted a fee for this work.",
    "The foundation published the source of the story.", "She used the same code in the second version.", "They may not use this road without permission.", "The rights of workers are protected by law.",
    "Mozilla is a browser and GNU is an animal as well.", "Creative people share their work in common rooms.", "The library is open to the public.", "We reserved a table and all seats at the restaurant.",
    "This is a test of the program.", "You should have received a letter.", "To deal with it, one needs a purpose.", "By the way, the notice shall be read out loud.", "We modified the plan and copied it for any use.", "The text is subject to change.",
]
UNKNOWN = "unknown"
BUCKETS = 1 << 17
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: str) -> list[str]:
    return [w for w in regex.split(NOT_WORD, text.lower()) if w]


def grams(tokens: list[str]) -> list[str]:
    return tokens + [" ".join(p) for p in zip(tokens, tokens[1:])]


def word_pairs(text: str) -> set[str]:
    tokens = words(text)
    return {" ".join(p) for p in zip(tokens, tokens[1:])}


class LicenceModel:
    """Multinomial logistic regression on the presence of word n-grams (1 and 2), with an unknown class.

    paragraphs: real text; those with more than `foreign` of some template's word pairs are left out, the
    others are examples of the unknown class, together with the prose. variants: training paragraphs made
    of each template and of each name in each frame, by leaving words out and by putting real text around
    it. Each of two folds holds out every other one of these of a family, whole, and every other paragraph; the temperature is the one, of
    a few, that gives these the best log loss. precision and recall are those of families among them.
    """

    def __init__(self, paragraphs: list[str] = (), templates: dict[str, list[str]] = TEMPLATES, names: dict[str, list[str]] = NAMES, prose: list[str] = PROSE, variants: int = 8, steps: int = 200, foreign: float = 0.3, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes = [UNKNOWN, *sorted(templates)]
        # What confirms a family: most word pairs of a template, or of one of its names.
        confirming = {f: [*ts, *names.get(f, [])] for f, ts in templates.items()}
        self.template_pairs = {f: [sorted(word_pairs(t)) for t in ts if len(words(t)) > 1] for f, ts in confirming.items()}
        templates = {f: [*ts, *[frame.format(n) for n in names.get(f, []) for frame in FRAMES]] for f, ts in templates.items()}
        common = {w for t in prose for w in words(t)}  # alone, these say nothing
        vocabulary = sorted({g for ts in templates.values() for t in ts for g in grams(words(t)) if g not in common})
        self.features = {g: k for k, g in enumerate(vocabulary)}
        own_pairs = [set(t) for ts in self.template_pairs.values() for t in ts]
        others = [p for p in paragraphs if words(p) and not any(len(word_pairs(p) & t) > foreign * len(t) for t in own_pairs)] + list(prose)
        rows, labels, folds, whole = [], [], [], []
        for family, texts in templates.items():
            for k, text in enumerate(texts):  # names and frames alternate, so a fold holds out every other sentence of a name
                tokens = words(text)
                for v in range(variants):
                    kept = tokens if v < 2 else [w for w in tokens if rng.random() > 0.08]
                    around = words(others[int(rng.integers(len(others)))])[:40] if v % 3 == 1 else []
                    rows.append(around + kept)
                    labels.append(self.classes.index(family))
                    folds.append(k % 2 if len(texts) > 1 else -1)  # a lone template is never held out
                    whole.append(v == 0)
        for k, text in enumerate(others):
            rows.append(words(text))
            labels.append(0)
            folds.append(k % 2)
            whole.append(True)
        for _ in range(6 * variants):  # a few words out of context say nothing
            rows.append([w for w in rng.choice([g for g in vocabulary if " " not in g], int(rng.integers(1, 4)))])
            labels.append(0)
            folds.append(-1)
            whole.append(False)
        x = np.zeros((len(rows), len(vocabulary)), np.float32)
        for r, tokens in enumerate(rows):
            x[r, [self.features[g] for g in set(grams(tokens)) if g in self.features]] = 1
        y, folds, whole = np.array(labels), np.array(folds), np.array(whole)
        logits, truth = [], []
        for fold in (0, 1):
            weights, bias = self._fit(x[folds != fold], y[folds != fold], steps)
            held = (folds == fold) & whole
            logits.append(x[held] @ weights + bias)
            truth.append(y[held])
        logits, truth = np.concatenate(logits), np.concatenate(truth)
        loss = lambda t: -np.log(self._softmax(logits / t)[np.arange(len(logits)), truth] + 1e-12).mean()
        self.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
        guess = logits.argmax(1)
        right = ((guess == truth) & (truth > 0)).sum()
        self.precision, self.recall = float(right / max(1, (guess > 0).sum())), float(right / max(1, (truth > 0).sum()))
        self.weights, self.bias = self._fit(x, y, steps)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _fit(self, x, y, steps, rate=2.0, decay=1e-4):
        w, b = np.zeros((x.shape[1], len(self.classes)), np.float32), np.zeros(len(self.classes), np.float32)
        target = np.eye(len(self.classes), dtype=np.float32)[y]
        # Every class weighs as much as its rows' square root, or the unknown class would outweigh all others.
        balance = (1 / np.sqrt(np.bincount(y, minlength=len(self.classes))[y]))[:, None].astype(np.float32)
        balance *= len(y) / balance.sum()
        for _ in range(steps):
            error = (self._softmax(x @ w + b) - target) / len(y)
            error *= balance
            w -= rate * (x.T @ error + decay * w)
            b -= rate * error.sum(0)
        return w, b

    def probabilities(self, text: str) -> np.ndarray:
        """Of each class, for one paragraph, by the plain formula."""
        x = np.zeros((1, len(self.features)))
        x[0, [self.features[g] for g in set(grams(words(text))) if g in self.features]] = 1
        return self._softmax((x @ self.weights + self.bias) / self.temperature)[0]

    def confirmed(self, text: str, family: str, least: float = 0.6) -> bool:
        pairs = word_pairs(text)
        return any(len(pairs & set(t)) >= least * len(t) for t in self.template_pairs.get(family, []))


def _literal(values, kind: str) -> Column:
    """A constant array in one expression, which the optimizer folds once."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def gram_hash(gram: str) -> int:
    """What Spark's xxhash64 gives a word, or the hashes of a pair's words."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in gram.split(" ")]
    if len(hashes) == 1:
        return signed(hashes[0])
    first = xxhash.xxh64_intdigest(hashes[0].to_bytes(8, "little"), seed=42)
    return signed(xxhash.xxh64_intdigest(hashes[1].to_bytes(8, "little"), seed=first))


def lookup_table(hashes: list[int]) -> tuple[list[int], int]:
    """A table from hash bits to the feature's number (-1: none), and the shift that keeps all features apart."""
    for shift in range(0, 48):
        table = [-1] * BUCKETS
        for k, h in enumerate(hashes):
            bucket = (h >> shift) % BUCKETS
            if table[bucket] >= 0:
                break
            table[bucket] = k
        else:
            return table, shift
    raise ValueError("too many features for the table")


def paragraphs_of(docs: DataFrame, rows: int = 400, chars: int = 2000, most: int = 1500) -> list[str]:
    """Real paragraphs for the unknown class, a bounded sample: lines of the first `chars` characters of the `rows` distinct texts first by a hash, at most `most` lines in all."""
    some = drawn(docs.where(F.length("text") > 0), "text", rows, F.substring("text", 1, chars))
    return [p for text in some for p in text.split("\n") if words(p)][:most]


def scan_licences(docs: DataFrame, model: LicenceModel | None = None, least: float = 0.5, confirm: float = 0.6) -> DataFrame:
    """docs with n_paragraphs and licences, an array of (paragraph, n_lines, family, probability, confirmed).

    model: by default trained with paragraphs_of(docs). Paragraphs are the text's lines, numbered from 0,
    and blocks of two or more lines with words between lines without, named by their first line: in each,
    every word and word pair is looked up. Lines whose likeliest class is a family, with a probability of
    at least `least`, are listed; blocks only if they are confirmed and none of their lines is, of that
    family, and then in place of their unconfirmed lines. Of equally likely classes the first by name
    counts. Null and empty texts have no paragraphs, an empty table gives no rows, repeated rows each get
    theirs; columns of docs with these names are replaced, all others stay. A text, however long, stays in
    its row, so nothing is shuffled.
    """
    model = model or LicenceModel(paragraphs_of(docs))
    docs = docs.drop("licences", "n_paragraphs")
    own = docs.columns
    lines, hashed, block_at, found, scored, best_of, listed = fresh(docs, "lines", "hashed", "blocks", "found", "scored", "best", "listed")
    hashes = [gram_hash(g) for g in model.features]
    table, shift = lookup_table(hashes)
    numbers, known = _literal(table, "array<int>"), _literal(hashes, "array<bigint>")
    weights, bias = _literal(model.weights.tolist(), "array<array<double>>"), _literal(model.bias.tolist(), "array<double>")
    names = _literal(model.classes, "array<string>")
    templates = _literal([[[model.features[g] for g in t] for t in model.template_pairs.get(c, [])] for c in model.classes], "array<array<array<int>>>")

    def number(g: Column) -> Column:
        at = F.get(numbers, F.shiftright(g, shift).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
        return F.when(F.get(known, at) == g, at)

    def features(h: Column) -> Column:
        pairs = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, i: F.xxhash64(a, F.get(h, i + 1)))
        return F.array_distinct(F.filter(F.transform(F.concat(h, pairs), number), lambda x: x.isNotNull()))

    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn(lines, F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n")))
    out = out.select(*own, F.size(lines).cast("long").alias("n_paragraphs"), F.transform(lines, lambda t: F.transform(F.array_remove(F.split(F.lower(t), NOT_WORD), ""), lambda w: F.xxhash64(w))).alias(hashed))
    own = [*own, "n_paragraphs"]
    some = lambda i: F.coalesce(F.size(F.get(F.col(hashed), i)) > 0, F.lit(False))
    edge = lambda step: F.filter(F.transform(hashed, lambda h, i: F.when((F.size(h) > 0) & ~some(i + step), i)), lambda i: i.isNotNull())
    spans = F.filter(F.zip_with(edge(-1), edge(1), lambda a, b: F.struct(a.alias("a"), (b - a + 1).alias("n"))), lambda s: s["n"] > 1)
    out = out.withColumn(block_at, spans)
    single = F.transform(hashed, lambda h, i: F.struct(i.alias("paragraph"), F.lit(1).alias("n_lines"), features(h).alias("f")))
    # The words of a block are put together once, before they are looked up.
    joined = F.transform(block_at, lambda s: F.struct(s["a"].alias("paragraph"), s["n"].alias("n_lines"), F.flatten(F.slice(hashed, s["a"] + 1, s["n"])).alias("h")))
    blocks = F.transform(joined, lambda s: F.struct(s["paragraph"].alias("paragraph"), s["n_lines"].alias("n_lines"), features(s["h"]).alias("f")))
    out = out.select(*own, F.filter(F.concat(single, blocks), lambda s: F.size(s["f"]) > 0).alias(found))
    score = lambda f: F.transform(bias, lambda b, c: F.aggregate(f, b, lambda z, x: z + F.get(F.get(weights, x), c)))
    out = out.select(*own, F.transform(found, lambda s: F.struct(s["paragraph"].alias("paragraph"), s["n_lines"].alias("n_lines"), s["f"].alias("f"), score(s["f"]).alias("z"))).alias(scored))
    best = lambda s: F.array_max(F.transform(s["z"], lambda z, c: F.struct(z.alias("z"), (-c).alias("c"))))
    kept = F.filter(F.transform(scored, lambda s: F.struct(s["paragraph"].alias("paragraph"), s["n_lines"].alias("n_lines"), s["f"].alias("f"), s["z"].alias("z"), best(s).alias("b"))), lambda s: s["b"]["c"] != 0)
    out = out.select(*own, kept.alias(best_of))

    def finding(s: Column) -> Column:
        top = s["b"]["z"]
        probability = 1 / F.aggregate(s["z"], F.lit(0.0), lambda t, z: t + F.exp((z - top) / F.lit(model.temperature)))
        sure = F.exists(F.get(templates, -s["b"]["c"]), lambda t: F.size(F.array_intersect(t, s["f"])) >= F.size(t) * F.lit(confirm))
        return F.struct(s["paragraph"].alias("paragraph"), s["n_lines"].alias("n_lines"), F.get(names, -s["b"]["c"]).alias("family"), probability.alias("probability"), sure.alias("confirmed"))

    out = out.select(*own, F.filter(F.transform(best_of, finding), lambda x: x["probability"] >= least).alias(listed))
    inside = lambda x, b: (x["paragraph"] >= b["paragraph"]) & (x["paragraph"] < b["paragraph"] + b["n_lines"])
    alone = F.filter(listed, lambda x: x["n_lines"] == 1)
    whole = F.filter(listed, lambda b: (b["n_lines"] > 1) & b["confirmed"] & ~F.exists(alone, lambda x: x["confirmed"] & (x["family"] == b["family"]) & inside(x, b)))
    alone = F.filter(alone, lambda x: x["confirmed"] | ~F.exists(whole, lambda b: inside(x, b)))
    return out.select(*own, F.array_sort(F.concat(alone, whole)).alias("licences"))
