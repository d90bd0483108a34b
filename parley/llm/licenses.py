"""Licence scans: a trained paragraph classifier whose predictions templates confirm.

Every paragraph (line that isn't blank) is described by the set of its word 1- and 2-grams, hashed to BUCKETS; a
multinomial logistic regression with an unknown class names its family. It is trained in numpy on notices and texts
of known licences and their cut-outs, and, as unknown, on other licences, on sentences that merely talk about
licences, and on a bounded sample of the table's own paragraphs. A temperature and the least probability of a known
family are calibrated on wordings, licences and sentences that the model has not seen; then it is fitted on all. A
prediction counts once a template of its family confirms it: the paragraph shares enough of the word pairs that
only this family has.

Scanning uses DataFrame functions only. Each paragraph's upper bound of the log-odds of any known family is one sum
over its buckets, taken in the pass that reads the text. Only those whose bound reaches the calibrated least, a few
in a hundred, can be named; they go on with their words and are scored in full. Nothing else is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small

UNKNOWN = "unknown"

#: Names of public licences by family, as notices and package data write them.
NAMES: dict[str, list[str]] = {
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD license", "BSD-3-Clause", "BSD-2-Clause"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License v2.0", "GNU GPL", "GPLv3", "GPLv2", "GPL-3.0", "GPL-2.0-or-later", "GPL-3.0-only"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v3.0", "GNU LGPL", "LGPLv3", "LGPL-2.1", "LGPL-3.0-or-later"],
    "mit": ["MIT License", "MIT"],
    "mpl": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "proprietary": [],
}
#: Opening words, conditions and warranty paragraphs of those licences.
TEXTS: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Use of this source code is governed by a BSD-style license.",
    ],
    "cc-by": ["To view a copy of this license, visit creativecommons.org/licenses/by/4.0/"],
    "cc-by-nc": ["To view a copy of this license, visit creativecommons.org/licenses/by-nc/4.0/"],
    "cc-by-sa": ["To view a copy of this license, visit creativecommons.org/licenses/by-sa/4.0/"],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, you can obtain one at",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright the company. All rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential.",
        "This software is proprietary and confidential. Unauthorized copying, via any medium, is strictly prohibited.",
    ],
}
#: Licences of no family above, by name and by a piece of their texts.
OTHER_NAMES = [
    "ISC License", "ISC", "Boost Software License", "BSL-1.0", "Eclipse Public License 2.0", "EPL-2.0", "zlib License", "Unlicense", "WTFPL", "Artistic License 2.0",
    "Common Development and Distribution License", "CDDL-1.0", "European Union Public Licence", "EUPL-1.2", "SIL Open Font License", "OFL-1.1", "PostgreSQL License", "Academic Free License", "AFL-3.0",
    "Microsoft Public License", "GNU Affero General Public License", "AGPL-3.0", "GNU Free Documentation License", "Python Software Foundation License", "CC0 1.0", "Open Data Commons License",
]
#: Licences that differ from a family of FURTHER_OF by a further condition.
FURTHER_OF = ("cc-by", "cc-by-nc", "cc-by-sa")
FURTHER_NAMES = [
    "CC BY-NC-SA 4.0", "CC BY-NC-SA 3.0", "CC BY-NC-ND 4.0", "CC BY-NC-ND 3.0", "CC BY-ND 4.0", "CC BY-ND 3.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivatives 4.0 International License",
]
OTHER_TEXTS = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "This is free and unencumbered software released into the public domain.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
]
#: Sentences that talk about licences, or share their words, and name none.
OTHERS = [
    "He lost his driving licence after the accident.", "The restaurant applied for a liquor license last year.", "A fishing license is required on this lake.",
    "Please ask for permission before you take photographs.", "The warranty covers parts and labour for two years.", "The court issued a search warrant for the house.",
    "Poetic license allows the author some freedom.", "The license plate of the car was unreadable.", "Copyright law is taught in the second year.",
    "The wealth of the kingdom was redistributed among the people.", "The Apache helicopter landed near the village.", "The gnu grazed on the plain at dawn.",
    "She studied physics at the MIT campus.", "The Mozilla team met in Berlin.", "Your warranty is void if the seal is broken.", "The library is free for all students.",
    "Copyright 2019 the authors.", "This license expires at the end of the year.", "The software is distributed on two disks.", "All passengers have rights under the treaty.",
    "The general public was not admitted.", "The terms of the agreement are secret.", "A copy of the report was sent to the minister.", "You should have received a letter by now.",
    "He was released under the terms of the treaty.", "The programme was published by the foundation.", "This file is part of the report.", "The software must be licensed before use.",
    "The company reserved a table for ten.", "The version of the story differs in the north.", "They were granted permission to build.", "The attribution of the painting is doubtful.",
]
#: How notices name a licence; a template is such a notice or one of TEXTS.
WORDINGS = [
    "Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This project is licensed under the terms of the {}.", "This project is available under the {}.",
    "Distributed under the {}. See the file LICENSE for details.", "This work is licensed under a {}.", "License: {}", "SPDX-License-Identifier: {}",
]
TEMPLATES: dict[str, list[str]] = {f: [w.format(n) for n in NAMES[f] for w in WORDINGS] + TEXTS[f] for f in sorted(NAMES)}
#: A choice or a sum of licences behind a field's name (``License: A OR B``), or in words (``under either A or B``): what stands
#: before it, and its parts. The same in Java's and Python's regular expressions.
EXPRESSION = r"(?i)^(.*?licen[cs]es?(?:-identifier)?[\"']? *[:=] *[\"']?)(\(*[a-z0-9.+-]+\)*(?: +(?:or|and|with) +\(*[a-z0-9.+-]+\)*)++)[\"',; */-]*$"
#: The first ``under either`` decides and a run of spaces is tried once, so that time is linear in the text.
EITHER = r"(?i)^(?>(.*?\bunder +)(?=either ))either +(?:of +)?(?:the +)?(.+?)(?<! ) ++or +(?:the +)?(.+)$"
BETWEEN = r"(?i) +(?:or|and) +"
#: Places that grams are hashed to (a power of two).
BUCKETS = 1 << 15
#: Documents and paragraphs of the sample; cut-outs of a template.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS, VARIANTS = 300, 800, 10


@dataclass(frozen=True)
class LicenseModel:
    classes: tuple[str, ...]  # UNKNOWN first
    buckets: np.ndarray  # those that the grams of licences fall in; all others weigh nothing
    weights: np.ndarray  # bucket by class
    bias: np.ndarray
    temperature: float
    least: float

    @property
    def bounds(self) -> np.ndarray:
        """What each of all buckets adds, at most, to the log-odds of a known family against the unknown class."""
        out = np.zeros(BUCKETS)
        out[self.buckets] = (self.weights[:, 1:] - self.weights[:, :1]).max(axis=1)
        return out

    @property
    def wanted(self) -> float:
        """The sum of bounds under which no family's probability can reach ``least``."""
        return self.temperature * float(np.log(self.least / (1 - self.least))) - float((self.bias[1:] - self.bias[0]).max()) - 1e-6


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def pairs_of(text: str) -> set[str]:
    words = words_of(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def own_pairs() -> dict[str, set[str]]:
    """Word pairs that the templates of one family alone have; other licences' texts have them neither."""
    by_family = {f: set().union(*map(pairs_of, ts)) for f, ts in TEMPLATES.items()}
    others = set().union(*map(pairs_of, [*OTHER_TEXTS, *(w.format(n) for n in OTHER_NAMES for w in WORDINGS)]))
    return {f: ps - others - set().union(*(qs for g, qs in by_family.items() if g != f)) for f, ps in by_family.items()}


def further_pairs() -> list[str]:
    """Word pairs of FURTHER_NAMES that no template has: what holds one is none of FURTHER_OF."""
    return sorted(set().union(*map(pairs_of, FURTHER_NAMES)) - set().union(*(pairs_of(t) for f in FURTHER_OF for t in TEMPLATES[f])))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _examples(paragraphs: list[str], rng: np.random.Generator) -> list[tuple[int, bool, bool, str]]:
    """(class, held out, of a licence, text). What is held out shares no wording, other licence, text or sentence with the rest."""
    out: list[tuple[int, bool, bool, str]] = []

    def with_pieces(y: int, held: bool, text: str, n: int) -> None:
        words = words_of(text)
        out.append((y, held, True, text))
        for _ in range(n):  # most of it, in other text
            size = int(rng.integers(min(len(words), max(3, len(words) * 3 // 5)), len(words) + 1))
            at = int(rng.integers(0, len(words) - size + 1))
            tail = words_of(paragraphs[int(rng.integers(len(paragraphs)))])[: int(rng.integers(0, 6))] if paragraphs else []
            if size > 4 or size == len(words):
                out.append((y, held, True, " ".join(words[at : at + size] + tail)))

    apart = set(rng.permutation(len(WORDINGS))[:2].tolist())
    for y, family in enumerate(TEMPLATES, 1):
        for name in NAMES[family]:
            for i, wording in enumerate(WORDINGS):
                with_pieces(y, i in apart, wording.format(name), 1)
        for text in TEXTS[family]:
            with_pieces(y, rng.random() < 0.2, text, VARIANTS)
    for name in OTHER_NAMES:
        held = rng.random() < 0.3
        for i, wording in enumerate(WORDINGS):
            with_pieces(0, held or i in apart, wording.format(name), 1)
    for text in OTHER_TEXTS:
        with_pieces(0, rng.random() < 0.2, text, VARIANTS)
    return out + [(0, rng.random() < 0.3, False, t) for t in OTHERS] + [(0, rng.random() < 0.2, False, p) for p in paragraphs]


def _descend(x: np.ndarray, y: np.ndarray, n_classes: int, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    weights, bias = np.zeros((x.shape[1], n_classes), np.float32), np.zeros(n_classes, np.float32)
    bias[0] = 2.0
    target = np.eye(n_classes, dtype=np.float32)[y]
    for _ in range(steps):
        g = (_softmax(x @ weights + bias) - target) / len(x)
        weights -= 20 * (x.T @ g + 2e-5 * weights)
        bias -= 2 * g.sum(axis=0)
    return weights, bias


def fit_licenses(spark: SparkSession, paragraphs: list[str], seed: int = 17) -> LicenseModel:
    """A model from the licences above, OTHERS and ordinary ``paragraphs``."""
    classes = (UNKNOWN, *TEMPLATES)
    examples = _examples(paragraphs, np.random.default_rng(seed))
    frame = spark.createDataFrame([(i, t) for i, (*_, t) in enumerate(examples)], "i int, text string")
    found = {r["i"]: r["b"] for r in frame.select("i", buckets_of(_words(F.col("text"))).alias("b")).collect()}
    buckets = np.unique(np.concatenate([found[i] for i, e in enumerate(examples) if e[2]]))
    x = np.zeros((len(examples), BUCKETS), bool)
    for i in range(len(examples)):
        x[i, found[i]] = True
    x = x[:, buckets].astype(np.float32)
    y, held = np.array([e[0] for e in examples]), np.array([e[1] for e in examples])
    weights, bias = _descend(x[~held], y[~held], len(classes))
    z, known = x[held] @ weights + bias, y[held]
    grid = np.geomspace(0.2, 20, 60)
    temperature = float(grid[int(np.argmin([-np.log(_softmax(z / t)[np.arange(len(known)), known] + 1e-9).mean() for t in grid]))])
    p = _softmax(z / temperature)
    wrong = p[:, 1:].max(axis=1)[(known == 0) | (p.argmax(axis=1) != known)]
    least = float(min(0.95, max(0.5, np.quantile(wrong, 0.99) if len(wrong) else 0.5)))
    weights, bias = _descend(x, y, len(classes))
    return LicenseModel(classes, buckets, weights.astype(np.float64).round(6), bias.astype(np.float64).round(6), round(temperature, 6), least)


def train_licenses(docs: DataFrame, seed: int = 17) -> LicenseModel:
    """A model; ordinary paragraphs come from SAMPLE_DOCS documents, SAMPLE_PARAGRAPHS at most, without those that
    have a word pair that only one family has (they may be its notices)."""
    known = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    ids = known.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(SAMPLE_DOCS)
    lines = known.join(F.broadcast(ids), "doc_id", "left_semi").select(F.explode(paragraphs_of(F.col("text"))).alias("p")).distinct()
    own = set().union(*own_pairs().values())
    sample = lines.orderBy(F.xxhash64("p", F.lit(seed)), "p").limit(SAMPLE_PARAGRAPHS).collect()
    return fit_licenses(docs.sparkSession, [r["p"] for r in sample if not pairs_of(r["p"]) & own], seed)


def paragraphs_of(text: Column) -> Column:
    return F.filter(F.split(text, "[\\r\\n]+"), lambda p: p.rlike("\\S"))


def notices_of(paragraph: str) -> list[str]:
    """A paragraph that joins several licences as one notice for each of them; any other as it is."""
    if m := re.match(EXPRESSION, paragraph):
        return [m[1] + part for part in re.split(BETWEEN, re.sub("[()]", "", m[2]))]
    if m := re.match(EITHER, paragraph):
        return [m[1] + m[2], m[1] + m[3]]
    return [paragraph]


def _notices(paragraphs: Column) -> Column:
    """``notices_of`` all of them, in order."""

    def of(p: Column) -> Column:
        group = lambda pattern, i: F.regexp_extract(p, pattern, i)
        # as a value of an array, what stands before the parts is found once, and not for each of them
        held = F.array(F.struct(group(EXPRESSION, 1).alias("before"), F.split(F.regexp_replace(group(EXPRESSION, 2), "[()]", ""), BETWEEN).alias("parts")))
        parts = F.flatten(F.transform(held, lambda h: F.transform(h["parts"], lambda part: F.concat(h["before"], part))))
        either = F.array(*(F.concat(group(EITHER, 1), group(EITHER, i)) for i in (2, 3)))
        return F.when(p.rlike(EXPRESSION), parts).when(p.rlike(EITHER), either).otherwise(F.array(p))

    return F.flatten(F.transform(paragraphs, of))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def buckets_of(words: Column) -> Column:
    """The distinct buckets of a word list's 1- and 2-grams. (The last word has no follower: its pair hashes as the word.)"""
    place = lambda *grams: F.pmod(F.xxhash64(*grams), F.lit(BUCKETS)).cast("int")
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(0))), lambda a, b: place(a, b))
    return F.array_distinct(F.concat(F.transform(words, lambda w: place(w)), pairs))


def _pairs(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b)))


def may_be_known(buckets: Column, model: LicenseModel) -> Column:
    """Whether the sum of the buckets' bounds leaves room for a known family."""
    bounds = F.split(F.lit(" ".join(f"{v:.6f}".rstrip("0").rstrip(".") for v in model.bounds)), " ").cast("array<double>")
    return F.aggregate(buckets, F.lit(0.0), lambda total, b: total + F.get(bounds, b)) >= model.wanted


def classify_paragraphs(spark: SparkSession, paragraphs: DataFrame, model: LicenseModel, shared: float = 0.5) -> DataFrame:
    """(row, at, family, probability, similarity, confirmed) of each paragraph (row, at, words, buckets).

    ``probability`` is that of the likeliest known family. ``similarity`` compares the paragraph with that family's
    templates: the share of a template's own pairs (which no other family has) that it holds, or, if it holds two
    of them at least, the share of its pairs that the template has; the largest counts. A family is confirmed from
    ``shared`` on if its probability reaches the calibrated least, else it is unknown; so is one of FURTHER_OF where the
    paragraph names a further condition.
    """
    known, n = model.classes, len(model.classes)
    weights = spark.createDataFrame([(int(b), [float(v) for v in w]) for b, w in zip(model.buckets, model.weights, strict=True)], "bucket int, w array<double>")
    terms = paragraphs.select("row", "at", F.explode("buckets").alias("bucket")).join(F.broadcast(weights), "bucket")
    sums = terms.groupBy("row", "at").agg(*(F.sum(F.element_at("w", i + 1)).alias(f"z{i}") for i in range(n)))
    z = [(F.col(f"z{i}") + float(model.bias[i])) / model.temperature for i in range(n)]
    total = sum((F.exp(x - F.greatest(*z)) for x in z[1:]), F.exp(z[0] - F.greatest(*z)))
    best = F.greatest(*(F.struct(x.alias("z"), F.lit(c).alias("family")) for x, c in zip(z[1:], known[1:], strict=True)))
    guessed = sums.withColumn("best", best).select("row", "at", F.col("best.family").alias("guess"), (F.exp(F.col("best.z") - F.greatest(*z)) / total).alias("probability"))
    own = own_pairs()
    of_templates = [(p, i, f, p in own[f], max(1, len(pairs_of(t) & own[f]))) for f, ts in TEMPLATES.items() for i, t in enumerate(ts) for p in sorted(pairs_of(t))]
    templates = spark.createDataFrame(of_templates, "pair string, template int, guess string, own boolean, n_own int")
    pairs = paragraphs.select("row", "at", _pairs(F.col("words")).alias("pairs")).select("row", "at", F.size("pairs").alias("n"), F.explode("pairs").alias("pair"))
    common = pairs.join(F.broadcast(templates), "pair").groupBy("row", "at", "guess", "template", "n", "n_own").agg(F.count(F.lit(1)).alias("c"), F.count_if("own").alias("c_own"))
    share = F.greatest(F.col("c_own") / F.col("n_own"), F.when(F.col("c_own") > 1, F.col("c") / F.col("n")).otherwise(0.0))
    near = common.groupBy("row", "at", "guess").agg(F.max(share).alias("similarity"))
    both = guessed.join(near, ["row", "at", "guess"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    further = paragraphs.select("row", "at", F.arrays_overlap(_pairs(F.col("words")), F.array(*map(F.lit, further_pairs()))).alias("further")).where("further")
    both = both.join(further, ["row", "at"], "left")
    plain = F.col("further").isNull() | ~F.col("guess").isin(*FURTHER_OF)
    sure = (F.col("probability") >= model.least) & (F.col("similarity") >= shared) & plain
    return both.select("row", "at", F.when(sure, F.col("guess")).otherwise(UNKNOWN).alias("family"), "probability", "similarity", sure.alias("confirmed"))


def scan_licenses(spark: SparkSession, docs: DataFrame, model: LicenseModel) -> DataFrame:
    """(doc_id, n_paragraphs, n_known, n_confirmed, families, probability) of every row's whole text.

    A paragraph that joins licences (``A OR B``) counts as a notice for each. ``families`` are the confirmed ones of all
    notices, sorted and comma-joined; ``n_known`` counts the notices whose likeliest known family reaches the model's
    least probability, and ``probability`` is the largest among them. Null, empty and blank texts have no paragraphs (empty families, probability 0). Repeated rows get
    equal results; a null id is a value like others. Other columns are ignored. A paragraph may be any length.
    """
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), paragraphs_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("ps"))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    lines = numbered.select("doc_id", "row", F.size("ps").cast("long").alias("n_paragraphs"), F.posexplode_outer(_notices(F.col("ps"))).alias("at", "paragraph"))
    cut = lines.select("doc_id", "row", "n_paragraphs", F.coalesce("at", F.lit(0)).alias("at"), _words(F.col("paragraph")).alias("words"))
    hashed = cut.withColumn("buckets", buckets_of(F.col("words")))
    tried = hashed.withColumn("tried", F.coalesce(may_be_known(F.col("buckets"), model), F.lit(False)))
    # a row's first paragraph stays as well, so that every row does
    kept = scratch.save(tried.where("tried or at = 0"), "lines")
    found = classify_paragraphs(spark, kept.where("tried"), model).where(F.col("probability") >= model.least)
    by_row = scratch.save(
        found.groupBy("row").agg(
            F.count(F.lit(1)).alias("n_known"),
            F.count_if("confirmed").alias("n_confirmed"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
            F.max("probability").alias("probability"),
        ),
        "by_row",
    )
    joined = kept.where("at = 0").select("doc_id", "row", "n_paragraphs").join(small(by_row, by_row.count()), "row", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", "n_paragraphs", count("n_known"), count("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
