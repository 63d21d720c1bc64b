"""License scans: a trained paragraph classifier, with template comparison to confirm it.

Every paragraph (line) of every text is classified by softmax regression over sparse word n-grams (one and
two words) of licence notices, and a feature for the share of words that no notice uses. The classes are
licence families and an unknown class. The model is trained here: on variations of each family's notices
(words dropped, replaced or added around) against a bounded sample of corpus paragraphs and against shuffled
notices, notices of licences beyond the families and negated notices. A temperature fitted on held-out variations
and paragraphs calibrates the probabilities. A predicted family is confirmed by comparing the paragraph with the
family's templates, of which one must be as similar as any other family's and any unknown notice; what is not
confirmed is unknown. In a paragraph longer than a template, windows of the
template's length that hold one of its word pairs are classified and confirmed the same way, so a notice
counts wherever it stands, unless the word before it, or the one before a word like ``yet``, negates it.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Batches, as_bytes, column_values, with_columns

SAMPLE = 4_000  # corpus paragraphs, about, that stand for the unknown class in training
NEGATIONS = {b"not", b"never", b"isn", b"wasn", b"aren", b"cannot", b"neither", b"nor", b"no"}
BETWEEN = {b"t", b"yet", b"been", b"being", b"currently"}  # words that may stand between a negation and what it negates
UNKNOWN = "unknown"
WORD = re.compile(rb"[a-z0-9\x80-\xff]+(?:[.-][0-9]+)*")

#: Short notices as they stand in documents, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
                   "See the License for the specific language governing permissions and limitations under the License.",
                   "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."),
    "bsd": ("Licensed under the BSD 3-Clause License.", "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
            "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties are disclaimed."),
    "isc": ("Released under the ISC License.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
            "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
            "See the GNU General Public License for more details.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
             "You should have received a copy of the GNU Lesser General Public License along with this library.",
             "See the GNU Lesser General Public License for more details."),
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-only",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
             "You should have received a copy of the GNU Affero General Public License along with this program.",
             "See the GNU Affero General Public License for more details."),
    "epl": ("Licensed under the Eclipse Public License 2.0.", "Distributed under the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0",
            "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0",
            "Licensed under the Mozilla Public License 2.0.",
            "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "proprietary": ("All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "Unauthorized copying of this file is strictly prohibited."),
}

#: Notices of licences that are no family, examples of the unknown class.
OTHERS = ("Licensed under the Artistic License 2.0.", "Licensed under the European Union Public Licence, version 1.2.", "Licensed under the Common Development and Distribution License.",
          "Released under the zlib License.", "Distributed under the Boost Software License, Version 1.0.", "Licensed under the Academic Free License, version 3.0.",
          "Released under the Unlicense.", "This is free and unencumbered software released into the public domain.", "Licensed under the Open Software License 3.0.",
          "Licensed under the Python Software Foundation License.", "Licensed under the SIL Open Font License, Version 1.1.", "Licensed under the Microsoft Public License.",
          "Licensed under the Server Side Public License, version 1.", "Licensed under the Business Source License 1.1.", "Licensed under the PostgreSQL License.",
          "Licensed under the GNU Free Documentation License, version 1.3.", "Licensed under CC BY-ND 4.0.", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: BSL-1.0")


def words(paragraph: bytes) -> list[bytes]:
    return WORD.findall(paragraph.lower())


def grams(tokens: list[bytes]) -> list[bytes]:
    return tokens + [a + b" " + b for a, b in zip(tokens, tokens[1:])]


def similarity(tokens: list[bytes], templates: list[list[bytes]] | list[frozenset[bytes]]) -> float:
    """The best template's (given by its words or its n-grams) share of n-grams that the paragraph holds, times the paragraph's share of n-grams
    that the template holds, the latter by square root: notices may stand in longer paragraphs."""
    own, best = set(grams(tokens)), 0.0
    for t in templates:
        other = t if isinstance(t, frozenset) else set(grams(t))
        both = len(own & other)
        if both:
            best = max(best, both / len(other) * (both / len(own)) ** 0.5)
    return best


def negated(before: list[bytes]) -> bool:
    """Whether the words before a notice negate it."""
    return bool(before) and (before[-1] in NEGATIONS or before[-1] in BETWEEN and before[0] in NEGATIONS)


@dataclass
class Model:
    families: list[str]
    index: dict[bytes, int]  # n-grams of the notices; the last column is the share of foreign words
    weights: np.ndarray  # (columns, families), unknown first
    bias: np.ndarray
    temperature: float
    templates: dict[str, list[list[bytes]]]
    others: list[list[bytes]]  # notices of the unknown class

    @cached_property
    def sets(self) -> dict[str, list[frozenset[bytes]]]:
        """The n-grams of the templates by family, of the unknown notices as the unknown family's."""
        return {f: [frozenset(grams(t)) for t in ts] for f, ts in {**self.templates, UNKNOWN: self.others}.items()}

    def vector(self, tokens: list[bytes]) -> tuple[list[int], list[float]]:
        known = sorted({self.index[g] for g in grams(tokens) if g in self.index})
        foreign = sum(t not in self.index for t in tokens) / max(1, len(tokens))
        return [*known, len(self.index)], [1.0] * len(known) + [4 * foreign]

    def classify(self, tokens: list[bytes]) -> tuple[str, float]:
        cols, x = self.vector(tokens)
        z = (np.array(x) @ self.weights[cols] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.families[k], float(p[k])

    def judge(self, tokens: list[bytes], p_least: float, s_least: float) -> tuple[str, float, float] | None:
        """Family, probability and similarity, where a family is predicted and confirmed: none of the other families'
        templates or unknown notices is more similar."""
        family, p = self.classify(tokens)
        if family == UNKNOWN or p < p_least:
            return None
        s = similarity(tokens, self.sets[family])
        if s < s_least or any(similarity(tokens, ts) > s for f, ts in self.sets.items() if f != family):
            return None
        return family, p, s

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each template its words, its different n-grams, and which columns it holds (the last: none)."""
        every = sorted({tuple(t) for ts in self.templates.values() for t in ts})
        holds = np.zeros((len(every), len(self.index) + 1), bool)
        for k, t in enumerate(every):
            holds[k, [self.index[g] for g in grams(list(t))]] = True
        return np.array([len(t) for t in every]), holds.sum(axis=1), holds

    def windows(self, tokens: list[bytes], s_least: float) -> list[tuple[int, int]]:
        """Start and end of the windows of a template's length in a longer paragraph that may be similar to it:
        all that hold one of its bigrams, but for those that hold too few of its n-grams to reach ``s_least``."""
        index, out = self.index, set()
        lengths, sizes, holds = self.table
        one = np.array([index.get(t, -1) for t in tokens])
        two = np.array([index.get(a + b" " + b, -1) for a, b in zip(tokens, tokens[1:])])
        own = sorted({*one.tolist(), *two.tolist()})
        for k in np.nonzero((holds[:, own].sum(axis=1) >= s_least * sizes) & (lengths > 1) & (lengths < len(tokens)))[0]:
            n = int(lengths[k])
            hits = [np.concatenate(([0], np.cumsum(holds[k, x]))) for x in (one, two)]
            pairs = hits[1][n - 1:] - hits[1][: len(hits[1]) - n + 1]
            every = hits[0][n:] - hits[0][:-n] + pairs
            out.update((int(i), int(i) + n) for i in np.nonzero((pairs > 0) & (every >= s_least * sizes[k]))[0])
        return sorted(out)

    def notices(self, paragraph: bytes, p_least: float, s_least: float) -> list[tuple[str, float, float]]:
        """Family, probability and similarity of the confirmed notices of a paragraph, one of each family: the
        paragraph as a whole and windows of it, of overlapping ones the most similar. Paragraphs without two
        neighbouring words of a notice can't be confirmed and are passed over."""
        tokens = words(paragraph)
        index = self.index
        if not any(a in index and b in index and a + b" " + b in index for a, b in zip(tokens, tokens[1:])):
            return []
        whole = self.judge(tokens, p_least, s_least)
        judged = [(w, self.judge(tokens[w[0]:w[1]], p_least, s_least)) for w in self.windows(tokens, s_least)]
        taken: list[tuple[tuple[int, int], tuple[str, float, float]]] = []
        for (i, j), hit in sorted(((w, h) for w, h in judged if h), key=lambda x: (-x[1][2], -x[1][1], x[0])):
            if all(j <= p or q <= i for (p, q), _ in taken):
                taken.append(((i, j), hit))
        plain = [(w, h) for w, h in taken if not negated(tokens[max(0, w[0] - 2):w[0]])]
        if whole and whole[0] in {h[0] for _, h in taken} - {h[0] for _, h in plain}:
            whole = None
        taken = plain
        if whole:  # another family counts where the paragraph without it is still a notice of the first
            taken = [(w, h) for w, h in taken if h[0] == whole[0] or (self.judge(tokens[:w[0]] + tokens[w[1]:], p_least, s_least) or whole[1:])[0] == whole[0]]
        best = {whole[0]: whole} if whole else {}
        for _, hit in taken:
            best.setdefault(hit[0], hit)
        at = {h[0]: w for w, h in reversed(taken)}
        return sorted(best.values(), key=lambda h: at.get(h[0], (0, 0)))


def variations(templates: dict[str, list[list[bytes]]], noise: list[list[bytes]], each: int, rng: random.Random):
    """Notices with words dropped, replaced or added at the ends, and their shuffled words as unknown."""
    for family, texts in templates.items():
        for text in texts:
            for i in range(each):
                tokens, other = list(text), rng.choice(noise) if noise else []
                if i:
                    tokens = [w for w in tokens if rng.random() > 0.08] or tokens
                if i % 3 == 1 and other:
                    tokens = other[: rng.randrange(6)] + tokens + other[-rng.randrange(1, 6):]
                yield tokens, family
            if len(tokens) > 3:
                yield rng.sample(tokens, len(tokens)), UNKNOWN


def _softmax_fit(rows, cols, x, y, n_cols: int, n_classes: int, l2: float = 0.05, steps: int = 300):
    w, b = np.zeros((n_cols, n_classes)), np.zeros(n_classes)
    moment = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    n = len(y)
    want = np.eye(n_classes)[y]
    for step in range(1, steps + 1):
        z = np.zeros((n, n_classes))
        np.add.at(z, rows, w[cols] * x[:, None])
        z += b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        gap = want - p / p.sum(axis=1, keepdims=True)
        gw = np.zeros_like(w)
        np.add.at(gw, cols, gap[rows] * x[:, None])
        for i, (param, grad) in enumerate(((w, gw - l2 * w), (b, gap.sum(axis=0)))):
            moment[2 * i] = 0.9 * moment[2 * i] + 0.1 * grad
            moment[2 * i + 1] = 0.999 * moment[2 * i + 1] + 0.001 * grad ** 2
            param += 0.1 * 0.995 ** step * moment[2 * i] / (1 - 0.9 ** step) / (np.sqrt(moment[2 * i + 1] / (1 - 0.999 ** step)) + 1e-8)
    return w, b


def fit(docs: DataFrame, text: str = "text", templates: dict[str, tuple[str, ...]] | None = None, sample: int = SAMPLE, seed: int = 7) -> Model:
    """Train on the templates and on about ``sample`` whole paragraphs of the corpus, those of the smallest hashes
    among the different paragraphs that share no notice's wording; half of either side is for the calibration.
    They are counted first and picked by a threshold of their hash, so that no more are gathered."""
    others = list(OTHERS) if templates is None else []
    templates = TEMPLATES if templates is None else templates
    known = {f: [words(t.encode()) for t in ts] for f, ts in templates.items()}
    unknown = [words(t.encode()) for t in others]
    unknown += [[b"not", *t] for ts in known.values() for t in ts if t[0] in (b"licensed", b"released", b"distributed")]
    line = F.trim(F.col("line"))
    notice = F.lower(line).rlike("licen[sc]e|copyright|rights reserved|redistribut|permission is hereby|creative commons|cc.by|cc0")
    lines = docs.select(F.explode(F.split(F.col(f"`{text}`"), "\n")).alias("line")).where((line != "") & ~notice)
    hashed = lines.select("line", F.xxhash64("line").alias("h"))
    different = hashed.agg(F.approx_count_distinct("h", 0.02).alias("n")).first()["n"]
    top = -(1 << 63) + ((1 << 64) - 1) * sample // max(different, sample, 1)
    noise = [words(r.line.encode()) for r in hashed.where(F.col("h") <= F.lit(top)).groupBy("h").agg(F.min("line").alias("line")).orderBy("h", "line").collect()]
    noise = [t for t in noise if t]
    rng = random.Random(seed)
    rows = [*variations({**known, UNKNOWN: unknown}, noise, 24, rng), *[(t, UNKNOWN) for t in noise]]
    lengths = sorted({len(t) for ts in known.values() for t in ts})
    for t in noise:  # windows of prose, as a scan of long paragraphs meets them
        n = rng.choice(lengths)
        i = rng.randrange(max(1, len(t) - n + 1))
        rows.append((t[i:i + n], UNKNOWN))
    rng.shuffle(rows)
    index = {g: i for i, g in enumerate(sorted({g for ts in (*known.values(), unknown) for t in ts for g in grams(t)}))}
    families = [UNKNOWN, *templates]
    model = Model(families, index, np.zeros((len(index) + 1, len(families))), np.zeros(len(families)), 1.0, known, unknown)

    def design(part):
        vectors = [model.vector(t) for t, _ in part]
        return (np.repeat(np.arange(len(part)), [len(c) for c, _ in vectors]), np.array([c for cs, _ in vectors for c in cs]),
                np.array([v for _, vs in vectors for v in vs]), np.array([families.index(f) for _, f in part]))

    half = len(rows) // 2
    model.weights, model.bias = _softmax_fit(*design(rows[:half]), len(index) + 1, len(families))
    r, c, x, y = design(rows[half:])
    z = np.zeros((len(rows) - half, len(families)))
    np.add.at(z, r, model.weights[c] * x[:, None])
    z += model.bias

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).mean())

    model.temperature = min(np.geomspace(0.25, 8, 41), key=loss)
    return model


def notices(docs: DataFrame, model: Model, text: str = "text", p_least: float = 0.5, s_least: float = 0.4) -> DataFrame:
    """The documents without their text, with ``n_paragraphs`` and ``notices``: line (from 1), family,
    probability and similarity of each confirmed notice, one of a family per line. No shuffle."""
    kept = [f for f in docs.schema.fields if f.name not in ("n_paragraphs", "notices", text)]
    item = pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            n, found = [], []
            for value in column_values(batch, "__text"):
                lines = (value or b"").split(b"\n")
                n.append(sum(1 for x in lines if x.strip()))
                hits = ((i, h) for i, x in enumerate(lines, 1) for h in model.notices(x, p_least, s_least))
                found.append([dict(zip(("line", "family", "probability", "similarity"), (i, *h))) for i, h in hits])
            yield with_columns(batch, ("__text",), n_paragraphs=pa.array(n, pa.int64()), notices=pa.array(found, pa.list_(item)))

    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], as_bytes(f"`{text}`").alias("__text"))
    columns = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return source.mapInArrow(run, columns + "n_paragraphs long, notices array<struct<line:int,family:string,probability:double,similarity:double>>")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``notices`` with a model trained on the corpus, and ``families``: the different confirmed families of
    a document, sorted. Null and empty texts have no paragraphs; a corpus without any trains on the
    templates alone; repeated rows are judged each."""
    return notices(docs, fit(docs, text), text).withColumn("families", F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["family"]))))
