"""License scans: a trained paragraph classifier, confirmed by templates.

Word 1- to 3-grams of short stretches of a paragraph (up to a blank line; other
line ends are white space) feed a sparse softmax regression over licence
families and an unknown class.  It is trained in numpy, per process-wide seed,
on the templates below set into other words, cut and worn, and on sentences
that only sound alike; a held-out part gives the temperature and the least
probability that the calibrated unknown class leaves to a family.  A predicted
family must also be confirmed: enough of one of its templates' 3-grams have to
be in the stretch's neighbourhood.

A stretch without any n-gram of the vocabulary has the unknown class's score,
so only stretches that have some are worked out; that skips no text.

Defined results: null, empty and wordless texts have no licence; equal texts
get equal results (rows that repeat an id are rows like others); an empty
table gives an empty result; a text with several families names the one of the highest
probability (ties by name) and lists all; very long texts are walked in
bounded spans; extra columns travel in the struct ``doc``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.staging import small_arrow_batches
from quarry.llm.textkit import slices, string_buffers, window_hashes, word_hashes

STRETCH, STEP = 24, 12
UNKNOWN = "unknown"
#: An n-gram of the training texts is a feature if it is in a template or in so many of them.
COMMON = 12
RATE, PENALTY = 0.5, 0.02
#: Share of wrong families among the held-out verdicts that the calibrated unknown class may leave.
FALSE_SHARE = 0.005

# Notices and sentences of licence families.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0", "Distributed under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0", "you may not use this file except in compliance with the License",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "See the License for the specific language governing permissions and limitations under the License", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license",
    ],
    "MIT": [
        "Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the terms of the MIT license", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Licensed under the ISC License", "SPDX-License-Identifier: ISC"],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GNU GPL version 2",
        "You should have received a copy of the GNU General Public License along with this program", "SPDX-License-Identifier: GPL-2.0-only", "Released under the GPL v3",
    ],
    "LGPL": ["under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-only", "You should have received a copy of the GNU Lesser General Public License along with this library", "Licensed under the LGPL version 3"],
    "AGPL": ["under the terms of the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-only", "You should have received a copy of the GNU Affero General Public License along with this program", "Licensed under the AGPL version 3"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD 3-Clause License", "Released under the BSD license", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "may be used to endorse or promote products derived from this software without specific prior written permission", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "SPDX-License-Identifier: MPL-2.0"],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "Licensed under the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "EUPL": ["Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission", "Licensed under the European Union Public Licence", "SPDX-License-Identifier: EUPL-1.2"],
    "CDDL": ["The contents of this file are subject to the terms of the Common Development and Distribution License", "Licensed under the Common Development and Distribution License", "SPDX-License-Identifier: CDDL-1.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0", "Use, modification and distribution are subject to the Boost Software License", "SPDX-License-Identifier: BSL-1.0"],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software", "Licensed under the zlib License", "SPDX-License-Identifier: Zlib",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "Released under the Unlicense", "SPDX-License-Identifier: Unlicense"],
    "WTFPL": ["Do What The Fuck You Want To Public License", "Licensed under the WTFPL", "SPDX-License-Identifier: WTFPL"],
    "Artistic": ["This is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0", "Licensed under the Artistic License", "SPDX-License-Identifier: Artistic-2.0"],
    "PSF": ["Licensed under the Python Software Foundation License", "PSF hereby grants Licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test", "SPDX-License-Identifier: PSF-2.0"],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", "Licensed under the PostgreSQL License", "SPDX-License-Identifier: PostgreSQL"],
    "OFL": ["This Font Software is licensed under the SIL Open Font License, Version 1.1", "SPDX-License-Identifier: OFL-1.1"],
    "ODbL": ["made available under the Open Database License", "Licensed under the ODbL 1.0", "SPDX-License-Identifier: ODbL-1.0"],
    "GFDL": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License", "SPDX-License-Identifier: GFDL-1.3-or-later"],
    "CC-BY-NC-ND": ["Licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"],
    "CC-BY-NC-SA": ["Licensed under CC BY-NC-SA 4.0", "available under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "available under the Creative Commons Attribution-ShareAlike License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC0": ["Released under CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related rights", "dedicated to the public domain", "SPDX-License-Identifier: CC0-1.0"],
    "Proprietary": [
        "All rights reserved", "Unauthorized copying of this file, via any medium, is strictly prohibited", "This software is proprietary and confidential", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
        "without the prior written permission of the publisher", "SPDX-License-Identifier: LicenseRef-Proprietary",
    ],
}
_ALIKE = [
    "the driver must renew a license every year", "a new version of the program was released under pressure", "he had a public debate with the general", "the author reserved all seats for the rest of the day",
    "she was licensed to fish under the bridge", "version 2.0 of the plan was released today", "the terms of the contract are confidential", "permission to leave was granted to any person", "they work under the terms of a truce",
    "the apache people of the plains", "creative people in common rooms", "redistribution of wealth in modern states", "a licence fee is due in march", "mit researchers released a study", "use of this road is prohibited at night",
    "all rights of way were reserved for walkers", "the union reserved its rights in court", "the eclipse was public and free for all", "an artistic version of the work was made available", "the boost came from a software update",
    "the foundation granted a royalty free stay", "copies of the software were sold without a fee", "the python was released into the domain of the zoo", "the font was made in a public school", "no part of this play may be cut",
]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = True
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _tokens(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case word hashes, starts, first word of each text)."""
    ink = _WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    before, after = np.zeros_like(ink), np.zeros_like(ink)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    starts, ends = np.flatnonzero(ink & (~before | edge[:-1])), np.flatnonzero(ink & (~after | edge[1:])) + 1
    return word_hashes(raw, starts, ends, lower=True), starts, np.searchsorted(starts, bounds)


def _words_of(text: str) -> np.ndarray:
    raw, bounds = string_buffers(pa.array([text], pa.large_string()))
    return _tokens(raw, bounds)[0]


def _grams(words: np.ndarray) -> list[np.ndarray]:
    return [words, window_hashes(words, 2), window_hashes(words, 3)]


@dataclass
class LicenseModel:
    families: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    templates: list[list[np.ndarray]]
    sieve: np.ndarray

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, feature ids) of the hashes in the vocabulary."""
        at = np.flatnonzero(self.sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        hit = self.vocabulary[place] == hashes[at]
        return at[hit], place[hit]

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def confirmed(self, family: int, around: np.ndarray) -> float:
        """The largest share of a template's 3-grams (2-grams of very short ones) found in the words around."""
        seen = np.concatenate([window_hashes(around, 3), window_hashes(around, 2)])
        return max((float(np.isin(t, seen).mean()) for t in self.templates[family]), default=0.0)


def train(seed: int = 5, per_family: int = 120, rounds: int = 60) -> LicenseModel:
    rng = np.random.default_rng(seed)
    families = [*sorted(TEMPLATES), UNKNOWN]
    common = "the of and to in a is that for it as was with be by on not he his this are or at from".split()
    syllables = "er th in on re an st nd ti es or ed le ra ol um".split()

    def filler(n: int) -> str:
        return " ".join(str(rng.choice(common)) if rng.random() < 0.4 else "".join(rng.choice(syllables, int(rng.integers(1, 5)))) for _ in range(n))

    samples: list[tuple[str, int]] = []
    for label, family in enumerate(families[:-1]):
        for _ in range(per_family):
            words = str(rng.choice(TEMPLATES[family])).split()
            if rng.random() < 0.2 and len(words) > 6:
                words.pop(int(rng.integers(len(words))))
            samples.append((" ".join([filler(int(rng.integers(0, 12))), *words, filler(int(rng.integers(0, 12)))]), label))
    every = [t for v in TEMPLATES.values() for t in v]
    for _ in range(3 * per_family):
        kind = rng.random()
        middle = str(rng.choice(_ALIKE)) if kind < 0.5 else ""
        if kind > 0.75:  # a scrap of a template is no licence
            words = str(rng.choice(every)).split()
            at = int(rng.integers(max(1, len(words) - 1)))
            middle = " ".join(words[at : at + 2])
        samples.append((" ".join([filler(int(rng.integers(2, 14))), middle, filler(int(rng.integers(2, 14)))]), len(families) - 1))
    grams = [np.unique(np.concatenate(_grams(_words_of(text)))) for text, _ in samples]
    seen, times = np.unique(np.concatenate(grams), return_counts=True)
    own = np.unique(np.concatenate([np.concatenate(_grams(_words_of(t))) for t in [*every, *_ALIKE]]))
    source = np.union1d(own, seen[times >= COMMON])
    y = np.array([label for _, label in samples])
    held = rng.random(len(y)) < 0.3
    known = [np.intersect1d(g, source, assume_unique=True) for g in grams]
    rows = np.repeat(np.arange(len(y)), [len(g) for g in known])
    columns = np.searchsorted(source, np.concatenate(known))
    w, b = _fit(rows[~held[rows]], columns[~held[rows]], y, held, len(source), len(families), rounds)
    z = np.tile(b, (len(y), 1))
    np.add.at(z, rows, w[columns])
    z = z[held]
    losses = []
    for temperature in (0.5, 0.7, 1.0, 1.4, 2.0):
        s = z / temperature
        s = s - s.max(axis=1, keepdims=True)
        losses.append((float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), y[held]]).mean()), temperature))
    sieve = np.zeros(1 << 16, bool)
    sieve[(source & np.uint64(0xFFFF)).astype(np.int64)] = True
    templates = [[window_hashes(words, 3) if len(words) > 3 else window_hashes(words, 2) for words in map(_words_of, TEMPLATES[f])] for f in families[:-1]]
    model = LicenseModel(families, source, w, b, min(losses)[1], 0.5, templates, sieve)
    p = model.probabilities(z)
    model.least = _least_probability(p, y[held], len(families) - 1)
    return model


def _fit(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, held: np.ndarray, features: int, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression over the sparse ones at (rows, columns), by gradient steps scaled per weight."""
    w, b = np.zeros((features, classes), np.float32), np.zeros(classes, np.float32)
    target = np.eye(classes, dtype=np.float32)[y]
    live = np.flatnonzero(~held)
    heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    filled = rows[heads]
    by_column = np.argsort(columns, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(columns[by_column]) > 0])
    used, order = columns[by_column][starts], rows[by_column]
    past = np.full((len(used), classes), 1e-8, np.float32)
    past_b = np.full(classes, 1e-8, np.float32)
    for _ in range(rounds):
        z = np.tile(b, (len(y), 1))
        z[filled] += np.add.reduceat(w[columns], heads, axis=0)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        d = e / e.sum(axis=1, keepdims=True) - target
        g = np.add.reduceat(d[order], starts, axis=0) + PENALTY * w[used]
        past += g * g
        w[used] -= RATE * g / np.sqrt(past)
        g = d[live].sum(axis=0)
        past_b += g * g
        b -= RATE * g / np.sqrt(past_b)
    return w, b


def _least_probability(p: np.ndarray, y: np.ndarray, unknown: int) -> float:
    """The smallest probability from which on at most ``FALSE_SHARE`` of the held-out family verdicts are wrong."""
    best, top = p.argmax(axis=1), p.max(axis=1)
    order = np.argsort(-top[best != unknown], kind="stable")
    tops, wrong = top[best != unknown][order], (best != y)[best != unknown][order]
    fine = np.flatnonzero(np.cumsum(wrong) <= FALSE_SHARE * np.arange(1, len(wrong) + 1))
    return float(max(0.5, tops[fine[-1]])) if len(fine) else 1.0


def scan_texts(model: LicenseModel, column: pa.Array, confirm: float = 0.6) -> list[dict[str, tuple[float, float, int]]]:
    """Per text: family -> (probability, share of a template found, stretches)."""
    raw_all, bounds_all = string_buffers(column)
    out: list[dict[str, tuple[float, float, int]]] = []
    unknown = len(model.families) - 1
    for at, to in slices(bounds_all):
        raw, bounds = raw_all[bounds_all[at] : bounds_all[to]], bounds_all[at : to + 1] - bounds_all[at]
        words, starts, first = _tokens(raw, bounds)
        found: list[dict[str, tuple[float, float, int]]] = [{} for _ in range(to - at)]
        out.extend(found)
        if not len(words):
            continue
        # A paragraph ends at a blank line or at the text's end; n-grams and stretches stay inside one.
        ink = np.flatnonzero(~_BLANK[raw])
        feed = raw[ink] == 0x0A
        ends = np.zeros(len(raw) + 1, np.int64)
        ends[ink[1:][feed[1:] & feed[:-1]] + 1] = 1
        part = np.cumsum(ends)[starts] + np.repeat(np.arange(to - at), np.diff(first))
        head = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        place = np.arange(len(words)) - np.repeat(head, np.diff(np.r_[head, len(words)]))
        owner = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(words)]))
        spots, features = [], []
        for size, hashes in enumerate(_grams(words), 1):
            p, f = model.known(hashes)
            same = owner[p] == owner[np.minimum(p + size - 1, len(words) - 1)]
            spots.append(p[same])
            features.append(f[same])
        spot, feature = np.concatenate(spots), np.concatenate(features)
        if not len(spot):
            continue
        slot = place[spot] // STEP
        both = np.concatenate([np.stack([owner[spot], slot, feature], 1), np.stack([owner[spot], slot - 1, feature], 1)[slot > 0]])
        both = np.unique(both, axis=0)
        cell, which = np.unique(both[:, :2], axis=0, return_inverse=True)
        logits = np.tile(model.bias, (len(cell), 1))
        np.add.at(logits, which.ravel(), model.weights[both[:, 2]])
        p = model.probabilities(logits)
        best, top = p.argmax(axis=1), p.max(axis=1)
        for c in np.flatnonzero((best != unknown) & (top >= model.least)):
            begin = head[cell[c, 0]] + max(0, cell[c, 1] * STEP - STEP)
            end = min(begin + STRETCH + 2 * STEP, head[cell[c, 0] + 1] if cell[c, 0] + 1 < len(head) else len(words))
            share = model.confirmed(int(best[c]), words[begin:end])
            if share >= confirm:
                text = int(np.searchsorted(first, begin, side="right")) - 1
                name = model.families[best[c]]
                had = found[text].get(name, (0.0, 0.0, 0))
                found[text][name] = (max(had[0], float(top[c])), max(had[1], share), had[2] + 1)
    return out


def license_scan(docs: DataFrame, text: str = "text", model: LicenseModel | None = None, keep: list[str] | None = None) -> DataFrame:
    """(doc struct, license_family, probability, template_share, families) for every row of ``docs``."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    shared = spark.sparkContext.broadcast(train() if model is None else model)  # a few hundred kB
    packed = docs.select(F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("doc"), docs[text].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = []
            for found in scan_texts(shared.value, b.column(1)):
                name = min(found, key=lambda f: (-found[f][0], f), default=None)
                best.append((name, *(found[name][:2] if name else (None, None)), sorted(found)))
            columns = [b.column(0), *(pa.array([r[k] for r in best], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()))))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "license_family", "probability", "template_share", "families"])

    fields = [T.StructField("license_family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("template_share", T.DoubleType()), T.StructField("families", T.ArrayType(T.StringType()))]
    return packed.mapInArrow(run, T.StructType([packed.schema["doc"], *fields]))
