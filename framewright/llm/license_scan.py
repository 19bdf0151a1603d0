"""Licence scans by a trained paragraph classifier [native: DataFrame functions only].

A paragraph is what stands between blank lines, its lines joined. A multinomial logistic regression over word 1- and 2-grams
tells licence families and an unknown class apart. It is trained here, on the driver, from the notices and sentences below and
from negatives: prose, standard disclaimers that several licences share, and notices of other licences. Its temperature and
threshold are calibrated on whole notices, and on whole licences of the unknown class, that are left out of training. Only the
non-zero weights matter: a stretch without any word that can outweigh the unknown class is passed over. Paragraphs longer than
CHUNK words are classified in overlapping chunks, so that a notice within a long text is seen with few words
around it, and a licence's text is recognised sentence by sentence. What is predicted is confirmed by the nearest template of the
family: by the share of the template's words that stand in a window of its length, if at least half of the words that set
the template apart from other families (a licence's name, say) are among them. Documents are never joined or shuffled.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Customary notices of licence families and sentences of the licences' published texts and recommended headers.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Distributed under the MIT License, see the LICENSE file.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
        "This project is distributed under the Apache License 2.0.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL v3.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "Released under the LGPL version 3.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Released under the AGPL version 3.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the 3-clause BSD license.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
        "Licensed under the ISC license.",
    ],
    "Zlib": [
        "Released under the zlib License.",
        "SPDX-License-Identifier: Zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "Licensed under the zlib license.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
        "Released under the Boost Software License 1.0.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "Released under the Mozilla Public License 2.0.",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
        "Released under the Eclipse Public License version 2.0.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
        "Released under the Unlicense.",
    ],
    "CC0": [
        "Released under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
        "This work is dedicated to the public domain under the CC0 waiver.",
    ],
    "Proprietary": [
        "Copyright 2020 Example Corporation. All rights reserved.",
        "Proprietary and confidential. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
#: The header that the GNU licences recommend, with the licence's name left open, and the Creative Commons terms.
_GNU = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "See the GNU {} for more details.",
    "You should have received a copy of the GNU {} along with this program.",
]
_GNU_NAMES = {"GPL": "General Public License", "LGPL": "Lesser General Public License", "AGPL": "Affero General Public License"}
_TERMS = {"NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
for _k, _n in _GNU_NAMES.items():
    NOTICES[_k] = [x.format(_n) for x in _GNU] + NOTICES[_k]
for _t in ((), ("SA",), ("ND",), ("NC",), ("NC", "SA"), ("NC", "ND")):
    _k, _n = "-".join(("CC", "BY", *_t)), "-".join(("Attribution", *(_TERMS[x] for x in _t)))
    NOTICES[_k] = [
        f"Licensed under CC {_k[3:]} 4.0.", f"This work is licensed under a Creative Commons {_n} 4.0 International License.", f"SPDX-License-Identifier: {_k}-4.0", f"Released under the {_k} license.",
    ]
#: Paragraphs that speak of licences or share their words without granting one.
NEGATIVES = [
    "He lost his driving license on the way home.", "The licence fee was raised again this year.", "She is a licensed electrician.",
    "The general public was invited to the opening.", "A version of this story was published before.", "The software was free of charge.",
    "All work and no play.", "Free beer for all students of the university.", "The Apache helicopter landed near the village.",
    "He studied at MIT and later moved abroad.", "The right of way was granted to the farmers.", "Permission to land was refused.",
    "The terms were not acceptable to either side.", "The foundation was laid two years ago.", "Source and target are compared word by word.",
    "He came with the train, mit dem Zug.", "license", "licensed", "released", "public", "commons", "copyright", "software",
    "", "the of and to in is was for that with as it on by", "1.0 2.0 3.0", "Commons was in session until midnight.", "The public library is closed.",
    "The new album was released under great secrecy.", "The town was under the protection of the crown.", "All rights and duties pass to the heirs.",
    "A copy of the letter was included in the file.", "The above conditions were agreed to in writing.", "The copyright of the novel expired in the last century.",
]
#: Standard disclaimers that stand in several licences and so tell no family.
DISCLAIMERS = [
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
]
#: Licences of the unknown class: those that train it, and those that calibrate it.
OTHERS = ["WTFPL", "Artistic", "CDDL", "Ruby", "Vim", "Acme Corp", "House Rules", "Open Government", "Beerware", "Foo"]
OTHERS_HELD = ["OFL", "EUPL", "PSF", "MS-PL", "Academic Free", "Bar Industries", "Database Contents", "Sleepycat"]
_OTHER_FORMS = ["Released under the {} license.", "Licensed under the {} License, version 2.0.", "SPDX-License-Identifier: {}-1.0", "This project is licensed under the terms of the {} license.", "Distributed under the {} Public License, see the LICENSE file."]
UNKNOWN = "unknown"
#: Function words, which are features only beside another word.
FUNCTION_WORDS = set(
    "a all an and any are as at be been below but by can do for from had has have he her here his i if in into is it its me may met more no not of on one or our "
    "see she so than that the their them then there these they this to under up via was we were what which who will with without work you your".split()
)
#: Similarity to a template from which a prediction counts as confirmed, and the share of its own words it takes.
CONFIRM, OWN = 0.6, 0.5
#: Sentences of more than LONGEST words are cut into templates of that length at most.
LONGEST = 28
#: Windows begin at STEP words of a chunk, which has MARGIN words more on either side of these windows.
STEP, MARGIN = 12, 4
_SPLIT = r"[^a-z0-9]+"


def _words(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


#: Words of a chunk: a window as long as the longest template may begin at each of its STEP words.
CHUNK = MARGIN + STEP + LONGEST + MARGIN


def _cut(text: str) -> list[str]:
    """A notice in pieces of nearly equal length, LONGEST words at most."""
    w = _words(text)
    k = -(-len(w) // LONGEST)
    return [" ".join(w[i * len(w) // k : (i + 1) * len(w) // k]) for i in range(k)]


@functools.lru_cache(maxsize=1)
def templates() -> dict[str, list[tuple[int, list[str], list[str]]]]:
    """For each family the templates: number of words, distinct words, and those of them that no other family's templates have."""
    cut = {k: [_words(p) for n in v for p in _cut(n)] for k, v in NOTICES.items()}
    used = {k: {w for t in v for w in t} for k, v in cut.items()}
    own = {k: {w for w in used[k] if not w.isdigit() and not any(w in used[x] for x in used if x != k)} for k in cut}
    return {k: [(len(t), sorted(set(t)), sorted(set(t) & own[k])) for t in v] for k, v in cut.items()}


def _light(word: str) -> bool:
    """Too common to be a feature by itself."""
    return word in FUNCTION_WORDS or word.isdigit() or len(word) == 1


def _grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def _variants(text: str) -> list[str]:
    """The text as it may stand: alone, among other words and, if it is long enough to be known from a part, cut off."""
    w = _words(text)
    out = [w, ["the", *w], [*w, "see", "below"], ["all", "content", "here", "is", *w]]
    return [" ".join(x) for x in (out + [w[2:], w[:-2]] if len(w) > 12 else out)]


class Model:
    def __init__(self, classes: list[str], vocabulary: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, threshold: float) -> None:
        self.classes, self.vocabulary, self.weights, self.bias = classes, vocabulary, weights, bias
        self.temperature, self.threshold = temperature, threshold

    def triggers(self) -> list[str]:
        """The words of features that can matter: were all features of a chunk weaker, unknown would still win."""
        lift = (self.weights[:, :-1] - self.weights[:, -1:]).max(1)
        enough = (self.bias[-1] - self.bias[:-1].max()) / (2 * CHUNK)
        return sorted({w for g, x in zip(self.vocabulary, lift) if x >= enough for w in g.split() if not _light(w)})

    def logits(self, words: list[str]) -> np.ndarray:
        """Of one stretch of words, as the native expression gives them; for tests."""
        index = {g: i for i, g in enumerate(self.vocabulary)}
        return self.bias + sum((self.weights[index[g]] for g in set(_grams(words)) if g in index), np.zeros(len(self.classes)))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _examples() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(text, class) to train on and to calibrate by: the last notice of each family and the licences OTHERS_HELD are held out."""
    seen, held = [], []
    for k, notices in NOTICES.items():
        for n in notices:
            to = held if n == notices[-1] else seen
            to.extend((v, k) for p in _cut(n) for v in _variants(p))
    for n in NEGATIVES + [p for d in DISCLAIMERS for p in _cut(d)]:
        seen.extend((v, UNKNOWN) for v in (n, n + " " + n[: len(n) // 2]))
    for names, to in ((OTHERS, seen), (OTHERS_HELD, held)):
        to.extend((v, UNKNOWN) for name in names for f in _OTHER_FORMS for v in _variants(f.format(name)))
    return seen, held


def _fit(rows: list[tuple[str, str]], classes: list[str], steps: int, rate: float, l1: float):
    """(vocabulary, weights, bias) by proximal gradient descent (L1, so that the weights are sparse)."""
    vocabulary = sorted({g for t, _ in rows for g in _grams(_words(t)) if not all(map(_light, g.split()))})
    x, y = _table(rows, vocabulary, classes)
    # classes weigh alike, the unknown one as much as ten families
    each = (np.where(np.arange(len(classes)) == len(classes) - 1, 10.0, 1.0) / np.maximum(1, np.bincount(y, minlength=len(classes))))[y]
    each = (each / each.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((len(vocabulary), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    one = np.eye(len(classes), dtype=np.float32)[y]
    xt = np.ascontiguousarray(x.T)
    for _ in range(steps):
        g = (_softmax(x @ w + b) - one) * each
        w -= rate * (xt @ g)
        b -= rate * 0.1 * g.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - l1 * rate * 0.1, 0)
    b[-1] = max(b[-1], b[:-1].max() + 1.0)  # an empty paragraph is unknown
    return vocabulary, w, b


def _table(rows: list[tuple[str, str]], vocabulary: list[str], classes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    index = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for r, (t, _) in enumerate(rows):
        for g in set(_grams(_words(t))):
            if g in index:
                x[r, index[g]] = 1
    return x, np.array([classes.index(k) for _, k in rows])


@functools.lru_cache(maxsize=1)
def train(steps: int = 200, rate: float = 8.0, l1: float = 1.5e-3) -> Model:
    """Fitted twice: without the held-out examples, which give temperature and threshold, and then with them for the weights.

    The threshold is the smallest from 0.5 on that no more than one in a hundred of the held-out unknown examples exceeds.
    """
    classes = [*NOTICES, UNKNOWN]
    seen, held = _examples()
    vocabulary, w, b = _fit(seen, classes, steps, rate, l1)
    x, y = _table(held, vocabulary, classes)
    z = x @ w + b
    temps = np.geomspace(0.25, 4, 33)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in temps]
    t = float(temps[int(np.argmin(loss))])
    p = np.sort(_softmax(z[y == len(classes) - 1] / t)[:, :-1].max(1))
    threshold = float(max(0.5, np.round(p[int(len(p) * 0.99)], 4)))
    vocabulary, w, b = _fit(seen + held, classes, steps, rate, l1)
    live = np.abs(w).sum(1) > 0
    return Model(classes, [v for v, k in zip(vocabulary, live) if k], np.round(w[live], 4).astype(float), np.round(b, 4).astype(float), t, threshold)


def _word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _SPLIT), "")


#: What ends a paragraph: a line break, then lines of nothing but white space.
BLANK = r"\n[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*"
#: Parts of the weights' table; a feature is looked up in its part only.
_PARTS = 128


def scan(docs: DataFrame, model: Model | None = None, *, text: str = "text", unconfirmed: bool = False) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed for every paragraph and confirmed licence family in it.

    Paragraphs are split by blank lines and numbered from 0; their lines count as joined. A family is given once for a
    paragraph, with the similarity that is highest, the probability that is highest at equal ones.
    With unconfirmed=True also predictions that no template of the family confirms; else those count as unknown. Null and empty
    texts, and texts without a licence, give no row; repeated rows give their rows each; texts are scanned whole. An empty table
    gives an empty result. Other columns are ignored.
    """
    m = model or train()
    words = m.triggers()
    text_of = lambda x: "'" + x.replace("'", "''") + "'"
    list_of = lambda v: "array(" + ", ".join(map(text_of, v)) + ")" if v else "CAST(array() AS array<string>)"
    part_of = lambda g: zlib.crc32(g.encode()) % _PARTS
    row = lambda v: "array(" + ", ".join(f"{x!r}D" for x in v) + ")"
    parts: list[list[int]] = [[] for _ in range(_PARTS)]
    for i, g in enumerate(m.vocabulary):
        parts[part_of(g)].append(i)
    weights = m.weights.tolist()
    known = F.expr("array(" + ", ".join(
        f"map_from_arrays({list_of([m.vocabulary[i] for i in p])}, " + ("array(" + ", ".join(row(weights[i]) for i in p) + ")" if p else "CAST(array() AS array<array<double>>)") + ")" for p in parts
    ) + ")")
    weight = lambda g: F.get(known, (F.crc32(g.cast("binary")) % _PARTS).cast("int"))[g]
    zero = F.array(*[F.lit(0.0) for _ in m.classes])
    start = F.array(*[F.lit(float(v)) for v in m.bias])
    notices = F.expr("map(" + ", ".join(
        f"{text_of(k)}, array(" + ", ".join(f"struct({n} AS n, {list_of(w)} AS w, {list_of(d)} AS d)" for n, w, d in v) + ")" for k, v in templates().items()
    ) + ")")
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), BLANK, -1)).alias("paragraph", "_text"))
    lines = lines.filter(F.exists(_word_array(F.col("_text")), lambda w: w.isin(words)))
    names = F.array(*[F.lit(x) for x in m.classes])
    add = lambda a, g: F.zip_with(a, F.coalesce(weight(g), zero), lambda p, q: p + q)

    def grams(w: Column) -> Column:
        two = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 1)), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
        return F.array_distinct(F.filter(F.concat(w, two), lambda g: g.isin(m.vocabulary)))

    def within(w: Column, first: Column, last: Column, n: Column) -> Column:
        """The largest share of the template's words in a window of its length that begins at word `first` to `last` and has enough of its own words."""
        last = F.greatest(first, F.least(last, F.size(w) - n["n"]))

        def share(i: Column) -> Column:
            both = F.array_intersect(F.slice(w, i + 1, n["n"]), n["w"])
            enough = lambda b: F.size(F.array_intersect(b, n["d"])) >= OWN * F.size(n["d"])
            return c.let(both, lambda b: F.when(enough(b), F.size(b) / F.size(n["w"])).otherwise(F.lit(0.0)))

        return F.array_max(F.transform(F.sequence(first, last), share))

    def judged(w: Column, e: Column, first: Column, last: Column) -> Column:
        top = F.array_max(e)
        family = F.get(names, (F.array_position(e, top) - 1).cast("int"))
        return F.struct(
            F.coalesce(F.array_max(F.transform(notices[family], lambda n: within(w, first, last, n))), F.lit(0.0)).alias("similarity"),
            (top / F.aggregate(e, F.lit(0.0), lambda a, v: a + v)).alias("probability"),
            family.alias("family"),
        )

    def classify(p: Column) -> Column:
        scores = lambda g: F.transform(F.aggregate(g, start, add), lambda v: F.exp(v / m.temperature))
        return c.let(grams(p["w"]), lambda g: c.let(scores(g), lambda e: judged(p["w"], e, p["first"], p["last"])))

    def stretches(w: Column) -> Column:
        """The words as a whole, or in chunks if they are many: words, and the first and last word where windows begin."""
        part = lambda w, first, last: F.struct(w.alias("w"), first.alias("first"), last.alias("last"))

        def chunk(i: Column) -> Column:
            before = F.least(i, F.lit(MARGIN))
            return part(F.slice(w, i - before + 1, before + CHUNK - MARGIN), before, before + STEP - 1)

        chunks = F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(STEP)), chunk)
        whole = F.array(part(w, F.lit(0), F.lit(CHUNK)))
        return F.when(F.size(w) > CHUNK, F.filter(chunks, lambda p: F.exists(p["w"], lambda x: x.isin(words)))).otherwise(whole)

    counts = lambda r: (r["family"] != UNKNOWN) & (r["probability"] > m.threshold) & (F.lit(unconfirmed) | (r["similarity"] >= CONFIRM))
    best = lambda found: F.transform(
        F.array_distinct(F.transform(found, lambda r: r["family"])), lambda f: F.array_max(F.filter(found, lambda r: r["family"] == f))
    )
    # the generators keep the results from being computed anew for each of their fields
    found = lines.select("doc_id", "paragraph", F.explode(F.array(_word_array(F.col("_text")))).alias("_w"))
    found = found.select("doc_id", "paragraph", F.explode(F.array(stretches(F.col("_w")))).alias("_p"))
    found = found.select("doc_id", "paragraph", F.explode(F.array(F.filter(F.transform("_p", classify), counts))).alias("_f"))
    return found.select("doc_id", "paragraph", F.explode(best(F.col("_f"))).alias("_r")).select(
        "doc_id", "paragraph", "_r.family", "_r.probability", "_r.similarity", (F.col("_r.similarity") >= CONFIRM).alias("confirmed")
    )
