"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns for every corpus operator."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import chat_format, common, components, decontaminate, jaccard_join, language_id, license_scan, mixing, quality_fm, quality_rules, substring_dedup, token_counts
from framewright.llm.queries import vocabulary

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
ODD = [None, "", " ", "  ", " a", "a ", "a  b", "a\n b", "a \nb", "it's  don't\t\tx", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "x  y", "é è  ü", "a\x1cb \x1c c", "1 2  33 4.5", "\n\n\n", "日本語 テキスト 。", "🙂 🙂🙂", "a " * 60, LONG]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, "clash", 1) for i, t in enumerate(ODD)]
    rows += [(3000, "same", "en", "s", "", 1), (3000, "other text", "en", "s", "", 1), (None, "x y", None, None, None, None), (9, "it's  don't\t\tx", "en", None, "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string, n_chars long")


def test_other_columns_may_have_any_name(spark):
    """Every name that the operators use inside, as a string column: it comes back unchanged, or is replaced as documented."""
    names = ["row", "start", "_start", "knots", "_knots", "s", "bucket", "order", "tie", "at", "uses", "target", "lang", "_lang", "own_lang", "symbol_rate", "max_symbol_rate", "kept", "words", "lines", "t"]
    names += ["ranges", "_ranges", "doc", "h", "_h", "w", "n_removed", "_id", "item_id", "position", "epoch", "n", "key", "base", "metric", "found", "gone_id"]
    texts = ["alpha beta gamma delta " * 20, "alpha beta gamma delta " * 20 + "tail", None]
    docs = spark.createDataFrame([(i, t, "src") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    bench = spark.createDataFrame([(1, "nothing of this kind " * 3)], "item_id long, text string")
    for out, replaced in (
        (quality_rules.judge(docs, keep_text=True), {"kept", "base_failed"}),
        (mixing.assign(docs, weight=mixing.by_rank(1), keep_text=True), {"uses", "target"}),
        (mixing.curriculum(mixing.assign(docs, weight=mixing.by_rank(1), keep_text=True)), {"uses", "target", "position", "epoch", "words"}),
        (substring_dedup.remove(docs), {"n_removed"}),
        (decontaminate.clean(docs, bench), set()),
    ):
        assert len({x.lower() for x in out.columns}) == len(out.columns)
        rows = out.collect()
        assert {r.doc_id for r in rows} >= {0, 1}
        for n in set(names) - replaced:
            assert all(r[n] == f"{n}{r.doc_id}" for r in rows), n


def test_running_sums_by_range(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40), i, float(rng.randrange(9))) for i in range(500)]
    got = common.running(spark.createDataFrame(rows, "k long, i long, v double").repartition(7), [F.col("k"), F.col("i")], {"before": "v"}, number="r").collect()
    total = 0.0
    for n, r in enumerate(sorted(got, key=lambda r: (r.k, r.i))):
        assert (r.r, r.before) == (n, total)
        total += r.v


def test_a_shared_folder_is_asked_for(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())
    Session.conf.get = staticmethod(lambda key, default=None: "hdfs://store/ckpt/")
    assert common.shared_dir(Session()) == "hdfs://store/ckpt"


def test_token_counts(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_bytes)
    got = [(r.doc_id, r.n_bytes, r.n_tokens) for r in sorted(token_counts.count(odd, vocabulary()).collect(), key=key)]
    want = [(r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect()]
    assert got == sorted(want, key=lambda r: (r[0] is None, r[0], r[1]))
    assert token_counts.count(odd.limit(0), vocabulary()).count() == 0
    assert sorted(r.n_tokens for r in token_counts.count(odd, vocabulary(), head=2).collect()) == sorted(w[2] for w in want)


def test_substring_dedup(spark, odd):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(40)}" for _ in range(120)] for _ in range(6)]
    texts = [" ".join(base[i % 6][a : a + rng.randrange(15, 90)] + ["z"] * rng.randrange(60)) for i in range(60) for a in (rng.randrange(60),)]
    texts += ["ab cd " * 40, "q " * 70, "q " * 70, "ab cd " * 40 + "tail"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, want = set(), []
    for i, t in enumerate(texts):
        w = t.split()
        gone = set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone |= set(range(k, k + 20))
            seen.add(g)
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove(docs).orderBy("doc_id").collect()]
    assert got == want
    out = substring_dedup.remove(odd)
    assert out.count() == odd.count() and out.filter("n_words is null or kept_text is null").count() == 0
    assert substring_dedup.remove(odd.limit(0)).count() == 0


def test_anchor_depends_on_the_window_alone():
    rng = np.random.default_rng(1)
    h = common.mix(rng.integers(0, 12, 6000).astype(np.uint64))
    starts = np.arange(len(h) - 19)
    doc = np.zeros(len(h), np.int64)
    doc[3000:] = 1
    h[3000:] = np.roll(h[:3000], 7)
    h[500:540] = h[500]
    ok = doc[starts] == doc[starts + 19]
    key, at = substring_dedup.anchors(h, doc, starts[ok], 20)
    known: dict = {}
    for s, k, p in zip(starts[ok].tolist(), key.tolist(), at.tolist()):
        assert known.setdefault(h[s : s + 20].tobytes(), (k, p - s)) == (k, p - s)


def _components(sets, percent):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [root(x) for x in range(len(sets))]


def test_jaccard_join(spark, odd):
    rng = random.Random(5)
    texts = []
    for size in (3, 5, 6, 8, 9, 12, 20, 45, 90, 240):
        base = [f"t{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(1 + size // 25 + 1)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w[rng.randrange(2) :]))
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} for w in words]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.component_id, r.n_shingles) for r in jaccard_join.join(docs).orderBy("doc_id").collect()]
    assert got == list(zip(_components(sets, 75), map(len, sets)))
    out = jaccard_join.join(odd)
    assert out.count() == odd.count()
    assert out.filter("doc_id in (0, 1, 2, 3) and (component_id <> doc_id or n_shingles <> 0)").count() == 0
    assert jaccard_join.join(odd.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_decontamination(spark, odd):
    item = " ".join(f"b{i}" for i in range(40))
    changed = item.replace("b39", "other")
    docs = [(1, "x " * 7 + item.upper() + " y" * 30), (2, "clean " * 50), (3, "a b c " + changed), (4, None), (5, ""), (None, item), (6, LONG + " " + item + " " + LONG), (6, LONG + " " + item + " " + LONG), (7, " ".join(item.split()[:20]))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, item), (12, None), (13, ""), (14, "one two")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect())
    want = Counter({(d, i): n for d, n in ((1, 1), (3, 1), (None, 1), (6, 2)) for i in (10, 11)})
    assert got == want
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {2, 4, 5, 7}
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.matches(docs.limit(0), bench).count() == 0
    assert decontaminate.clean(odd, bench).count() == odd.count()


def test_decontamination_finds_every_near_copy(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 300)
    word = lambda: f"ü{rng.randrange(3000)}"
    items = [[word() for _ in range(n)] for n in (3, 5, 8, 15, 30, 30, 41, 60, 60, 150, 400)]
    items[5][:12] = items[4][:12]
    items[8] = items[8][:15] * 4
    texts = []
    for x in items * 12:
        w = list(x)
        for _ in range(rng.randrange(1 + max(1, len(w) // 40))):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [word()] * rng.randrange(2)
        texts.append([word() for _ in range(rng.choice((0, 0, 40, 290)))] + w[rng.choice((0, 0, 1)) :] + [word() for _ in range(rng.choice((0, 0, 40, 310)))])
    want = {}
    for a, w in enumerate(texts):
        for k, x in enumerate(items):
            known = decontaminate.shingles(x)
            for start in range(-len(x), len(w)):
                low, high = decontaminate.similarity(decontaminate.shingles(w[max(0, start) : max(0, start + len(x))]), known)
                if high and 100 * low >= 75 * high:
                    want[a, k] = max(want.get((a, k), 0), low / high)
    index = decontaminate.Index([(k, " ".join(x).encode()) for k, x in enumerate(items)])
    found = index.search([" ".join(w).upper().encode() for w in texts], common.WordHasher())
    assert {(r[0], r[1]): r[3] / r[4] for r in found} == want
    assert len(want) > 100 and sum(s < 1 for s in want.values()) > 40


def test_hamming_index_is_exact():
    rng = np.random.default_rng(2)
    known = rng.integers(0, 2**63, 300).astype(np.uint64)
    found = np.concatenate([known[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)), rng.integers(0, 2**63, 500).astype(np.uint64)])
    tables = []
    for b in range(4):
        block = ((known >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
        o = np.argsort(block, kind="stable")
        first = np.searchsorted(block[o], np.arange(65537))
        tables.append((o, first, np.diff(first) > 0))
    i, j = decontaminate.Index([]).near(found, known, tables)
    want = {(a, b) for a in range(len(found)) for b in range(len(known)) if bin(int(found[a] ^ known[b])).count("1") <= decontaminate.RADIUS}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_quality_rules(spark, odd):
    judged = quality_rules.judge(odd)
    assert judged.count() == odd.count() and judged.filter("kept is null").count() == 0
    assert judged.filter("doc_id in (0, 1) and kept").count() == 0
    assert quality_rules.judge(odd.limit(0)).count() == 0
    for text in ("a b c", "a b c a b c", "x x x x x", "p q r s p q r t", ""):
        w = text.split()
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        want = len({i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)})
        row = quality_rules.metrics(spark.createDataFrame([(text,)], "text string")).first()
        assert (row.n_words, row.n_repeat_words) == (len(w), want)


def test_sketches_merge(spark):
    rows = spark.createDataFrame([("en", "a" if i % 2 else "b", *(i * k for k in (1, 2, 3, 5))) for i in range(400)], "lang string, source string, " + ", ".join(f"{m} long" for m in quality_rules.METRICS))
    whole = quality_rules.sketch(rows, ["lang"])
    parts = quality_rules.sketch(rows, ["lang", "source"]).groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, whole.select("lang", "metric", "bucket", "n").collect())) == sorted(map(tuple, parts.collect()))
    got = {r.metric: (r.q25, r.q75) for r in quality_rules.quantiles(whole, ["lang"]).collect()}
    for k, m in zip((1, 2, 3, 5), quality_rules.METRICS):
        assert all(want * (1 - 1 / 32) - 1 <= x <= want for x, want in zip(got[m], (99 * k, 299 * k)))


def test_mixing(spark, odd):
    mixed = mixing.assign(odd, weight=mixing.by_rank(3, 1, 2))
    rows = mixed.collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r.size for r in rows)
    for key in {r.source for r in rows}:
        own = [r for r in rows if r.source == key]
        assert sum(r.taken for r in own) == int(own[0].target)
    again = {(r.doc_id, r.size): r.taken for r in mixing.assign(odd.repartition(5), weight=mixing.by_rank(3, 1, 2)).collect()}
    assert again == {(r.doc_id, r.size): r.taken for r in rows}
    assert mixing.assign(odd.limit(0), weight=mixing.by_rank(1)).count() == 0
    order = mixing.curriculum(mixing.assign(odd, weight=mixing.by_rank(1), keep_text=True)).collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and all(0 <= r.position <= 1 for r in order)


def test_schedule_is_inverted(spark):
    knots = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(f).alias("f")) for t, f in ((0.0, 2.0), (0.5, 1.0), (1.0, 0.0))])
    area = lambda t: 2 * t - t * t
    for t in (0.0, 0.1, 0.5, 0.9, 1.0):
        assert abs(spark.range(1).select(mixing._invert(knots, F.lit(area(t) / area(1.0)))).first()[0] - t) < 1e-6


def test_classifiers(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(15)], "doc_id long, label int")
    model = quality_fm.train(odd, labels)
    scored = quality_fm.score(odd, model)
    assert scored.count() == odd.count() and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality_fm.score(odd.limit(0), model).count() == 0
    assert quality_fm.score(odd, quality_fm.train(odd.limit(0), labels)).count() == odd.count()
    lang = language_id.train(odd)
    found = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(odd, lang).collect()}
    assert {(0, "und", 0.0), (1, "und", 0.0), (15, "und", 0.0), (16, "und", 0.0)} <= found
    assert language_id.identify(odd.limit(0), lang).count() == 0
    assert language_id.identify(odd, language_id.train(odd.limit(0))).filter("lang_pred <> 'und'").count() == 0


def test_pairwise_term_is_the_sum_over_pairs():
    m = quality_fm.Machine()
    rng = np.random.default_rng(4)
    m.w = rng.standard_normal(len(m.w)).astype(np.float32)
    i, x = np.array([3, 8, 20, 31]), rng.standard_normal(4).astype(np.float32)
    z, _ = m.logits(np.zeros(4, int), i, x, 1)
    want = m.b + m.w[i] @ x + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert abs(z[0] - want) < 1e-3


def test_mixture_of_languages(spark):
    en, de = "the house and the garden with the river that ", "das haus und der garten mit dem fluss nicht "
    docs = spark.createDataFrame([(i, (en if i % 2 else de) * 30, "en" if i % 2 else "de") for i in range(40)] + [(100, (en + de) * 20, None)], "doc_id long, text string, lang string")
    r = language_id.identify(docs, language_id.train(docs)).filter("doc_id = 100").first()
    assert set(r.languages) == {"de", "en"} and 0.3 < r.languages["en"] < 0.7


def test_mixture_of_five_languages_and_the_likelihood(spark):
    """Sets grow beyond three languages, and EM ends no lower than brute force over a grid of proportions."""
    alphabet = ["abcdefgh", "ijklmnop", "qrstuvwx", "αβγδεζηθ", "абвгдежз"]
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice(alphabet[k]) for _ in range(6))
    text = lambda k, n: " ".join(word(k) for _ in range(n))
    docs = [(10 * k + i, text(k, 80), f"l{k}") for k in range(5) for i in range(8)]
    docs += [(1000, " ".join(text(k, 60) for k in range(5)), None), (1001, text(0, 150) + " " + text(3, 50), None), (1002, text(2, 300), None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.train(df)
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert len(got[1000].languages) == 5 and all(0.15 < v < 0.25 for v in got[1000].languages.values())
    assert set(got[1001].languages) == {"l0", "l3"} and abs(got[1001].languages["l0"] - 0.75) < 0.05 and got[1001].lang_pred == "l0"
    assert got[1002].languages == {"l2": 1.0}
    bucket, word_of, _ = language_id.trigrams([docs[-2][1]])
    ll = np.add.reduceat(model.logp[bucket], np.flatnonzero(np.append(True, word_of[1:] != word_of[:-1])))
    weight = np.bincount(word_of)
    value = lambda share: (weight * np.log(np.exp(ll - ll.max(1)[:, None]) @ share + 1e-300)).sum()
    mine = np.array([got[1001].languages.get(x, 0.0) for x in model.languages])
    grid = [np.eye(5)[0] * a + np.eye(5)[3] * (1 - a) for a in np.linspace(0, 1, 41)]
    assert value(mine) >= max(map(value, grid)) - 0.5


def test_licences(spark, odd):
    rows = [(1, "x\n\nReleased under the MIT License.\n\ny"), (2, "He lost his driving license."), (3, None), (4, ""), (5, "SPDX-License-Identifier: Apache-2.0"), (5, "SPDX-License-Identifier: Apache-2.0"), (6, "Mit der und die.")]
    got = sorted((r.doc_id, r.paragraph, r.family) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, "MIT"), (5, 0, "Apache-2.0"), (5, 0, "Apache-2.0")]
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(odd.limit(0)).count() == 0


PROSE = "They walked along the river for an hour and talked about the garden, the weather and the new bridge near the village. " * 12


def test_licences_in_long_paragraphs(spark):
    """Every notice in front of, inside and behind prose, and two in one paragraph."""
    rows, want = [], set()
    for k, notices in license_scan.NOTICES.items():
        for n in notices:
            for cut in (0, 333, len(PROSE)):
                want.add((len(rows), k))
                rows.append((len(rows), PROSE[:cut] + " " + n + " " + PROSE[cut:]))
    want |= {(len(rows), "GPL"), (len(rows), "BSD")}
    rows.append((len(rows), PROSE + "Licensed under the GPL v3. " + PROSE + "Released under the BSD License. " + PROSE))
    rows.append((len(rows), PROSE))
    got = {(r.doc_id, r.family) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got - want and len(want - got) <= len(want) // 100


WRAPPED = {
    "MIT": """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "Apache-2.0": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright
  notice, this list of conditions and the following disclaimer.
* Redistributions in binary form must reproduce the above copyright
  notice, this list of conditions and the following disclaimer in the
  documentation and/or other materials provided with the distribution.""",
    "GPL": """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
}


def test_wrapped_licence_texts(spark):
    rows = [(i, sep.join(WRAPPED[k].split("\n"))) for i, k in enumerate(WRAPPED) for sep in ("\n",)]
    rows += [(i + 10, " ".join(WRAPPED[k].split())) for i, k in enumerate(WRAPPED)]
    got = {}
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.family)
    assert got == {i + d: {k} for i, k in enumerate(WRAPPED) for d in (0, 10)}
    whole = license_scan.scan(spark.createDataFrame([(0, WRAPPED["MIT"])], "doc_id long, text string")).collect()
    assert sorted(r.paragraph for r in whole) == [1, 2]  # not the name, nor the disclaimer that other licences have too


def test_unheard_of_licences(spark):
    """None of 40 names that the model has never seen is taken for a family it knows."""
    names = ["QPL", "OpenSSL", "Zope", "PHP", "Python", "Perl", "NTP", "Intel", "IBM", "Apple", "Nokia", "Lucent", "Sun", "Adobe", "Fair", "Jam", "Motosoto", "Naumen", "Nethack", "Ricoh"]
    names += ["Frameworx", "Entessa", "Catosl", "Watcom", "Sybase", "W3C", "Xnet", "Zimbra", "Simple", "Blue Oak", "Parity", "Hippocratic", "Elastic", "Redis", "Confluent", "Business Source", "Server Side", "Commons Clause", "Polyform", "Community"]
    forms = ["Released under the {} license.", "This project is licensed under the terms of the {} License, version 1.1.", "Distributed under the {} License, see the LICENSE file.", "SPDX-License-Identifier: {}"]
    rows = [(i, f.format(n)) for i, (n, f) in enumerate((n, f) for n in names for f in forms)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(rows[r.doc_id][1], r.family) for r in got] == []


def test_licence_scores_are_the_models(spark):
    m = license_scan.train()
    texts = [n for v in license_scan.NOTICES.values() for n in v if len(license_scan._words(n)) <= license_scan.CHUNK]
    got = {r.doc_id: (r.family, r.probability) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), unconfirmed=True).collect()}
    for i, t in enumerate(texts):
        z = m.logits(license_scan._words(t)) / m.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        k = m.classes[int(p.argmax())]
        if k == license_scan.UNKNOWN or p.max() <= m.threshold:
            assert i not in got
        else:
            assert got[i][0] == k and abs(got[i][1] - p.max()) < 1e-6
    seen, held = license_scan._examples()
    assert not {t for t, _ in seen} & {t for t, _ in held}


def test_chat(spark):
    texts = ["", "\\", "\\\\", "[INST]", "\\[INST]", "<|im_start|>", "<<SYS>>", "a<|im_sep|>b<|im_end|>\n<|im_start|>user<|im_sep|>", "<<s>>", "$1 \\$2", "é🙂<s>\\", "[INST", "<|im_end|", None, "\t\r\n \x0b"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "as\nsi<|im_sep|>st", None) for t in texts)] + [(2, 0, "user", "x"), (2, 0, "user", "x"), (None, 1, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat_format.format_turns(chat_format.canonical(chat_format.conversations_as_records(df))).collect()
    assert len(done) == 3
    for r in done:
        assert [(t.role, t.text) for t in r.turns] == [(t.role, t.text) for t in r.parsed]
        assert not any(k in r.formatted for k in chat_format.CONTROL[3:])
    records = ['{"instruction":"do","input":"","output":"done"}', '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', '{"x":1}', "not json", None, "[]"]
    out = chat_format.canonical(spark.createDataFrame([(r, "k") for r in records], "record string, layout string"))
    assert [r.layout for r in out.collect()] == ["instruction", "shared conversation", None, None, None, None]
    assert chat_format.canonical(out.limit(0).select("record")).count() == 0


def test_pretokens_are_the_librarys_for_every_code_point(spark):
    path = vocabulary()
    tok = token_counts._load(path)
    pre = token_counts.PreTokens(token_counts.classes(spark, path), token_counts._special(path))
    cuts = lambda t: (lambda text, first, last, _: [text[a:b] for a, b in zip(first, last)])(*pre.cut([t]))
    want = lambda t: [t[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(t)]
    rng = random.Random(1)
    odd = ["a", "s", "t", "re", "ve", "ll", "d", "m", "'", " ", "  ", "\n", "\t", "1", "!", "é", "\xa0", "　", "٣", "—", "\x1c", "​", "\U00011de0", "'ll", "s'", "S"]
    for _ in range(10_000):
        t = "".join(rng.choice(odd) for _ in range(rng.randrange(1, 14)))
        assert cuts(t) == want(t)
    docs = []
    for low in range(0, 0x110000, 1 << 14):
        t = "".join(f".{ch}'ll {ch}  {ch}{ch}x{ch}7 " for ch in map(chr, range(low, low + (1 << 14))) if not "\ud800" <= ch <= "\udfff")
        assert not t or cuts(t) == want(t)
        docs.append((low, t[: 1 << 11]))
    got = {r.doc_id: r.n_tokens for r in token_counts.count(spark.createDataFrame(docs, "doc_id long, text string"), path).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in docs}


def test_token_counts_of_long_texts_and_hot_long_pretokens(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE", 64)
    path = vocabulary()
    tok = token_counts._load(path)
    texts = [LONG, "-" * 500 + " x", "=" * 300, ("-" * 500 + "\n") * 9, "ab" * 400, "a  b " * 300, ("word " * 40 + "<|endoftext|>") * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    for head in (token_counts.HEAD, 3):
        assert [r.n_tokens for r in token_counts.count(docs, path, head=head).orderBy("doc_id").collect()] == want
