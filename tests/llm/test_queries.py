"""The corpus queries against SQL, and the pipeline against its parts."""

import hashlib
import math
import random
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from test_catalogue import compare  # noqa: E402

from framewright.llm import chat_format, decontaminate, license_scan  # noqa: E402
from framewright.llm import queries as q  # noqa: E402


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query(spark, data, name):
    compare(spark, data, q.QUERIES[name](spark, data), q.SQL[name])


def test_token_counts_are_the_librarys(spark, data):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(q.vocabulary())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in q.op1_token_counts(spark, data).collect():
        n = len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def _texts(spark, data, name="documents", key="doc_id"):
    return {r[key]: r.text or "" for r in spark.read.parquet(f"{data}/{name}.parquet").collect()}


def _windowed(words: list[str], item: list[str]) -> tuple[int, int]:
    """The best weighted similarity of the item to any place of the text, as (low, high); brute force."""
    known = decontaminate.shingles(item)
    near = [i for i in range(len(words)) if tuple(words[i : i + min(5, len(item))]) in known]
    best = 0, 1
    for start in sorted({i + d for i in near for d in range(-len(item), len(item))}):
        low, high = decontaminate.similarity(decontaminate.shingles(words[max(0, start) : max(0, start + len(item))]), known)
        if high and low * best[1] > best[0] * high:
            best = low, high
    return best


def _leaks(texts: dict, items: dict) -> dict:
    """(document, item) -> similarity, for all pairs of 0.75 or more."""
    split = lambda t: t.lower().split()
    out = {}
    for i, x in items.items():
        x = split(x)
        known = decontaminate.shingles(x)
        for d, t in texts.items():
            w = split(t)
            if x and not known.keys().isdisjoint(decontaminate.shingles(w)) or (len(x) < 5 and x):
                low, high = _windowed(w, x)
                if 100 * low >= 75 * high:
                    out[d, i] = low / high
    return out


def test_decontamination_is_brute_force(spark, data):
    want = _leaks(_texts(spark, data), _texts(spark, data, "benchmark", "item_id"))
    got = {(r.doc_id, r.item_id): r.similarity for r in q.op2_decontamination(spark, data).collect()}
    assert got == pytest.approx(want) and len(want) >= 3


def test_decontamination_of_edited_items(spark, data):
    """Words changed, inserted or deleted at two rates: every copy of the required similarity is found, no other."""
    rng = random.Random(4)
    items = _texts(spark, data, "benchmark", "item_id")
    texts, filler = {}, " ".join(_texts(spark, data).values()).split()
    for i, x in items.items():
        for every in (20, 50):
            for how in ("change", "insert", "delete"):
                w = x.split()
                for at in sorted(rng.sample(range(len(w)), max(1, len(w) // every)), reverse=True):
                    w[at : at + (how != "insert")] = [] if how == "delete" else [rng.choice(filler)]
                a = rng.randrange(len(filler) - 60)
                texts[len(texts)] = " ".join(filler[a : a + 30] + w + filler[a + 30 : a + 60])
    want = _leaks(texts, items)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(docs, spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    assert got == pytest.approx(want) and len({d for d, _ in want}) > len(texts) // 3


def test_classifier_on_held_out_rows(spark, data):
    data = data.replace("sf0.001", "sf0.01")  # the smaller table has a handful of bad documents
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = q.op3_quality_classifier(spark, data).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert good and bad
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) >= 0.98
    assert sum(r.predicted == 0 for r in rows if r.quality == 1) <= 0.1 * len(good)
    assert sum(r.predicted == 1 for r in rows if r.quality == 0) <= 0.2 * len(bad)


def test_language_on_held_out_rows(spark, data):
    found = q.op9_language_id(spark, data).join(spark.read.parquet(f"{data}/documents.parquet"), "doc_id").filter("held_out")
    assert found.filter("lang <> lang_pred").count() <= 0.03 * found.count()


def test_conversations_come_in_several_layouts(spark, data):
    rows = spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text")
    marks = chat_format.canonical(chat_format.conversations_as_records(rows)).groupBy("fingerprint", "layout").count().collect()
    assert len(marks) >= 4 and all(r.layout for r in marks)


def test_licence_paragraphs(spark, data):
    parts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.posexplode(F.split("text", license_scan.BLANK)).alias("paragraph", "part"))
    want = {(r.doc_id, r.paragraph) for r in parts.filter("lower(part) rlike 'licensed under|released under'").collect()}
    got = {(r.doc_id, r.paragraph) for r in q.op6_license_scan(spark, data).collect()}
    assert got == want


def _near_duplicates(texts: dict) -> set:
    """The smallest document of each component of links; brute force."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in texts.items():
        w = t.translate(lower).encode().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    return {d for d in texts if top(d) == d}


def _without_repeats(texts: dict) -> dict:
    seen, out = set(), {}
    for d in sorted(texts):
        w, gone = texts[d].encode().split(), set()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if g in seen:
                gone |= set(range(i, i + 20))
            seen.add(g)
        if len(gone) < len(w) or not gone:
            out[d] = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else texts[d]
    return out


def _mix(texts: dict, source: dict) -> list:
    """(doc_id, epoch, words, position) by the rules of the mix, one source after the other."""
    key = lambda s: (s is None, (s or "").encode())
    size = {d: len(t.encode().split()) for d, t in texts.items()}
    names = sorted({source[d] for d in texts}, key=key)
    own = {s: sum(size[d] for d in texts if source[d] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    open_, target, left = set(names), {}, 1.5 * sum(own.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 2 * own[s] < level * weight[s]]
        for s in full or list(open_):
            target[s] = 2.0 * own[s] if full else level * weight[s]
            left -= target[s]
            open_.remove(s)
    out = []
    for i, s in enumerate(names):
        f0, f1 = ((2, 1), (1, 2), (1, 1))[i % 3]
        at = 0
        for epoch in (0, 1):
            for d in sorted((d for d in texts if source[d] == s), key=lambda d: hashlib.md5(str(d).encode()).hexdigest()):
                n = max(0, min(size[d], int(target[s]) - at))
                if n:
                    u = min(1.0, (at + n / 2) / max(1.0, target[s])) * (f0 + f1) / 2
                    out.append((d, epoch, n, 2 * u / (f0 + math.sqrt(max(0.0, f0 * f0 + 2 * (f1 - f0) * u)))))
                at += size[d]
    return out


def test_pipeline_is_brute_force(spark, data):
    import corpus_pipeline as p

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    source = dict(con.execute("select doc_id, source from documents").fetchall())
    kept = {r[0] for r in con.execute(f"select doc_id from ({q.SQL['op7_quality_rules']}) where kept").fetchall()}
    texts = {d: t for d, t in _texts(spark, data).items() if d in kept}
    whole = dict(texts)
    firsts = _near_duplicates(texts)
    texts = _without_repeats({d: t for d, t in texts.items() if d in firsts})
    leaks = {d for d, _ in _leaks(texts, _texts(spark, data, "benchmark", "item_id"))}
    texts = {d: t for d, t in texts.items() if d not in leaks}
    want = {(d, e): (n, round(x, 9)) for d, e, n, x in _mix(texts, source)}
    rows = p.run(spark, data).collect()
    assert {(r.doc_id, r.epoch): (r.words, pytest.approx(r.position, abs=1e-8)) for r in rows} == want
    assert all(r.text == texts[r.doc_id] for r in rows)
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    # every stage had something to do
    assert len(whole) < len(source) and len(firsts) < len(whole) and leaks and any(t != whole[d] for d, t in texts.items())


def test_stages_on_odd_tables(spark, data):
    """Nulls in any column, empty, repeated and very long texts, ids that texts share, a column with a clashing name, no rows."""
    import corpus_pipeline as p

    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))
    good = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
    rows = [(1, good, "en", "s", 5), (1, good, "en", "s", 5), (2, good, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, good + " more", "en", "s", 1), (None, None, None, None, None)]
    rows += [(5, "one text " * 40, "en", "s", 1), (5, "another text " * 40, "en", "s", 1), (6, long, "en", "t", 1), (7, "tail " + long, "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("position", F.lit("x"))
    for name, stage in p.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, data)
            found = out.collect()
            assert out.columns[:5] == p.COLUMNS and (len(out.columns) == 5) == (name != p.STAGES[-1][0])
            assert bool(found) == (df is docs), name
            kept = [(r.doc_id, r.text) for r in found] if df is docs else kept
        if name == "ngram_jaccard_join":  # of the copies the first, of rows that share an id one
            assert sorted(i for i, _ in kept if i is not None) == [1, 3, 4, 5, 6] and len(kept) == 7
        if name == "substring_dedup":
            assert {i for i, _ in kept} >= {1, None, 3, 4, 6} and (7, "tail") in kept and 2 not in {i for i, _ in kept}
        if name == "benchmark_decontamination":
            assert len(kept) == len(rows)
        if name == "source_mixing":
            assert all(t for _, t in kept)


@pytest.mark.parametrize("name", ["op3_quality_classifier", "op7_quality_rules", "op9_language_id"])
def test_one_row_for_each_row(spark, data, tmp_path, name):
    """Repeated rows, rows that share an id but not a text, null ids and very long texts come back row by row."""
    base = spark.read.parquet(f"{data}/documents.parquet")
    extra = [(1, "other text of a shared id", "en", "s", 3), (None, "no id", "en", None, None), (None, None, None, None, None), (9_000_001, "lang word " * 60_000, "en", "s", 1)]
    docs = base.unionByName(base.limit(3)).unionByName(spark.createDataFrame(extra, base.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = q.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(got) == base.count() + 3 + len(extra)
    assert all(v is not None for r in got for k, v in r.asDict().items() if k != "doc_id")
