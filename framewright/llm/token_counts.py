"""Token counts of byte-level BPE without ids.

A byte-level BPE never merges across pre-tokens, so a document's count is the sum over its distinct pre-tokens of
frequency times pieces. One pass finds the distinct pre-tokens of the corpus and how often they occur; each is cut
into pieces once. A second pass forms the pre-token frequencies of every document and joins: the most frequent
`head` pre-tokens, a fixed number, by broadcast; the others, none of which has more than a `head`-th of all occurrences,
by a shuffle on the pre-token.

Pre-tokens follow from four classes of characters: letters, numbers, white space, others. Which class a character has is
asked of the tokenizers library, for every code point, so its version of Unicode is the one that counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: Pre-tokens joined by broadcast. Those of more than LONG characters are broadcast as a digest.
HEAD, LONG = 1 << 18, 48
#: Distinct pre-tokens that a task gathers before it sends them; characters that are cut up at once.
FLUSH, PIECE = 400_000, 1 << 18
LETTER, NUMBER, OTHER, SPACE = range(4)
CODE_POINTS, SURROGATES, BLOCK = 0x110000, range(0xD800, 0xE000), 256
_U = np.uint64


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _special(path: str) -> list[str]:
    """The added tokens that a text may hold, the longest first. A file that isn't of the kind handled here is an error."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError("not a plain byte-level BPE")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"]):
        raise ValueError("added tokens that take in the characters around them are not handled")
    return sorted((t["content"] for t in spec["added_tokens"]), key=lambda x: (-len(x), x))


def probe(tok, first: int, last: int) -> np.ndarray:
    """The classes of the code points first..last-1, from how the library cuts them beside a number, a letter and a mark.

    A block that makes one pre-token behind a mark, or behind a letter, needs no closer look.
    """
    kinds = np.full(last - first, OTHER, np.uint8)
    points = [i for i in range(first, last) if i not in SURROGATES and i != 0x20]
    if last - first > BLOCK:
        return np.concatenate([probe(tok, i, min(last, i + BLOCK)) for i in range(first, last, BLOCK)])
    for kind, ch in ((OTHER, "!"), (LETTER, "a")):
        if len(tok.pre_tokenizer.pre_tokenize_str(ch + "".join(map(chr, points)))) == 1:
            kinds[np.array(points, np.int64) - first] = kind
            return kinds
    text = "".join(f"1{ch}a!{ch}a" for ch in map(chr, points))
    start = np.zeros(len(text) + 1, bool)
    start[[at for _, (at, _) in tok.pre_tokenizer.pre_tokenize_str(text)]] = True
    at = np.arange(len(points)) * 6
    kind = np.where(~start[at + 1], NUMBER, np.where(~start[at + 2], LETTER, np.where(~start[at + 4], OTHER, SPACE)))
    kinds[np.array(points, np.int64) - first] = kind
    if first <= 0x20 < last:
        kinds[0x20 - first] = SPACE
    return kinds


_classes: dict[tuple, np.ndarray] = {}


def classes(spark: SparkSession, path: str) -> np.ndarray:
    """The class of every code point (1.1 MB), asked of the library once for each file and driver."""
    key = path, os.path.getmtime(path)
    if key not in _classes:
        step = 1 << 14

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tok = _load(path)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                yield pa.record_batch({"first": pa.array(ids, pa.int64()), "kinds": pa.array([probe(tok, i, i + step).tobytes() for i in ids], pa.binary())})

        rows = spark.range(0, CODE_POINTS, step, 17).mapInArrow(run, "first long, kinds binary").collect()
        _classes[key] = np.frombuffer(b"".join(bytes(r.kinds) for r in sorted(rows)), np.uint8)
    return _classes[key]


class PreTokens:
    """Cuts texts into pre-tokens as the published pattern of byte-level BPE does: contractions, then runs of letters, of
    numbers and of other characters with one space before them, then white space."""

    def __init__(self, table: np.ndarray, special: list[str]) -> None:
        self.table = table
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.gap = re.compile(r"(?<=\w) (?=\w)")

    def parts(self, text: str) -> tuple[list[str], int]:
        """The stretches between special strings, and how many of those there are. Long stretches are cut before a space
        between two words, where a pre-token begins in any case."""
        found = self.special.split(text) if self.special else [text]
        out = []
        for x in found:
            while len(x) > 2 * PIECE:
                m = self.gap.search(x, PIECE)
                if not m or m.start() >= len(x) - 1:
                    break
                out.append(x[: m.start()])
                x = x[m.start() :]
            if x:
                out.append(x)
        return out, len(found) - 1

    def cut(self, parts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The parts joined, and for each pre-token its first character there, its last one plus one, and its part."""
        text = "".join(parts)
        n = len(text)
        if not n:
            none = np.zeros(0, np.int64)
            return text, none, none, none
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = self.table[code]
        size = np.array([len(p) for p in parts])
        edge = np.zeros(n + 1, bool)  # a part begins
        edge[np.cumsum(size) - size] = True
        edge[n] = True
        start = edge[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        # one space goes with what follows; of several, the last one
        start[1:] &= (code[:-1] != 0x20) | edge[1:n] | space[1:]
        start[:-1] |= space[:-1] & ~space[1:] & ~edge[1:n]
        at = np.flatnonzero(start & (code == 0x27))
        at = at[at + 1 < n]
        at = at[(kind[at + 1] == LETTER) & ~edge[at + 1]]
        if len(at):
            a = code[at + 1]
            b = np.where(edge[at + 2], 0, code[np.minimum(at + 2, n - 1)])
            one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
            two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            start[at[one | two] + 1] = False
            after = np.concatenate([at[one] + 2, at[two] + 3])
            after = after[(after < n) & ~edge[after]]
            start[after[kind[after] == LETTER]] = True
        first = np.flatnonzero(start)
        last = np.append(first[1:], n)
        return text, first, last, np.searchsorted(np.cumsum(size), first, "right")

    def distinct(self, parts: list[str]):
        """text, first and last as in cut() for each distinct pre-token, and its number and part for each pre-token."""
        text, first, last, part = self.cut(parts)
        if not len(first):
            return text, first, last, first, part
        code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(_U)
        place = np.arange(len(code)) - np.repeat(first, last - first)
        h = np.add.reduceat(c.mix(code | (place.astype(_U) << _U(24))), first)
        _, at, which = np.unique(h, return_index=True, return_inverse=True)
        return text, first[at], last[at], which, part


def _key(pretoken: str) -> str:
    """What a pre-token is looked up by: itself, or if it is long a digest (which no pre-token is, as it mixes classes)."""
    return pretoken if len(pretoken) <= LONG else "\0" + hashlib.md5(pretoken.encode()).hexdigest()


def _key_column(pretoken: Column) -> Column:
    return F.when(F.length(pretoken) <= LONG, pretoken).otherwise(F.concat(F.lit("\0"), F.md5(pretoken.cast("binary"))))


def pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(pretoken, n, pieces): every distinct pre-token of the corpus, its occurrences, and its number of BPE pieces."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(classes(spark, path))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = PreTokens(table.value, _special(path))
        found: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            done = pa.record_batch({"pretoken": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})
            found.clear()
            return done

        for batch in batches:
            for part in c.slices(batch, "t", PIECE):
                stretches = [p for t in part.column("t").to_pylist() if t for p in pre.parts(t)[0]]
                for group in c.grouped(stretches, len, PIECE):
                    joined, first, last, which, _ = pre.distinct(group)
                    many = np.bincount(which, minlength=len(first)).tolist()
                    for a, b, n in zip(first.tolist(), last.tolist(), many):
                        p = joined[a:b]
                        found[p] = found.get(p, 0) + n
                    if len(found) > FLUSH:
                        yield out()
        yield out()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _load(path)
        for batch in batches:
            for part in c.slices(batch, "pretoken", 1 << 16):
                got = tok.encode_batch_fast(part.column("pretoken").to_pylist(), add_special_tokens=False)
                yield pa.record_batch({"pretoken": part.column("pretoken"), "n": part.column("n"), "pieces": pa.array([len(e) for e in got], pa.int64())})

    found = docs.select(F.col(text).alias("t")).mapInArrow(distinct, "pretoken string, n long")
    once = found.groupBy("pretoken").agg(F.sum("n").alias("n"))
    return once.mapInArrow(cut, "pretoken string, n long, pieces long")


def most_frequent(known: DataFrame, head: int) -> DataFrame:
    """The rows with the largest n, at most `head`: all above a bound read off a histogram of log-linear buckets of n.

    The histogram has 64 rows for each power of two, so what the driver gets doesn't grow with the number of tasks.
    """
    bucket = F.expr("shiftleft(shiftright(n, greatest(0, length(bin(n)) - 7)), greatest(0, length(bin(n)) - 7))")
    rows = known.groupBy(bucket.alias("low")).agg(F.count("*").alias("m")).collect()
    total, bound = 0, None
    for r in sorted(rows, key=lambda r: -r.low):
        total += r.m
        if total > head:
            break
        bound = r.low
    return known.filter(F.col("n") >= bound) if bound is not None else known.limit(0)


def count(docs: DataFrame, path: str, *, text: str = "text", head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens for every row of `docs`, without begin, end or added special tokens.

    path: a tokenizer file of the tokenizers library with a byte-level BPE; every executor reads it there.
    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows each come back; rows that share a doc_id but not a
    text are told apart by a hash of the text. An empty table gives an empty result; other columns are ignored.
    Long texts are counted piece by piece. Pre-tokens are told apart by 64 bits within a piece, else by their characters.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(classes(spark, path))
    known = c.materialize(pieces(docs, path, text), "pieces")
    top = most_frequent(known, head).select(_key_column(F.col("pretoken")).alias("key"), "pieces")
    # at most `head` rows of at most LONG characters, whatever the corpus
    shared = spark.sparkContext.broadcast({r[0]: r[1] for r in top.collect()})
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ["doc_id", "h", "pretoken", "freq", "rows", "n_bytes", "n_tokens"]

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, common = PreTokens(table.value, _special(path)), shared.value

        def rest(group: list[tuple[str, int]], tokens: np.ndarray, ids: np.ndarray, hs: np.ndarray) -> pa.RecordBatch:
            """Adds the tokens of common pre-tokens to their documents; rows for the other ones."""
            joined, first, last, which, part = pre.distinct([p for p, _ in group])
            own = np.array([k for _, k in group])[part]
            strings = [joined[a:b] for a, b in zip(first.tolist(), last.tolist())]
            size = np.fromiter((common.get(s if len(s) <= LONG else _key(s), -1) for s in strings), np.int64, len(strings))
            each = size[which]
            some = each >= 0
            tokens += np.bincount(own[some], each[some], len(tokens)).astype(np.int64)
            cell, many = np.unique(own[~some] * len(strings) + which[~some], return_counts=True)
            k, s = cell // max(1, len(strings)), cell % max(1, len(strings))
            zero = np.zeros(len(cell), np.int64)
            cols = (ids[k], hs[k], pa.array(strings, pa.string()).take(pa.array(s)), many, zero, zero, zero)
            return pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(cols, kinds)], names=names)

        for batch in batches:
            for part in c.slices(batch, "t", PIECE):
                texts = part.column("t").to_pylist()
                tokens = np.zeros(len(texts), np.int64)
                ids, hs = part.column("doc_id"), part.column("h").to_numpy(zero_copy_only=False)
                at = np.arange(len(texts))
                stretches = []
                for k, t in enumerate(texts):
                    found, n = pre.parts(t)
                    tokens[k] += n
                    stretches.extend((p, k) for p in found)
                for group in c.grouped(stretches, lambda x: len(x[0]), PIECE):
                    more = rest(group, tokens, at, hs)
                    yield more.set_column(0, "doc_id", ids.take(more.column("doc_id")))
                one = np.ones(len(texts), np.int64)
                none = pa.nulls(len(texts), pa.string())
                yield pa.record_batch([ids, part.column("h"), none, pa.array(one), pa.array(one), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens)], names=names)

    parts = rows.mapInArrow(frequencies, "doc_id long, h long, pretoken string, freq long, rows long, n_bytes long, n_tokens long")
    parts = c.materialize(parts, "frequencies")
    tail = (
        parts.filter(F.col("pretoken").isNotNull())
        .join(known.select("pretoken", "pieces"), "pretoken")
        .select("doc_id", "h", F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("n_bytes"), (F.col("freq") * F.col("pieces")).alias("n_tokens"))
    )
    heads = parts.filter(F.col("pretoken").isNull()).select("doc_id", "h", "rows", "n_bytes", "n_tokens")
    # m equal rows: every sum is m times that of one row
    sums_ = heads.unionByName(tail).groupBy("doc_id", "h").agg(*[F.sum(x).alias(x) for x in ("rows", "n_bytes", "n_tokens")])
    one = sums_.select("doc_id", F.expr("n_bytes div rows").alias("n_bytes"), F.expr("n_tokens div rows").alias("n_tokens"), "rows")
    return one.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("_i", "rows")
