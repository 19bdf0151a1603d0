"""Substring dedup by recompression.

Every text is a sequence of word symbols. Rounds rename it: in the first round maximal runs of one symbol become one
symbol; in every round a symbol is a left or a right one by a bit of its name, and each left symbol followed by a
right one becomes one symbol. Names are 64-bit hashes of what they stand for, so equal content has one name in all tasks;
only symbols at the ends of a stretch depend on its surroundings. For a window of WINDOW words the symbols that depend on
the window alone are followed through the rounds; the last of them with the smallest name is the window's anchor: equal
windows have the same anchor at the same place.

1. High-level symbols are exchanged: a Spark round brings the anchors of all texts together by name and keeps those that
   occur more than once (about three words and the windows around them are one row).
2. Windows over shared symbols, and no others, are exchanged by anchor; where an anchor's windows agree in a hash of all
   their words, all but the first are proposed as repeats, each with the place of the first.
3. The words at these places are fetched and compared: what isn't equal word by word stays.

What is shared within a task's batch is settled before anything is sent, so a passage that a third of all documents
share is sent once for each batch, not once for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as c

WINDOW = 20
#: Rounds after that of the runs: symbols then stand for about three words.
ROUNDS = 4
#: Windows that a task gathers before it sends them, and text bytes for each bucket of the exchange.
FLUSH_WINDOWS, BUCKET_BYTES = 2_000_000, 2 << 20
LAST_ID = (1 << 63) - 1
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def window_hashes(h: np.ndarray, window: int) -> np.ndarray:
    """Polynomial hashes of all stretches of `window` words, by doubling."""
    out, done, power, width, block = None, 0, _BASE, 1, h
    step = {1: power}
    left = window
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                part = block
                if out is None:
                    out, done = part, width
                else:
                    m = len(h) - done - width + 1
                    out = out[:m] * step[width] + part[done : done + m]
                    done += width
            left >>= 1
            if left:
                m = len(h) - 2 * width + 1
                block = block[:m] * step[width] + block[width : width + m]
                step[2 * width] = step[width] * step[width]
                width *= 2
        return c.mix(out)


def _name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return c.mix(a * _BASE + c.mix(b + _U(0x632BE59BD9B4E019)))


def anchors(h: np.ndarray, doc: np.ndarray, starts: np.ndarray, window: int):
    """For windows beginning at `starts` in the word hashes h: the anchor's name and the word where it begins.

    doc: the document of each word; symbols never reach over its ends. Where nothing inside a window is independent of its
    surroundings (a window within one run), its own hash is the anchor.
    """
    n = len(h)
    name, pos, who = h, np.arange(n, dtype=np.int64), doc
    key, at = np.zeros(len(starts), _U), starts.copy()
    live = np.arange(len(starts))
    a, b = starts.copy(), starts + window - 1
    # runs of one word
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (name[1:] != name[:-1]) | (who[1:] != who[:-1])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, n))
    name = np.where(length > 1, _name(name[first], length.astype(_U)), name[first])
    pos, who = pos[first], who[first]
    a, b = group[a] + 1, group[b] - 1
    some = a <= b
    alone = live[~some]
    for i in range(window if len(alone) else 0):
        with np.errstate(over="ignore"):
            key[alone] = key[alone] * _BASE + h[starts[alone] + i]
    live, a, b = live[some], a[some], b[some]
    for r in range(ROUNDS + 1):
        if not len(live):
            break
        if r < ROUNDS:
            left = (c.mix(name + _U(r + 1)) & _U(1)) == 0
            joins = np.zeros(len(name), bool)  # starts a pair
            joins[:-1] = left[:-1] & ~left[1:] & (who[:-1] == who[1:])
            keep = np.ones(len(name), bool)
            keep[1:] = ~joins[:-1]
            to = np.cumsum(keep) - 1
            na = np.where(left[a], to[a], to[np.minimum(a + 1, len(name) - 1)])
            nb = np.where(left[b], to[np.maximum(b - 1, 0)], to[b])
            na[(~left[a]) & (a >= b)] = len(name)  # nothing is left
            nb[left[b] & (a >= b)] = -1
            some = na <= nb
        else:
            some = np.zeros(len(a), bool)
        over = ~some
        if over.any():
            x, y, w = a[over], b[over], live[over]
            best = x.copy()
            for k in range(1, int((y - x).max()) + 1):
                at_k = np.minimum(x + k, y)
                best = np.where(name[at_k] < name[best], at_k, best)
            key[w], at[w] = name[best], pos[best]
        if r == ROUNDS or not some.any():
            break
        pairs = np.flatnonzero(joins)
        merged = name.copy()
        merged[pairs] = _name(name[pairs], name[pairs + 1])
        name, pos, who = merged[keep], pos[keep], who[keep]
        live, a, b = live[some], na[some], nb[some]
    return key, at


def _pack48(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).reshape(-1)


def _unpack48(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = b.reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _firsts(same: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each item the number of the equal one at the smallest place (itself if none has a smaller place)."""
    o = np.lexsort((place, same))
    s = same[o]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    first = o[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = np.empty(len(s), np.int64)
    out[o] = np.where(place[first] < place[o], first, o)
    return out


#: Windows starting at words s..e repeat those that start at words src_s.. of the document src.
RANGES = "doc bigint, h int, s int, e int, src bigint, src_h int, src_s int"
_RANGE_KINDS = ("<i8", "<i4", "<i4", "<i4", "<i8", "<i4", "<i4")


def _ranges(gone: np.ndarray, first: np.ndarray, rank: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, hs: np.ndarray) -> list[np.ndarray]:
    """The columns of RANGES for the windows `gone` (ascending, windows of a document in order), which repeat `first`."""
    d, p, q, r = doc[gone], pos[gone], pos[first], doc[first]
    new = np.ones(len(gone), bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1) | (r[1:] != r[:-1]) | (q[1:] != q[:-1] + 1)
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(gone)) - 1
    if not len(gone):
        a = z = np.zeros(0, np.int64)
    return [x.astype(k) for x, k in zip((ids[d[a]], hs[d[a]], p[a], p[z], ids[r[a]], hs[r[a]], q[a]), _RANGE_KINDS)]


class _Texts:
    """Word hashes of texts, each (doc, h) once for each batch."""

    def __init__(self, window: int) -> None:
        self.window, self.seen = window, set()

    def hashes(self, ids: list[int], hs: list[int], texts: list[bytes]):
        """The rows that are new and long enough, their numbers of words, and all their words' hashes."""
        h, many = c.hash_words(texts)
        rows = []
        for k, (i, key) in enumerate(zip(ids, hs)):
            if many[k] >= self.window and (i, key) not in self.seen:
                self.seen.add((i, key))
                rows.append(k)
        rows = np.array(rows, np.int64)
        keep = np.zeros(len(texts), bool)
        keep[rows] = True
        return rows, many[rows], h[np.repeat(keep, many)]


SYMBOLS = "key bigint, n int, doc bigint, h int, start int, off int, many int"


class _Symbols(_Texts):
    """Gathers the anchors of a task's texts: rows of SYMBOLS.

    A row is an anchor with the `many` windows around it, the first of which begins `off` words before it at word `start`.
    n is 1 for an anchor that the batch has once and 0 for one that it has again and that is known to be shared with that; one row
    without a document then tells the other batches (n = 2).
    """

    def __init__(self, window: int) -> None:
        super().__init__(window)
        self.parts, self.n = [], 0

    def add(self, ids: list[int], hs: list[int], texts: list[bytes]) -> None:
        rows, lengths, h = self.hashes(ids, hs, texts)
        if not len(rows):
            return
        doc = np.repeat(np.arange(len(rows)), lengths)
        starts = np.flatnonzero(doc[: len(doc) - self.window + 1] == doc[self.window - 1 :])
        key, at = anchors(h, doc, starts, self.window)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        a = np.flatnonzero(new)
        d = doc[starts[a]]
        first = np.cumsum(lengths) - lengths
        self.parts.append((key[a].view(np.int64), np.array(ids, np.int64)[rows[d]], np.array(hs, np.int32)[rows[d]], starts[a] - first[d], at[a] - starts[a], np.diff(np.append(a, len(key)))))
        self.n += len(starts)

    def flush(self) -> pa.RecordBatch:
        key, doc, h, start, off, many = (np.concatenate(x) for x in zip(*self.parts))
        names, which, count = np.unique(key, return_inverse=True, return_counts=True)
        n = np.where(count[which] > 1, 0, 1).astype(np.int32)
        told = names[count > 1]
        blank = pa.nulls(len(told), pa.int64())
        cols = {"key": np.concatenate([key, told]), "n": np.concatenate([n, np.full(len(told), 2, np.int32)])}
        out = {k: pa.array(v) for k, v in cols.items()}
        for k, v, kind in (("doc", doc, pa.int64()), ("h", h, pa.int32()), ("start", start, pa.int32()), ("off", off, pa.int32()), ("many", many, pa.int32())):
            out[k] = pa.concat_arrays([pa.array(v).cast(kind), blank.cast(kind)])
        self.parts, self.n = [], 0
        self.seen.clear()
        return pa.record_batch(out)


class _Packer(_Texts):
    """Gathers windows over shared symbols, settles the repeats among them and packs the rest by bucket."""

    def __init__(self, buckets: int, window: int) -> None:
        super().__init__(window)
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.parts, self.ids, self.hs, self.n = [], [], [], 0
        self.seen.clear()

    def add(self, ids: list[int], hs: list[int], texts: list[bytes], listed: pa.ListArray) -> None:
        """listed: for each text its anchors (key, start, off, many)."""
        rows, lengths, h = self.hashes(ids, hs, texts)
        if not len(rows):
            return
        wh = window_hashes(h, self.window)
        offsets = listed.offsets.to_numpy()
        many = np.diff(offsets)[rows]
        fields = dict(zip(("key", "start", "off", "many"), (x.to_numpy(zero_copy_only=False) for x in listed.values.flatten())))
        at = np.repeat(offsets[rows], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        local = np.repeat(np.arange(len(rows)), many)
        key, start, off, n = (fields[x][at] for x in ("key", "start", "off", "many"))
        o = np.lexsort((start, local))  # windows of a document in their order
        key, start, off, n, local = key[o], start[o].astype(np.int64), off[o], n[o].astype(np.int64), local[o]
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin = np.cumsum(lengths) - lengths
        pos = np.repeat(start, n) + j
        base = len(self.ids)
        self.ids.extend(ids[k] for k in rows)
        self.hs.extend(hs[k] for k in rows)
        self.parts.append((np.repeat(key, n).view(_U), wh[np.repeat(begin[local], n) + pos], (base + np.repeat(local, n)).astype(np.int32), pos.astype(np.int32), (np.repeat(off, n) - j).astype(np.uint8)))
        self.n += len(j)

    def flush(self) -> pa.RecordBatch:
        key, wh, doc, pos, off = (np.concatenate(x) for x in zip(*self.parts))
        ids, hs = np.array(self.ids, np.int64), np.array(self.hs, np.int32)
        rank = np.unique(ids, return_inverse=True)[1]
        first = _firsts(_name(key, wh), (rank[doc].astype(np.int64) << 32) | pos)
        gone = np.flatnonzero(first != np.arange(len(first)))
        blobs, to, kind = [], [], []
        found = _ranges(gone, first[gone], rank, doc, pos, ids, hs)
        for lo in range(0, len(found[0]), 20_000):
            blobs.append(b"".join(v[lo : lo + 20_000].tobytes() for v in found))
            to.append(int((found[0][lo] + lo) % self.buckets))
            kind.append(1)
        live = np.ones(len(key), bool)
        live[gone] = False
        key, wh, doc, pos, off = key[live], wh[live], doc[live], pos[live], off[live]
        # records: consecutive windows with one anchor
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (off[1:] != off[:-1] - 1)
        s = np.flatnonzero(new)
        many = np.diff(np.append(s, len(key)))
        bucket = (c.mix(key[s]) % _U(self.buckets)).astype(np.int32)
        o = np.argsort(bucket, kind="stable")
        s, many, bucket = s[o], many[o], bucket[o]
        at = np.repeat(s - (np.cumsum(many) - many), many) + np.arange(many.sum())
        wh = wh[at]
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(s) else np.zeros(0, int)
        upto = np.append(0, np.cumsum(many))
        for lo, hi in zip(edges, np.append(edges[1:], len(s))):
            r = s[lo:hi]
            blobs.append(b"".join(v.tobytes() for v in (
                np.array([len(r)], "<u4"), key[r], ids[doc[r]], hs[doc[r]], pos[r], off[r], many[lo:hi].astype(np.uint8), _pack48(wh[upto[lo] : upto[hi]]))))
            to.append(int(bucket[lo]))
            kind.append(0)
        self.clear()
        return pa.record_batch({"bucket": pa.array(to, pa.int32()), "kind": pa.array(kind, pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _resolve(table: pa.Table) -> pa.Table:
    """One bucket: the ranges of window starts that repeat an earlier window."""
    own: tuple[list, ...] = tuple([] for _ in _RANGE_KINDS)
    parts: tuple[list, ...] = ([], [], [], [], [], [], [])
    width = sum(np.dtype(k).itemsize for k in _RANGE_KINDS)
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
        x = np.frombuffer(blob, np.uint8)
        n, at = (len(x) // width, 0) if kind == 1 else (int(x[:4].view("<u4")[0]), 4)
        for col, k in zip(own, _RANGE_KINDS) if kind == 1 else zip(parts, ("<u8", "<i8", "<i4", "<i4", "u1", "u1")):
            size = n * np.dtype(k).itemsize
            col.append(np.frombuffer(x[at : at + size].tobytes(), k))
            at += size
        if kind == 0:
            parts[6].append(_unpack48(x[at:]))  # 6 bytes for each window
    cols = [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(own, _RANGE_KINDS)]
    if parts[0]:
        key, ids, hs, pos, off, many, wh = (np.concatenate(x) for x in parts)
        m = many.astype(np.int64)
        rec = np.repeat(np.arange(len(key)), m)
        j = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        same = _name(key[rec], wh ^ ((off[rec] - j).astype(_U) << _U(56)))
        p = pos[rec].astype(np.int64) + j
        rank = np.unique(ids, return_inverse=True)[1]
        first = _firsts(same, (rank[rec].astype(np.int64) << 32) | p)
        gone = np.flatnonzero(first != np.arange(len(first)))
        more = _ranges(gone, first[gone], rank, rec, p, ids, hs)
        cols = [np.concatenate([x, y]) for x, y in zip(cols, more)]
    return pa.table({name.split()[0]: pa.array(x) for name, x in zip(RANGES.split(", "), cols)})


def text_key(docs: DataFrame, text: str) -> tuple[Column, bool]:
    """What tells apart the texts of one doc_id, and whether doc_ids are unique: a hash of the text if some doc_id occurs again, else nothing."""
    unique = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    return (F.lit(0) if unique else F.xxhash64(text).bitwiseAND(0x7FFFFFFF).cast("int")), unique


def shared_symbols(rows: DataFrame, window: int) -> DataFrame:
    """(doc, h, key, start, off, many) from rows (doc, h, t): the anchors that occur more than once in all texts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Symbols(window)
        for batch in batches:
            for part in c.slices(batch, "t", 4 << 20):
                found.add(part.column("doc").to_pylist(), part.column("h").to_pylist(), part.column("t").to_pylist())
                if found.n >= FLUSH_WINDOWS:
                    yield found.flush()
        if found.n:
            yield found.flush()

    symbols = c.materialize(rows.mapInArrow(send, SYMBOLS), "symbols")
    total = F.sum("n").over(W.partitionBy("key"))
    again = symbols.filter("n > 0").withColumn("total", total).filter("total > 1 and doc is not null")
    cols = ["doc", "h", "key", "start", "off", "many"]
    out = c.materialize(symbols.filter("n = 0").select(*cols).unionByName(again.select(*cols)), "shared")
    c.discard(symbols)
    return out


def repeats(docs: DataFrame, *, window: int = WINDOW, text: str = "text", key: Column | None = None) -> DataFrame:
    """(doc, h, s, e, src, src_h, src_s): windows starting at words s..e of that document repeat the earlier windows from src_s on.

    doc is doc_id, with the largest long for null; h is the text_key. Earlier: a smaller doc_id, or the same and a smaller
    start. The windows agree in 112 bits of hash; remove() compares their words.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(256, size // BUCKET_BYTES)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"),
        (text_key(docs, text)[0] if key is None else key).alias("h"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"),
    )
    shared = shared_symbols(rows, window)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Packer(buckets, window)
        for batch in batches:
            for part in c.slices(batch, "t", 2 << 20):
                pack.add(part.column("doc").to_pylist(), part.column("h").to_pylist(), part.column("t").to_pylist(), part.column("listed"))
                if pack.n >= FLUSH_WINDOWS:
                    yield pack.flush()
        if pack.n:
            yield pack.flush()

    listed = shared.groupBy("doc", "h").agg(F.collect_list(F.struct("key", "start", "off", "many")).alias("listed"))
    sent = rows.join(listed, ["doc", "h"]).select("doc", "h", "t", "listed").mapInArrow(send, "bucket int, kind int, blob binary")
    out = c.materialize(sent.groupBy("bucket").applyInArrow(_resolve, RANGES), "repeats")
    c.discard(shared)
    return out


def merged(ranges: DataFrame) -> DataFrame:
    """Ranges that touch and repeat one stretch become one."""
    w = W.partitionBy("doc", "h", "src", "src_h", "shift").orderBy("s", "e")
    t = ranges.withColumn("shift", F.col("s") - F.col("src_s"))
    t = t.withColumn("reach", F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1)))
    t = t.withColumn("part", F.sum(F.when(F.col("s") <= F.col("reach") + 1, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return t.groupBy("doc", "h", "src", "src_h", "shift", "part").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("src_s").alias("src_s")).drop("shift", "part")


#: Places of one source that are fetched together; a source that very many documents repeat is read several times.
TOGETHER = 4096


def fetch(wanted: DataFrame, sources: DataFrame, window: int) -> DataFrame:
    """(doc, h, s, e, w) from ranges and rows (src, src_h, t): w is what stands at the earlier place, words joined by one space."""
    n = F.count("*").over(W.partitionBy("src", "src_h"))
    part = F.pmod(F.xxhash64("doc", "h", "s"), F.expr(f"1 + n div {TOGETHER}")).alias("part")
    asked = wanted.withColumn("n", n).select("src", "src_h", part, F.struct("doc", "h", "s", "e", "src_s").alias("r"))
    asked = asked.groupBy("src", "src_h", "part").agg(F.collect_list("r").alias("asked"))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in c.slices(whole, "t", 1 << 20):
                listed = batch.column("asked")
                cols = dict(zip(("doc", "h", "s", "e", "src_s"), (x.to_numpy(zero_copy_only=False) for x in listed.flatten().flatten())))
                ends = np.cumsum([len(x) for x in listed]).tolist()
                first, out = cols["src_s"].tolist(), []
                last = (cols["src_s"] + cols["e"] - cols["s"] + window).tolist()
                at = 0
                for t, end in zip(batch.column("t").to_pylist(), ends):
                    words = t.split()
                    out.extend(b" ".join(words[a:z]) for a, z in zip(first[at:end], last[at:end]))
                    at = end
                yield pa.record_batch([*(pa.array(cols[k], kind) for k, kind in zip(("doc", "h", "s", "e"), kinds)), pa.array(out, pa.binary())], names=["doc", "h", "s", "e", "w"])

    return sources.join(asked, ["src", "src_h"]).select("t", "asked").mapInArrow(run, "doc long, h int, s int, e int, w binary")


def remove(docs: DataFrame, *, window: int = WINDOW, text: str = "text") -> DataFrame:
    """`docs` with n_words, n_removed and kept_text (the words that stay, joined by one space).

    A word goes if a repeated window covers it; windows are those of the input. Null or empty text: no words, an empty
    kept_text. Texts shorter than the window are left alone. A null doc_id counts as one that is larger than all others.
    Equal rows get equal results and don't repeat each other. An empty table gives an empty result. Texts are never cut.
    Columns with the names above are replaced, all others pass through whatever their names.
    """
    key, unique = text_key(docs, text)
    place = [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), key.alias("h")]
    found = repeats(docs, window=window, text=text, key=key)
    wanted = c.materialize(merged(found), "wanted")
    c.discard(found)
    sources = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"), place[0].alias("src"), place[1].alias("src_h"))
    if not unique:
        sources = sources.dropDuplicates(["src", "src_h"])
    fetched = c.materialize(fetch(wanted, sources, window), "fetched")
    by_doc = fetched.groupBy("doc", "h").agg(F.collect_list(F.struct("s", "e", "w")).alias("ranges"))
    kept = [x for x in docs.columns if x.lower() not in {"n_words", "n_removed", "kept_text"}]
    left = docs.select(F.struct(*[F.col(f"`{x}`") for x in kept]).alias("row"), *place)
    joined = left.join(by_doc, ["doc", "h"], "left").select("row", "ranges")
    where = kept.index(next(x for x in kept if x.lower() == text.lower()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in c.slices(whole.append_column("t", whole.column("row").field(where)), "t"):
                total, gone, left = [], [], []
                for t, ranges in zip(batch.column("t").to_pylist(), batch.column("ranges").to_pylist()):
                    words = (t or "").encode().split()
                    total.append(len(words))
                    edge = np.zeros(len(words) + 1, np.int32)
                    for r in ranges or ():
                        for s, e in equal_windows(words, r["w"].split(b" "), r["s"], window):
                            edge[s] += 1
                            edge[e] -= 1
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0) if ranges else range(len(words))
                    gone.append(len(words) - len(stay))
                    left.append(b" ".join([words[i] for i in stay] if gone[-1] else words).decode())
                yield pa.record_batch([batch.column("row"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())], names=["row", "n_words", "n_removed", "kept_text"])

    schema = joined.select("row", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_text")).schema
    return joined.mapInArrow(cut, schema).select("row.*", "n_words", "n_removed", "kept_text")


def equal_windows(words: list[bytes], other: list[bytes], start: int, window: int) -> Iterator[tuple[int, int]]:
    """Stretches (from, to) of at least `window` words from `start` on in which `words` and `other` are equal."""
    own = words[start : start + len(other)]
    if own == other:
        yield start, start + len(own)
        return
    run = 0
    for i, (a, b) in enumerate(zip(own, other)):
        run = run + 1 if a == b else 0
        if run >= window and (i + 1 == min(len(own), len(other)) or own[i + 1] != other[i + 1]):
            yield start + i + 1 - run, start + i + 1
