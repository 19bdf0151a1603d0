"""Benchmark decontamination with SimHash windows.

Benchmark items are few and given; they are taken in blocks of at most BLOCK_ITEMS, and each block goes over all
documents once. Window sizes form a fixed ladder; an item is represented by the largest size c with stride s such that
c + s - 1 words fit into it, by its s windows of c words at offsets 0..s-1. Documents are cut into windows of the same
sizes every s words, so wherever an item stands in a document, one document window covers exactly the words of one of the
item's windows. Fingerprints are 64-bit SimHashes of the windows' words. Four indexes over 16-bit blocks find all pairs of
fingerprints within RADIUS = 3 bits: of four blocks at least one is equal. Every such candidate is verified by the weighted
Jaccard similarity (sum of minima over sum of maxima of counts) of 5-word shingles between the item and the document's words
at the place where the item would lie.

These windows miss most changed copies, so an item is represented by sub-windows of WIDTH words as well, as many of its rarest
as a copy of the required similarity cannot all lack. Documents are fingerprinted at every word for these, equal fingerprints
are candidates, and all places around such a candidate are tried: every pair of the required similarity is found.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Items in a block, and bytes of their texts, about.
RADIUS, BLOCK_ITEMS, BLOCK_BYTES = 3, 2000, 8 << 20
WIDTH, PERCENT = 5, 75
#: Words handled at once within a text; longer texts go in overlapping pieces.
PIECE_WORDS = 60_000
_U = np.uint64


def words_of(text: bytes) -> list[str]:
    """Lower case and white space are Unicode's."""
    return text.decode("utf-8", "replace").lower().split()


def ladder(words: int) -> tuple[int, int]:
    """Window size and stride for an item of so many words: sizes grow by a quarter, the stride is a quarter."""
    best, size = (1, 1), 1
    while True:
        stride = max(1, size // 4)
        if size + stride - 1 > words:
            return best
        best = (size, stride)
        size = max(size + 1, size * 5 // 4)


def running(h: np.ndarray, longest: int) -> np.ndarray:
    """Running counts of the 64 bits over the words' hashes, one row more than words.

    The counts lie side by side in 64-bit numbers, 8 bits each (16 or 32 if a window may be longer than 255 or 65,535 words). They
    overflow into each other, but a difference over a window is exact, as each of its counts fits.
    """
    lane = np.uint8 if longest < 1 << 8 else np.uint16 if longest < 1 << 16 else np.uint32
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(lane)
    bits = bits.view("<u8")
    out = np.zeros((len(h) + 1, bits.shape[1]), _U)
    np.cumsum(bits, axis=0, out=out[1:])
    return out


def simhashes(sums: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the windows of `size` words that begin at `starts`: the majority of each bit."""
    lane = {8: np.uint8, 16: np.uint16, 32: np.uint32}[sums.shape[1]]
    counts = (sums[starts + size] - sums[starts]).view(lane)
    return np.packbits(counts > size // 2, axis=1, bitorder="little").view("<u8").reshape(-1)


def shingles(words: list[str], width: int = WIDTH) -> Counter:
    """Counts of `width`-word shingles; fewer words are one shingle."""
    if len(words) < width:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*[words[i:] for i in range(width)]))


def similarity(a: Counter, b: Counter) -> tuple[int, int]:
    """Weighted Jaccard as (sum of minima, sum of maxima)."""
    low = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return low, sum(a.values()) + sum(b.values()) - low


def best_place(words: list[str], n: int, known: Counter, hits: list[int], percent: int) -> tuple[int, int, int] | None:
    """(start, low, high) of the place most similar to the item (of n words), the first of equal ones, if percent or more.

    A place is n words, less what lies before or after the text. Only places with one of `hits` (sorted numbers of
    shingles of the text) are tried.
    """
    width = min(n, WIDTH)
    m, total = n - width + 1, len(words) - width + 1
    best = None
    at = 0
    while at < len(hits):
        first = hits[at] - m + 1  # places from first to last, whose shingles run to last + m - 1
        while at + 1 < len(hits) and hits[at + 1] - m < hits[at] + 1:
            at += 1
        last = hits[at]
        at += 1
        base, end = max(0, first), min(total, last + m)
        own = [tuple(words[i : i + width]) for i in range(base, end)]
        own = [g if g in known else None for g in own]
        if 100 * (len(own) - own.count(None)) < percent * m:
            continue
        count: dict = {}
        low = 0
        for i in range(base, last + m):  # shingle i comes, shingle i - m goes: the place begins at i - m + 1
            g = own[i - base] if i < end else None
            if g:
                count[g] = k = count.get(g, 0) + 1
                low += k <= known[g]
            g = own[i - m - base] if i - m >= base else None
            if g:
                low -= count[g] <= known[g]
                count[g] -= 1
            start = i - m + 1
            if start < first:
                continue
            high = m + min(total, start + m) - max(0, start) - low
            if 100 * low >= percent * high and (best is None or low * best[2] > best[1] * high):
                best = max(0, start), low, high
    return best


class Index:
    """The fingerprints of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, bytes]], percent: int = PERCENT) -> None:
        hasher = c.WordHasher()
        longest = max((ladder(len(words_of(t)))[0] for _, t in items), default=1)
        self.items = []  # id, number of words, shingles
        sizes: dict[tuple[int, int], list] = {}
        sub: dict[int, list[tuple[int, list[int]]]] = {}
        for item_id, text in items:
            w = words_of(text)
            if not w:
                continue
            size, stride = ladder(len(w))
            at = np.arange(stride)
            sums = running(c.mix(hasher(w)), longest)
            fp = simhashes(sums, size, at)
            k = len(self.items)
            width = min(len(w), WIDTH)
            sub.setdefault(width, []).append((k, simhashes(sums, width, np.arange(len(w) - width + 1)).tolist()))
            self.items.append((item_id, len(w), shingles(w)))
            sizes.setdefault((size, stride), []).extend((int(f), k, int(o)) for f, o in zip(fp, at))
        self.classes = []
        for (size, stride), rows in sorted(sizes.items()):
            fp = np.array([r[0] for r in rows], _U)
            tables = []
            for b in range(4):
                block = ((fp >> _U(16 * b)) & _U(0xFFFF)).astype(np.int64)
                o = np.argsort(block, kind="stable")
                first = np.searchsorted(block[o], np.arange(65537))
                tables.append((o, first, np.diff(first) > 0))
            self.classes.append((size, stride, fp, [r[1] for r in rows], [r[2] for r in rows], tables))
        self.percent = percent
        self.subwindows = [(width, *self.selected(rows, percent)) for width, rows in sorted(sub.items())]

    @staticmethod
    def selected(rows: list[tuple[int, list[int]]], percent: int):
        """(mask, all fingerprints, the selected ones, their items) from (item, fingerprints of its sub-windows), sorted.

        Of m sub-windows a copy shares at least percent of m, so it shares one of any m - that + 1. Selected are those in the
        fewest items.
        """
        spread = Counter(f for _, fps in rows for f in set(fps))
        pairs = []
        for k, fps in rows:
            m, seen = len(fps), 0
            count = Counter(fps)
            for f in sorted(count, key=lambda f: (spread[f], f)):
                pairs.append((f, k))
                seen += count[f]
                if seen > m - max(1, -(-percent * m // 100)):
                    break
        pairs.sort()
        every = np.array(sorted(spread), _U)
        mask = np.zeros(1 << 20, bool)
        mask[(every & _U(len(mask) - 1)).astype(np.int64)] = True
        return mask, every, np.array([f for f, _ in pairs], _U), np.array([k for _, k in pairs], np.int64)

    def places(self, sums: np.ndarray, lengths: np.ndarray, begin: np.ndarray):
        """Arrays (text, item, place) of the selected sub-windows near which as many sub-windows of any items lie as the item needs."""
        number = np.array([n for _, n, _ in self.items], np.int64)
        for width, mask, every, some, item in self.subwindows:
            count = np.maximum(lengths - width + 1, 0)
            own = np.repeat(np.arange(len(lengths)), count)
            starts = begin[own] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at, fps = [], []
            for lo in range(0, len(starts), 50_000):
                fp = simhashes(sums, width, starts[lo : lo + 50_000])
                hit = np.flatnonzero(mask[(fp & _U(len(mask) - 1)).astype(np.int64)])
                fp = fp[hit]
                real = every[np.minimum(np.searchsorted(every, fp), len(every) - 1)] == fp
                at.append(hit[real] + lo)
                fps.append(fp[real])
            if not sum(map(len, at)):
                continue
            at, fps = np.concatenate(at), np.concatenate(fps)
            first = np.searchsorted(some, fps, "left")
            m = np.searchsorted(some, fps, "right") - first
            place = starts[at]
            for lo in range(0, len(at), 2_000):
                n, f = m[lo : lo + 2_000], first[lo : lo + 2_000]
                i = np.repeat(np.arange(lo, lo + len(n)), n)
                k = item[np.repeat(f, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                span = number[k] - width + 1
                around = np.searchsorted(place, place[i] + span, "left") - np.searchsorted(place, place[i] - span, "right")
                ok = 100 * around >= self.percent * span
                i, k = i[ok], k[ok]
                yield own[at[i]], k, place[i] - begin[own[at[i]]]

    def near(self, found: np.ndarray, fp: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of found, row of fp) within RADIUS: exact, by equal blocks first."""
        left, right = [], []
        parts = found.astype("<u8").view("<u2").reshape(-1, 4)
        for b in range(4):
            order, first, some = tables[b]
            block = parts[:, b]
            hit = np.flatnonzero(some[block])
            if not len(hit):
                continue
            lo = first[block[hit]]
            m = first[block[hit].astype(np.int64) + 1] - lo
            i = np.repeat(hit, m)
            j = order[np.repeat(lo, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            ok = np.bitwise_count(found[i] ^ fp[j]) <= RADIUS
            left.append(i[ok])
            right.append(j[ok])
        if not left:
            return np.zeros(0, int), np.zeros(0, int)
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def search(self, texts: list[bytes], hasher: c.WordHasher):
        """(text's number, item_id, first word, low, high) for every verified match, the best for each text and item."""
        best: dict[tuple[int, int], tuple] = {}
        percent = self.percent
        hits: dict[tuple[int, int], set[int]] = {}
        longest = max((size for size, *_ in self.classes), default=1)  # as in the index
        overlap = max([2 * longest, *(n for _, n, _ in self.items)])
        group: list[tuple[int, int, list[str], np.ndarray]] = []
        total = 0

        def done() -> None:
            if not group:
                return
            sums = running(c.mix(np.concatenate([g[3] for g in group])), longest)
            lengths = np.array([len(g[3]) for g in group])
            begin = np.cumsum(lengths) - lengths
            for own, items, places in self.places(sums, lengths, begin):
                for x, k, place in zip(own.tolist(), items.tolist(), places.tolist()):
                    hits.setdefault((group[x][0], k), set()).add(group[x][1] + place)
            for size, stride, fp, item, offset, tables in self.classes:
                count = np.where(lengths >= size, (lengths - size) // stride + 1, 0)
                if not count.sum():
                    continue
                own = np.repeat(np.arange(len(group)), count)
                local = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * stride
                starts = begin[own] + local
                for lo in range(0, len(starts), 50_000):
                    at = starts[lo : lo + 50_000]
                    i, j = self.near(simhashes(sums, size, at), fp, tables)
                    for x, y in zip(i.tolist(), j.tolist()):
                        number, base, words, _ = group[own[lo + x]]
                        k = item[y]
                        item_id, n, known = self.items[k]
                        start = base + int(local[lo + x]) - offset[y]
                        if start < 0:
                            continue
                        low, high = similarity(shingles(words[start : start + n]), known)
                        if 100 * low >= percent * high:
                            old = best.get((number, k))
                            if old is None or (low * old[4], -start) > (old[3] * high, -old[2]):
                                best[number, k] = (number, item_id, start, low, high)
            group.clear()

        split = [words_of(t) for t in texts]
        hashes = hasher([w for words in split for w in words])
        at = 0
        for number, words in enumerate(split):
            h = hashes[at : at + len(words)]
            at += len(words)
            # pieces overlap by two windows, so that each window and its stride's next one lie in one piece, and by an item
            for lo in range(0, len(words), PIECE_WORDS):
                group.append((number, lo, words, h[lo : lo + PIECE_WORDS + overlap]))
                total += len(group[-1][3])
                if total > PIECE_WORDS:
                    done()
                    total = 0
        done()
        for (number, k), at in hits.items():
            item_id, n, known = self.items[k]
            found = best_place(split[number], n, known, sorted(at), percent)
            if found:
                start, low, high = found
                old = best.get((number, k))
                if old is None or (low * old[4], -start) > (old[3] * high, -old[2]):
                    best[number, k] = (number, item_id, start, low, high)
        return list(best.values())


def matches(docs: DataFrame, benchmark: DataFrame, *, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """(doc_id, h, item_id, start, similarity): items found in documents; start is a word's number, h a hash of the text.

    Every item is found (other case or white space aside) whose weighted similarity to as many words of the document in a
    row, or to what the document's ends leave of them, is percent or more; percent is 1 at least.
    Null or empty texts, and items without words, match nothing. Repeated rows are reported for each row; items with equal
    texts each. Of equally similar places the first is given. A null doc_id is carried through. An empty table on either side
    gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    items = benchmark.filter(F.col("text").isNotNull()).select("item_id", F.col("text").cast("binary").alias("t"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size.n // BLOCK_ITEMS), -(-size.b // BLOCK_BYTES))
    schema = "doc_id long, h long, item_id long, start long, similarity double"
    out = None
    for k in range(blocks):
        # about BLOCK_ITEMS items or BLOCK_BYTES each: bounded however many there are and however long they are together
        block = items.filter(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == k)
        index = spark.sparkContext.broadcast(Index([(r[0], bytes(r[1])) for r in block.orderBy("item_id", "t").collect()], percent))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            hasher = c.WordHasher()
            for batch in batches:
                for part in c.slices(batch, "t", 2 << 20):
                    ids, hs = part.column("doc_id").to_pylist(), part.column("h").to_pylist()
                    found = index.value.search(part.column("t").to_pylist(), hasher)
                    yield pa.record_batch([
                        pa.array([ids[x[0]] for x in found], pa.int64()), pa.array([hs[x[0]] for x in found], pa.int64()),
                        pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()),
                        pa.array([x[3] / x[4] for x in found], pa.float64())], names=["doc_id", "h", "item_id", "start", "similarity"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """The rows of `docs`, unchanged, in which no benchmark item was found; rows of one doc_id are told apart by their texts.

    Null and empty texts are clean. An empty benchmark leaves all rows.
    """
    found = c.materialize(matches(docs, benchmark, percent=percent, text=text).select("doc_id", "h").distinct(), "leaks")
    leaks = c.small_enough(found, 1_000_000)
    return docs.join(leaks, docs["doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs[text]) == found["h"]), "left_anti")
