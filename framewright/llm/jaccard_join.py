"""Exact Jaccard join of word n-gram sets with PartEnum signatures, reduced to connected components.

Sets are put into size bands of ratio 1 / threshold, so sets that link are in one band or in neighbouring ones; a set
signs for its own band and, if it can have larger partners there, for the next. With p = threshold in percent, sets of sizes s and t
that link differ in at most (100 - p)(s + t) / (100 + p) elements. For a band with bound k the feature domain is hashed
into n1 partitions of n2 sub-partitions, n1 = k // 2 + T. At least T partitions differ in one element or none, and then all
subsets of n2 - 1 sub-partitions but one are equal: each such subset is a signature.

Two consequences of T keep the work near linear without losing a link. Signatures of empty subsets, which unrelated
sets share, are left out by a set with fewer partitions that have an empty subset than it must share; and a set that
shares fewer signatures than that with all others together has no partner and is dropped before pairs are formed, as is a
set with too few shingles that occur in any other of those that are left.

Copies are one node. Instead of all pairs of a bucket, nodes are verified against a hub of theirs, what links is
merged, and this repeats for what is still apart; of what is left, all pairs across components that share one of their
rarest shingles (the prefix filter, which no link escapes) are then verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as c
from .components import components
from .substring_dedup import window_hashes

#: Sets a task gathers before it sends its signatures, and text bytes for each bucket of the exchange.
FLUSH_SHINGLES, BUCKET_BYTES = 2_000_000, 8 << 20
#: Hubs that each node is verified against in the rounds before all remaining pairs are.
PICKS = (3, 6)
_U = np.uint64


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (A-Z lower-cased; fewer words: all of them as one shingle)."""
    h, lengths = c.hash_words(texts, lower=True)
    if not len(h):
        return [np.zeros(0, _U) for _ in texts]
    ends = np.cumsum(lengths)
    grams = window_hashes(h, width) if len(h) >= width else np.zeros(0, _U)
    out = []
    for n, end in zip(lengths, ends):
        if n >= width:
            g = np.sort(grams[end - n : end - width + 1])
            out.append(g[np.append(True, g[1:] != g[:-1])])
        elif n:
            out.append(window_hashes(h[end - n : end], n) ^ _U(n))
        else:
            out.append(np.zeros(0, _U))
    return out


def fingerprint(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


class Bands:
    """Size bands and, for each, the signature scheme."""

    def __init__(self, percent: int) -> None:
        self.p = percent
        self.lo, lo = [], 1
        while lo < 1 << 31:
            self.lo.append(lo)
            lo = lo * 100 // percent + 1
        self.lo = np.array(self.lo)
        self.hi = np.append(self.lo[1:] - 1, (1 << 31) - 1)

    def differ(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (100 - self.p) * (s + t) // (100 + self.p)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lo, n, "right") - 1

    def scheme(self, band: int) -> tuple[int, int, int]:
        """k, n1, n2."""
        k = int(self.differ(self.hi[band], self.hi[band]))
        return k, k // 2 + max(1, -(-15 * (k // 2 + 1) // 100)), 6 if k < 14 else 3


class _Packer:
    def __init__(self, buckets: int, percent: int, width: int) -> None:
        self.buckets, self.width, self.bands = buckets, width, Bands(percent)
        self.clear()

    def clear(self) -> None:
        self.nodes, self.sigs, self.refs, self.table, self.n, self.seen = [], [], [], [], 0, set()

    def add(self, texts: list[bytes]) -> None:
        sets = []
        for s in shingle_sets(texts, self.width):
            if len(s):
                f = fingerprint(s)
                if f not in self.seen:
                    self.seen.add(f)
                    self.nodes.append(f)
                    sets.append(s)
        if not sets:
            return
        base = len(self.nodes) - len(sets)
        n = np.array([len(s) for s in sets])
        self.n += int(n.sum())
        band = self.bands.of(n)
        upper = n * 100 // self.bands.p >= self.bands.lo[np.minimum(band + 1, len(self.bands.lo) - 1)]
        for which in (0, 1):
            for b in np.unique(band):
                pick = np.flatnonzero((band == b) & (upper | (which == 0)))
                if len(pick):
                    self.sign([sets[i] for i in pick], n[pick], base + pick, int(b) + which, which)

    def sign(self, sets: list[np.ndarray], n: np.ndarray, index: np.ndarray, band: int, which: int) -> None:
        k, n1, n2 = self.bands.scheme(band)
        if k == 0:
            return  # only equal sets link
        d = len(sets)
        x = np.concatenate(sets)
        row = np.repeat(np.arange(d), n)
        part = (c.mix(x + _U(band + 1)) % _U(n1 * n2)).astype(np.int64)
        cell = row * (n1 * n2) + part
        v = c.mix(x)
        size = d * n1 * n2
        lo = np.bincount(cell, (v & _U(0xFFFFFFFF)).astype(np.float64), size).reshape(d, n1, n2)
        hi = np.bincount(cell, (v >> _U(32)).astype(np.float64), size).reshape(d, n1, n2)
        cnt = np.bincount(cell, minlength=size).reshape(d, n1, n2)
        rest = lambda a: a.sum(2, keepdims=True) - a
        lo, hi, cnt = rest(lo).astype(_U), rest(hi).astype(_U), rest(cnt)
        label = c.mix(np.arange(n1 * n2).astype(_U) + _U(band << 32)).reshape(1, n1, n2)
        sig = c.mix(c.mix(lo) + hi * _U(0x9E3779B97F4A7C15) + label)
        empty = cnt == 0
        holes = empty.any(2).sum(1)
        most = self.bands.differ(n, np.minimum(n * 100 // self.bands.p, self.bands.hi[band]))
        share = n1 - most // 2
        sound = holes < share
        need = np.where(sound, share - holes, 1)  # a sound partner doesn't send what an unsound set may share with it
        keep = ~empty | ~sound[:, None, None]
        self.sigs.append(sig[keep])
        self.refs.append(np.broadcast_to((index * 2 + which)[:, None, None], keep.shape)[keep].astype(np.int32))
        self.table.append(np.stack([index, np.full(d, which), n, need], 1))

    def flush(self) -> pa.RecordBatch | None:
        if not self.table:
            self.clear()
            return None
        nodes = np.array(self.nodes, np.int64)
        sig, ref, table = np.concatenate(self.sigs), np.concatenate(self.refs), np.concatenate(self.table)
        bucket = (sig % _U(self.buckets)).astype(np.int32)
        blobs, to, kind = [], [], []
        for lo in range(0, len(table), 20_000):
            t = table[lo : lo + 20_000]
            blobs.append(nodes[t[:, 0]].tobytes() + t[:, 1:].astype("<i4").T.tobytes())
            to.append(int(nodes[t[0, 0]] % self.buckets))
            kind.append(1)
        o = np.argsort(bucket, kind="stable")
        sig, ref, bucket = sig[o], ref[o], bucket[o]
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int)
        for lo, hi in zip(edges, np.append(edges[1:], len(sig))):
            used, local = np.unique(ref[lo:hi] >> 1, return_inverse=True)
            short = (sig[lo:hi] >> _U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            blobs.append(b"".join(v.tobytes() for v in (
                np.array([len(used), hi - lo], "<u4"), nodes[used], (local * 2 + (ref[lo:hi] & 1)).astype("<u2" if len(used) < 32768 else "<u4"), np.ascontiguousarray(short))))
            to.append(int(bucket[lo]))
            kind.append(0)
        self.clear()
        return pa.record_batch({"bucket": pa.array(to, pa.int32()), "kind": pa.array(kind, pa.int32()), "blob": pa.array(blobs, pa.binary())})


ENTRIES = "kind int, sig bigint, node bigint, which int, n int, need int"


def _shared(table: pa.Table) -> pa.Table:
    """One bucket: the signatures that two or more nodes have (kind 0), and the nodes' own data passed on (kind 1)."""
    sigs, nodes, whichs, own = [], [], [], []
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
        x = np.frombuffer(blob, np.uint8)
        if kind == 1:
            m = len(x) // 20
            own.append((x[: 8 * m].view("<i8"), x[8 * m :].view("<i4").reshape(3, m)))
            continue
        d, m = x[:8].view("<u4")
        ids = x[8 : 8 + 8 * d].view("<i8")
        at, wide = 8 + 8 * int(d), 2 if d < 32768 else 4
        ref = np.frombuffer(x[at : at + wide * m].tobytes(), f"<u{wide}").astype(np.int64)
        s = np.zeros((m, 8), np.uint8)
        s[:, :5] = x[at + wide * m :].reshape(-1, 5)
        sigs.append(s.reshape(-1).view("<i8"))
        nodes.append(ids[ref >> 1])
        whichs.append((ref & 1).astype(np.int32))
    out: list[list] = [[], [], [], [], [], []]
    if own:
        a, b = np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own], 1)
        zero = np.zeros(len(a), np.int64)
        for col, v in zip(out, (zero + 1, zero, a, b[0], b[1], b[2])):
            col.append(v)
    if sigs:
        sig, node, which = np.concatenate(sigs), np.concatenate(nodes), np.concatenate(whichs)
        o = np.argsort(sig, kind="stable")
        sig = sig[o]
        again = np.zeros(len(sig), bool)
        again[1:] = sig[1:] == sig[:-1]
        multi = again.copy()
        multi[:-1] |= again[1:]
        o, sig = o[multi], sig[multi]
        node, which = node[o], which[o]
        p = np.lexsort((node, sig))
        sig, node, which = sig[p], node[p], which[p]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node, which = sig[new], node[new], which[new]
        same = np.zeros(len(sig), bool)
        same[1:] = sig[1:] == sig[:-1]
        same[:-1] |= same[1:].copy()
        bucket = table.column("bucket")[0].as_py()
        zero = np.zeros(int(same.sum()), np.int64)
        for col, v in zip(out, (zero, sig[same] + (np.int64(bucket) << 40), node[same], which[same], zero, zero)):
            col.append(v)
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    arrays = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)).cast(k) for x, k in zip(out, kinds)]
    return pa.table(arrays, names=["kind", "sig", "node", "which", "n", "need"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) -> (a, b, linked), exactly."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(linked, pa.bool_())})

    return pairs.join(left, "a").join(right, "b").mapInArrow(test, "a long, b long, linked boolean")


def _nodes(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(doc_id, n, node) for every row: node is a 64-bit hash of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch, "t", 4 << 20):
                sets = shingle_sets(part.column("t").to_pylist(), width)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array([fingerprint(s) for s in sets], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n long, node long")


def signatures(docs: DataFrame, *, percent: int, width: int, text: str) -> DataFrame:
    """(sig, node) of the nodes that share enough signatures, for signatures that two or more nodes have."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(211, size // BUCKET_BYTES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Packer(buckets, percent, width)
        for batch in batches:
            for part in c.slices(batch, "t", 2 << 20):
                pack.add(part.column("t").to_pylist())
                if pack.n >= FLUSH_SHINGLES and (out := pack.flush()) is not None:
                    yield out
        if (out := pack.flush()) is not None:
            yield out

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    sent = rows.mapInArrow(send, "bucket int, kind int, blob binary")
    found = c.materialize(sent.groupBy("bucket").applyInArrow(_shared, ENTRIES), "signatures")
    entries = found.filter("kind = 0").select("sig", "node", "which")
    needs = found.filter("kind = 1").groupBy("node", "which").agg(F.first("need").alias("need"))
    able = entries.groupBy("node", "which").agg(F.count("*").alias("m")).join(needs, ["node", "which"]).filter("m >= need").select("node", "which")
    return entries.join(able, ["node", "which"]).select("sig", "node")


def supported(sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """The nodes of which at least `percent` of the shingles occur in another node: no other can have a link.

    Documents that share a passage and nothing else agree in signatures made of the passage alone; they go here, before
    any pair is formed. Shingles are dealt out packed by bucket, counts come back for each node and bucket.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in c.slices(whole, "shingles", 24 << 20):
                nodes = batch.column("node").to_numpy(zero_copy_only=False)
                each = [np.frombuffer(x.as_buffer(), _U) for x in batch.column("shingles")]
                x = np.concatenate(each)
                row = np.repeat(np.arange(len(each)), [len(e) for e in each]).astype("<u4")
                bucket = (x % _U(buckets)).astype(np.int32)
                o = np.argsort(bucket, kind="stable")
                x, row, bucket = x[o], row[o], bucket[o]
                edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                blobs, to = [], []
                for lo, hi in zip(edges, np.append(edges[1:], len(x))):
                    used, local = np.unique(row[lo:hi], return_inverse=True)
                    blobs.append(b"".join(v.tobytes() for v in (np.array([len(used), hi - lo], "<u4"), nodes[used], local.astype("<u4"), x[lo:hi])))
                    to.append(int(bucket[lo]))
                yield pa.record_batch({"bucket": pa.array(to, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        nodes, x = [], []
        for blob in table.column("blob").to_pylist():
            y = np.frombuffer(blob, np.uint8)
            d, m = (int(v) for v in y[:8].view("<u4"))
            ids = y[8 : 8 + 8 * d].view("<i8")
            at = 8 + 8 * d
            nodes.append(ids[np.frombuffer(blob, "<u4", m, at)])
            x.append(np.frombuffer(blob, "<u8", m, at + 4 * m))
        node, x = np.concatenate(nodes), np.concatenate(x)
        o = np.argsort(x, kind="stable")
        same = x[o][1:] == x[o][:-1]
        multi = np.zeros(len(x), bool)
        multi[1:] |= same
        multi[:-1] |= same
        ids, m = np.unique(node[o][multi], return_counts=True)
        return pa.table({"node": pa.array(ids, pa.int64()), "m": pa.array(m, pa.int64())})

    counted = sets.select("node", "shingles").mapInArrow(send, "bucket int, blob binary").groupBy("bucket").applyInArrow(count, "node long, m long")
    total = counted.groupBy("node").agg(F.sum("m").alias("m"))
    return total.join(sets.select("node", (F.octet_length("shingles") / 8).alias("n")), "node").filter(100 * F.col("m") >= percent * F.col("n")).select("node")


def links(docs: DataFrame, nodes: DataFrame, *, percent: int, width: int, text: str) -> DataFrame:
    """Verified links (a, b) between nodes; enough of them for the components, not all."""
    spark = docs.sparkSession
    able = c.materialize(signatures(docs, percent=percent, width=width, text=text), "able")
    reps = nodes.join(able.select("node").distinct(), "node").groupBy("node").agg(F.min("doc_id").alias("_id"))
    text_rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch, "t", 4 << 20):
                sets = shingle_sets(part.column("t").to_pylist(), width)
                yield pa.record_batch({"node": pa.array([fingerprint(s) for s in sets], pa.int64()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    wanted = reps.select(F.col("_id").alias("_r")).distinct()
    some = text_rows.join(wanted, text_rows["_id"].eqNullSafe(F.col("_r")), "left_semi")
    sets = c.materialize(some.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"]), "sets")
    size = sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    fine = c.materialize(supported(sets, percent, max(64, size // BUCKET_BYTES)), "supported")
    left = able.join(fine, "node")
    shared = left.groupBy("sig").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("sig")
    cand = c.materialize(left.join(shared, "sig"), "candidates")
    c.discard(able)
    tested = spark.createDataFrame([], "a long, b long, linked boolean")
    labels, live = None, cand
    for rnd in range(len(PICKS) + 1):
        if labels is None:
            apart = live.withColumn("comp", F.col("node"))
        else:
            at = live.select("sig", "node").join(labels, "node").select("sig", "node", "comp")
            ends = at.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("sig")
            apart = c.materialize(at.join(ends, "sig"), "apart")  # signatures whose nodes are in several components so far
            c.discard(live)
            live = apart
        if apart.isEmpty():
            break
        if rnd < len(PICKS):
            pairs = _hub_pairs(apart, rnd, PICKS[rnd])
        else:
            pairs = _prefix_pairs(sets.join(apart.select("node", "comp").distinct(), "node"), percent)
        pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        tested = tested.unionByName(c.materialize(_verify(pairs, sets, percent), "verified"))
        if rnd < len(PICKS):
            found = components(tested.filter("linked").select("a", "b"))
            nodes_left = apart.select("node").distinct()
            labels = nodes_left.join(found, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    c.discard(sets)
    return tested.filter("linked").select("a", "b")


def _hub_pairs(apart: DataFrame, rnd: int, picks: int, hubs: int = 3) -> DataFrame:
    """(a, b): for each node the `picks` hubs of other components that it shares the most signatures with.

    A signature's hubs are those of its nodes with the smallest hashes, which differ between signatures and rounds."""
    rank = lambda j: F.xxhash64("node", "sig", F.lit(100 * rnd + j))
    few = apart.groupBy("sig").agg(
        *[F.min_by("node", rank(j)).alias(f"h{j}") for j in range(hubs)], *[F.min_by("comp", rank(j)).alias(f"c{j}") for j in range(hubs)]
    )
    each = F.explode(F.array_distinct(F.array(*[F.struct(F.col(f"h{j}").alias("h"), F.col(f"c{j}").alias("c")) for j in range(hubs)]))).alias("m")
    met = apart.join(few, "sig").select("node", "comp", each).filter("m.c <> comp").groupBy("node", F.col("m.h").alias("h")).agg(F.count("*").alias("m"))
    best = F.row_number().over(W.partitionBy("node").orderBy(F.desc("m"), F.xxhash64("h")))
    pairs = met.withColumn("_i", best).filter(F.col("_i") <= picks)
    return pairs.select(F.least("node", "h").alias("a"), F.greatest("node", "h").alias("b")).distinct()


def _prefix_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that can still link, from rows (node, comp, shingles): all of them.

    With the shingles of all sets in one order, two sets of n and m shingles that link share one of the first
    n - ceil(n * percent / 100) + 1 and m - ... + 1. The order is by frequency, the rarest first, so the pairs that share
    only what many sets have don't meet.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in c.slices(whole, "shingles", 4 << 20):
                each = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column("shingles")]
                n = np.array([len(e) for e in each])
                many = lambda v: pa.array(np.repeat(v.to_numpy(zero_copy_only=False), n))
                yield pa.record_batch([many(batch.column("node")), many(batch.column("comp")), pa.array(np.repeat(n, n)), pa.array(np.concatenate(each))], names=["node", "comp", "n", "token"])

    tokens = rest.select("node", "comp", "shingles").mapInArrow(spread, "node long, comp long, n long, token long")
    often = tokens.groupBy("token").agg(F.count("*").alias("df"))
    place = F.row_number().over(W.partitionBy("node").orderBy("df", "token"))
    first = tokens.join(often, "token").withColumn("_i", place).filter(F.col("_i") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    first = c.materialize(first.filter("df > 1").select("token", "node", "comp", "n", (F.col("n") - F.col("_i") + 1).alias("left")), "prefixes")
    # a token whose sets are all in one component forms no pair
    apart = first.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    first = c.materialize(first.join(apart, "token"), "tokens-apart")
    side = lambda x: first.select("token", F.col("node").alias(x), F.col("comp").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("left").alias(f"l{x}"))
    # sizes have to fit, and at the first common shingle what is left of both has to suffice
    met = (
        (F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b"))
        & (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
        & ((100 + percent) * F.least("la", "lb") >= percent * (F.col("na") + F.col("nb")))
    )
    return side("a").join(side("b"), "token").filter(met).select("a", "b").distinct()


def join(docs: DataFrame, *, percent: int = 75, width: int = 5, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    Documents link when 100 * |intersection| >= percent * |union| of their sets of `width`-word shingles; component_id is
    the smallest doc_id reachable by links. Null or empty text: an empty set, linked with nothing, its own component.
    Null doc_id: takes part under a null id; its component_id is the smallest id of its component, null if all are null.
    Repeated rows link like any copies. An empty table gives an empty result. Other columns are ignored.
    Sets are named by 64-bit hashes; links between different sets are verified on 64-bit shingle hashes.
    """
    nodes = c.materialize(_nodes(docs, text, width), "nodes")
    full = nodes.filter("n > 0")
    found = components(links(docs, full, percent=percent, width=width, text=text))
    classes = full.groupBy("node").agg(F.min("doc_id").alias("low")).join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    low = classes.groupBy("comp").agg(F.min("low").alias("component_id"))
    by_node = classes.select("node", "comp").join(low, "comp").select("node", "component_id")
    out = full.join(by_node, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(nodes.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
