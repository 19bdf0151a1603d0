"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum is half of
|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2, so a document costs its number of distinct words times the rank.
It is fitted on the driver from a bounded sample of labelled rows; scoring is one pass over the documents, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

BUCKETS, RANK = 1 << 14, 8
#: Labelled rows at most that a fit uses (those with the smallest hashes of their doc_id).
FIT_ROWS = 4000
_U = np.uint64

#: Statistics of a text, each of order one.
STATS = ["log_words", "word_length", "upper", "digits", "symbols", "punctuation", "non_ascii", "line_words", "repeated_lines", "same_as_before", "distinct", "length_claim"]


def _classes() -> np.ndarray:
    kinds = np.zeros((4, 256), np.uint8)
    kinds[0, 65:91] = 1
    kinds[1, 48:58] = 1
    for ch in b"#*$%&|<>":
        kinds[2, ch] = 1
    for ch in b"!\"'(),-./:;?@[\\]^_`{}~+=":
        kinds[3, ch] = 1
    return kinds


_KINDS = _classes()


def features(texts: list[bytes], claims: list[int | None]):
    """(row, bucket, value) triples in row order with 1-norm scaled word counts, and the statistics of each text."""
    h, n = c.hash_words(texts, lower=True)
    size = np.array([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), n)
    cell, count = np.unique(row.astype(np.int64) * BUCKETS + (c.mix(h) % _U(BUCKETS)).astype(np.int64), return_counts=True)
    rows, bucket = cell // BUCKETS, cell % BUCKETS
    norm = np.sqrt(np.bincount(rows, count.astype(float) ** 2, len(texts)))
    value = count / np.maximum(norm, 1e-9)[rows]
    s = np.zeros((len(texts), len(STATS)), np.float32)
    some = np.maximum(n, 1)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    at = np.repeat(np.arange(len(texts)), size)
    total = np.maximum(size, 1)
    s[:, 0] = np.log1p(n) / 5
    s[:, 1] = np.minimum(size / some, 50) / 10
    if len(flat):
        begin = np.flatnonzero(size)
        starts = (np.cumsum(size) - size)[begin]
        for k in range(4):
            s[begin, 2 + k] = np.add.reduceat(_KINDS[k][flat], starts, dtype=np.int64) / total[begin] * 4
        s[begin, 6] = np.add.reduceat((flat >> 7), starts, dtype=np.int64) / total[begin] * 4
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    m = np.array([len(x) for x in lines])
    s[:, 7] = np.log1p(n / np.maximum(m, 1)) / 4
    s[:, 8] = np.array([1 - len(set(x)) / len(x) if x else 0.0 for x in lines])
    same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    s[:, 9] = np.bincount(row[1:][same], minlength=len(texts)) / some
    s[:, 10] = np.bincount(rows, minlength=len(texts)) / some
    claim = np.array([np.nan if x is None else x for x in claims], float)
    s[:, 11] = np.where(np.isnan(claim), 0, np.clip(np.log1p(np.maximum(np.nan_to_num(claim), 0)) - np.log1p(size), -1, 1))
    return rows, bucket, value.astype(np.float32), s


class Machine:
    """Weights of the model. Columns: BUCKETS words, then the standardised statistics."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        d = BUCKETS + len(STATS)
        self.b = 0.0
        self.w = np.zeros(d, np.float32)
        self.v = (rng.standard_normal((d, RANK)) * 0.02).astype(np.float32)
        self.mean, self.dev = np.zeros(len(STATS), np.float32), np.ones(len(STATS), np.float32)

    def sparse(self, rows, bucket, value, stats):
        """All features as triples in row order."""
        k, m = stats.shape
        z = np.clip((stats - self.mean) / self.dev, -6, 6) / 3
        r = np.concatenate([rows, np.repeat(np.arange(k), m)])
        i = np.concatenate([bucket, np.tile(np.arange(m) + BUCKETS, k)])
        x = np.concatenate([value, z.reshape(-1).astype(np.float32)])
        o = np.argsort(r, kind="stable")
        return r[o], i[o], x[o]

    def logits(self, r, i, x, k: int):
        """One pass: the linear part and the sum-of-squares form of the pairwise part."""
        starts = np.searchsorted(r, np.arange(k))
        linear = np.add.reduceat(self.w[i] * x, starts)
        vx = self.v[i] * x[:, None]
        s = np.add.reduceat(vx, starts)
        squares = np.add.reduceat((vx * vx).sum(1), starts)
        return self.b + linear + 0.5 * ((s * s).sum(1) - squares), s

    def fit(self, data: list[tuple], labels: np.ndarray, steps: int = 900, rate: float = 0.05, decay: float = 1e-4, batch: int = 64, seed: int = 11) -> None:
        """AdaGrad on the logistic loss, in about `steps` batches. data: per document (bucket, value, stats)."""
        if not len(data):
            return
        stats = np.stack([d[2] for d in data])
        self.mean, self.dev = stats.mean(0), stats.std(0) + 1e-3
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full_like(self.w, 1e-3), np.full_like(self.v, 1e-3), 1e-3
        for _ in range(-(-steps * batch // len(data))):
            order = rng.permutation(len(data))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                rows = np.repeat(np.arange(len(pick)), [len(data[j][0]) for j in pick])
                r, i, x = self.sparse(rows, np.concatenate([data[j][0] for j in pick]), np.concatenate([data[j][1] for j in pick]), stats[pick])
                z, s = self.logits(r, i, x, len(pick))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]).astype(np.float32) / len(pick)
                used, at = np.unique(i, return_inverse=True)
                dw = np.bincount(at, g[r] * x) + decay * self.w[used]
                each = (g[r] * x)[:, None] * (s[r] - self.v[i] * x[:, None])
                o = np.argsort(at, kind="stable")
                dv = np.add.reduceat(each[o], np.searchsorted(at[o], np.arange(len(used)))) + decay * self.v[used]
                db = float(g.sum())
                gw[used] += dw**2
                gv[used] += dv**2
                gb += db * db
                self.w[used] -= (rate * dw / np.sqrt(gw[used])).astype(np.float32)
                self.v[used] -= (rate * dv / np.sqrt(gv[used])).astype(np.float32)
                self.b -= rate * db / gb**0.5

    def scores(self, texts: list[bytes], claims: list) -> np.ndarray:
        rows, bucket, value, stats = features(texts, claims)
        z, _ = self.logits(*self.sparse(rows, bucket, value, stats), len(texts))
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _rows(docs: DataFrame, text: str, *more) -> DataFrame:
    claim = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", *more, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"), claim.alias("claim"))


def train(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, text: str = "text") -> Machine:
    """Fit on at most `fit_rows` rows of (doc_id, label) with label 0 or 1; rows with a null label or doc_id are left out.

    A label counts for every document row of its doc_id, whatever its text. No labels, or none with a document, give an
    untrained machine, which scores near 0.5. The driver gets the fitted rows' features: a doc has BUCKETS distinct ones at most.
    """
    chosen = labels.filter("doc_id is not null and label is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(fit_rows)
    # at most fit_rows small rows, so broadcasting them is safe whatever the size of `docs`
    picked = docs.join(F.broadcast(chosen.select("doc_id", "label")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch, "t", 2 << 20):
                rows, bucket, value, stats = features(part.column("t").to_pylist(), part.column("claim").to_pylist())
                cut = np.searchsorted(rows, np.arange(part.num_rows + 1))
                pieces = [(bucket[a:b].astype("<u2").tobytes(), value[a:b].astype("<f4").tobytes(), s.astype("<f4").tobytes()) for a, b, s in zip(cut, cut[1:], stats)]
                yield pa.record_batch([part.column("doc_id"), part.column("label"), *[pa.array(x, pa.binary()) for x in zip(*pieces)]], names=["doc_id", "label", "i", "x", "s"])

    found = _rows(picked, text, F.col("label").cast("int").alias("label")).mapInArrow(run, "doc_id long, label int, i binary, x binary, s binary")
    got = sorted(found.collect(), key=lambda r: (r.doc_id, r.label, bytes(r.i)))
    model = Machine()
    model.fit([(np.frombuffer(r.i, "<u2").astype(np.int64), np.frombuffer(r.x, "<f4"), np.frombuffer(r.s, "<f4")) for r in got], np.array([r.label for r in got], float))
    return model


def score(docs: DataFrame, model: Machine, *, text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every row.

    Null texts score like empty ones; a null n_chars, or none at all, counts as correct. Repeated rows score alike.
    An empty table gives an empty result. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * (RANK + 1) floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch, "t", 2 << 20):
                found = shared.value.scores(part.column("t").to_pylist(), part.column("claim").to_pylist())
                yield pa.record_batch([part.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return _rows(docs, text).mapInArrow(run, "doc_id long, score double")
