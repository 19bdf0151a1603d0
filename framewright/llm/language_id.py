"""Language identification as mixture inference.

Languages are distributions over hashed letter trigrams. A document is a mixture of languages whose words each come from
one language; expectation-maximisation estimates the proportions from the words' trigram likelihoods. Sets of one, two,
three and more languages (those with the largest proportions) are refitted as long as each is better than the one before by
its likelihood less half the logarithm of the number of words for each language beyond the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

BUCKETS = 1 << 15
#: About so many documents of each language are used to learn its trigrams.
FIT_ROWS = 1000
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """True for each code point that is a letter; made once for each worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(texts: list[str]):
    """Hash buckets of all trigrams around a letter, the word each belongs to, and the text of each word.

    Other characters than letters count as one kind of space; texts are lower-cased.
    """
    joined = "\n".join(["", *[t.lower() for t in texts], ""])
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    lower = [len(t.lower()) for t in texts]
    is_letter = letters()[code]
    x = np.where(is_letter, code, 0).astype(np.uint32)
    at = np.flatnonzero(is_letter)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (x[at - 1] * np.uint32(0x9E3779B1)) ^ (x[at] * np.uint32(0x85EBCA77)) ^ (x[at + 1] * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    bucket = (mixed >> np.uint32(17)).astype(np.int64)
    first = np.append(True, at[1:] != at[:-1] + 1)
    word = np.cumsum(first) - 1
    ends = np.cumsum(np.array(lower) + 1)
    owner = np.searchsorted(ends, at[first], "right")
    return bucket, word, owner


def _em(lik: np.ndarray, weight: np.ndarray, starts: np.ndarray, owner: np.ndarray, share: np.ndarray, rounds: int):
    """Proportions for each text after some rounds; share: where to start (zero stays zero)."""
    total = np.add.reduceat(weight, starts)[:, None]
    for _ in range(rounds):
        r = lik * share[owner]
        r *= (weight / np.maximum(r.sum(1), 1e-30))[:, None]
        share = np.add.reduceat(r, starts) / total
    return share


def infer(texts: list[str], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: proportions from all languages, and from the chosen set (all zero without a letter)."""
    k, m = len(texts), logp.shape[1]
    full, chosen = np.zeros((k, m)), np.zeros((k, m))
    bucket, word, owner = trigrams(texts)
    if not len(bucket):
        return full, chosen
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    ll = np.add.reduceat(logp[bucket], first)
    weight = np.diff(np.append(first, len(bucket))).astype(np.float32)
    top = ll.max(1)
    lik = np.exp(ll - top[:, None])
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    who = owner[starts]
    local = np.repeat(np.arange(len(who)), np.diff(np.append(starts, len(owner))))
    share = _em(lik, weight, starts, local, np.full((len(who), m), 1 / m, np.float32), 8)
    full[who] = share
    rank = np.argsort(-share, 1, kind="stable")
    n = np.diff(np.append(starts, len(owner)))
    best = np.full(len(who), -np.inf)
    out = np.zeros_like(share)
    live = np.arange(len(who))  # texts that the last set made better
    for size in range(1, m + 1):
        if not len(live):
            break
        keep = np.zeros(len(who), bool)
        keep[live] = True
        words = np.flatnonzero(keep[local])
        l, count = lik[words], n[live]
        begin, own = np.cumsum(count) - count, np.repeat(np.arange(len(live)), count)
        mask = np.zeros((len(live), m), np.float32)
        np.put_along_axis(mask, rank[live, :size], 1, 1)
        s = mask / size
        if size > 1:
            s = share[live] * mask + 1e-6 * mask
            s = _em(l, weight[words], begin, own, (s / s.sum(1, keepdims=True)).astype(np.float32), 3)
        fit = np.add.reduceat(np.log(np.maximum((l * s[own]).sum(1), 1e-30)), begin)
        value = fit - 0.5 * (size - 1) * np.log(np.maximum(count, 2))
        better = value > best[live]
        live = live[better]
        best[live] = value[better]
        out[live] = s[better]
    chosen[who] = out
    return full, chosen


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        """counts: trigram counts by bucket and language."""
        self.languages = languages
        p = (counts + 0.5) / (counts.sum(0, keepdims=True) + 0.5 * BUCKETS)
        self.logp = np.log(p).astype(np.float32)


def train(docs: DataFrame, *, fit_rows: int = FIT_ROWS, text: str = "text", lang: str = "lang") -> Model:
    """Learn from about `fit_rows` documents of each non-null language: those with the smallest hashes of their doc_id.

    Rows without text or lang teach nothing; repeated rows count again; rows of one doc_id are taken or left together. An empty
    table gives a model without languages. The driver gets BUCKETS counts for each language at most.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = known.groupBy(lang).agg(F.count("*").alias("_n"))  # one row for each language
    part = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)).alias("_u")
    picked = known.select(lang, text, part).join(c.small_enough(sizes, 10_000), lang).filter(F.col("_u") * F.col("_n") < fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for x in c.slices(batch, "t", 2 << 20):
                texts, langs = x.column("t").to_pylist(), x.column("lang").to_pylist()
                for name in set(langs):
                    bucket, _, _ = trigrams([t for t, k in zip(texts, langs) if k == name])
                    sums[name] = sums.get(name, 0) + np.bincount(bucket, minlength=BUCKETS)
        for name, n in sums.items():
            i = np.flatnonzero(n)
            yield pa.record_batch({"lang": pa.array([name] * len(i), pa.string()), "bucket": pa.array(i, pa.int64()), "n": pa.array(n[i], pa.int64())})

    cells = picked.select(F.col(lang).alias("lang"), F.col(text).alias("t")).mapInArrow(run, "lang string, bucket long, n long")
    got = cells.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows for each language at most
    languages = sorted(got["lang"].unique())
    counts = np.zeros((BUCKETS, len(languages)))
    counts[got["bucket"].to_numpy(), [languages.index(x) for x in got["lang"]]] = got["n"].to_numpy()
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, languages (map of the chosen set to proportions) for every row.

    score: the share of the text that is in lang_pred. Null texts and texts without a letter, or a model without
    languages: `und`, score 0 and an empty map. Repeated rows get equal results; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats for each language
    schema = "doc_id long, lang_pred string, score double, languages map<string,double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in c.slices(batch, "t", 1 << 20):
                texts = part.column("t").to_pylist()
                if m.languages:
                    full, chosen = infer(texts, m.logp)
                else:
                    full = chosen = np.zeros((len(texts), 1))
                best = chosen.argmax(1)
                some = chosen.sum(1) > 0
                pred = [m.languages[b] if s else UNKNOWN for b, s in zip(best, some)]
                score = np.where(some, np.clip(full[np.arange(len(texts)), best], 0, 1), 0.0)
                maps = [[(m.languages[j], float(row[j])) for j in np.flatnonzero(row > 0)] if s else [] for row, s in zip(chosen, some)]
                yield pa.record_batch([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(maps, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "languages"])

    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, schema)
