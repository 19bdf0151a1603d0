"""Quality rules with adaptive thresholds [native: DataFrame functions only].

Each document gets integer metrics. For every (lang, source) group each metric is summarised in a
mergeable quantile sketch: counts of log-linear buckets (values below 128 exact, then 64 buckets per
power of two, so a relative error of at most 1/64). Sketches add up cell by cell, in any order, so they
are partial-aggregated before the shuffle and reruns agree exactly. Thresholds are the third quartile plus
`spread` times the interquartile range (with a floor), joined back on (lang, source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as c

SYMBOLS = r"[#*$%&|<>]"
#: metric -> (numerator, denominator), in ten-thousandths; the floor that no threshold goes below
METRICS = {
    "symbol_rate": ("n_symbols", "word_chars", 300),
    "dup_line_rate": ("n_dup_lines", "n_lines", 5000),
    "repeat_rate": ("n_repeat_words", "n_words", 3500),
    "upper_rate": ("n_upper", "word_chars", 3000),
}
SPREAD = 3
#: Groups with fewer documents than this are judged by the sketch of all documents: a quartile of so few says little.
MIN_GROUP = 30


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text.

    Each window is a long: its hash, shifted up to make room for its position. Sorted, a window that is repeated has a
    neighbour with its hash; the union of the intervals [p, p + 2] is then counted over the sorted positions. Neighbours of
    one hash have their words compared; should any differ, the text's windows are sorted by their words instead.
    """
    def count(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w)))
        numbers = F.sequence(F.lit(0), F.size(w) - 3)
        grams = F.transform(
            numbers,
            lambda i: F.call_function(
                "shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits
            ).bitwiseOR(i.cast("long")),
        )
        place = lambda x: (x - F.call_function("shiftleft", F.call_function("shiftright", x, bits), bits)).cast("int")
        same = lambda x, y: F.call_function("shiftrightunsigned", x.bitwiseXOR(y), bits) == 0

        def covered(p: Column) -> Column:
            step = lambda a, j: a + F.least(F.lit(3).cast("long"), F.coalesce((F.get(p, j) - F.get(p, j - 1)).cast("long"), F.lit(3).cast("long")))
            total = F.aggregate(F.sequence(F.lit(1), F.size(p)), F.lit(0).cast("long"), step)
            return F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(total)

        def by_hash(s: Column) -> Column:
            return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1))), place))

        def by_words() -> Column:
            cut = F.sort_array(F.transform(numbers, lambda i: F.struct(F.slice(w, i + 1, 3).alias("g"), i.alias("p"))))
            again = lambda s: F.filter(s, lambda x, j: (x["g"] == F.get(s, j - 1)["g"]) | (x["g"] == F.get(s, j + 1)["g"]))
            return c.let(cut, lambda s: F.sort_array(F.transform(again(s), lambda x: x["p"])))

        def clash(s: Column) -> Column:
            """Whether neighbours of one hash differ in a word."""
            differ = lambda p, q: (F.get(w, p) != F.get(w, q)) | (F.get(w, p + 1) != F.get(w, q + 1)) | (F.get(w, p + 2) != F.get(w, q + 2))
            return F.exists(F.sequence(F.lit(1), F.size(s)), lambda j: F.coalesce(same(F.get(s, j), F.get(s, j - 1)) & differ(place(F.get(s, j)), place(F.get(s, j - 1))), F.lit(False)))

        found = lambda s: F.when(clash(s), by_words()).otherwise(by_hash(s))
        return c.let(F.sort_array(grams), lambda s: c.let(found(s), covered))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(c.let(words, count))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]


def metrics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines, n_repeat_words, base_failed).

    row holds the columns `keep` of `docs` (all if None), so that no name among them can clash. A null text has no words and fails.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    kept = F.struct(*[F.col(f"`{x}`") for x in (docs.columns if keep is None else keep)]).alias("row")
    words, lines = F.col("words"), F.col("lines")
    out = docs.select(kept, t.alias("t"), c.word_array(F.col(text)).alias("words"), F.filter(F.split(t, "\n", -1), lambda x: x.rlike(c.WORD)).alias("lines"))
    out = out.select(
        "row",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _rate(top: str, bottom: str) -> Column:
    return F.when(F.col(bottom) > 0, F.expr(f"{top} * 10000 div {bottom}")).otherwise(F.lit(0)).cast("long")


def sketch(measured: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, metric and bucket: `n`, the number of documents in it. Add rows up to merge sketches."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    )
    return (
        measured.select(*keys, cells.alias("_c"))
        .select(*keys, F.col("_c.metric").alias("metric"), F.col("_c.value").alias("value"))
        .withColumn("_shift", F.greatest(F.lit(0), F.length(F.bin("value")) - 7).cast("int"))
        .withColumn("bucket", F.expr("shiftleft(shiftright(value, _shift), _shift)"))
        .groupBy(*keys, "metric", "bucket")
        .agg(F.count("*").alias("n"))
    )


def quantiles(cells: DataFrame, keys: list[str], parts: tuple[int, ...] = (25, 75)) -> DataFrame:
    """For each key and metric: the smallest bucket below which (inclusive) at least that percentage lies."""
    w = W.partitionBy(*keys, "metric")
    return (
        cells.withColumn("_up", F.sum("n").over(w.orderBy("bucket")))
        .withColumn("_all", F.sum("n").over(w))
        .groupBy(*keys, "metric")
        .agg(
            F.max("_all").alias("n"),
            *[F.min(F.when(F.col("_up") * 100 >= F.col("_all") * p, F.col("bucket"))).alias(f"q{p}") for p in parts],
        )
    )


def thresholds(measured: DataFrame, spread: int = SPREAD, min_group: int = MIN_GROUP) -> DataFrame:
    """One row for each (lang, source) that occurs, nulls included, with the upper bound of every metric."""
    cells = sketch(measured, ["lang", "source"])
    limit = F.col("q75") + spread * (F.col("q75") - F.col("q25"))
    floors = F.create_map(*[F.lit(x) for m, (_, _, floor) in METRICS.items() for x in (m, floor)])
    named = lambda q, n: q.withColumn(n, F.greatest(limit, floors[F.col("metric")]).cast("long"))
    own = named(quantiles(cells, ["lang", "source"]), "_own")
    whole = named(quantiles(cells.groupBy("metric", "bucket").agg(F.sum("n").alias("n")), []), "_whole")
    return (
        own.join(F.broadcast(whole.select("metric", "_whole")), "metric")  # four rows
        .withColumn("_limit", F.when(F.col("n") >= min_group, F.col("_own")).otherwise(F.col("_whole")))
        .groupBy("lang", "source")
        .agg(*[F.max(F.when(F.col("metric") == m, F.col("_limit"))).alias(f"max_{m}") for m in METRICS])
    )


def judge(
    docs: DataFrame, *, text: str = "text", spread: int = SPREAD, min_group: int = MIN_GROUP, keep_text: bool = False
) -> DataFrame:
    """`docs` with metrics, base_failed and kept.

    kept: not base_failed, and no metric above the threshold of the document's lang and source. Groups with fewer than
    `min_group` documents that passed the base rules take the thresholds of all documents instead (min_group=0: none does).
    Nulls: a null text has no words and is not kept; null lang or source form groups of their own.
    An empty table gives an empty result; repeated rows are judged alike. Columns named like a metric, base_failed or kept
    are replaced, all others pass through whatever their names.
    With keep_text=False the text column is left out, so that nothing wide is written or joined.
    """
    replaced = {*MEASURES, "kept"} | (set() if keep_text else {text.lower()})
    measured = metrics(docs, text, [x for x in docs.columns if x.lower() not in replaced])
    for m, (top, bottom, _) in METRICS.items():
        measured = measured.withColumn(m, _rate(top, bottom))
    measured = c.materialize(measured.withColumns({"lang": F.col("row.lang"), "source": F.col("row.source")}), "quality-metrics")
    limits = thresholds(measured.filter(~F.col("base_failed")), spread, min_group).withColumnsRenamed({"lang": "own_lang", "source": "own_source"})
    joined = measured.join(
        c.small_enough(limits, 100_000),
        F.col("lang").eqNullSafe(F.col("own_lang")) & F.col("source").eqNullSafe(F.col("own_source")),
        "left",
    )
    fine = F.lit(True)
    for m in METRICS:
        fine = fine & (F.col(m) <= F.coalesce(F.col(f"max_{m}"), F.lit(0)))
    return joined.select("row.*", *MEASURES, (~F.col("base_failed") & fine).alias("kept"))
