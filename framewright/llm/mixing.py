"""Mixing sources to target weights along a curriculum [native: DataFrame functions only].

Token targets: sources share `share` times all words by weight; no source is used more than `most` times over,
and what it cannot take goes to the others by weight. Documents of a source stand in a fixed pseudo-random
order (md5 of doc_id); pass after pass over that order fills the source's target. A source's weight schedule
(piecewise linear over training time 0..1) is integrated; inverting the cumulative demand gives every use of a
document its training position, and the output is range-sorted by position.

Running sums over a source with a third of all rows do not go through one task: documents are summed in
buckets of the order first, bucket totals give each bucket its start, and windows run inside buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as c

#: Hexadecimal digits of the order's key that name a bucket: 16 ** 4 buckets for each source.
BUCKET_DIGITS = 4


def by_rank(*values: float) -> Callable[[Column], Column]:
    """Values given to the sources by rank, repeating."""
    return lambda rank: F.array(*[F.lit(float(v)) for v in values])[(rank % len(values)).cast("int")]


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(sizes: DataFrame, weight: Callable[[Column], Column], share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size) -> rank, weight, target. Sources by code point, null last.

    Water-filling: the level L with sum(min(weight * L, most * size)) = share * all. Sources in order of
    most * size / weight; the first one that isn't full at the level its predecessors leave gives L. Ranks and running
    sums are taken range by range, so there may be as many sources as there are web hosts.
    """
    t = (
        c.running(sizes, [F.col("source").asc_nulls_last()], {}, number="rank")
        .withColumn("weight", weight(F.col("rank")))
        .withColumn("cap", (most * F.col("source_size")).cast("double"))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
    )
    t = c.materialize(c.running(t, [F.col("full_at"), F.col("rank")], {"before": "cap", "used": "weight"}), "sources")
    whole = t.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    if not whole.n:  # no rows, or no words
        return t.select("source", "source_size", "weight", "rank", F.col("cap").alias("target"))
    level = (F.lit(float(whole.n)) * share - F.col("before")) / (F.lit(float(whole.w)) - F.col("used"))
    found = t.withColumn("level", level).filter("level <= full_at").agg(F.min_by("level", F.struct("full_at", "rank"))).first()[0]
    wanted = F.col("cap") if found is None else F.lit(float(found)) * F.col("weight")
    return t.select("source", "source_size", "weight", "rank", F.least("cap", wanted).alias("target"))


def _invert(knots: Column, u: Column) -> Column:
    """The time at which a piecewise linear rate, given as structs (t, f), has used up the fraction u of its integral."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(knots) - 2),
        lambda i: F.struct(
            knots[i]["t"].alias("t"),
            knots[i]["f"].alias("f"),
            ((knots[i + 1]["f"] - knots[i]["f"]) / (knots[i + 1]["t"] - knots[i]["t"])).alias("slope"),
            ((knots[i + 1]["f"] + knots[i]["f"]) * (knots[i + 1]["t"] - knots[i]["t"]) / 2).alias("area"),
        ),
    )
    whole = F.aggregate(pieces, F.lit(0.0), lambda a, p: a + p["area"])
    start = F.struct(F.lit(0.0).alias("t"), F.lit(1.0).alias("f"), F.lit(0.0).alias("slope"), (u * whole).alias("left"), F.lit(False).alias("done"))

    def step(a: Column, p: Column) -> Column:
        stays = a["done"]
        here = a["left"] <= p["area"]
        return F.struct(
            F.when(stays, a["t"]).otherwise(p["t"]).alias("t"),
            F.when(stays, a["f"]).otherwise(p["f"]).alias("f"),
            F.when(stays, a["slope"]).otherwise(p["slope"]).alias("slope"),
            F.when(stays | here, a["left"]).otherwise(a["left"] - p["area"]).alias("left"),
            (stays | here).alias("done"),
        )

    def solve(a: Column) -> Column:
        root = a["f"] + F.sqrt(F.greatest(F.lit(0.0), a["f"] * a["f"] + 2 * a["slope"] * a["left"]))
        return F.least(F.lit(1.0), a["t"] + F.when(root > 0, 2 * a["left"] / root).otherwise(F.lit(0.0)))

    return F.aggregate(pieces, start, step, solve)


def assign(
    docs: DataFrame,
    *,
    weight: Callable[[Column], Column],
    schedule: Callable[[Column], Column] | None = None,
    share: float = 1.5,
    most: int = 2,
    text: str = "text",
    keep_text: bool = False,
) -> DataFrame:
    """`docs` (without the text unless keep_text) with size, source_size, target, taken and uses: array<struct<epoch, words, position>>.

    weight and schedule take the rank of a source among the sources; a schedule gives array<struct<t, f>>
    with t rising from 0 to 1. Only the last use can be partial, so the words taken are the target rounded down.
    Null text: size 0. Null source: a source of its own, the last. Null doc_id: ordered like an empty one.
    Repeated rows and ties: told apart by doc_id, size and a hash of the text; equal rows are interchangeable.
    An empty table gives an empty result. Columns with the names above are replaced, all others pass through whatever their names.
    """
    flat = F.array(F.struct(F.lit(0.0).alias("t"), F.lit(1.0).alias("f")), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("f")))
    replaced = {"size", "source_size", "target", "taken", "uses"} | (set() if keep_text else {text.lower()})
    kept = [x for x in docs.columns if x.lower() not in replaced]
    sized = docs.select(
        F.struct(*[F.col(f"`{x}`") for x in kept]).alias("row"),  # so that no name in it can clash
        c.n_words(F.col(text)).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("order"),
        F.xxhash64(text).alias("tie"),
        _source_key(F.col("source")).alias("s"),
    ).withColumn("bucket", F.conv(F.substring("order", 1, BUCKET_DIGITS), 16, 10).cast("int"))
    sized = c.materialize(sized, "sized")
    totals = c.running(sized.groupBy("s", "bucket").agg(F.sum("size").alias("n")), [F.col("s"), F.col("bucket")], {"before": "n"})
    totals = c.materialize(totals, "totals")
    sources = totals.groupBy("s").agg(F.sum("n").alias("source_size"), F.min("before").alias("base"))
    starts = totals.join(c.small_enough(sources, 100_000), "s").select("s", "bucket", (F.col("before") - F.col("base")).alias("start"))
    named = F.when(F.col("s") != "n", F.expr("substring(s, 2)"))
    goals = c.materialize(targets(sources.select(named.alias("source"), "source_size"), weight, share, most), "goals")
    goals = goals.select(_source_key(F.col("source")).alias("s"), "source_size", "target", (schedule(F.col("rank")) if schedule else flat).alias("knots"))
    inside = W.partitionBy("s", "bucket").orderBy("order", F.col("row.doc_id").asc_nulls_last(), "size", "tie")
    placed = (
        sized.join(starts, ["s", "bucket"])
        .withColumn("at", F.col("start") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        .join(c.small_enough(goals, 100_000), "s")
    )
    goal = F.floor("target").cast("long")

    def use(e: int) -> Column:
        begin = F.col("at") + F.lit(e) * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - begin))
        middle = (begin + words / 2) / F.greatest(F.lit(1.0), F.col("target"))
        return F.struct(F.lit(e).alias("epoch"), words.alias("words"), _invert(F.col("knots"), F.least(F.lit(1.0), middle)).alias("position"))

    used = placed.withColumn("uses", F.filter(F.array(*[use(e) for e in range(most)]), lambda u: u["words"] > 0))
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda a, u: a + u["words"])
    return used.select("row.*", "size", "source_size", "target", taken.alias("taken"), "uses")


def curriculum(mixed: DataFrame) -> DataFrame:
    """One row for each use of a document, range-sorted by training position (ties by doc_id, epoch).

    uses gives way to epoch, words and position; columns of these names are replaced. Documents without a use give no row.
    """
    rest = [F.col(f"`{x}`") for x in mixed.columns if x.lower() not in {"uses", "epoch", "words", "position"}]
    rows = mixed.select(*rest, F.inline("uses"))
    return rows.orderBy("position", "doc_id", "epoch")


def by_position(mixed: DataFrame) -> DataFrame:
    """`mixed` with position and position_2, where its first and second use stand in training (null: not used), range-sorted by position."""
    at = lambda k: F.round(F.get("uses", k)["position"], 9)
    out = mixed.withColumns({"position": at(0), "position_2": at(1)}).drop("uses")
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")
