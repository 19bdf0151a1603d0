"""A corpus pipeline of five stages over `documents`; each stage's rows are written and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import common as c
from framewright.llm import decontaminate, jaccard_join, mixing, quality_rules, queries, substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null or empty texts have too few words and go; repeated rows are judged alike; an empty table gives an empty one. Like all
    stages but the last it returns the columns of documents, and leaves out any others.
    """
    return quality_rules.judge(docs, keep_text=True).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join the document with the smallest doc_id; of rows that share a doc_id, one.

    Rows with a null doc_id can't be named and stay. Empty texts link with nothing and stay. An empty table gives an empty one.
    """
    docs = docs.select(*COLUMNS)
    found = c.materialize(jaccard_join.join(docs, percent=75, width=5).select("doc_id", "component_id"), "components")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    left = docs.join(c.small_enough(gone, 1_000_000), docs["doc_id"] == F.col("gone_id"), "left_anti")
    again = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("again_id"))
    if again.isEmpty():
        return left
    match = left["doc_id"] == F.col("again_id")
    one = left.join(again, match, "left_semi").dropDuplicates(["doc_id"])
    return left.join(again, match, "left_anti").unionByName(one)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones hold; a document of which nothing is left goes.

    What is left of a changed text is its words joined by one space, and n_chars is counted again; other texts stay as they are,
    null and empty ones too. An empty table gives an empty one.
    """
    left = substring_dedup.remove(docs.select(*COLUMNS), window=substring_dedup.WINDOW)
    changed = F.col("n_removed") > 0
    return (
        left.filter(~changed | (F.col("n_removed") < F.col("n_words")))
        .withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text")))
        .withColumn("n_chars", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")))
        .select(*COLUMNS)
    )


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found; null and empty texts hold none. An empty table or benchmark changes nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each use of a document in the training mix, sorted by training position.

    Null and empty texts have no words and no use; rows of a null source form a source of their own; repeated rows are used
    each. An empty table gives an empty result.
    """
    mixed = mixing.assign(docs, weight=mixing.by_rank(3, 1, 2), schedule=queries.ramps, keep_text=True)
    return mixing.curriculum(mixed).select(*COLUMNS, "size", "source_size", "target", "epoch", "words", "position")


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("source_mixing", mix),
]

#: SQL can't express the SimHash candidates of stage 4; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`: the training mix of the documents that are left. Columns are those of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = c.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
