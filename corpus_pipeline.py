"""A corpus pipeline: five stages, each over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate as decontamination
from tidelog.llm import exact_dedup, near_dedup, quality
from tidelog.llm.common import Scratch, drop_path, give_back, is_empty, marked, new_path, read_table, stored
from tidelog.llm.queries import bpe_digests

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes that a worker's BPE memory takes here, where executors have all stages' needs to meet; by itself it takes more.
REMEMBERED = 40 << 20


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``: no null, of one row each, in the order of doc_id (nulls last).

    That is doc_id itself where it is so already; else all rows are sorted and numbered.
    """
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 or doc_id is null")
    if is_empty(odd):
        return docs.withColumn("row", F.col("doc_id"))
    # The last key spreads repeated rows over tasks.
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("row")]
    ordered = docs.withColumn("row", F.monotonically_increasing_id()).orderBy(*order)
    return stored(ordered.withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")


def first_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` without those that an operator, given ``row`` as their id, doesn't keep.

    Only rows that may go are shuffled, whatever the sizes; all others pass whole.
    """
    gone = stored(found.filter("not kept").select(F.col("doc_id").alias("row")), "pipeline-gone")
    split = marked(rows, "row", gone.select(F.col("row").alias("id")))
    left = split.filter("maybe").join(gone.hint("merge"), "row", "left_anti")
    return split.filter("not maybe").select(COLUMNS).unionAll(left.select(COLUMNS))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably of good quality and not toxic.

    Each row is judged by itself, so ties, repeated rows and shared or null ids make no
    difference; equal rows share a fate. A null text counts as empty, null metadata as a kind
    of its own, and texts are read whole at any length. Without usable labels all rows stay;
    an empty table gives no rows. Columns besides those of ``documents`` are dropped, here and
    in all stages.
    """
    give_back(spark)
    return quality.keep_good(docs.select(COLUMNS), read_table(spark, sf_dir, "labels"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of equal texts.

    Rows are told apart even if they share an id: one row of a group stays, also of repeated
    rows, and rows with one id and different texts go by their own. A null id is larger than
    any other; of a group with no other, one row stays. A null text equals an empty one.
    Texts are compared whole at any length; an empty table gives no rows.
    """
    give_back(spark)
    rows = numbered(docs.select(COLUMNS))
    return first_rows(rows, exact_dedup.exact_dedup(rows, "row"))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of near copies (five words, 0.8).

    Shared and null ids count as in the stage before. Texts without words are linked with
    nothing, so all of them stay. Texts are compared whole; an empty table gives no rows.
    """
    give_back(spark)
    rows = numbered(docs.select(COLUMNS))
    return first_rows(rows, near_dedup.near_components(rows, "row", width=5, percent=80))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item.

    Each row is judged by itself: shared and null ids, ties and repeated rows make no
    difference. A null or empty text holds no item and stays; a long one is searched whole. An
    empty table gives no rows, and an empty benchmark drops none.
    """
    give_back(spark)
    return decontamination.keep_clean(docs.select(COLUMNS), read_table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of the ids and of the decoded text: one row per row.

    A null or empty text has no ids. Repeated rows and shared or null ids each have their row;
    texts are encoded whole at any length; an empty table gives no rows.
    """
    give_back(spark)
    return bpe_digests(docs, "ids", remembered=REMEMBERED)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", benchmark_decontamination),
    ("bpe", bpe_encoding),
]

#: Training, MinHash, BM25 and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's output is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        with Scratch():  # what a stage has stored goes once its rows are written
            stage(spark, docs, sf_dir).write.parquet(path)
        if name != STAGES[0][0]:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
