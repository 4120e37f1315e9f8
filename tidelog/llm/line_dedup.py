"""Line deduplication (operator 7, native: DataFrame functions only).

The keys of long lines are range-partitioned with a secondary sort by document (largest
first) and position. Each partition is then read as one sorted stream: a key's first
occurrence is in the document that keeps its lines, and all that follows in other documents
goes if the stream meets enough documents. Keys with more than 1/HOT_KEYS of all lines, which
no single stream should hold, are aggregated before they meet. What leaves the operator is one
run-length coded keep bitmap per document that loses lines, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget_shuffles, hot_groups, marked, release, row_mark, stored, with_hot


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends and with A-Z lower-cased."""
    stripped = F.trim(line, F.lit(" \t\n\x0b\f\r"))
    letters = F.translate(stripped, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(stripped) == F.length(stripped), F.lower(stripped)).otherwise(letters)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """The compressed keep bitmap: runs (start, length) of the positions below ``n_lines`` that aren't in ``dropped`` (sorted, distinct)."""
    before = F.concat(F.array(F.lit(-1)), dropped)
    gaps = F.transform(before, lambda p, i: F.struct((p + 1).alias("start"), (F.coalesce(F.get(dropped, i), n_lines) - p - 1).alias("length")))
    return F.filter(gaps, lambda r: r["length"] > 0)


def lost_lines(keyed: DataFrame, min_docs: int) -> DataFrame:
    """doc_id, mark, n_lines, pos of the lines of ``keyed`` (those and key) that go."""
    rows = with_hot(keyed, ["key"], "doc_id", "mark", "pos")
    firsts = hot_groups(rows, ["key", "doc_id"]).groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("first_doc"))
    rows = rows.join(F.broadcast(firsts), "key", "left")
    stream = rows.repartitionByRange("key", "_salt").sortWithinPartitions("key", "_salt", F.desc("doc_id"), "mark", "pos")
    key = Window.partitionBy("key", "_salt").orderBy(F.desc("doc_id"))  # the range partitioning and the sort serve this as they are
    stream = stream.withColumn("nth", F.dense_rank().over(key))
    stream = stream.withColumn("docs", F.max("nth").over(key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    streamed = (F.col("nth") > 1) & (F.col("docs") >= min_docs)
    counted = (F.col("n_docs") >= min_docs) & (F.col("doc_id") != F.col("first_doc"))
    return stream.filter(F.when(F.col("_hot"), counted).otherwise(streamed)).select("doc_id", "mark", "n_lines", "pos")


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, mark, kept: keep bitmaps, as runs (start, length), of the documents that lose lines; all others keep all.

    A key of at least ``min_chars`` code points that at least ``min_docs`` documents hold
    loses all its lines but those of the largest doc_id. A null text is one empty line.
    Repeated rows count as one document by doc_id, each losing its own lines (``mark`` tells
    rows of one id apart). Rows without an id neither count nor lose lines. Other columns
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and length(text) >= %d" % min_chars)
    lines = docs.select("doc_id", row_mark(F.col("text")).alias("mark"), lines_of(F.col("text")).alias("lines"))
    lines = lines.select("doc_id", "mark", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    long = lines.filter(F.length("line") >= min_chars).withColumn("line", line_key(F.col("line"))).filter(F.length("line") >= min_chars)
    # Stored, as range partitioning samples its input and so would hash every line twice.
    keyed = stored(long.select(F.unhex(F.md5("line")).alias("key"), "doc_id", "mark", "n_lines", "pos"), "line-keys")
    lost = lost_lines(keyed, min_docs)
    bitmaps = lost.groupBy("doc_id", "mark", "n_lines").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    out = stored(bitmaps.select("doc_id", "mark", keep_runs(F.col("dropped"), F.col("n_lines")).alias("kept")), "line-bitmaps")
    release(keyed)
    forget_shuffles(spark)
    return out


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, text (the lines that stay, joined by a line feed): one row per row of ``docs``.

    Only documents that may have a bitmap are shuffled to it, whatever the sizes; all others pass whole.
    A null text counts as empty, which is one line; rows without a bitmap, those with a null
    id among them, keep all lines. Repeated rows each get their row; other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = marked(rows, "doc_id", bitmaps.select(F.col("doc_id").alias("id")))
    text = F.coalesce("text", F.lit(""))
    n_lines = lambda t: (F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long")
    whole = rows.filter("not maybe").select("doc_id", n_lines(text).alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), text.alias("text"))
    cut = rows.filter("maybe").withColumn("mark", row_mark(F.col("text"))).join(bitmaps.hint("merge"), ["doc_id", "mark"], "left")
    lines = F.flatten(F.transform("kept", lambda r: F.slice(F.col("lines"), r["start"] + 1, r["length"])))
    cut = cut.withColumn("lines", F.when(F.col("kept").isNotNull(), lines_of(F.col("text")))).withColumn("stay", lines)
    cut = cut.select(
        "doc_id", F.coalesce(F.size("lines").cast("long"), n_lines(text)).alias("n_lines"),
        F.coalesce((F.size("lines") - F.size("stay")).cast("long"), F.lit(0).cast("long")).alias("n_dropped"),
        F.coalesce(F.array_join("stay", "\n"), text).alias("text"),
    )
    return whole.unionAll(cut)
