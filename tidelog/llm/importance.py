"""Importance resampling towards a target distribution, by hashed n-grams (operator 12).

Each task sorts the word positions of a block of its texts by the next n word ids (a suffix
array, as deep as the longest n-gram). Neighbours with a common prefix of k ids are a run of
one repeated k-gram: it is hashed once, and its bucket goes back to all of the run's places.
One pass counts the buckets, a second one adds up each document's gains. Documents are drawn by
their weight with Gumbel noise, which is sampling without replacement in proportion to
exp(weight / 1000).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, sliced, small_batches, stored

#: Buckets bound the table of gains that every task gets.
BUCKETS, MOST_BUCKETS = 10_000, 1 << 20
#: Bytes of text of one suffix array; a longer text is one by itself.
BLOCK = 1 << 22
#: Bytes that end a word become a blank, A-Z become a-z; bytes of characters beyond ASCII belong to words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The runs of digits, a-z and characters beyond ASCII, A-Z in lower case; none for null."""
    return text.translate(_WORD_BYTES).split() if text else []


def ngram_buckets(texts: list[list[bytes]], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every n-gram (1 to ``longest`` words of one text), repeats included."""
    flat = [w for words in texts for w in words]
    if not flat:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids: dict[bytes, int] = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for w in flat), np.int64, len(flat))
    size = np.array([len(x) for x in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), size)
    end = np.repeat(np.cumsum(size), size)
    at = np.arange(len(flat))
    # ahead[k]: the word k places on, or -1 behind the text's end, so that no run crosses it
    ahead = [np.where(at + k < end, word[np.minimum(at + k, len(flat) - 1)], -1) for k in range(longest)]
    suffixes = np.lexsort(ahead[::-1]) if longest > 1 else np.argsort(word, kind="stable")
    begins = np.zeros(len(flat), bool)
    begins[0] = True
    found_of, found = [], []
    for k in range(longest):
        column = ahead[k][suffixes]
        begins[1:] |= column[1:] != column[:-1]  # where the common prefix has k words at most
        run = np.flatnonzero(begins)
        length = np.diff(np.append(run, len(flat)))
        whole = column[run] >= 0
        first = suffixes[run[whole]]
        hashed = np.fromiter((zlib.crc32(flat[p] if k == 0 else b" ".join(flat[p : p + k + 1])) % buckets for p in first.tolist()), np.int64, len(first))
        places = suffixes[np.repeat(whole, length)]
        found_of.append(of[places])
        found.append(np.repeat(hashed, length[whole]))
    return np.concatenate(found_of), np.concatenate(found)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for part in sliced(batches, "text", BLOCK):
        yield part, [words_of(x) for x in part.column("text").to_pylist()]


def _count(longest: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, texts in _blocks(batches):
            total += np.bincount(ngram_buckets(texts, longest, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return run


def _weigh(longest: int, gains: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _blocks(batches):
            of, bucket = ngram_buckets(texts, longest, len(gains))
            n = np.bincount(of, minlength=len(texts))
            weight = np.bincount(of, gains[bucket], len(texts)).astype(np.int64)  # whole numbers far below 2**53
            words = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), words, pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def _texts(rows: DataFrame, text_col: str, *more: Column) -> DataFrame:
    return rows.select(*more, F.encode(F.col(text_col), "UTF-8").alias("text"))


def bucket_counts(rows: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the features of all texts that fall into each bucket; none for a bucket without any.

    Tasks hand on at most one row a bucket.
    """
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"1 to {MOST_BUCKETS} buckets")
    small_batches(rows.sparkSession)
    found = _texts(rows, text_col).mapInArrow(_count(longest, buckets), "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of all buckets: floor of 1000 times the logarithm of how much likelier the target has it, with one added to each count."""
    every = raw.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    every = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    sums = every.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    x = lambda c: F.col(c).cast("double")
    ratio = (x("t") + 1) * (x("all_s") + buckets) / ((x("s") + 1) * (x("all_t") + buckets))
    return every.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain"))


def gumbel(key: Column, seed: int) -> Column:
    """Floor of 1000 times Gumbel noise from the first 32 bits of a hash of seed and key; a null key counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` (a stored table) with their number from 1 in a total order, by a range-partitioned sort and the partitions' sizes.

    Rows that are equal in ``order`` follow their places in the files, so that no value,
    however common, must stay in one partition. The driver gets one row a partition.
    """
    order = [*order, F.col("_file_row")]
    placed = rows.withColumn("_file_row", F.col("_metadata.row_index"))
    kept = stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_file_row").withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    at, before = 0, []
    for r in kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        before.append((r.part, at))
        at += r.n
    sizes = rows.sparkSession.createDataFrame(before, "_part long, _before long")
    out = kept.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    return out.withColumn("number", F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) + 1).drop("_at", "_part", "_before")


def resample(
    docs: DataFrame, target: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, least_words: int = 20,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs``.

    ``percent`` of the documents with at least ``least_words`` words are drawn, those with the
    highest scores (weight and noise); ties go to the smaller id. rank is 1, 2, 3 ... in that
    order and null for all others. A null or empty text has no features and weight 0; a null
    id is smaller than any other, and its noise is that of an empty one; rows that share an id
    share their noise and are drawn each by its own text. Other columns are ignored. An empty
    target gives the same gain to buckets that are as full; an empty table gives no rows.
    """
    raw = stored(bucket_counts(docs, text_col, longest, buckets), "dsir-raw")
    aimed = stored(bucket_counts(target, target_text, longest, buckets), "dsir-target")
    gains = np.zeros(buckets, np.int64)
    for r in gains_of(raw, aimed, buckets).collect():  # one row a bucket
        gains[r.bucket] = r.gain
    release(raw, aimed)
    rows = _texts(docs, text_col, F.col(id_col).cast("long").alias("doc_id")).mapInArrow(_weigh(longest, gains), "doc_id long, n_words long, n_features long, weight long")
    scored = stored(rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "dsir-scores")
    may = F.col("n_words") >= least_words
    drawn = percent * scored.filter(may).count() // 100
    order = [may.desc(), F.desc("score"), F.asc_nulls_first("doc_id"), F.desc("weight"), F.desc("n_features")]
    out = numbered(scored, order, "dsir-ranks")
    release(scored)
    return out.withColumn("rank", F.when(F.col("number") <= drawn, F.col("number"))).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
