"""Helpers that the operators of this subpackage share: inputs, shared tables, skew-safe joins."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: At most this many keys are ever broadcast by ``join_unique``: a key is hot when it
#: holds more than 1/HOT_KEYS of all rows, so fewer than HOT_KEYS keys can be hot.
HOT_KEYS = 2000

#: Bits of the bitmap that ``marked`` broadcasts: 8 an id, between 128 KB and 32 MB in all.
LEAST_SLOTS, MOST_SLOTS = 1 << 20, 1 << 28

#: Bytes of text that a Python worker turns into objects at a time.
AT_ONCE = 1 << 21

#: ASCII white space, ``[\x20\x09-\x0D]``; it is also what ``bytes.split()`` splits on.
SPACE_RUN = r"[\x20\x09-\x0D]+"


#: Rows and bytes of an Arrow batch at most; each task holds a few batches in the JVM and in its worker.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits of an Arrow batch to ARROW, as texts may be long; smaller ones stay."""
    for k, most in ARROW.items():
        now = int((spark.conf.get(k, None) or "0").rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(k, str(most))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidelog-{name}-{uuid.uuid4().hex}"


_OPEN: list[Scratch] = []


class Scratch:
    """``with Scratch() as s:`` deletes, at its end, all tables that were ``stored`` inside, but for those that it ``keep``s.

    What is kept belongs to the scratch around it, if there is one, so an operator's tables
    last only as long as they are read.
    """

    def __init__(self) -> None:
        self.made: list[DataFrame] = []
        self.kept: list[str] = []

    def __enter__(self) -> Scratch:
        _OPEN.append(self)
        return self

    def __exit__(self, *error: object) -> None:
        _OPEN.remove(self)
        for t in self.made:
            if t.stored_at not in self.kept:
                release(t)
            elif _OPEN:
                _OPEN[-1].made.append(t)

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.append(table.stored_at)
        return table


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _OPEN:
        _OPEN[-1].made.append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned, once all that reads them is stored itself."""
    for t in tables:
        if path := getattr(t, "stored_at", None):
            drop_path(t.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of jobs whose results are stored by now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back(spark: SparkSession) -> None:
    """Let executors collect garbage, as a heap that has grown for one job else stays as large in all later ones, beside their workers."""
    tasks = 2 * spark.sparkContext.defaultParallelism  # some for each executor
    spark.range(0, tasks, 1, tasks).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def total_of(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(column)).first()[0] or 0


def join_unique(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row per key and a row count ``weight``.

    Keys with more than ``total / HOT_KEYS`` rows (fewer than HOT_KEYS of them, whatever the
    input) are joined by broadcast, so that a key with a third of all rows never meets in
    one task; all other keys take a shuffle join. Both sides should be stored tables.
    """
    limit = total // HOT_KEYS
    hot = F.broadcast(keyed.filter(F.col(weight) > limit))
    cold = keyed.filter(F.col(weight) <= limit)
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(cold, keys))


def marked(rows: DataFrame, id_col: str, ids: DataFrame, name: str = "maybe") -> DataFrame:
    """``rows`` with a boolean column: true where the id is among ``ids`` (a column id), and for a few others.

    A hash of the id picks one bit of a bitmap with 8 bits an id, which is broadcast: 32 MB at
    most, whatever the input. The fuller it is, the more other rows are marked; none is lost.
    So a join that concerns some documents needn't shuffle the texts of all.
    """
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (8 * ids.count()).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots))
    bits = ids.select(slot("id").alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("_part"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits"))
    at = F.bitmap_bit_position(slot(id_col)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_part", F.bitmap_bucket_number(slot(id_col))).join(F.broadcast(bits), "_part", "left")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1
    return found.withColumn(name, F.coalesce(bit, F.lit(False))).select(*rows.columns, name)


def maybe_in(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ``ids``, and a few others, without a shuffle."""
    return marked(rows, id_col, ids, "_maybe").filter("_maybe").drop("_maybe")


def hot_hashes(rows: DataFrame, keys: list[str]) -> list[int]:
    """xxhash64 of every key with more than 1/HOT_KEYS of all rows, and of some less common ones (fewer than 16 * HOT_KEYS in all).

    Each of 64 groups of partitions has a sketch of its most common keys, of bounded size
    (200 KB a task); their counts are added up. All sketches together miss fewer than
    1/(2 * HOT_KEYS) of the rows of any key, so half the threshold finds every hot one.
    """
    n = rows.count()
    if not n:
        return []
    tracked = 4 * HOT_KEYS
    parts = rows.select(F.xxhash64(*keys).alias("h")).groupBy(F.pmod(F.spark_partition_id(), F.lit(64)).alias("part"))
    tops = parts.agg(F.expr(f"approx_top_k(h, {tracked}, {tracked})").alias("top")).select(F.explode("top").alias("t")).select("t.*")
    found = tops.groupBy("item").agg(F.sum("count").alias("n")).filter(F.col("n") > n // (2 * HOT_KEYS))
    return sorted(r["item"] for r in found.select("item").collect())


#: Parts that the rows of a hot key are dealt to.
SALTS = 4096


def with_hot(rows: DataFrame, keys: list[str], *spread: str) -> DataFrame:
    """``rows`` with ``_hot`` (true where the key is hot, else null) and ``_salt``.

    The salt deals the rows of a hot key out by the columns ``spread``, and is 0 for all other
    keys, so that a key and its salt are few enough for one task. ``rows`` should be stored.
    """
    hot = rows.sparkSession.createDataFrame([(h, True) for h in hot_hashes(rows, keys)], "_h long, _hot boolean")
    marked = rows.withColumn("_h", F.xxhash64(*keys)).join(F.broadcast(hot), "_h", "left").drop("_h")
    return marked.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(0))


def hot_groups(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of ``columns`` in the hot rows of ``with_hot``, by partial aggregates; all others are one group that is left out."""
    pick = [F.when(F.col("_hot"), F.col(c)).alias(c) for c in columns]
    return rows.groupBy(*pick).agg(F.count("_hot").alias("_n")).filter("_n > 0").drop("_n")


def beside_least(rows: DataFrame, keys: list[str], of: str) -> DataFrame:
    """``rows`` with ``low`` and ``high``, the extremes of a column over all rows of the same key, in one shuffle of the rows.

    Hot keys are aggregated in each task first, and their result is broadcast. ``rows`` should
    be stored, and its keys not null.
    """
    every = with_hot(rows, keys, *[c for c in rows.columns if c not in keys])
    pick = [F.when(F.col("_hot"), F.col(c)).alias(c) for c in keys]
    few = every.groupBy(*pick).agg(F.min(of).alias("_low"), F.max(of).alias("_high"), F.count("_hot").alias("_n")).filter("_n > 0").drop("_n")
    one = Window.partitionBy(*keys, "_salt")
    found = every.join(F.broadcast(few), keys, "left")
    found = found.withColumns({"low": F.coalesce("_low", F.min(of).over(one)), "high": F.coalesce("_high", F.max(of).over(one))})
    return found.drop("_hot", "_salt", "_low", "_high")


def row_mark(text: Column) -> Column:
    """31 bits of a text, to tell rows apart that share a doc_id."""
    return F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1))


#: What kernels remember in a worker from task to task.
CACHES: list[dict] = []


def forget_caches(own: dict | None) -> None:
    """Give back what other operators' kernels have left in this worker, as workers outlive a job."""
    left = [c for c in CACHES if c is not own and c]
    if left:
        for c in left:
            c.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = AT_ONCE, own: dict | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose ``column`` has about ``most`` bytes, or list items; a longer row is one slice.

    What a worker holds as Python objects is then bounded by the data's size, not by a number
    of rows. ``own`` is the caller's cache among CACHES; all others are emptied first.
    """
    forget_caches(own)
    for batch in batches:
        values = batch.column(column)
        sizes = values.value_lengths() if pa.types.is_list(values.type) else pc.binary_length(values)
        group = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield batch.slice(a, b - a)
