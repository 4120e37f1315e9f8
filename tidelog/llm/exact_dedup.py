"""Exact deduplication as a stateful stream (operator 2, native: DataFrame functions only).

Documents pass a journal of (doc_id, digest, locator). A streaming aggregation keeps, for
every digest, the smallest doc_id, the locator of that document's content (file and row) and a
count, in a RocksDB state store without watermark or expiry. On a hit the bytes themselves are
compared: the whole normalised text of every later document against the text that is read at
the state's locator; where a digest proves ambiguous, its texts are grouped by their bytes.

With a ``state_dir`` journal, state and checkpoint outlive the run, so that later input is
deduplicated against all earlier input. The normalised text of every digest's first document is
kept there too, so nothing of what earlier input was read from need stay as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_RUN, drop_path, forget_shuffles, is_empty, join_unique, maybe_in, new_path, release, stored, total_of

#: Disk-backed state. Files aren't allocated ahead, as many partitions hold little state; memory is bounded for an executor.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}
#: Micro-batches of a run; the state of one meets the next.
BATCHES = 2
#: Rows of one state entry that are compared with one copy of the kept text.
MEMBERS_PER_COPY = 256
#: Where a document's content is: a hash of its file's path, and the row in the file.
LOCATOR = "struct<file:bigint,row:bigint>"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def sha256_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def is_plain(rows: DataFrame) -> bool:
    """Whether each row is one row of a file: a scan with projections and filters only. A generator, union or join gives rows that share a place."""
    todo, plain = [rows._jdf.queryExecution().analyzed()], {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}
    while todo:
        node = todo.pop()
        if node.nodeName().split(" ")[0] not in plain:
            return False
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return True


def located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, locator of every row; input whose rows aren't rows of Parquet files is written to some first."""
    plain = is_plain(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    try:
        rows = docs.select("*", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").cast("long").alias("row")) if plain else None
    except AnalysisException:
        rows = None
    if rows is None:
        return located(stored(docs, "dedup-texts"), "doc_id", "text")
    return rows.select("doc_id", "text", F.struct("file", "row").alias("locator"))


def state_stream(journal: DataFrame) -> DataFrame:
    """Keyed state over a (streaming or batch) journal: one entry per digest, never expired."""
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "locator")  # a null id comes last
    return journal.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.min_by("locator", first).alias("keep_locator"), F.count(F.lit(1)).alias("group_size"))


def run_stream(spark: SparkSession, journal_path: str, schema: T.StructType, checkpoint: str, files_per_batch: int) -> DataFrame:
    """Stream what is new in the journal through the state store; returns the last state of every digest that occurs in it."""
    out = new_path(spark, "dedup-state")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(journal_path)
    batches: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        batches.append(number)

    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        query = (
            state_stream(source).writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    shape = state_stream(spark.createDataFrame([], schema)).schema
    if not batches:
        return spark.createDataFrame([], shape)
    updates = spark.read.schema(T.StructType([*shape, T.StructField("batch", T.IntegerType())])).parquet(out)
    newest = F.max_by(F.struct(*[c for c in shape.names if c != "digest"]), "batch")
    last = stored(updates.groupBy("digest").agg(newest.alias("s")).select("digest", "s.*"), "dedup-last")
    drop_path(spark, out)
    return last


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_of,
    state_dir: str | None = None, batches: int = BATCHES,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest: one row per row of ``docs``, dropped ones too.

    Texts are equal when identical after every run of ASCII white space became one space;
    the row with the smallest id stays. A null text counts as empty; an empty text is a text
    like any other. Repeated rows each get their row and count in group_size; rows that
    share the kept id are all marked kept. A null id is larger than any other: such a row
    stays only if its whole group has none. Other columns are ignored. An empty table gives
    no rows.

    ``state_dir``, a folder that all executors reach, keeps the state and the texts of first
    occurrences. Then keep_id and group_size also count the documents of all earlier runs with
    this folder and ``digest``, whatever has become of the files that these were read from.
    """
    spark = docs.sparkSession
    where = state_dir or new_path(spark, "dedup")
    rows = located(docs, id_col, text_col)
    entry = rows.select("doc_id", "locator", digest(normalised(F.col("text"))).alias("digest"))
    run = f"{where}/journal/run-{new_path(spark, 'x')[-32:]}"
    if state_dir:  # two runs may read the same file, so a locator counts for its run only
        entry = entry.withColumn("locator", F.struct(F.xxhash64("locator.file", F.lit(run)).alias("file"), "locator.row"))
        rows = rows.withColumn("locator", F.struct(F.xxhash64("locator.file", F.lit(run)).alias("file"), "locator.row"))
    entry.write.parquet(run)
    journal = spark.read.schema(entry.schema).parquet(run)
    files = len(journal.inputFiles())
    state = run_stream(spark, f"{where}/journal/run-*", entry.schema, f"{where}/checkpoint", max(1, -(-files // batches)))
    decided = stored(join_unique(journal, state, ["digest"], "group_size", total_of(state, "group_size")), "dedup-decided")
    forget_shuffles(spark)
    kept = kept_texts(spark, where) if state_dir else None
    clashes = stored(clashing(rows, decided, kept), "dedup-clashes")
    forget_shuffles(spark)
    release(state)
    if state_dir:
        keep_texts(rows, decided, clashes, kept, where)
    else:
        drop_path(spark, where)
    if not is_empty(clashes):
        decided = regrouped(rows, decided, clashes, digest, kept, f"{where}/journal/run-*", entry.schema)
    return decided.select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "digest",
    )


def texts_at(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """``picked`` (locator and others) with the normalised text that ``rows`` has at each locator; no other text is shuffled."""
    place = lambda d: d.withColumn("_at", F.xxhash64("locator.file", "locator.row"))
    some = maybe_in(place(rows), "_at", place(picked).select(F.col("_at").alias("id")))
    some = some.select("locator", normalised(F.col("text")).alias("text"))
    return picked.hint("merge").join(some, "locator")


_KEPT = "digest binary, locator struct<file:bigint,row:bigint>, text string, run int"


def kept_texts(spark: SparkSession, state_dir: str) -> DataFrame | None:
    """digest, locator, text, run: of every digest of earlier runs its first text, and all texts since it has proved ambiguous."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{state_dir}/kept")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(_KEPT).parquet(f"{state_dir}/kept")


def keep_texts(rows: DataFrame, decided: DataFrame, clashes: DataFrame, kept: DataFrame | None, state_dir: str) -> None:
    """Adds the texts of digests that are new, and of all rows under an ambiguous one."""
    first = decided.filter("locator = keep_locator").select("digest", "locator")
    number = 0
    if kept is not None:
        first = first.join(kept.select("digest"), "digest", "left_anti")
        number = (kept.agg(F.max("run")).first()[0] or 0) + 1
    picked = stored(first.unionByName(decided.join(clashes, "digest").select("digest", "locator")).distinct(), "dedup-keep")
    texts_at(rows, picked).select("digest", "locator", "text").write.parquet(f"{state_dir}/kept/run={number}")
    release(picked)


def clashing(rows: DataFrame, decided: DataFrame, kept: DataFrame | None) -> DataFrame:
    """Digests under which a text differs from a kept one, by comparing whole texts.

    Only documents of entries with a hit are read, by their locators. The kept text is copied
    once for every MEMBERS_PER_COPY rows, so no task gets a whole hot group.
    """
    hit = decided.filter("group_size > 1").withColumn("copies", F.ceil(F.col("group_size") / MEMBERS_PER_COPY).cast("int"))
    got = stored(texts_at(rows, hit.select("locator", "keep_locator", "digest", "copies")), "dedup-hits")
    texts = got.filter("locator = keep_locator").select("digest", "copies", "text")
    if kept is not None:  # what earlier runs have under the digest, even if a smaller id is kept by now
        asked = stored(hit.select("digest", "copies").distinct(), "dedup-earlier")
        place = lambda d: d.withColumn("_at", F.xxhash64("digest"))
        some = maybe_in(place(kept), "_at", place(asked).select(F.col("_at").alias("id"))).select("digest", "text")
        texts = texts.unionByName(asked.join(some, "digest").select("digest", "copies", "text"))
    texts = texts.select("digest", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("text").alias("kept_text"))
    members = got.select("digest", F.pmod(F.xxhash64("locator.file", "locator.row"), F.col("copies")).cast("int").alias("copy"), "text")
    return members.join(texts, ["digest", "copy"]).filter(F.col("text") != F.col("kept_text")).select("digest").distinct()


def regrouped(rows: DataFrame, decided: DataFrame, clashes: DataFrame, digest: Callable[[Column], Column], kept: DataFrame | None, journal: str, shape: T.StructType) -> DataFrame:
    """``decided`` with the rows of ambiguous digests grouped by their bytes, those of earlier runs among them.

    An earlier row's text is the one that was kept for it; before its digest proved ambiguous,
    all rows had the digest's first text.
    """
    spark = rows.sparkSession
    now = rows.select("doc_id", normalised(F.col("text")).alias("text")).withColumn("digest", digest(F.col("text"))).join(clashes, "digest")
    every = now
    if kept is not None:
        old = stored(kept.join(clashes, "digest"), "dedup-ambiguous")
        entries = spark.read.schema(shape).parquet(journal).join(clashes, "digest").join(rows.select("locator"), "locator", "left_anti").select("locator", "doc_id", "digest")
        first = old.groupBy("digest").agg(F.min_by("text", "run").alias("_first"))
        before = entries.join(old.select("locator", "text"), "locator", "left").join(first, "digest", "left")
        every = now.unionByName(before.select("doc_id", "digest", F.coalesce("text", "_first").alias("text")).filter("text is not null"))
    groups = every.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    fixed = now.join(groups, ["digest", "text"])
    columns = ["doc_id", "digest", "keep_id", "group_size"]
    return decided.join(clashes, "digest", "left_anti").select(columns).unionByName(fixed.select(columns))
