"""The event log: Parquet partitioned by commit, symbol and UTC date, with a manifest of committed files.

A commit is one folder, so its files are known without a look at any other, and writing it
again replaces it. Files that no manifest entry names are incomplete.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clock import utc_date
from ..operators.ordering import order_errors
from ..operators.validate import event_error, with_decimals
from ..schema import EVENT, EVENT_TYPES, TYPE_COLUMNS
from ..streaming.observe import counted
from ..streaming.state import check_order, rocksdb

ROWS_PER_GROUP = 250_000
OPTIONS = {
    "compression": "zstd", "parquet.compression.codec.zstd.level": "3", "parquet.page.size": str(1 << 20), "parquet.enable.dictionary": "true",
    "parquet.block.row.count.limit": str(ROWS_PER_GROUP),
}
#: Columns of the folders below a commit's.
LAYOUT = ("symbol", "event_date")


def as_events(rows: DataFrame) -> DataFrame:
    """Any rows as the wide event schema: missing columns are null, types are cast."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT])


def union_events(kinds: dict[str, DataFrame]) -> DataFrame:
    """Per-type DataFrames as one wide DataFrame."""
    parts = [as_events(df.withColumn("event_type", F.lit(EVENT_TYPES[k]))) for k, df in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def check(events: DataFrame, arrival: list[str], file: tuple[str, ...] = LAYOUT) -> DataFrame:
    """``events`` with ``error`` and ``event_date``: the validation's first error, or else that of the order check.

    As in a writer's append, events that fail validation don't take part in the order check.
    """
    rows = events.withColumns({"event_date": utc_date("ts_event_ns"), "error": event_error()})
    return order_errors(rows, arrival, list(file), "error")


def write_log(
    events: DataFrame, path: str, session_id: str, feed_mode: str, max_file_rows: int = 2_000_000, arrival: list[str] | None = None,
    commit: str | None = None, layout: tuple[str, ...] = LAYOUT, order: tuple[str, ...] = ("seq",),
) -> DataFrame:
    """Append the events that validation and order check accept; returns the rejected ones with their errors.

    ``arrival`` is the order of appending (receive time and sequence if not given). Rows are
    range-partitioned by ``layout`` and ``order`` and sorted, so that a busy symbol's day
    spreads over tasks, files and row groups hold narrow ranges, and a quiet symbol gets one
    file. Only this commit's files are read again, for their zone map. A ``commit`` that is
    written again, as by a stream that restarts, replaces itself.
    """
    checked = check(as_events(events), arrival or ["ts_receive_ns", "seq"])
    return write_checked(checked, path, session_id, feed_mode, commit or uuid.uuid4().hex, max_file_rows, layout, order)


def write_checked(checked: DataFrame, path: str, session_id: str, feed_mode: str, commit: str, max_file_rows: int = 2_000_000, layout: tuple[str, ...] = LAYOUT, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Append ``checked`` events (with event_date and error) as one commit; returns the rejected ones."""
    spark = checked.sparkSession
    staged, refused = f"{path}/staged/commit={commit}", f"{path}/refused/commit={commit}"
    checked.write.mode("overwrite").option("compression", "lz4_raw").parquet(staged)
    checked = spark.read.schema(checked.schema).parquet(staged)
    rows = with_decimals(checked.filter("error is null").drop("error")).withColumn("feed_mode", F.lit(feed_mode))
    key = [*layout, *order]
    rows.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").options(**OPTIONS).option("maxRecordsPerFile", max_file_rows).partitionBy(*layout).parquet(f"{path}/events/commit={commit}")
    zones_of(read_log(spark, path, [commit])).write.mode("overwrite").parquet(f"{path}/zones/commit={commit}")
    facts = rolled_up(spark.read.schema(ZONES).parquet(f"{path}/zones/commit={commit}"))
    facts = facts.withColumns({"session_id": F.lit(session_id), "feed_mode": F.lit(feed_mode), "write_complete": F.lit(True)})
    facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/commit={commit}")
    checked.filter("error is not null").drop("event_date").write.mode("overwrite").parquet(refused)
    where = spark._jvm.org.apache.hadoop.fs.Path(staged)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return spark.read.schema(checked.drop("event_date").schema).parquet(refused)


def _reader(spark: SparkSession, path: str) -> DataFrameReader:
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT)
    return spark.read.schema(f"{ddl}, feed_mode string, event_date date, commit string").option("basePath", f"{path}/events")


def read_log(spark: SparkSession, path: str, commits: list[str] | None = None) -> DataFrame:
    """All events, or those of some commits; ranges of event time and sequence are pushed to the Parquet scan."""
    return _reader(spark, path).parquet(*[f"{path}/events/commit={c}" for c in commits] if commits else [f"{path}/events"])


def append_stream(
    stream: DataFrame, path: str, checkpoint: str, session_id: str, feed_mode: str, arrival: list[str] | None = None, every: str | None = "2 seconds",
    layout: tuple[str, ...] = LAYOUT, order: tuple[str, ...] = ("seq",), file: tuple[str, ...] = LAYOUT, keep_ms: int | None = None,
    name: str | None = None,
):
    """A running query that appends a stream to the log: one commit for each micro-batch, every two seconds.

    With ``every=None`` it takes what is available and ends. After a failure the next run with
    the same ``checkpoint`` goes on where this one ended, and a batch that was half written is
    replaced. The last accepted event of each ``file`` (a symbol's day) is kept as state, so
    an event that is late against an earlier micro-batch, or an earlier run, is refused; with
    ``keep_ms`` that state goes so long after a file's last event. Date rollover and a change
    of ``feed_mode`` need no closing of files, as both are in the layout or in each row.
    Each micro-batch observes what it took in and refused, for an ``IngestListener``, under the query's ``name``.
    """
    rows = as_events(stream).drop(*[f.name for f in EVENT if f.name.endswith("_decimal")])
    rows = rows.withColumns({"event_date": utc_date("ts_event_ns"), "error": event_error()})
    checked = counted(check_order(rows, list(file), arrival or ["ts_receive_ns", "seq"], keep_ms))

    def put(batch: DataFrame, number: int) -> None:
        write_checked(batch, path, session_id, feed_mode, f"{session_id}-{number:09d}", layout=layout, order=order)

    with rocksdb(stream.sparkSession):
        out = checked.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
        out = out.queryName(name) if name else out
        return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


#: Per file and 250,000 rows in it: the ranges that pruning needs, and the first and last event by sequence.
ZONES = (
    "file string, zone long, rows long, low long, high long, low_seq long, high_seq long, "
    "first struct<ts_event_ns:bigint,symbol:string,venue:string,source:string>, last_ts_ns long, commit string"
)
MANIFEST = "file string, events long, first_seq long, last_seq long, first_ts_ns long, last_ts_ns long, first_symbol string, first_venue string, first_source string, session_id string, feed_mode string, write_complete boolean"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], f"{MANIFEST}, commit string")
    return spark.read.schema(f"{MANIFEST}, commit string").parquet(f"{path}/manifest")


def zones_of(log: DataFrame) -> DataFrame:
    """The zone map of written events: one row for every ROWS_PER_GROUP rows of a file, with partial aggregates."""
    header = F.struct("ts_event_ns", "symbol", "venue", "source")
    zone = F.floor(F.col("_metadata.row_index") / ROWS_PER_GROUP).cast("long")
    return log.groupBy(F.col("_metadata.file_path").alias("file"), zone.alias("zone")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts_event_ns").alias("low"), F.max("ts_event_ns").alias("high"), F.min("seq").alias("low_seq"), F.max("seq").alias("high_seq"),
        F.min_by(header, "seq").alias("first"), F.max_by("ts_event_ns", "seq").alias("last_ts_ns"),
    )


def rolled_up(zones: DataFrame) -> DataFrame:
    """Manifest entries from a zone map: rows, and the header of the first and the time of the last accepted event."""
    out = zones.groupBy("file").agg(F.sum("rows").alias("events"), F.min("low_seq").alias("first_seq"), F.max("high_seq").alias("last_seq"), F.min_by("first", "low_seq").alias("first"), F.max_by("last_ts_ns", "high_seq").alias("last_ts_ns"))
    return out.select("file", "events", "first_seq", "last_seq", F.col("first.ts_event_ns").alias("first_ts_ns"), "last_ts_ns", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("symbol", "venue", "source")])


def file_facts(events: DataFrame, file: Column) -> DataFrame:
    """Per file: rows, header of the first and time of the last event by sequence, in which a file's events were accepted."""
    return events.groupBy(file.alias("file")).agg(
        F.count(F.lit(1)).alias("events"), F.min_by("ts_event_ns", "seq").alias("first_ts_ns"), F.max_by("ts_event_ns", "seq").alias("last_ts_ns"),
        F.min_by("symbol", "seq").alias("first_symbol"), F.min_by("venue", "seq").alias("first_venue"), F.min_by("source", "seq").alias("first_source"),
    )


def incomplete_files(log: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that no commit has entered into the manifest."""
    return log.select(F.col("_metadata.file_path").alias("file")).distinct().join(manifest.filter("write_complete").select("file"), "file", "left_anti")


def read_zones(spark: SparkSession, path: str, time: tuple[int, int] | None = None, seq: tuple[int, int] | None = None) -> DataFrame:
    """The log's zone map, or the zones that ranges of event time and sequence touch; zones of half-written commits aren't in the manifest and left out."""
    files = read_manifest(spark, path).filter("write_complete").select("file")
    rows = spark.read.schema(ZONES).parquet(f"{path}/zones") if _exists(spark, f"{path}/zones") else spark.createDataFrame([], ZONES)
    for low, high, asked in (("low", "high", time), ("low_seq", "high_seq", seq)):
        if asked:
            rows = rows.filter((F.col(low) <= asked[1]) & (F.col(high) >= asked[0]))
    return rows.join(files, "file", "left_semi")


def read_range(spark: SparkSession, path: str, time: tuple[int, int] | None = None, seq: tuple[int, int] | None = None) -> DataFrame:
    """The events in ranges of event time and sequence, from those files only that the zone map says may hold some."""
    files = [r.file for r in read_zones(spark, path, time, seq).select("file").distinct().collect()]  # names, as for any read
    log = _reader(spark, path).parquet(*files) if files else read_log(spark, path).limit(0)
    return in_range(log, time, seq)


def touched(groups: DataFrame, time: tuple[int, int]) -> DataFrame:
    """``groups`` with whether a time range touches them, by their statistics."""
    return groups.withColumn("touched", (F.col("low") <= time[1]) & (F.col("high") >= time[0]))


def in_range(events: DataFrame, time: tuple[int, int] | None = None, seq: tuple[int, int] | None = None) -> DataFrame:
    """Inclusive ranges of event time and sequence; both reach the Parquet scan."""
    if time:
        events = events.filter(F.col("ts_event_ns").between(*time))
    if seq:
        events = events.filter(F.col("seq").between(*seq))
    return events


def replay(events: DataFrame) -> DataFrame:
    return events.orderBy("symbol", "event_date", "seq") if "event_date" in events.columns else events.orderBy("symbol", "seq")


def type_name(code: Column) -> Column:
    """The name of an event type's code; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in EVENT_TYPES.items() for x in (v, k)]), code.cast("int"))


def newest(events: DataFrame, most: int = 100) -> DataFrame:
    """The newest events, newest first."""
    return events.orderBy(F.desc("ts_event_ns"), F.desc("seq"), "symbol").limit(most)


def of_type(events: DataFrame, kind: str) -> DataFrame:
    """One event type with its own columns."""
    header = [c for c in EVENT.names[:8] if c != "event_type"]
    return events.filter(F.col("event_type") == EVENT_TYPES[kind]).select(*header, *TYPE_COLUMNS[kind])


def row_groups(events: DataFrame, order: list[str], time: tuple[int, int], size: int = ROWS_PER_GROUP) -> DataFrame:
    """Each file's row groups (of ``size`` rows in order) and whether a time range touches them."""
    n = F.row_number().over(Window.partitionBy("symbol").orderBy(*order))
    groups = events.withColumn("row_group", F.floor((n - 1) / size).cast("long")).groupBy("symbol", "row_group")
    return touched(groups.agg(F.count(F.lit(1)).alias("rows"), F.min("ts_event_ns").alias("low"), F.max("ts_event_ns").alias("high")), time)


def row_group_estimate(rows: Column) -> Column:
    """Full row groups that so many rows would fill."""
    return F.floor(rows / ROWS_PER_GROUP).cast("long")


def legacy_path(base: str) -> Column:
    """base/SYMBOL/YYYY/MM/DD.parquet"""
    d = utc_date("ts_event_ns")
    return F.concat_ws("/", F.lit(base), F.col("symbol"), F.date_format(d, "yyyy"), F.date_format(d, "MM"), F.concat(F.date_format(d, "dd"), F.lit(".parquet")))


_PATH = r"([A-Z0-9]+)/(\d{4})/(\d{2})/(\d{2})\.parquet$"


def path_symbol(path: Column) -> Column:
    return F.regexp_extract(path, _PATH, 1)


def path_date(path: Column) -> list[Column]:
    part = lambda k: F.coalesce(F.regexp_extract(path, _PATH, k).try_cast("int"), F.lit(0)).cast("long")
    return [part(2).alias("year"), part(3).alias("month"), part(4).alias("day")]


def list_files(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """File paths and sizes under the log, sorted by path, without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{path}/events").select("path", "length", F.regexp_extract("path", r"symbol=([^/]+)/", 1).alias("symbol"))
    return (files.filter(F.col("symbol") == symbol) if symbol else files).orderBy("path")


def storage_files(spark: SparkSession, path: str) -> DataFrame:
    """symbol, day, bytes of the log's files, from their names and sizes alone."""
    day = F.to_date(F.regexp_extract("path", r"event_date=([0-9-]+)", 1))
    return list_files(spark, path).select("symbol", day.alias("day"), F.col("length").alias("bytes"))


def size_text(bytes_: Column, unit: str) -> Column:
    """Bytes as MB or GB with two decimals."""
    return F.format_string("%.2f", bytes_ / (1024 ** {"MB": 2, "GB": 3}[unit]))


def storage_by_symbol(files: DataFrame) -> DataFrame:
    """(symbol, day, bytes) -> per symbol: bytes, files, first and last day, distinct days, MB as text."""
    out = files.groupBy("symbol").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.countDistinct("day").alias("distinct_days"))
    return out.withColumn("size_mb", size_text(F.col("bytes"), "MB"))


def storage_total(by_symbol: DataFrame) -> DataFrame:
    """Totals; ``days_of_data_ref`` counts distinct end dates of all symbols."""
    ends = F.collect_set(F.col("first_day")), F.collect_set(F.col("last_day"))
    return by_symbol.agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.size(F.array_union(*ends)).cast("long").alias("days_of_data_ref")).withColumn("size_gb", size_text(F.col("bytes"), "GB"))
