"""Structured Streaming queries, run over all available input and returned as tables."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import service
from ..operators import metrics, validate
from ..sources import eventlog
from ..streaming import ingest, observe
from . import query
from . import views as V


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A glob, as a streaming source takes a folder or a pattern, but no single file.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


@query(f"WITH {V.EVENTS} SELECT symbol, event_id + 1 AS seq, round(value, 6) AS price, k AS size FROM ev WHERE kind = 2 AND value > 0 AND k > 0")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks through the gate, as validated trades."""
    s = _stream(spark, sf_dir).filter("event_type = 'purchase'")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    ticks = s.select(ns.alias("ts_event_ns"), (ns + 1000).alias("ts_receive_ns"), (ns + 500).alias("ts_monotonic_ns"), F.lit("").alias("venue"), F.concat(F.lit("U"), "user_id").alias("symbol"), F.lit("stream").alias("source"), (F.col("event_id") + 1).alias("seq"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("size"), (F.col("value") * 0.99).alias("bid"), (F.col("value") * 1.01).alias("ask"))
    trades = ingest.ticks_to_trades(ticks).filter(validate.event_error().isNull())
    return ingest.run_available(trades.select("symbol", "seq", F.round("price", 6).alias("price"), "size")).drop("batch")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by type; updates of windows still open are merged by taking the last."""
    s = _stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    out = ingest.run_available(ingest.window_counts(s, "at", ["event_type"], "1 hour"), "update")
    return out.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max_by("n", "batch").alias("n"))


@query("""WITH h AS (SELECT event_id, unnest(range(0, 4)) AS k, ts, event_type FROM events) SELECT date_trunc('hour', ts) - to_minutes(CAST(15 * k AS INTEGER)) + to_minutes(CAST(15 * (minute(ts) // 15) AS INTEGER)) AS start, event_type, count(*) AS n FROM h GROUP BY 1, 2""")
def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over hours that start every quarter of an hour."""
    s = _stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    out = ingest.run_available(ingest.window_counts(s, "at", ["event_type"], "1 hour", "15 minutes"), "update")
    return out.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max_by("n", "batch").alias("n"))


@query(f"""WITH RECURSIVE {V.EVENTS}, v AS (SELECT symbol, seq, ts_event_ns AS m, row_number() OVER (PARTITION BY symbol ORDER BY (seq * 37) % 101, seq) AS i FROM ev),
f AS (SELECT symbol, i, seq, true AS accepted, m AS last_m, seq AS last_s FROM v WHERE i = 1
  UNION ALL SELECT v.symbol, v.i, v.seq, v.m >= f.last_m AND v.seq > f.last_s, CASE WHEN v.m >= f.last_m AND v.seq > f.last_s THEN v.m ELSE f.last_m END,
    CASE WHEN v.m >= f.last_m AND v.seq > f.last_s THEN v.seq ELSE f.last_s END FROM f JOIN v ON v.symbol = f.symbol AND v.i = f.i + 1)
SELECT symbol, seq, accepted FROM f""")
def stream_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-symbol order check with state: late events are marked, and don't advance the state."""
    s = _stream(spark, sf_dir)
    seq = F.col("event_id") + 1
    rows = s.select(F.concat(F.lit("U"), "user_id").alias("symbol"), seq.alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_monotonic_ns"), ((seq * 37) % 101 * 1_000_000_000 + seq).alias("arrival"))
    return ingest.run_available(ingest.order_check(rows)).drop("batch")


@query(f"WITH {V.EVENTS} SELECT symbol, event_id AS arrival, CAST(row_number() OVER (PARTITION BY symbol ORDER BY event_id) AS BIGINT) AS seq FROM ev")
def stream_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's events numbered with state."""
    rows = _stream(spark, sf_dir).select(F.concat(F.lit("U"), "user_id").alias("symbol"), F.col("event_id").alias("arrival"))
    return ingest.run_available(ingest.sequence_numbers(rows)).drop("batch")


def _replayed(spark: SparkSession, rows: DataFrame, part: Column, parts: int) -> DataFrame:
    """``rows`` as a stream of one input file a micro-batch, in the order of ``part`` (0 to parts - 1)."""
    path = ingest.shared_path(spark, "stream-in")
    numbered = rows.withColumn("_part", part)
    for k in range(parts):
        numbered.filter(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(f"""WITH RECURSIVE {V.EVENTS}, v AS (SELECT symbol, CAST(ts AS DATE) AS d, seq, ts_monotonic_ns AS m, value, k, kind, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY (seq * 37) % 101, seq) AS i FROM ev WHERE {V.OK} = 1),
f AS (SELECT symbol, d, i, seq, value, k, kind, CAST(NULL AS VARCHAR) AS error, m AS last_m, seq AS last_s FROM v WHERE i = 1
  UNION ALL SELECT v.symbol, v.d, v.i, v.seq, v.value, v.k, v.kind, CASE WHEN v.m < f.last_m THEN 'monotonic clock went back' WHEN v.seq <= f.last_s THEN 'sequence didn''t grow' END, CASE WHEN v.m >= f.last_m AND v.seq > f.last_s THEN v.m ELSE f.last_m END,
    CASE WHEN v.m >= f.last_m AND v.seq > f.last_s THEN v.seq ELSE f.last_s END FROM f JOIN v ON v.symbol = f.symbol AND v.d = f.d AND v.i = f.i + 1)
SELECT symbol, seq, CAST(CASE WHEN kind <> 5 THEN value END AS DOUBLE) AS price, CASE WHEN kind <> 5 THEN k END AS size, CASE WHEN error IS NULL THEN 'live' END AS feed_mode, error FROM f
UNION ALL SELECT symbol, seq, value, k, NULL, CASE WHEN kind = 3 THEN 'bad size' WHEN value <= 0 THEN 'bad price' ELSE 'bad size' END FROM ev WHERE {V.OK} = 0""")
def stream_to_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, out of order, streamed into the log over five micro-batches: what is read back from it, and what was refused.

    The order check of a symbol's day goes on from batch to batch.
    """
    arrival = (F.col("seq") * 37) % 101
    rows = V.events(spark, sf_dir).withColumn("ts_receive_ns", F.lit(1_735_689_600 * 1_000_000_000) + arrival)  # received in this order, after all have happened
    stream = _replayed(spark, rows, F.floor(arrival / 21), 5)
    path, checkpoint = ingest.shared_path(spark, "stream-log"), ingest.shared_path(spark, "stream-log-checkpoint")
    eventlog.append_stream(stream, path, checkpoint, "session", "live", every=None, layout=("event_date",)).awaitTermination()
    log = eventlog.read_log(spark, path).select("symbol", "seq", "price", "size", "feed_mode", F.lit(None).cast("string").alias("error"))
    refused = spark.read.parquet(f"{path}/refused").select("symbol", "seq", "price", "size", F.lit(None).cast("string").alias("feed_mode"), "error")
    return log.unionByName(refused)


@query("""WITH e AS (SELECT event_type AS kind, epoch_us(ts) // 1000000 AS t, max(epoch_us(ts)) OVER () // 1000000 AS ending FROM events),
g AS (SELECT DISTINCT kind, t, ending FROM e), n AS (SELECT *, lag(t) OVER (PARTITION BY kind ORDER BY t) AS last, lead(t) OVER (PARTITION BY kind ORDER BY t) AS nxt FROM g),
x AS (SELECT kind, t AS last, t + 600 AS "at", true AS silent FROM n WHERE nxt - t > 600 OR (nxt IS NULL AND t + 600 <= ending)
  UNION ALL SELECT kind, last, t, false FROM n WHERE t - last > 600)
SELECT kind, make_timestamp(last * 1000000) AS last, make_timestamp("at" * 1000000) AS "at", silent FROM x""")
def stream_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When an event type had no event for over ten minutes, as timers behind a watermark notice it, and when the next one came."""
    rows = V.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.date_trunc("second", F.col("ts")).cast("timestamp").alias("at"))
    stream = _replayed(spark, rows, F.floor(F.dayofmonth("at") / 8), 4)
    out = ingest.run_available(ingest.silences(stream, "kind", "at", 600))
    return out.select("kind", F.col("last").cast("timestamp_ntz").alias("last"), F.col("at").cast("timestamp_ntz").alias("at"), "silent")


@query(f"WITH {V.EVENTS} SELECT count(*) AS received, CAST(sum({V.OK}) AS BIGINT) AS written, CAST(sum(1 - {V.OK}) AS BIGINT) AS invalid, CAST(floor(max(CASE WHEN {V.OK} = 1 THEN ts_event_ns END) / 1e9) AS BIGINT) AS last_event FROM ev")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream into the log has received, written and refused, as its listener heard it over three micro-batches."""
    rows = V.events(spark, sf_dir)
    heard = observe.IngestListener()
    spark.streams.addListener(heard)
    try:
        path, checkpoint = ingest.shared_path(spark, "counted-log"), ingest.shared_path(spark, "counted-log-checkpoint")
        stream = _replayed(spark, rows, F.floor(F.col("seq") * 3 / (V.table(spark, sf_dir, "events").count() + 1)), 3)
        query = eventlog.append_stream(stream, path, checkpoint, "session", "live", every=None, layout=("event_date",), file=("event_date",), name=f"counted-{heard.__hash__()}")
        query.awaitTermination()
        heard.wait(str(query.runId))
    finally:
        spark.streams.removeListener(heard)
    monitor = service.Monitor(heard.samples(spark))
    at = int(time.time()) + 1
    values = [monitor.instant(metrics.Expr("sum", name), at).select(F.floor("value").alias(kind)) for kind, name in (*observe.COUNTERS.items(), ("last_event", observe.LAST))]
    out = values[0]
    for v in values[1:]:  # one row each
        out = out.join(v)
    return out
