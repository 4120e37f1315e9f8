"""Streaming ingestion: tick gate, windows, and order checks with state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validate import positive
from ..sources.eventlog import as_events, newest
from .state import Numbering, check_order, rocksdb, silences  # noqa: F401


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local session may use a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidelog-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tick_gate(price: Column, size: Column) -> Column:
    return F.coalesce(positive(price) & positive(size), F.lit(False))


def infer_aggressor(price: Column, bid: Column, ask: Column) -> Column:
    """0 buy, 1 sell, 2 unknown, from the trade's place between the quotes."""
    usable = F.coalesce(positive(F.abs(bid)) & positive(F.abs(ask)) & (bid < ask), F.lit(False))
    middle, slack = (bid + ask) / 2, F.greatest((ask - bid) * 0.1, price * 0.0001)
    return F.when(~usable, 2).when(price >= ask, 0).when(price <= bid, 1).when(price > middle + slack, 0).when(price < middle - slack, 1).otherwise(2)


def latency_seconds(receive_ns: Column, event_ns: Column) -> Column:
    """Receive minus event time; null unless positive and below a minute."""
    s = (receive_ns - event_ns) / 1e9
    return F.when((s > 0) & (s < 60), s)


def ticks_to_trades(ticks: DataFrame) -> DataFrame:
    """Gated ticks as trade events; an empty venue is SMART."""
    rows = ticks.filter(tick_gate(F.col("price"), F.col("size")))
    return as_events(rows.withColumns({"event_type": F.lit(2), "venue": F.coalesce(F.when(F.col("venue") == "", None).otherwise(F.col("venue")), F.lit("SMART")), "aggressor": infer_aggressor(F.col("price"), F.col("bid"), F.col("ask"))}))


def run_available(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run a streaming DataFrame over all available input; its result as a table with the batch's number.

    With a ``checkpoint`` and ``out`` that are kept, the next run takes only what is new and
    the table has the results of all runs; a batch that is run again replaces itself.
    """
    spark = stream.sparkSession
    out, checkpoint = out or shared_path(spark, "stream-out"), checkpoint or shared_path(spark, "stream-checkpoint")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with rocksdb(spark):
        query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.IntegerType())])).parquet(out)


def window_counts(stream: DataFrame, at: str, keys: list[str], size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts per key and tumbling or sliding window.

    With ``late``, a window's state goes once the watermark (the latest time seen by the
    batches before, less ``late``) has passed its end, and rows that come later are dropped.
    Without, no row is ever dropped and the state of all windows stays: for bounded input, or
    few windows.
    """
    w = F.window(at, size, slide) if slide else F.window(at, size)
    rows = stream.withWatermark(at, late) if late else stream
    return rows.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def order_check(stream: DataFrame) -> DataFrame:
    """symbol, seq, accepted: late rows against the last accepted event of their symbol, with state across batches (symbol, seq, ts_monotonic_ns, arrival, and source if there is one)."""
    source = F.col("source") if "source" in stream.columns else F.lit("")
    rows = stream.select("symbol", "seq", "ts_monotonic_ns", "arrival", source.alias("source"), F.lit(None).cast("string").alias("error"))
    return check_order(rows, ["symbol"], ["arrival"]).select("symbol", "seq", F.col("error").isNull().alias("accepted"))


def sequence_numbers(stream: DataFrame) -> DataFrame:
    """symbol, arrival, seq: each symbol's rows numbered from 1 by arrival, with state across batches."""
    return stream.select("symbol", "arrival").groupBy("symbol").transformWithStateInPandas(Numbering(), "symbol string, arrival long, seq long", "append", "none")


def mock_ticks(spark: SparkSession, n: int, symbols: list[str], seed: int = 0, start_ns: int = 1_704_844_800_000_000_000, step_ns: int = 1_000_000) -> DataFrame:
    """``n`` random ticks: price from 100 to 200, size from 1 to 1000, any of the symbols; the same for a seed."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 53)) / float(1 << 53)  # noqa: E731  doesn't depend on partitions
    names = F.array(*[F.lit(s) for s in symbols])
    ns = F.lit(start_ns) + F.col("id") * step_ns
    return spark.range(n).select(
        F.get(names, F.floor(u(1) * len(symbols)).cast("int")).alias("symbol"), (100 + 100 * u(2)).alias("price"), (1 + 999 * u(3)).alias("size"), ns.alias("ts_event_ns"),
        (ns + 1000).alias("ts_receive_ns"), (ns + 500).alias("ts_monotonic_ns"), F.lit("").alias("venue"), F.lit("mock").alias("source"), (F.col("id") + 1).alias("seq"),
        F.lit(None).cast("double").alias("bid"), F.lit(None).cast("double").alias("ask"),
    )


def heartbeats(stream: DataFrame, at: str, every: str = "30 seconds") -> DataFrame:
    """One heartbeat for each symbol and interval in which it has events (symbol and the time column ``at``)."""
    return stream.groupBy(F.window(at, every).alias("w"), "symbol").agg(F.count(F.lit(1)).alias("events")).select("symbol", F.col("w.start").alias("at"), "events")


def keep_newest(spark: SparkSession, batch: DataFrame, kept: DataFrame | None, most: int = 100) -> DataFrame:
    """The bounded buffer behind a live view: the newest ``most`` events of what was kept and a new batch, newest first."""
    rows = batch if kept is None else kept.unionByName(batch)
    return newest(rows, most)


def backoff_seconds(attempt: Column) -> Column:
    """Wait before the next try to connect: 5 seconds, doubled each time, a minute at most."""
    return F.least(F.pow(F.lit(2), attempt) * 5, F.lit(60.0))


def feed_counters(ticks: DataFrame) -> DataFrame:
    """Received, written and invalid ticks of a feed, and the last event time."""
    good = tick_gate(F.col("price"), F.col("size"))
    return ticks.agg(F.count(F.lit(1)).alias("received"), F.count_if(good).alias("written"), F.count_if(~good).alias("invalid"), F.max("ts_event_ns").alias("last_ts_ns"))
