"""Metrics of running streams: what they observe about each micro-batch becomes labelled samples."""

from __future__ import annotations

import datetime as dt
import threading
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

#: Name of the observation that ``counted`` makes.
INGEST = "ingest"
SAMPLES = "name string, labels map<string,string>, at long, value double"
#: Counters of the samples, by what is observed.
COUNTERS = {"received": "events_received_total", "written": "events_written_total", "invalid": "validation_errors_total"}
LAST = "last_event_seconds"


def counted(events: DataFrame) -> DataFrame:
    """``events`` (with ``error``) that count themselves as they pass: received, written, invalid and the last event time; no further pass over the data."""
    good = F.col("error").isNull()
    return events.observe(INGEST, F.count(F.lit(1)).alias("received"), F.count_if(good).alias("written"), F.count_if(~good).alias("invalid"), F.max(F.when(good, F.col("ts_event_ns"))).alias("last_ns"))


class IngestListener(StreamingQueryListener):
    """Adds up what streams observe, and keeps the newest ``most`` samples of each metric by query.

    Counters go on over micro-batches of a run; they begin at 0 with a restart, as the rates expect.
    """

    def __init__(self, most: int = 10_000) -> None:
        self.rows: deque[tuple] = deque(maxlen=most)
        self.totals: dict[tuple[str, str], float] = {}
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def _end(self, run: str) -> threading.Event:
        with self.lock:
            return self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        found = p.observedMetrics.get(INGEST)
        if found is None:
            return
        query, labels = p.name or str(p.id), {"query": p.name or str(p.id)}
        at = int(dt.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).timestamp())
        with self.lock:
            for kind, name in COUNTERS.items():
                key = (query, name)
                self.totals[key] = self.totals.get(key, 0.0) + float(found[kind] or 0)
                self.rows.append((name, labels, at, self.totals[key]))
            if found["last_ns"] is not None:
                key = (query, LAST)
                self.totals[key] = max(self.totals.get(key, 0.0), found["last_ns"] / 1e9)
                self.rows.append((LAST, labels, at, self.totals[key]))

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self._end(str(event.runId)).set()

    def wait(self, run: str, seconds: float = 30.0) -> bool:
        """Until all of a run's progress has been heard of."""
        return self._end(run).wait(seconds)

    def samples(self, spark: SparkSession) -> DataFrame:
        """The samples so far, as ``Monitor`` takes them."""
        with self.lock:
            return spark.createDataFrame(list(self.rows), SAMPLES)
