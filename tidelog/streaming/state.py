"""Stateful processors: what a stream remembers of each key, in a RocksDB state store."""

from __future__ import annotations

import contextlib
import pickle
import tempfile
import time
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ordering import CLOCK_BACK, NOTHING, SEQUENCE_BACK, starts_of, walk

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB, which state with timers needs, in three partitions a core at most.

    Every partition of a state has a store to load and to commit in each micro-batch, and a Python worker, however few its rows.
    """
    most = max(32, 3 * spark.sparkContext.defaultParallelism)
    before = {k: spark.conf.get(k, None) for k in (_PROVIDER, _PARTITIONS)}
    spark.conf.set(_PROVIDER, _ROCKSDB)
    spark.conf.set(_PARTITIONS, str(min(most, int(spark.conf.get(_PARTITIONS)))))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Groups that the files of an order check are dealt to: a call of the processor has the rows of many small files.
PARTS = 512
#: Rows of a group that a task holds as a frame; the others wait in a temporary file while the facts of all are sorted.
HELD = 100_000


class OrderCheck(StatefulProcessor):
    """Sets ``error`` on rows that the order check of their file refuses; a value state holds the last accepted events of a group of files.

    Rows that have an error already take no part. A file's rows of one micro-batch are put in
    their order of arrival first, behind the file's last accepted event. Only what the check
    looks at is held for that, and sorted for all files of a group at once.
    """

    def __init__(self, columns: list[str], facts: pa.Schema, keep_ms: int | None = None) -> None:
        self.columns, self.facts, self.keep_ms = columns, facts, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "files binary")

    def _seeds(self, now: int) -> pa.Table:
        if not self.last.exists():
            return pa.schema([*self.facts, ("at", pa.int64())]).empty_table()
        held = pa.ipc.open_stream(self.last.get()[0]).read_all()
        return held if self.keep_ms is None else held.filter(pc.greater_equal(held.column("at"), now - self.keep_ms))

    def _refused(self, good: pa.Table) -> np.ndarray:
        """Which of the rows are refused (1 by their clock, 2 by their sequence); the state goes on."""
        now = int(time.time() * 1000)
        seeds = self._seeds(now)
        every = pa.concat_tables([seeds, good.append_column("at", pa.repeat(pa.scalar(now, pa.int64()), len(good)))])
        every = every.append_column("_new", pa.array(np.arange(len(every)) >= len(seeds)))
        arrival = [c for c in self.facts.names if c.startswith("check_arrival")]
        order = pc.sort_indices(every, sort_keys=[(c, "ascending") for c in ("check_file", "_new", *arrival)]).to_numpy()
        rows = pa.table({"check_file": every["check_file"], "ts_monotonic_ns": every["check_clock"], "source": every["check_source"], "seq": every["check_seq"]}).take(order).combine_chunks().to_batches()[0]
        found = walk(rows, ["check_file"], None, NOTHING)[0]
        fine = np.flatnonzero(found == 0)
        codes = np.cumsum(starts_of(rows, ["check_file"], None))[fine]
        last = order[fine[np.append(codes[1:] != codes[:-1], True)]]
        sink = pa.BufferOutputStream()
        kept = every.drop_columns(["_new"]).take(np.sort(last)).combine_chunks()
        with pa.ipc.new_stream(sink, kept.schema) as out:
            out.write_table(kept)
        self.last.update((sink.getvalue().to_pybytes(),))
        back = np.zeros(len(every), dtype=np.int8)
        back[order] = found
        return back[len(seeds) :]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frames, facts, good, n = [], [], [], 0
        with tempfile.TemporaryFile() as more:
            for frame in rows:
                good.append(frame.error.isnull().to_numpy())
                facts.append(pa.Table.from_pandas(frame.loc[good[-1], self.facts.names], self.facts, preserve_index=False))
                n += len(frame)
                if n <= HELD:
                    frames.append(frame[self.columns])
                else:
                    pickle.dump(frame[self.columns], more, protocol=5)
            checked = pa.concat_tables(facts)
            refused = self._refused(checked) if len(checked) else np.zeros(0, dtype=np.int8)
            names, at = np.array([None, CLOCK_BACK, SEQUENCE_BACK], dtype=object), 0
            more.seek(0)
            for k, some in enumerate(good):
                frame = frames[k] if k < len(frames) else pickle.load(more)
                error = frame.error.to_numpy(dtype=object, copy=True)
                error[some] = names[refused[at : at + some.sum()]]
                at += some.sum()
                yield frame.assign(error=error)

    def close(self) -> None:
        pass


def _safe(schema: T.StructType) -> list[str]:
    """Whole-number columns that may be null: pandas would turn them into doubles, which don't hold nanoseconds."""
    return [f.name for f in schema if f.nullable and isinstance(f.dataType, T.IntegralType)]


def check_order(stream: DataFrame, file: list[str], arrival: list[str], keep_ms: int | None = None) -> DataFrame:
    """``stream`` (with ``error``) after the order check of its files, whose state outlives micro-batches and restarts.

    With ``keep_ms`` a file's state goes that long after its last event; without, it stays.
    """
    packed = _safe(stream.schema)
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit((1 << 63) - 1)) if isinstance(stream.schema[c].dataType, T.IntegralType) else F.col(c)
    # names that begin with an underscore get lost on the way to a frame
    facts = {"check_file": F.to_json(F.struct(*file), {"ignoreNullFields": "false"}), "check_clock": whole("ts_monotonic_ns"), "check_seq": whole("seq"), "check_source": F.col("source"), **{f"check_arrival{k}": whole(c) for k, c in enumerate(arrival)}}
    rows = stream.withColumns({**facts, "check_part": F.pmod(F.xxhash64(*file), F.lit(PARTS))})
    rows = rows.withColumns({c: F.col(c).cast("string") for c in packed}) if packed else rows
    shape = T.StructType([rows.schema[c] for c in stream.columns])
    held = pa.schema([(c, to_arrow_type(rows.schema[c].dataType)) for c in facts])
    out = rows.groupBy("check_part").transformWithStateInPandas(OrderCheck(stream.columns, held, keep_ms), shape, "append", "none")
    return out.withColumns({c: F.col(c).cast(stream.schema[c].dataType) for c in packed}) if packed else out


class Numbering(StatefulProcessor):
    """Numbers a key's rows from 1 by ``arrival``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values("arrival", kind="stable")
        last = self.last.get()[0] if self.last.exists() else 0
        self.last.update((last + len(frame),))
        yield frame.assign(seq=range(last + 1, last + len(frame) + 1))

    def close(self) -> None:
        pass


class Silence(StatefulProcessor):
    """A row when a key has had no event for ``hold_ms``, and one when it is heard of again.

    The latest event time is the state, and a timer behind it notices the silence: once the
    watermark passes it the alert is there, with no further event of that key. An event from
    before the latest one doesn't count; an alert that is on stays on until an event ends it.
    """

    def __init__(self, hold_ms: int) -> None:
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "at long, silent boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at, silent = self.state.get() if self.state.exists() else (None, False)
        times = np.sort(np.concatenate([f.at_ms.to_numpy() for f in rows]))
        out = []
        for t in times[times > at].tolist() if at is not None else times.tolist():
            if at is not None and t - at > self.hold_ms and not silent:  # silence that lies within one micro-batch
                out.append((at, at + self.hold_ms, True))
                silent = True
            if silent:
                out.append((at, t, False))
                silent = False
            at = t
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at + self.hold_ms)
        self.state.update((at, silent))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at, silent = self.state.get()
        due = at + self.hold_ms <= expiredTimerInfo.getExpiryTimeInMs()
        if due and not silent:
            self.state.update((at, True))
        yield self._rows(key, [(at, at + self.hold_ms, True)] if due and not silent else [])

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(key: Any, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["last_ms", "at_ms", "silent"])
        frame.insert(0, "key", [key[0]] * len(frame))
        return frame.astype({"key": object, "last_ms": "int64", "at_ms": "int64", "silent": "bool"})


def silences(stream: DataFrame, key: str, at: str, hold: int, late: str = "0 seconds") -> DataFrame:
    """key, last, at, silent: when a key fell silent for over ``hold`` seconds of event time, and when it was heard of again.

    A silence is noticed when the watermark passes it: the latest event time of any key less
    ``late``. One row a silence begins (silent) and one it ends. Events that come later than
    the watermark are left out.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(at).alias("_at"), F.unix_millis(at).alias("at_ms")).withWatermark("_at", late)
    out = rows.groupBy("key").transformWithStateInPandas(Silence(hold * 1000), "key string, last_ms long, at_ms long, silent boolean", "append", "eventtime")
    return out.select(F.col("key").alias(key), F.timestamp_millis("last_ms").alias("last"), F.timestamp_millis("at_ms").alias("at"), "silent")
