"""Order-dependent rules of the event log."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Monotonic clock, source and sequence of the last accepted event; before the first one.
Last = tuple[int, str | None, int]
NOTHING: Last = (-(1 << 63), None, 0)
CLOCK_BACK, SEQUENCE_BACK = "monotonic clock went back", "sequence didn't grow"


def fold(clock: np.ndarray, source: np.ndarray, seq: np.ndarray, last: Last) -> tuple[np.ndarray, Last]:
    """Which events of one file are accepted (0), or refused by their clock (1) or sequence (2), and the state behind them.

    An event is compared with the last accepted one. Where each event is in order with the
    one before, all are accepted, so only stretches with a fault are gone through one by one.
    """
    n = len(clock)
    out = np.zeros(n, dtype=np.int8)
    if not n:
        return out, last
    with_last = lambda x, v: np.concatenate([np.array([v], dtype=x.dtype), x[:-1]])
    same = source == with_last(source, last[1])
    fine = (clock >= with_last(clock, last[0])) & (~same | (seq > with_last(seq, last[2])))
    if last == NOTHING:
        fine[0] = True
    at = 0
    while at < n:
        bad = np.flatnonzero(~fine[at:])
        stop = at + int(bad[0]) if len(bad) else n
        if stop > at:
            last = (int(clock[stop - 1]), source[stop - 1], int(seq[stop - 1]))
        at = stop
        while at < n:  # until an event is accepted that the one behind it can be compared with
            if clock[at] < last[0]:
                out[at] = 1
            elif source[at] == last[1] and seq[at] <= last[2]:
                out[at] = 2
            else:
                last = (int(clock[at]), source[at], int(seq[at]))
                at += 1
                break
            at += 1
    return out, last


def starts_of(batch: pa.RecordBatch, keys: list[str], before: tuple | None) -> np.ndarray:
    """Whether a row's keys differ from those of the row before; ``before`` are the keys of the last row of the batch before."""
    new = np.zeros(batch.num_rows, dtype=bool)
    for k in keys:
        x = batch.column(k)
        a, b = x.slice(1), x.slice(0, len(x) - 1)
        differ = pc.or_kleene(pc.xor(pc.is_null(a), pc.is_null(b)), pc.fill_null(pc.not_equal(a, b), False))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    new[0] = before is None or before != tuple(batch.column(k)[0].as_py() for k in keys)
    return new


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def walk(rows: pa.RecordBatch, file: list[str], before: tuple | None, last: Last) -> tuple[np.ndarray, tuple, Last]:
    """Which rows of a sorted batch are refused (1 or 2), its last row's file and the state behind it.

    "In order with the row before" is found for the whole batch at once; where it holds for all
    of a file's rows they are accepted, and only the other files are folded.
    """
    n = rows.num_rows
    new = starts_of(rows, file, before)
    clock, seq = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("ts_monotonic_ns", "seq"))
    kinds = rows.column("source").dictionary_encode()
    code = pc.fill_null(kinds.indices, -1).to_numpy(zero_copy_only=False)
    source = np.array([*kinds.dictionary.to_pylist(), None], dtype=object)
    faulty = ~new
    faulty[1:] &= (clock[1:] < clock[:-1]) | ((code[1:] == code[:-1]) & (seq[1:] <= seq[:-1]))
    faulty[0] = not new[0]  # a file that goes on from the batch before is compared with its state
    starts = np.flatnonzero(new)
    starts = starts if new[0] else np.concatenate([[0], starts])
    ends, out, held = np.append(starts[1:], n), np.zeros(n, dtype=np.int8), last
    folded = np.flatnonzero(np.add.reduceat(faulty, starts))
    for a, b in zip(starts[folded].tolist(), ends[folded].tolist()):
        out[a:b], held = fold(clock[a:b], source[code[a:b]], seq[a:b], NOTHING if new[a] else last)
    if not len(folded) or folded[-1] != len(starts) - 1:
        held = (int(clock[-1]), source[code[-1]], int(seq[-1]))
    return out, tuple(rows.column(k)[n - 1].as_py() for k in file), held


def _order_errors(file: list[str], error: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = None, NOTHING
        names = pa.array([None, CLOCK_BACK, SEQUENCE_BACK], pa.string())
        for batch in batches:
            found = batch.column(error) if error else pa.nulls(batch.num_rows, pa.string())
            good = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
            if len(good):
                rows = batch.select([*file, "ts_monotonic_ns", "source", "seq"])
                refused, before, last = walk(rows if len(good) == len(found) else rows.take(pa.array(good)), file, before, last)
                every = np.zeros(len(found), dtype=np.int8)
                every[good] = refused
                found = pc.coalesce(found, names.take(pa.array(every)))
            if error:
                yield batch.set_column(batch.schema.get_field_index(error), error, found)
            else:
                yield with_column(batch, "order_error", found)

    return run


def order_errors(events: DataFrame, arrival: list[str], file: list[str], error: str | None = None) -> DataFrame:
    """``events`` with ``order_error``: null if accepted by the order check of its file.

    The monotonic clock must not go back and the sequence must grow for one source, both
    against the last *accepted* event of the file; a refused one doesn't advance the state.
    So this is a fold over each file's events in arrival order and not a comparison with the
    row before. A file (a symbol's day) is read as a sorted stream in which the fold keeps
    three values; no list of its events is ever built. With ``error``, a column that has
    errors already, those rows take no part and the others' errors are put there.
    """
    schema = events.schema if error else T.StructType([*events.schema, T.StructField("order_error", T.StringType())])
    sorted_rows = events.repartition(*file).sortWithinPartitions(*file, *arrival)
    return sorted_rows.mapInArrow(_order_errors(file, error), schema)


def accept_in_order(events: DataFrame, arrival: list[str], file: list[str] | str = "symbol") -> DataFrame:
    """``events`` with ``accepted``: the verdict of ``order_errors``."""
    file = [file] if isinstance(file, str) else file
    return order_errors(events, arrival, file).withColumn("accepted", F.col("order_error").isNull()).drop("order_error")


def assign_sequence(ticks: DataFrame, key: str, arrival: list[str]) -> DataFrame:
    """Per-key sequence from 1 in arrival order."""
    return ticks.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*arrival)).cast("long"))


def replay_violations(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows whose sequence or event time goes back against the row before."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = events.withColumns({"last_seq": F.lag("seq").over(w), "last_ts": F.lag("ts_event_ns").over(w)})
    return rows.filter((F.col("seq") < F.col("last_seq")) | (F.col("ts_event_ns") < F.col("last_ts"))).drop("last_seq", "last_ts")


def flush_batches(events: DataFrame, key: str, order: list[str], size: int = 2000) -> DataFrame:
    """Number of the flush that writes a row, if a file is flushed every ``size`` rows."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("flush", F.floor((n - 1) / size).cast("long"))


def _timed(key: str, at: str, size: int, wait: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, flush, count, since = None, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for new, t in zip(starts_of(batch, [key], before).tolist(), batch.column(at).to_pylist()):
                if new:
                    flush, count, since = 0, 0, t
                elif count >= size or t - since >= wait:
                    flush, count, since = flush + 1, 0, t
                count += 1
                out.append(flush)
            before = (batch.column(key)[batch.num_rows - 1].as_py(),)
            yield with_column(batch, "flush", pa.array(out, pa.int64()))

    return run


def timed_flushes(events: DataFrame, key: str, at: str, order: list[str], size: int = 2000, wait: int = 2_000_000_000) -> DataFrame:
    """``events`` with ``flush``: a key's buffer is written once it holds ``size`` rows, or ``wait`` of ``at`` after its first row.

    A fold over each key's sorted stream, as the next buffer's time counts from its own first row.
    """
    schema = T.StructType([*events.schema, T.StructField("flush", T.LongType())])
    rows = events.repartition(key).sortWithinPartitions(key, at, *order)
    return rows.mapInArrow(_timed(key, at, size, wait), schema)


def monotonic_valid(ns: Column, now_ns: Column) -> Column:
    """A monotonic clock above 0 and not over a second ahead of now."""
    return (ns > 0) & (ns <= now_ns + 1_000_000_000)
