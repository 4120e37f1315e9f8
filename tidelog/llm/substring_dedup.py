"""Substring deduplication (operator 3): repeated fixed-length word windows.

Every window of ``width`` consecutive words gets a Rabin-Karp hash. Two equal windows also
share the smallest hash of their shorter sub-windows (a minimizer, as in winnowing), and a
text has many times fewer minimizers than windows. So minimizers are counted first, and
only windows whose minimizer occurs in two documents are counted by their own hash: no
repeated window can be missed, and no unique one is shuffled. Repeated windows merge into
maximal removal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import beside_least, forget_shuffles, marked, maybe_in, release, row_mark, sliced, small_batches, stored

#: Rows of one Arrow batch that a kernel returns at most.
OUT_ROWS = 200_000


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every window, the smallest hash of its sub-windows of just over half the width."""
    part = width // 2 + 1
    return K.sliding_min(K.window_hashes(hashes, part), width - part + 1)


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def _emit(schema: pa.Schema, parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    count = 0
    for part in parts:
        held.append(part)
        count += len(part[0])
        if count >= OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, count = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _minimizer_rows(width: int):
    schema = pa.schema([("m", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in sliced(batches, "text"):
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts(batch, "text")):
                    m = np.unique(minimizers(K.word_hashes(text.split()), width))
                    if len(m):
                        yield m.view(np.int64), np.full(len(m), doc_id)

        return _emit(schema, parts())

    return run


def _window_rows(width: int):
    """Two hashes, 64 and 32 bits, of every window whose minimizer is shared."""
    schema = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in sliced(batches, "text"):
                shared = batch.column("shared")
                for k, (doc_id, mark, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), _texts(batch, "text"))):
                    hashes = K.word_hashes(text.split())
                    own = np.asarray(shared[k].values).view(np.uint64)
                    pos = np.flatnonzero(np.isin(minimizers(hashes, width), own))
                    if len(pos):
                        h = K.window_hashes(hashes, width)[pos].view(np.int64)
                        g = (K.window_hashes(hashes, width, K.BASE_B)[pos] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                        yield h, g, np.full(len(pos), doc_id), pos + (mark << 32)

        return _emit(schema, parts())

    return run


def shared_windows(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, at: windows (mark and first word's position) that a smaller doc_id also has."""
    spark = docs.sparkSession
    docs = docs.filter("doc_id is not null")
    marks = stored(docs.select("doc_id", "text").mapInArrow(_minimizer_rows(width), "m long, doc_id long"), "sub-minimizers")
    shared = beside_least(marks, ["m"], "doc_id").filter("low < high")
    own = stored(shared.groupBy("doc_id").agg(F.collect_set("m").alias("shared")), "sub-own")
    release(marks)
    forget_shuffles(spark)
    # Only texts that may have a shared minimizer are shuffled, and at any size.
    some = maybe_in(docs, "doc_id", own.select(F.col("doc_id").alias("id")))
    windows = some.join(own.hint("merge"), "doc_id").select("doc_id", "mark", "text", "shared")
    windows = stored(windows.mapInArrow(_window_rows(width), "h long, g int, doc_id long, at long"), "sub-windows")
    release(own)
    forget_shuffles(spark)
    later = beside_least(windows, ["h", "g"], "doc_id").filter("doc_id > low")
    out = stored(later.groupBy("doc_id").agg(F.collect_list("at").alias("at")), "sub-later")
    release(windows)
    forget_shuffles(spark)
    return out


def spans_of(at: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal intervals [start, end) of words that windows starting at ``at`` cover."""
    out: list[tuple[int, int]] = []
    for p in np.unique(at).tolist():
        if out and p <= out[-1][1]:
            out[-1] = (out[-1][0], p + width)
        else:
            out.append((p, p + width))
    return out


def _cut(width: int):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            rows = []
            found = batch.column("at")
            for k, (doc_id, mark, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), _texts(batch, "text"))):
                words, spans = text.split(), []
                if found[k].is_valid:
                    at = np.asarray(found[k].values)
                    spans = spans_of(at[at >> 32 == mark] & 0xFFFFFFFF, width)
                kept, last = [], 0
                for a, b in spans:
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                rows.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode(), [{"start": a, "end": b} for a, b in spans]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words joined by one space), spans (removed words).

    Words are runs without ASCII white space. A word goes if a window of ``width`` words
    covers it whose words also start in a document with a smaller id, judged on the input.
    A null or empty text has no words; a text shorter than a window loses nothing. Repeated
    rows of one id don't remove each other's words. Rows without an id stay whole and
    remove nothing. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("mark", F.coalesce(row_mark(F.col("text")), F.lit(0)))
    small_batches(docs.sparkSession)
    later = shared_windows(docs, width)
    docs = marked(docs, "doc_id", later.select(F.col("doc_id").alias("id")))
    whole = docs.filter("not maybe").select("doc_id", "mark", "text", F.lit(None).cast("array<long>").alias("at"))
    cut = docs.filter("maybe").join(later.hint("merge"), "doc_id", "left").select("doc_id", "mark", "text", "at")
    schema = "doc_id long, n_words long, n_removed long, text string, spans array<struct<start:int,end:int>>"
    return whole.mapInArrow(_cut(width), schema).unionAll(cut.mapInArrow(_cut(width), schema))
