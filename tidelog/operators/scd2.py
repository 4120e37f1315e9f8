"""Type-2 slowly changing rows with half-open validity [valid_from, valid_to)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import starts_of, with_column

TOLERANCE = 0.01


def active(valid_to: str = "valid_to") -> Column:
    return F.col(valid_to).isNull()


def as_of(at: Column, prefix: str = "") -> Column:
    return (F.col(f"{prefix}valid_from") <= at) & (F.col(f"{prefix}valid_to").isNull() | (F.col(f"{prefix}valid_to") > at))


def _differs(old: tuple, new: tuple, exact: int) -> bool:
    if old[:exact] != new[:exact]:
        return True
    for a, b in zip(old[exact:], new[exact:]):
        if a is None or b is None:
            if a is not b:
                return True
        elif abs(a - b) > TOLERANCE:
            return True
    return False


def _kept(keys: list[str], exact: list[str], near: list[str]):
    """Flags of sorted rows: whether each differs from the last kept one of its key.

    Where a row is the very same as the one before, or differs by more than the tolerance, the
    row before is enough; only keys with a drift inside the tolerance are gone through row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = None, ()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new, changed = starts_of(batch, keys, before), starts_of(batch, exact, None)
            drift = np.zeros(n, dtype=bool)
            for c in near:
                x, none = batch.column(c).to_numpy(zero_copy_only=False).astype(float), batch.column(c).is_null().to_numpy(zero_copy_only=False)
                gap = np.abs(np.where(none, 0.0, x)[1:] - np.where(none, 0.0, x)[:-1])
                changed[1:] |= (none[1:] != none[:-1]) | (gap > TOLERANCE)
                drift[1:] |= (gap > 0) & (gap <= TOLERANCE)
            flags = new | changed
            drift &= ~new
            drift[0] = not new[0]  # a key that goes on from the batch before is compared with what was kept there
            starts = np.flatnonzero(new)
            starts = starts if new[0] else np.concatenate([[0], starts])
            ends = np.append(starts[1:], n)
            value = lambda k: tuple(batch.column(c)[k].as_py() for c in [*exact, *near])  # noqa: B023, E731
            folded = np.flatnonzero(np.add.reduceat(drift, starts)).tolist()
            if folded:  # as lists once, not value by value
                rows = list(zip(*(batch.column(c).to_pylist() for c in [*exact, *near])))
            for k in folded:
                held = last
                for i in range(int(starts[k]), int(ends[k])):
                    row = rows[i]
                    flags[i] = new[i] or _differs(held, row, len(exact))
                    held = row if flags[i] else held
                if k == len(starts) - 1:
                    last = held
            if not drift[starts[-1] :].any():
                last = value(int(np.flatnonzero(flags)[-1]))
            before = tuple(batch.column(k)[n - 1].as_py() for k in keys)
            yield with_column(batch, "_keep", pa.array(flags, pa.bool_()))

    return run


def _flagged(rows: DataFrame, keys: list[str], exact: list[str], near: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``_keep``: whether a row differs from the last kept one of its key."""
    if not near:  # equality carries over from row to row, so the row before does
        w = Window.partitionBy(*keys).orderBy(*order)
        same = F.row_number().over(w) > 1
        for c in exact:
            same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
        return rows.withColumn("_keep", ~same)
    schema = T.StructType([*rows.schema, T.StructField("_keep", T.BooleanType())])
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(_kept(keys, exact, near), schema)


def merge(current: DataFrame | None, staged: DataFrame, keys: list[str], exact: list[str], near: list[str], order: list[str], carry: list[str] | None = None) -> DataFrame:
    """All versions after applying the staged rows in order, with ``action`` (kept, inserted or updated).

    Per key: a first row is inserted; a changed one closes the kept version at its own
    valid_from and is inserted (updated); one without change is dropped. A change is judged
    against the last kept version, so slow drift inside the tolerance adds up: where there is a
    tolerance, each key's rows are read as a sorted stream that holds one version. ``current``
    holds stored versions (its open rows take part as the first kept version). The columns
    ``carry`` go along with their version without being compared; a table that lacks one has nulls there.
    """
    more = [c for c in carry or [] if c not in {*keys, "valid_from", *exact, *near}]
    fields = ["valid_from", *exact, *near, *more]
    steps = [f"_o{k}" for k in range(len(order))]
    given = [*staged.schema, *(current.schema if current is not None else [])]
    kinds = {f.name: f.dataType for f in reversed(given)}
    full = lambda d: d.withColumns({c: F.lit(None).cast(kinds[c]) for c in more if c not in d.columns}) if more else d
    staged, current = full(staged), current if current is None else full(current)
    rows = staged.select(*keys, *fields, F.lit(1).alias("_new"), *[F.col(c).alias(o) for c, o in zip(order, steps)])
    done = None
    if current is not None:
        open_rows = current.filter("valid_to is null").select(*keys, *fields, F.lit(0).alias("_new"), *[F.lit(None).cast(rows.schema[o].dataType).alias(o) for o in steps])
        rows = open_rows.unionByName(rows)
        done = current.filter("valid_to is not null").select(*keys, *fields, "valid_to", F.lit("kept").alias("action"))
    kept = _flagged(rows, keys, exact, near, ["_new", *steps]).filter("_keep")
    w = Window.partitionBy(*keys).orderBy("_new", *steps)
    action = F.when(F.col("_new") == 0, "kept").when(F.row_number().over(w) == 1, "inserted").otherwise("updated")
    out = kept.select(*keys, *fields, F.lead("valid_from").over(w).alias("valid_to"), action.alias("action"))
    return out if done is None else out.unionByName(done)


def merge_errors(current: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """Staged rows that don't start after the open version of their key (the batch must be refused)."""
    old = current.filter("valid_to is null").select(*keys, F.col("valid_from").alias("open_from"))
    return staged.join(old, keys).filter("valid_from <= open_from")


def merge_batch(current: DataFrame, staged: DataFrame, keys: list[str], exact: list[str], near: list[str], order: list[str], error: Column, most: int = 1000, carry: list[str] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """An atomic batch of 1 to ``most`` staged rows: the new versions, or None and the rows at fault with their errors.

    ``error`` names what is wrong with a row's own values. A row that doesn't start after its
    key's open version, or after the row before, is at fault as well. Nothing is applied if any is.
    """
    n = staged.count()
    if not 1 <= n <= most:
        raise ValueError(f"a batch has 1 to {most} rows, not {n}")
    w = Window.partitionBy(*keys).orderBy(*order)
    opened = current.filter("valid_to is null").select(*keys, F.col("valid_from").alias("_open"))
    checked = staged.join(opened, keys, "left").withColumn("_last", F.coalesce(F.lag("valid_from").over(w), F.col("_open")))
    late = F.when(F.col("valid_from") <= F.col("_last"), F.lit("valid_from isn't after the version before"))
    errors = checked.withColumn("error", F.coalesce(error, late)).filter("error is not null").drop("_open", "_last")
    if errors.take(1):
        return None, errors
    return merge(current, staged, keys, exact, near, order, carry), errors


def close(current: DataFrame, keys: DataFrame, on: list[str], at: Column) -> DataFrame:
    """Open rows of the given keys get ``valid_to``."""
    hit = keys.select(*on).distinct().withColumn("_hit", F.lit(True))
    rows = current.join(hit, on, "left")
    return rows.withColumn("valid_to", F.when(F.col("_hit") & F.col("valid_to").isNull(), at).otherwise(F.col("valid_to"))).drop("_hit")


def overlaps(rows: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """Rows that start before an earlier version of their key has ended."""
    w = Window.partitionBy(*keys).orderBy("valid_from", *tie).rowsBetween(Window.unboundedPreceding, -1)
    kind = rows.schema["valid_to"].dataType
    end = F.coalesce("valid_to", F.lit("9999-12-31").cast(kind))
    return rows.withColumn("_end", F.max(end).over(w)).filter(F.col("_end") > F.col("valid_from")).drop("_end")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
