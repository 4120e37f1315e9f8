"""Neighbours in time without a window over a whole key: keys are cut into slices of time.

Windows run inside (key, slice), so that a busy key spreads over tasks; what a slice takes from
the ones before or behind it is one row a slice, found by a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.col(f"{a}._slice").eqNullSafe(F.col(f"{b}._slice"))
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _slice(at: str, width: int) -> Column:
    return F.floor(F.col(at) / width).cast("long")


def neighbour(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, width: int, back: bool = True) -> DataFrame:
    """``rows`` with ``name``: ``value`` of the row before (or behind) in ``order``, whose first column is a number, cut into slices of ``width``; null if there is none."""
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    near = F.struct(F.col(value).alias("v"))  # tells a null value from no row
    cut = rows.withColumn("_slice", _slice(order[0], width))
    place = F.struct(*order)
    edge = cut.groupBy(*keys, "_slice").agg((F.max_by if back else F.min_by)(near, place).alias("_edge"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    edge = edge.withColumn("_edge", F.lag("_edge").over(across) if back else F.lead("_edge").over(across))
    found = cut.withColumn("_near", F.lag(near).over(inside) if back else F.lead(near).over(inside)).alias("a")
    joined = found.join(edge.alias("b"), _same("a", "b", keys), "left")
    return joined.select(*[F.col(f"a.{c}") for c in rows.columns], F.coalesce("a._near", "b._edge").getField("v").alias(name))


def prevailing(rows: DataFrame, facts: DataFrame, keys: list[str], at: str, values: list[str], tie: list[str], width: int) -> DataFrame:
    """``rows`` with the ``values`` of the latest of ``facts`` up to their time (a number), of the same keys; null before the first.

    A fact of the same time counts; of several of a time the last by ``tie``. Rows and facts are
    merged in (key, slice of ``width``), where the last fact so far is taken along; a slice
    begins with the last fact of an earlier one.
    """
    known = F.struct(*values).alias("_known")
    kind = facts.select(known).schema["_known"].dataType
    ties = [F.col(t).alias(f"_t{k}") for k, t in enumerate(tie)]
    shape = facts.select(*ties).schema
    merged = rows.select(*keys, at, F.struct(*rows.columns).alias("_row"), F.lit(None).cast(kind).alias("_known"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in shape], F.lit(1).alias("_kind"))
    given = facts.select(*keys, at, F.lit(None).cast(merged.schema["_row"].dataType).alias("_row"), known, *ties, F.lit(0).alias("_kind"))
    every = merged.unionByName(given).withColumn("_slice", _slice(at, width))
    order = [F.col(at), F.col("_kind"), *[F.col(f.name) for f in shape]]
    so_far = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    edge = every.groupBy(*keys, "_slice").agg(F.max_by("_known", F.when(F.col("_kind") == 0, F.struct(at, *shape.names))).alias("_edge"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_edge", F.last("_edge", True).over(earlier))
    found = every.withColumn("_last", F.last("_known", True).over(so_far)).filter("_kind = 1").alias("a")
    joined = found.join(edge.alias("b"), _same("a", "b", keys), "left").select(F.col("a._row").alias("_row"), F.coalesce("a._last", "b._edge").alias("_at"))
    return joined.select("_row.*", *[F.col(f"_at.{v}").alias(v) for v in values])
