"""Connected components by rounds of hooking and contraction over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, is_empty, stored


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node of ``edges`` (a, b).

    Each round hooks every node to its smallest neighbour (a partial aggregate, so a hub
    isn't gathered in one task), follows that pointer once more and replaces the ends of
    all edges. A star vanishes in one round, a path halves at least. Repeated edges count
    once; loops and edges with a null end are left out, and so are nodes without any other
    edge; other columns are ignored. No edges give no rows.
    """
    with Scratch() as s:
        return s.keep(_components(edges))


def _components(edges: DataFrame) -> DataFrame:
    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    roots = None
    while not is_empty(edges):
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select("b", "a"))
        hook = ends.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("root"))
        hook = stored(hook, "cc-hook")
        onward = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
        hook = stored(hook.join(onward, "root").select("node", F.col("next").alias("root")), "cc-jump")
        step = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
        if roots is None:
            roots = hook
        else:
            roots = roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        roots = stored(roots, "cc-roots")
        a = edges.join(hook.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        both = a.join(hook.select(F.col("node").alias("b"), F.col("root").alias("y")), "b").filter("x <> y")
        edges = stored(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
    return stored(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "cc-roots") if roots is None else roots
