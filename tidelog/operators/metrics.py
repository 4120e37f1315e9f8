"""Metric samples and the closed set of expressions over them.

Plain samples are (series, at in seconds, value); labelled ones (name, labels map, at, value).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slices import neighbour


def latest_sum(samples: DataFrame, at: int, tie: str) -> DataFrame:
    """Sum over series of the last sample up to ``at``."""
    last = samples.filter(F.col("at") <= at).groupBy("series").agg(F.max_by("value", F.struct("at", tie)).alias("value"))
    return last.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


#: Seconds of the slices that a series is cut into, so that no task holds a whole one.
SLICE = 21_600


def steps(samples: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Each sample's growth over the one before; a drop counts as a restart from 0."""
    old = F.col("_old")
    rows = neighbour(samples, keys, list(dict.fromkeys(["at", tie])), "value", "_old", SLICE)
    return rows.withColumn("step", F.when(old.isNull(), None).when(F.col("value") < old, F.col("value")).otherwise(F.col("value") - old)).drop("_old")


def growth(samples: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """keys, slice, first, last, growth, resets: a counter's mergeable state in each slice of time, by ``merged_growth``."""
    inner = Window.partitionBy(*keys, "slice").orderBy("at", tie)
    rows = samples.withColumn("slice", F.floor(F.col("at") / SLICE).cast("long"))
    old = F.lag("value").over(inner)
    rows = rows.withColumns({"_reset": old.isNotNull() & (F.col("value") < old), "_step": F.when(old.isNull(), 0.0).when(F.col("value") < old, F.col("value")).otherwise(F.col("value") - old)})
    place = F.struct("at", tie)
    return rows.groupBy(*keys, "slice").agg(F.min_by("value", place).alias("first"), F.max_by("value", place).alias("last"), F.sum("_step").alias("growth"), F.count_if("_reset").alias("resets"))


def merged_growth(states: DataFrame, keys: list[str]) -> DataFrame:
    """keys, growth, resets over all slices: between two slices a counter grows from the last value of one to the first of the next, or restarts."""
    w = Window.partitionBy(*keys).orderBy("slice")  # one row a slice
    old = F.lag("last").over(w)
    seam = F.when(old.isNull(), 0.0).when(F.col("first") < old, F.col("first")).otherwise(F.col("first") - old)
    rows = states.withColumns({"_seam": seam, "_reset": F.coalesce(F.col("first") < old, F.lit(False))})
    return rows.groupBy(*keys).agg((F.sum("growth") + F.sum("_seam")).alias("growth"), (F.sum("resets") + F.count_if("_reset")).alias("resets"))


def rates(samples: DataFrame, keys: list[str], tie: str, at: int, window: int) -> DataFrame:
    """Per series: growth by samples in (at - window, at], over the window's seconds."""
    inside = (F.col("at") > at - window) & (F.col("at") <= at)
    return steps(samples, keys, tie).filter(inside).groupBy(*keys).agg((F.coalesce(F.sum("step"), F.lit(0.0)) / window).alias("rate"))


def bucket_quantiles(buckets: DataFrame, quantiles: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, le, count cumulative) -> linear interpolation inside the bucket; no row without data."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # one row per bucket edge: a fixed few
    ordered, top = group.orderBy("le"), F.max(F.when(F.col("le") < float("inf"), F.col("le")))
    rows = buckets.withColumns({"low": F.coalesce(F.lag("le").over(ordered), F.lit(0.0)), "under": F.coalesce(F.lag("count").over(ordered), F.lit(0)), "total": F.max("count").over(group), "top": top.over(group)})
    hit = rows.withColumn("q", F.explode(F.array(*[F.lit(q) for q in quantiles]))).filter((F.col("total") > 0) & (F.col("count") >= F.col("q") * F.col("total")))
    first = hit.groupBy(*by, "q", "total", "top").agg(F.min_by(F.struct("le", "low", "under", "count"), "le").alias("b"))
    inside = F.col("b.low") + (F.col("b.le") - F.col("b.low")) * (F.col("q") * F.col("total") - F.col("b.under")) / (F.col("b.count") - F.col("b.under"))
    return first.select(*by, "q", F.when(F.col("b.le") == float("inf"), F.col("top")).when(F.col("b.count") == F.col("b.under"), F.col("b.le")).otherwise(inside).alias("value"))


def rate_grid(samples: DataFrame, keys: list[str], tie: str, start: int, end: int, step: int, window: int) -> DataFrame:
    """Rates at start, start + step ... end.

    Every sample goes straight to the few grid points whose window holds it (at most
    window / step + 1), so nothing is joined.
    """
    s = steps(samples, keys, tie).filter((F.col("at") > start - window) & (F.col("at") <= end))
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - start) / step)).cast("long")
    last = F.least(F.lit((end - start) // step), F.ceil((F.col("at") - start + window) / step) - 1).cast("long")
    grid = s.filter(first <= last).withColumn("point", F.explode(F.sequence(first, last)))
    return grid.groupBy(*keys, (F.lit(start) + F.col("point") * step).cast("long").alias("at")).agg((F.coalesce(F.sum("step"), F.lit(0.0)) / window).alias("rate"))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


#: Alert rules: id, comparison, threshold, severity (fixed values).
ALERT_RULES = [
    ("disconnected", "==", 0.0, "critical"), ("zero_flow", "==", 0.0, "critical"), ("high_validation_errors", ">", 10.0, "warning"),
    ("high_latency", ">", 0.05, "warning"), ("connection_errors", ">", 0.0, "warning"), ("high_cache_miss_rate", ">", 0.5, "info"),
]


def alerts(values: DataFrame) -> DataFrame:
    """(id, value) against the rules; a null value never fires."""
    rules = F.broadcast(values.sparkSession.createDataFrame(ALERT_RULES, "id string, op string, threshold double, severity string"))
    fires = F.when(F.col("op") == "==", F.col("value") == F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    return values.join(rules, "id").filter(F.coalesce(fires, F.lit(False)))


def held_alert(grid: DataFrame, keys: list[str], hold: int) -> DataFrame:
    """Points (at, firing) at which the condition has held for ``hold`` seconds without a break."""
    w = Window.partitionBy(*keys).orderBy("at").rangeBetween(-hold, 0)
    return grid.withColumns({"_all": F.min(F.col("firing").cast("int")).over(w), "_since": F.min("at").over(Window.partitionBy(*keys))}).withColumn("alert", (F.col("_all") == 1) & (F.col("at") - F.col("_since") >= hold)).drop("_all", "_since")


def parse_value(text: Column, default: float | None = 0.0) -> Column:
    """A sample's text as a number, or the default."""
    return F.coalesce(text.try_cast("double"), F.lit(default))


def matching(samples: DataFrame, name: str, labels: dict[str, str] | None = None) -> DataFrame:
    """Samples of a metric whose labels have the given values."""
    rows = samples.filter(F.col("name") == name)
    for k, v in (labels or {}).items():
        rows = rows.filter(F.element_at("labels", k) == v)
    return rows


def _series(samples: DataFrame) -> DataFrame:
    """With a label set's sorted entries as its key, as maps can't be ordered."""
    return samples.withColumn("_series", F.array_sort(F.map_entries("labels")))


def label(name: str) -> Column:
    return F.try_element_at(F.map_from_entries("_series"), F.lit(name))


def latest_grid(samples: DataFrame, keys: list[str], tie: str, start: int, end: int, step: int) -> DataFrame:
    """Each series' last sample at start, start + step ... end: a sample counts until the next one of its series."""
    rows = neighbour(samples.filter(F.col("at") <= end), keys, list(dict.fromkeys(["at", tie])), "at", "_after", SLICE, back=False)
    rows = rows.withColumn("_until", F.coalesce("_after", F.lit(end + 1)))
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - start) / step)).cast("long")
    last = F.least(F.lit((end - start) // step), F.ceil((F.col("_until") - start) / step) - 1).cast("long")
    grid = rows.filter(first <= last).withColumn("point", F.explode(F.sequence(first, last)))
    return grid.select(*keys, (F.lit(start) + F.col("point") * step).cast("long").alias("at"), "value")


@dataclass(frozen=True)
class Expr:
    """A metric expression: ``kind`` of the metric ``name`` with the label values ``where``, by the labels ``by``.

    sum: of the last samples; rate: of each series (``by`` is ignored, its label set is the
    result's ``labels``); sum_rate; quantile: of the rates of ``name``'s buckets, by le; mean:
    rate of ``name``_sum over rate of ``name``_count; ratio: sum_rate over that of ``over``.
    """

    kind: str
    name: str
    where: dict[str, str] = field(default_factory=dict)
    by: tuple[str, ...] = ()
    window: int = 60
    q: float = 0.99
    over: Expr | None = None


def query_range(samples: DataFrame, expr: Expr, start: int, end: int, step: int, tie: str = "at") -> DataFrame:
    """at, the labels of ``by``, value: the expression at start, start + step ... end; no row where there are no data."""
    by = list(expr.by)

    def rated(name: str) -> DataFrame:
        return rate_grid(_series(matching(samples, name, expr.where)), ["_series"], tie, start, end, step, expr.window)

    def summed(name: str, *more: Column) -> DataFrame:
        return rated(name).groupBy("at", *[label(b).alias(b) for b in by], *more).agg(F.sum("rate").alias("value"))

    if expr.kind == "sum":
        last = latest_grid(_series(matching(samples, expr.name, expr.where)), ["_series"], tie, start, end, step)
        return last.groupBy("at", *[label(b).alias(b) for b in by]).agg(F.sum("value").alias("value"))
    if expr.kind == "rate":
        return rated(expr.name).select("at", F.map_from_entries("_series").alias("labels"), F.col("rate").alias("value"))
    if expr.kind == "sum_rate":
        return summed(expr.name)
    if expr.kind == "quantile":
        le = F.when(label("le") == "+Inf", F.lit(float("inf"))).otherwise(label("le").try_cast("double"))
        buckets = summed(expr.name, le.alias("le")).withColumnRenamed("value", "count")
        return bucket_quantiles(buckets, [expr.q], ("at", *by)).drop("q")
    if expr.kind in ("mean", "ratio"):
        top, under = (f"{expr.name}_sum", f"{expr.name}_count") if expr.kind == "mean" else (expr.name, None)
        below = summed(under) if under else query_range(samples, expr.over, start, end, step, tie)
        both = summed(top).withColumnRenamed("value", "_top").join(below, ["at", *by])
        return both.select("at", *by, F.when(F.col("value") != 0, F.col("_top") / F.col("value")).alias("value"))
    raise ValueError(f"unknown kind of expression: {expr.kind}")


def query_instant(samples: DataFrame, expr: Expr, at: int, tie: str = "at") -> DataFrame:
    """The expression at one time: the labels of ``by``, value."""
    return query_range(samples, expr, at, at, 1, tie).drop("at")


def per_symbol(written: DataFrame, rate: DataFrame, rows: DataFrame, errors: DataFrame) -> DataFrame:
    """One row for each symbol of ``written``; what the others (symbol, value) lack is 0."""
    out = written.select("symbol", F.col("value").alias("events_written"))
    for name, df in (("rate", rate), ("rows_written", rows), ("validation_errors", errors)):
        out = out.join(df.select("symbol", F.col("value").alias(name)), "symbol", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out


def venue_status(venues: DataFrame, latency: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Venues with their latency and status: connected if a latency is known, else disconnected; unknown where the lookup failed."""
    out = venues.join(latency.select("venue", F.col("value").alias("latency")), "venue", "left")
    status = F.when(F.col("latency").isNotNull(), "connected").otherwise("disconnected")
    if failed is not None:
        out = out.join(failed.select("venue", F.lit(True).alias("_failed")).distinct(), "venue", "left")
        status = F.when(F.col("_failed"), "unknown").otherwise(status)
    return out.withColumn("status", status).drop("_failed")


def live_symbols(rates: DataFrame) -> DataFrame:
    """symbol, live: whether the symbol's write rate (symbol, value) is positive."""
    return rates.groupBy("symbol").agg((F.max("value") > 0).alias("live"))


#: Targets for the 99th percentile in milliseconds (fixed values).
LATENCY_TARGETS = {"tick": 10.0, "flush": 50.0, "network": 100.0}


def latency_verdicts(p99: DataFrame) -> DataFrame:
    """(kind, seconds) with the target in milliseconds and whether it is met."""
    target = F.element_at(F.create_map(*[F.lit(x) for kv in LATENCY_TARGETS.items() for x in kv]), F.col("kind"))
    return p99.withColumns({"target_ms": target, "good": F.col("seconds") * 1000 < target})


def latency_text(micros: Column) -> Column:
    """Microseconds as text in us, ms or s."""
    return F.when(micros < 1000, F.format_string("%.0fus", micros)).when(micros < 1_000_000, F.format_string("%.1fms", micros / 1000)).otherwise(F.format_string("%.2fs", micros / 1_000_000))


def ticker_change(price: Column, percent: Column) -> Column:
    return F.round(price * percent / 100, 2)


def alert_counts(fired: DataFrame) -> DataFrame:
    return fired.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def progress(items: DataFrame) -> DataFrame:
    """Mean progress, rounded, and how many of (progress, status) are complete or in progress."""
    return items.agg(F.round(F.avg("progress")).cast("long").alias("overall"), F.count_if(F.col("status") == "complete").alias("completed"), F.count_if(F.col("status") == "in-progress").alias("in_progress"))


def search_logs(logs: DataFrame, text: str | None = None, level: str | None = None, start=None, end=None, limit: int = 100) -> DataFrame:
    """Log entries (ts, level, message ...) with a text in the message, of a level, in a half-open time range; newest first."""
    rows = logs
    if text:
        rows = rows.filter(F.contains(F.lower("message"), F.lit(text.lower())))
    if level:
        rows = rows.filter(F.upper("level") == level.upper())
    if start is not None:
        rows = rows.filter(F.col("ts") >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col("ts") < F.lit(end))
    return rows.orderBy(F.desc("ts"), "message").limit(limit)


def zero_flow(samples: DataFrame, keys: list[str], start: int, end: int, step: int, hold: int, tie: str = "at") -> DataFrame:
    """Grid points at which a counter hasn't grown for ``hold`` seconds: keys, at, alert.

    The grid is made for every key from start to end, so that silence is seen as well.
    """
    grid = samples.select(*keys).distinct().withColumn("at", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end).cast("long"), F.lit(step).cast("long"))))
    flow = rate_grid(samples, keys, tie, start, end, step, step)
    points = grid.join(flow, [*keys, "at"], "left").withColumn("firing", F.coalesce("rate", F.lit(0.0)) == 0)
    return held_alert(points, keys, hold).select(*keys, "at", "alert")


def exposition(values: DataFrame) -> DataFrame:
    """(name, labels, value) as lines of the text exposition format, sorted."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    inside = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return values.select(F.concat(F.col("name"), inside, F.lit(" "), F.col("value").cast("string")).alias("line")).orderBy("line")
