"""Daily features as they were known on each day: nothing that is observed later changes a day's value.

All rest on one aggregate per entity and day; windows then run over an entity's calendar, so a
task holds days, not events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calendar(entities: DataFrame, start: str, end: str) -> DataFrame:
    """``entities`` with one row for every day from start to end."""
    return entities.withColumn("day", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))))


def link_counts(links: DataFrame, key: str, start: str, end: str, name: str) -> DataFrame:
    """key, day, ``name``: the links (key, valid_from, observed_at, valid_to) that were known and held at the end of each day.

    A link counts from the day on which it is both valid and observed, up to the day before
    its end; changes of a day are added up first, and then over the calendar.
    """
    known, gone = F.to_date(F.greatest("valid_from", "observed_at")), F.to_date("valid_to")
    rows = links.select(key, known.alias("known"), gone.alias("gone")).filter("gone is null or gone > known")
    changes = F.array(F.struct(F.col("known").alias("day"), F.lit(1).alias("n")), F.struct(F.col("gone").alias("day"), F.lit(-1).alias("n")))
    daily = rows.select(key, F.explode(changes).alias("c")).select(key, F.greatest("c.day", F.lit(start).cast("date")).alias("day"), "c.n", F.col("c.day").alias("_at"))
    daily = daily.filter(F.col("_at") <= F.lit(end).cast("date")).groupBy(key, "day").agg(F.sum("n").alias("n"))
    so_far = Window.partitionBy(key).orderBy("day")
    dense = calendar(links.select(key).distinct(), start, end).join(daily, [key, "day"], "left")
    return dense.select(key, "day", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias(name))


def spread_bps(bid: Column, ask: Column) -> Column:
    """The spread in hundredths of a percent of the middle; null unless 0 < bid < ask."""
    return F.when((bid > 0) & (bid < ask), (ask - bid) / ((ask + bid) / 2) * 10_000)


def market_features(trades: DataFrame, quotes: DataFrame, start: str, end: str, days: int = 5) -> DataFrame:
    """symbol, day, close, realized_vol, avg_spread_bps, volume over the last ``days`` calendar days, for trades (symbol, day, at, price, size) and quotes (symbol, day, bid, ask).

    A day without trades keeps the close of the day before and has return 0; the volatility is
    the root of the mean square of daily log returns, null before the second close is known.
    """
    traded = trades.groupBy("symbol", "day").agg(F.max_by("price", "at").alias("close"), F.sum("size").alias("volume"))
    quoted = quotes.withColumn("_s", spread_bps(F.col("bid"), F.col("ask"))).groupBy("symbol", "day").agg(F.sum("_s").alias("spreads"), F.count("_s").alias("quotes"))
    symbols = trades.select("symbol").union(quotes.select("symbol")).distinct()
    dense = calendar(symbols, start, end).join(traded, ["symbol", "day"], "left").join(quoted, ["symbol", "day"], "left")
    by_day = Window.partitionBy("symbol").orderBy("day")
    recent = by_day.rowsBetween(1 - days, 0)
    dense = dense.withColumn("close", F.last("close", True).over(by_day))
    step = F.log(F.col("close") / F.lag("close").over(by_day))
    dense = dense.withColumn("_r", F.when((F.col("close") > 0) & (F.lag("close").over(by_day) > 0), step))
    return dense.select(
        "symbol", "day", "close", F.sqrt(F.avg(F.col("_r") * F.col("_r")).over(recent)).alias("realized_vol"),
        (F.sum("spreads").over(recent) / F.nullif(F.sum("quotes").over(recent), F.lit(0))).alias("avg_spread_bps"), F.coalesce(F.sum("volume").over(recent), F.lit(0.0)).alias("volume"),
    )
