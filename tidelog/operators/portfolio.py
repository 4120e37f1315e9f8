"""Position roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valued(positions: DataFrame) -> DataFrame:
    """Positions (quantity, avg_price, price) with market_value, unrealized_pnl and its percentage of the cost; null where that is 0. A short position gains as the price falls."""
    cost = F.abs(F.col("quantity")) * F.col("avg_price")
    pnl = (F.col("price") - F.col("avg_price")) * F.col("quantity")
    return positions.withColumns({"market_value": F.col("quantity") * F.col("price"), "unrealized_pnl": pnl, "unrealized_pnl_percent": F.try_divide(pnl * 100, cost)})


def exposures(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Gross, net, long and short counts of ``market_value``, by keys or in total."""
    aggs = [F.sum(F.abs("market_value")).alias("gross"), F.sum("market_value").alias("net"), F.count_if(F.col("market_value") > 0).alias("longs"), F.count_if(F.col("market_value") < 0).alias("shorts")]
    return positions.groupBy(*keys).agg(*aggs) if keys else positions.agg(*aggs)


def top_shares(positions: DataFrame, key: str, most: int = 5) -> DataFrame:
    """The largest groups by gross value, with their share of the largest."""
    top = positions.groupBy(key).agg(F.sum(F.abs("market_value")).alias("gross")).orderBy(F.desc("gross"), key).limit(most)
    return top.withColumn("share_of_max", F.col("gross") / F.max("gross").over(Window.partitionBy(F.lit(1))))


def trade_summary(trades: DataFrame) -> DataFrame:
    """Counts and volume of trades by aggressor (0 buy, 1 sell)."""
    return trades.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("aggressor") == 0).alias("buys"), F.count_if(F.col("aggressor") == 1).alias("sells"), F.sum("size").alias("volume"))
