"""A feed of live ticks as a streaming source: ``spark.readStream.format("tick_feed")``.

A broker's client would take the place of ``Ticks``. Symbols are subscribed by an option, so
subscribing twice is the same as once; after a restart the checkpoint's offset says where to
go on, and a batch that is asked for again has the same ticks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

TICKS = "symbol string, price double, size double, ts_event_ns long, ts_receive_ns long, ts_monotonic_ns long, venue string, source string, seq long, bid double, ask double"
START_NS, STEP_NS = 1_704_844_800_000_000_000, 1_000_000


class Ticks(SimpleDataSourceStreamReader):
    """Random trades that depend on the seed and their number only: price from 100 to 200, size from 1 to 1000."""

    def __init__(self, symbols: list[str], rows: int, batch: int, seed: int) -> None:
        self.symbols, self.rows, self.batch, self.seed = symbols, rows, batch, seed

    def initialOffset(self) -> dict:
        return {"n": 0}

    def tick(self, n: int) -> tuple:
        h = hashlib.sha256(f"{self.seed}/{n}".encode()).digest()
        u = [int.from_bytes(h[k : k + 6], "big") / (1 << 48) for k in (0, 6, 12)]
        price, ns = 100 + 100 * u[1], START_NS + n * STEP_NS
        return (self.symbols[int(u[0] * len(self.symbols))], price, 1 + 999 * u[2], ns, ns + 1000, ns + 500, "", "feed", n + 1, price * 0.999, price * 1.001)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return map(self.tick, range(start["n"], end["n"]))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"n": min(self.rows, start["n"] + self.batch)}
        return self.readBetweenOffsets(start, end), end


class TickFeed(DataSource):
    """Options: symbols (with commas between), rows in all, rows of a batch, seed."""

    @classmethod
    def name(cls) -> str:
        return "tick_feed"

    def schema(self) -> str:
        return TICKS

    def simpleStreamReader(self, schema) -> Ticks:
        get = self.options.get
        symbols = sorted({s.strip().upper() for s in get("symbols", "AAPL,MSFT,SPY").split(",") if s.strip()})
        return Ticks(symbols, int(get("rows", "10000")), int(get("batch", "1000")), int(get("seed", "0")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TickFeed)
