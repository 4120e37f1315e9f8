"""The wide event row, its enums, and the entity tables' enums (all fixed values)."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _D, _S, _B = T.LongType(), T.DoubleType(), T.StringType(), T.ByteType()
PRICE, SIZE = T.DecimalType(18, 6), T.DecimalType(18, 3)

#: Header fields are required, all others null unless the event type uses them.
HEADER = [("ts_event_ns", _L), ("ts_receive_ns", _L), ("ts_monotonic_ns", _L), ("event_type", _B), ("venue", _S), ("symbol", _S), ("source", _S), ("seq", _L)]
BODY = [
    ("side", _B), ("price", _D), ("size", _D), ("level", _L), ("op", _B), ("price_decimal", PRICE), ("size_decimal", SIZE), ("aggressor", _B),
    ("order_id", _S), ("state", _B), ("filled", _D), ("reason", _S), ("filled_decimal", SIZE), ("ts_open_ns", _L), ("ts_close_ns", _L),
    ("open", _D), ("high", _D), ("low", _D), ("close", _D), ("open_decimal", PRICE), ("high_decimal", PRICE), ("low_decimal", PRICE), ("close_decimal", PRICE),
    ("volume", _D), ("volume_decimal", SIZE),
]
EVENT = T.StructType([T.StructField(n, t, False) for n, t in HEADER] + [T.StructField(n, t, True) for n, t in BODY])

EVENT_TYPES = {"depth": 1, "trade": 2, "order": 3, "bar": 4, "heartbeat": 5}
SIDES = {"bid": 0, "ask": 1}
DEPTH_OPS = {"add": 0, "update": 1, "delete": 2}
AGGRESSORS = {"buy": 0, "sell": 1, "unknown": 2}
ORDER_STATES = {"new": 0, "ack": 1, "replaced": 2, "canceled": 3, "filled": 4, "rejected": 5}
TYPE_COLUMNS = {
    "depth": ["side", "price", "size", "level", "op"],
    "trade": ["price", "size", "aggressor"],
    "order": ["order_id", "state", "price", "size", "filled", "reason"],
    "bar": ["ts_open_ns", "ts_close_ns", "open", "high", "low", "close", "volume"],
    "heartbeat": [],
}
#: Doubles that are also stored as decimals, by scale.
DECIMALS = {"price": 6, "open": 6, "high": 6, "low": 6, "close": 6, "size": 3, "filled": 3, "volume": 3}

ENTITY_PREFIXES = {
    "COMPANY": "CO", "SECURITY": "SE", "EXCHANGE": "EX", "INDEX": "IX", "PERSON": "PE", "ORG": "OR", "SECTOR": "SC", "THEME": "TH", "COMMODITY": "CM", "FX": "FX",
}
SCHEMES = ["FIGI", "ISIN", "CUSIP", "SEDOL", "LEI", "TICKER", "PERMID", "WIKIDATA", "MIC", "RIC", "ISO_4217", "COMMODITY_CODE"]
RELATIONS = ["ISSUES", "LISTED_ON", "BELONGS_TO", "LEADS", "DERIVES_FROM", "TRACKS_INDEX", "OWNS", "COMPETES_WITH", "SUPPLIES", "NEWS_ABOUT"]
DATATYPES = ["STRING", "NUMBER", "JSON"]
