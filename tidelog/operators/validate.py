"""Event validation: an ordered list of rules, the first that fails names the error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import wall_valid
from ..schema import DECIMALS, EVENT_TYPES

SKEW_NS = 60_000_000_000
Rule = tuple[Column, str]


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def positive(x: Column) -> Column:
    return finite(x) & (x > 0)


def not_negative(x: Column) -> Column:
    return finite(x) & (x >= 0)


def first_error(rules: list[Rule]) -> Column:
    """The message of the first rule that isn't met (a null counts as not met)."""
    out = F.lit(None).cast("string")
    for ok, message in reversed(rules):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)).otherwise(out)
    return out


def header_rules() -> list[Rule]:
    c = F.col
    return [
        (wall_valid(c("ts_event_ns")), "event time out of range"), (wall_valid(c("ts_receive_ns")), "receive time out of range"),
        (c("ts_receive_ns") >= c("ts_event_ns") - SKEW_NS, "received before event"), (c("seq") > 0, "sequence not positive"),
        (F.length("venue") > 0, "no venue"), (F.length("symbol") > 0, "no symbol"), (F.length("source") > 0, "no source"),
    ]


def type_rules(kind: str) -> list[Rule]:
    c = F.col
    price, size = c("price"), c("size")
    return {
        "depth": [(c("level") < 1000, "level too deep"), (F.when(c("op") == 2, not_negative(price)).otherwise(positive(price)), "bad price"), (not_negative(size), "bad size")],
        "trade": [(positive(price), "bad price"), (positive(size), "bad size")],
        "order": [(F.length("order_id") > 0, "no order id"), (not_negative(price), "bad price"), (positive(size), "bad size"), (not_negative(c("filled")), "bad fill"), (c("filled") <= size, "filled more than ordered")],
        "bar": [
            (c("ts_close_ns") > c("ts_open_ns"), "bar closes before it opens"), *[(positive(c(x)), f"bad {x}") for x in ("open", "high", "low", "close")],
            ((c("high") >= c("low")) & (c("high") >= c("open")) & (c("high") >= c("close")), "high not highest"),
            ((c("low") <= c("open")) & (c("low") <= c("close")), "low not lowest"), (not_negative(c("volume")), "bad volume"),
        ],
        "heartbeat": [],
    }[kind]


def event_error() -> Column:
    """Header rules first, then those of the event's type; null if all are met. A type that isn't known is the only error then."""
    own = F.lit(None).cast("string")
    for kind, code in EVENT_TYPES.items():
        own = F.when(F.col("event_type") == code, first_error(type_rules(kind))).otherwise(own)
    known = F.coalesce(F.col("event_type").isin(*EVENT_TYPES.values()), F.lit(False))
    return F.when(~known, "unknown event type").otherwise(F.coalesce(first_error(header_rules()), own))


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted events, and rejected ones with their error."""
    checked = events.withColumn("error", event_error())
    return checked.filter("error is null").drop("error"), checked.filter("error is not null")


def to_decimal(x: Column, scale: int) -> Column:
    """Round half away from zero at ``scale``; what isn't finite becomes 0."""
    unit = F.expr(f"cast(1e-{scale} as decimal({scale + 1},{scale}))")
    whole = F.round(x * float(10**scale)).cast("long").cast("decimal(18,0)")
    return F.when(x.isNull(), None).when(~finite(x), F.lit(0)).otherwise(whole * unit).cast(f"decimal(18,{scale})")


def with_decimals(events: DataFrame) -> DataFrame:
    return events.withColumns({f"{name}_decimal": to_decimal(F.col(name), scale) for name, scale in DECIMALS.items() if name in events.columns})
