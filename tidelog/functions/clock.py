"""Nanosecond clocks, calendar dates and venue time zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000
MIN_WALL_NS, MAX_WALL_NS = 1_577_836_800 * NS, 2_524_608_000 * NS

#: Ingestion venues and their zones (fixed values); any other venue is UTC.
VENUE_ZONES = {
    "SMART": "America/New_York", "NYSE": "America/New_York", "NASDAQ": "America/New_York", "ARCA": "America/New_York", "BATS": "America/New_York",
    "IEX": "America/New_York", "AMEX": "America/New_York", "CBOE": "America/Chicago", "TSE": "America/Toronto", "VENTURE": "America/Vancouver",
    "LSE": "Europe/London", "LSEETF": "Europe/London", "XETRA": "Europe/Berlin", "FWB": "Europe/Berlin", "AEB": "Europe/Amsterdam",
    "SWB": "Europe/Zurich", "SFB": "Europe/Stockholm", "EBS": "Europe/Zurich", "IBIS": "Europe/Berlin", "MEXI": "Europe/Moscow",
    "SEHK": "Asia/Hong_Kong", "HKFE": "Asia/Hong_Kong", "TSE.JPN": "Asia/Tokyo", "OSE.JPN": "Asia/Tokyo", "SGX": "Asia/Singapore",
    "KRX": "Asia/Seoul", "NSE": "Asia/Kolkata", "BSE": "Asia/Kolkata", "ASX": "Australia/Sydney", "BOVESPA": "America/Sao_Paulo", "BMV": "America/Mexico_City",
}


def whole_seconds(ns: Column | str) -> Column:
    """Integer division that rounds toward zero."""
    return F.expr(f"{ns} div {NS}") if isinstance(ns, str) else F.when(ns >= 0, F.floor(ns / NS)).otherwise(F.ceil(ns / NS))


def utc_date(ns: str) -> Column:
    return F.to_date(F.timestamp_seconds(whole_seconds(ns)))


def iso8601(ns: str) -> Column:
    """UTC with nine fraction digits and Z."""
    return F.concat(F.date_format(F.timestamp_seconds(whole_seconds(ns)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.expr(f"cast({ns} % {NS} as string)"), 9, "0"), F.lit("Z"))


def parse_iso8601(text: Column) -> Column:
    """Nanoseconds; a fraction and Z are needed, the fraction is padded or cut to nine digits; 0 on failure."""
    pattern = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})\.(\d+)Z$"
    seconds = F.unix_timestamp(F.try_to_timestamp(F.regexp_extract(text, pattern, 1), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    part = F.rpad(F.substring(F.regexp_extract(text, pattern, 2), 1, 9), 9, "0")
    return F.when(text.rlike(pattern), F.coalesce(seconds * NS + part.cast("long"), F.lit(0))).otherwise(F.lit(0)).cast("long")


def wall_valid(ns: Column) -> Column:
    return ns.between(MIN_WALL_NS, MAX_WALL_NS)


def venue_zone(venue: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in VENUE_ZONES.items() for x in kv])
    return F.coalesce(F.element_at(table, venue), F.lit("UTC"))


def _offset(utc: Column, zone: Column) -> Column:
    """Seconds that a zone's local time is ahead of UTC at an instant (timestamp_ntz in UTC)."""
    return F.timestamp_diff("SECOND", utc, F.convert_timezone(F.lit("UTC"), zone, utc))


def local_to_utc(local: Column, zone: Column) -> Column:
    """Local wall time of a zone as UTC, both timestamp_ntz.

    A time that occurs twice is standard time (the later instant), one that is skipped takes
    the summer offset. The offsets half a day before and after show a change of clocks.
    """
    ahead = lambda s: F.timestamp_add("SECOND", s, local)
    early, late = (_offset(F.timestamp_add("HOUR", F.lit(h), F.convert_timezone(zone, F.lit("UTC"), local)), zone) for h in (-12, 12))
    fits = lambda o: _offset(ahead(-o), zone) == o
    pick = F.when(fits(early) & fits(late), F.least(early, late)).when(fits(early), early).when(fits(late), late).otherwise(F.greatest(early, late))
    return ahead(-pick)


def localize(local: Column, venue: Column, fallback: Column, aware: Column | None = None) -> Column:
    """A venue's local time as UTC; a zone-aware time (a timestamp) counts as it is; the fallback where both are null."""
    utc = local_to_utc(local, venue_zone(venue))
    if aware is not None:
        utc = F.coalesce(F.convert_timezone(F.current_timezone(), F.lit("UTC"), aware.cast("timestamp_ntz")), utc)
    return F.coalesce(utc, fallback)


def localize_text(text: Column, venue: Column, fallback: Column) -> Column:
    """As ``localize`` for a time given as text, with or without an offset; what can't be read gives the fallback."""
    aware = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return localize(F.when(~aware, F.try_to_timestamp(text).cast("timestamp_ntz")), venue, fallback, F.when(aware, F.try_to_timestamp(text)))


def wall_ns() -> Column:
    """Now, in nanoseconds (of microsecond precision)."""
    return F.unix_micros(F.current_timestamp()) * 1000


def local_clock(utc: Column, zone: Column) -> Column:
    """HH:MM of a venue's wall clock."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), zone, utc), "HH:mm")


def market_open(utc: Column, zone: str, opens: int, closes: int, inclusive: bool = False) -> Column:
    """Monday to Friday, opens <= local minute < closes (<= if ``inclusive``)."""
    local = F.from_utc_timestamp(utc, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return F.dayofweek(local).between(2, 6) & (minute >= opens) & ((minute <= closes) if inclusive else (minute < closes))
