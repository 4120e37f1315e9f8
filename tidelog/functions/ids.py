"""Entity ids: a two-letter prefix, an underscore and 26 characters."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ENTITY_PREFIXES


def make_id(prefix: Column | str, key: Column) -> Column:
    """A deterministic id from a key of up to 26 digits."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(prefix, F.lit("_"), F.lpad(key.cast("string"), 26, "0"))


def id_valid(syn_id: Column) -> Column:
    parts = F.split(syn_id, "_", 2)
    return F.coalesce((F.size(parts) == 2) & F.get(parts, F.lit(0)).isin(*ENTITY_PREFIXES.values()) & (F.length(F.get(parts, F.lit(1))) == 26), F.lit(False))


def id_type(syn_id: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in ENTITY_PREFIXES.items() for x in (v, k)])
    return F.when(id_valid(syn_id), F.element_at(table, F.substring(syn_id, 1, 2)))


#: Base 32 without letters that look like digits (fixed value); in the order of its bytes, so texts sort as numbers do.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _base32(number: Column, digits: int) -> list[Column]:
    return [F.substring(F.lit(ALPHABET), F.shiftright(number, 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for k in range(digits - 1, -1, -1)]


def sortable_id(prefix: Column | str, at: Column, *key: Column) -> Column:
    """An id that sorts by time: 48 bits of milliseconds and 80 bits of a hash of the key, 26 characters of base 32.

    The same time and key give the same id, so a job that is run again makes no new ones;
    rows of one batch with different keys can't share an id but by a clash of 80 bits.
    """
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    hashed = F.sha2(F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in key]), 256)
    parts = [F.conv(F.substring(hashed, 5 * k + 1, 5), 16, 10).cast("long") for k in range(4)]  # 20 bits each
    millis = F.unix_millis(at.cast("timestamp"))
    return F.concat(prefix, F.lit("_"), *_base32(millis, 10), *[c for p in parts for c in _base32(p, 4)])


def id_time(syn_id: Column) -> Column:
    """The time in a ``sortable_id``; null for what isn't one."""
    digits = [F.instr(F.lit(ALPHABET), F.substring(syn_id, 4 + k, 1)) - 1 for k in range(10)]
    millis = F.lit(0).cast("long")
    for d in digits:
        millis = millis * 32 + d
    return F.when(id_valid(syn_id) & syn_id.rlike(f"^.._[0-7][{ALPHABET}]{{25}}$"), F.timestamp_millis(millis))


def ulid_id(prefix: str) -> Column:
    """A new time-ordered id: milliseconds of now and 80 random bits."""
    noise = [F.floor(F.rand() * (1 << 20)).cast("long") for _ in range(4)]
    return F.concat(F.lit(prefix + "_"), *_base32(F.unix_millis(F.current_timestamp()), 10), *[c for p in noise for c in _base32(p, 4)])


def session_id() -> str:
    """A random version 4 UUID for a writing session."""
    return str(uuid.uuid4())
