"""What the endpoints offer, as methods over tables: a registry of entities and a view of metrics.

Tables are DataFrames and never changed in place: a write returns a new service, and the rows
that it refused with their errors.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import linker, metrics, registry, scd2, store
from .sources import eventlog

EDGE_KEY, ATTRIBUTE_KEY = ["src_syn_id", "dst_syn_id", "rel_type"], ["syn_id", "key"]
ATTRIBUTE_VALUES = ["datatype", "value_string", "value_number", "value_json", "source"]


EDGE_VALUES = ["attrs", "source", "evidence"]


def _edges(rows: DataFrame) -> DataFrame:
    """Edges with all that a version is made of."""
    text, time = F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz")
    for c, empty in (("attrs", text), ("source", text), ("evidence", text), ("confidence", F.lit(1.0)), ("observed_at", time), ("valid_from", time), ("valid_to", time)):
        if c not in rows.columns:
            rows = rows.withColumn(c, empty)
    seen = F.coalesce("observed_at", F.current_timestamp().cast("timestamp_ntz"))
    return rows.withColumns({"attrs": store.no_empty_json(F.col("attrs")), "observed_at": seen, "valid_from": F.coalesce("valid_from", "observed_at", seen)})


def _others(keys: list[str], values: list[str], *tables: DataFrame) -> list[str]:
    """The columns of a version that are neither compared nor part of its validity."""
    known = {*keys, *values, "confidence", "valid_from", "valid_to"}
    return list(dict.fromkeys(["observed_at"] * ("rel_type" in keys) + [c for t in tables for c in t.columns if c not in known]))


@dataclass(frozen=True)
class Registry:
    entities: DataFrame
    identifiers: DataFrame
    aliases: DataFrame
    attributes: DataFrame
    edges: DataFrame
    quarantined: DataFrame

    def resolve(self, probes: DataFrame) -> DataFrame:
        """(scheme, value, at) -> the entity that held the value then."""
        return registry.resolve(probes, self.identifiers, self.entities)

    def entity(self, syn_id: str | None = None) -> DataFrame:
        rows = self.entities if syn_id is None else self.entities.filter(F.col("syn_id") == syn_id)
        return registry.entity_detail(rows, self.identifiers, self.aliases)

    def search(self, query: str, limit: int = 20) -> DataFrame:
        return registry.search(self.entities, query, limit)

    def edges_of(self, syn_id: str, direction: str = "both", relation: str | None = None, active_only: bool = True, at: Column | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        """One page, the latest observed first."""
        near = registry.neighbours(self.edges.filter((F.col("src_syn_id") == syn_id) | (F.col("dst_syn_id") == syn_id)), self.entities, direction, relation, active_only, at)
        return registry.page(near.filter(F.col("syn_id") == syn_id), [F.desc("observed_at"), F.desc("confidence"), F.col("related_id"), F.col("rel_type"), F.col("direction")], limit, offset)

    def add_entities(self, staged: DataFrame) -> tuple[Registry, DataFrame]:
        table, bad = store.insert_entities(self.entities, staged)
        return replace(self, entities=table), bad

    def add_identifiers(self, staged: DataFrame) -> tuple[Registry, DataFrame]:
        table, bad = store.insert_identifiers(self.identifiers, staged)
        return replace(self, identifiers=table), bad

    def add_aliases(self, staged: DataFrame) -> tuple[Registry, DataFrame]:
        table, bad = store.insert_aliases(self.aliases, staged)
        return replace(self, aliases=table), bad

    def add_edges(self, staged: DataFrame) -> tuple[Registry, DataFrame]:
        """An atomic batch of 1 to 1000 edges: all are applied, or none.

        A version changes by attrs (as JSON values; an empty object counts as missing), source,
        evidence or a confidence that drifts by over 0.01; it carries all other columns. A
        missing valid_from is observed_at, and a missing observed_at is now.
        """
        table, bad = scd2.merge_batch(_edges(self.edges), _edges(staged), EDGE_KEY, EDGE_VALUES, ["confidence"], ["valid_from"], store.edge_error(), carry=_others(EDGE_KEY, EDGE_VALUES, self.edges, staged))
        return (self if table is None else replace(self, edges=table.drop("action"))), bad

    def close_edges(self, keys: DataFrame, at: Column) -> Registry:
        return replace(self, edges=scd2.close(self.edges, keys, EDGE_KEY, at))

    def add_attributes(self, staged: DataFrame) -> tuple[Registry, DataFrame]:
        """An atomic batch of 1 to 1000 typed attributes (with valid_from): all are applied, or none."""
        tidy = lambda d: d.withColumn("value_json", store.canonical_json(F.col("value_json")))
        table, bad = scd2.merge_batch(tidy(self.attributes), staged, ATTRIBUTE_KEY, ATTRIBUTE_VALUES, ["confidence"], ["valid_from"], store.attribute_error())
        if table is None:
            return self, bad
        carry = _others(ATTRIBUTE_KEY, ATTRIBUTE_VALUES, self.attributes, staged)
        table = scd2.merge(tidy(self.attributes), tidy(staged), ATTRIBUTE_KEY, ATTRIBUTE_VALUES, ["confidence"], ["valid_from"], carry)
        return replace(self, attributes=table.drop("action")), bad

    def link(self, mentions: DataFrame, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Decisions for mentions (mention_id, text), and what goes to the quarantine with its candidates."""
        e = self.entities
        found = [linker.ticker_candidates(mentions, self.identifiers, e), linker.alias_candidates(mentions, self.aliases, e), linker.canonical_candidates(mentions, e), linker.fuzzy_candidates(mentions, self.aliases, e)]
        ranked = linker.cascade(found, e, kind)
        decided = linker.decide(mentions, ranked)
        return decided, linker.quarantine(decided, ranked)

    def quarantine(self, resolved: bool = False, limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """One page, and the totals."""
        return store.quarantine_items(self.quarantined, resolved, limit, offset), store.quarantine_totals(self.quarantined)

    def resolve_quarantined(self, decisions: DataFrame) -> tuple[Registry, DataFrame]:
        table, bad = store.resolve_items(self.quarantined, decisions)
        return replace(self, quarantined=table), bad

    def stats(self) -> DataFrame:
        return registry.stats(self.entities, self.identifiers, self.aliases, self.attributes, self.edges, self.quarantined)

    def edge_stats(self) -> DataFrame:
        return registry.edge_stats(self.edges).orderBy(F.desc("active"), "rel_type")


@dataclass(frozen=True)
class Monitor:
    """Labelled samples (name, labels, at, value), and the log's storage."""

    samples: DataFrame

    def instant(self, expr: metrics.Expr, at: int) -> DataFrame:
        return metrics.query_instant(self.samples, expr, at)

    def range(self, expr: metrics.Expr, start: int, end: int, step: int = 15) -> DataFrame:
        return metrics.query_range(self.samples, expr, start, end, step)

    def venues(self, venues: DataFrame, at: int) -> DataFrame:
        """A venue dimension (venue) with latency and status."""
        return metrics.venue_status(venues, self.instant(metrics.Expr("sum", "network_latency_seconds", by=("venue",)), at))

    def tickers(self, quotes: DataFrame, at: int) -> DataFrame:
        """Quotes (symbol, price, change_percent) with the change, and whether the symbol is being written."""
        live = metrics.live_symbols(self.instant(metrics.Expr("sum_rate", "events_written_total", by=("symbol",)), at))
        out = quotes.join(live, "symbol", "left").withColumn("live", F.coalesce("live", F.lit(False)))
        return out.withColumns({"price": F.round("price", 2), "change": metrics.ticker_change(F.col("price"), F.col("change_percent"))})

    def alerts(self, values: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Alerts that (id, value) fire, and their counts by severity."""
        fired = metrics.alerts(values)
        return fired, metrics.alert_counts(fired)

    @staticmethod
    def storage(files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(symbol, day, bytes) of the log's files, by symbol and in total."""
        by_symbol = eventlog.storage_by_symbol(files)
        return by_symbol, eventlog.storage_total(by_symbol)
