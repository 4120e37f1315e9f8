"""Entity registry: resolution, neighbourhoods, constraints, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import names
from .scd2 import as_of


def resolve(probes: DataFrame, identifiers: DataFrame, entities: DataFrame) -> DataFrame:
    """(scheme, value, at) -> the entity valid then; of several the latest start, then the smallest id.

    One equi join on (scheme, value) with the validity as its residual condition, so probes
    of any number are resolved in one pass.
    """
    hit = probes.join(identifiers, ["scheme", "value"]).filter(as_of(F.col("at")))
    newest = -F.unix_micros(F.col("valid_from").cast("timestamp"))
    best = hit.groupBy("scheme", "value", "at").agg(F.min(F.struct(newest.alias("newest"), "syn_id")).alias("b"))
    found = best.select("scheme", "value", "at", "b.syn_id")
    return found.join(entities, "syn_id").withColumns({"confidence": F.lit(1.0), "matched_via": F.col("scheme")})


def entity_detail(entities: DataFrame, identifiers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities with their active identifiers and all aliases as sorted arrays."""
    ids = identifiers.filter("valid_to is null").groupBy("syn_id").agg(F.sort_array(F.collect_list(F.struct("scheme", "value"))).alias("identifiers"))
    # Best confidence first, missing ones before all, as in a descending sort with nulls first.
    names = aliases.groupBy("syn_id").agg(F.sort_array(F.collect_list(F.struct((-F.coalesce("confidence", F.lit(2.0))).alias("rank"), "alias"))).alias("aliases"))
    out = entities.join(ids, "syn_id", "left").join(names, "syn_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    return out.withColumns({"identifiers": empty("identifiers"), "aliases": empty("aliases")})


def neighbours(edges: DataFrame, entities: DataFrame, direction: str, relation: str | None = None, active_only: bool = False, at: Column | None = None) -> DataFrame:
    """Edges seen from ``syn_id``, with the other end's name; direction out, in or both (from one pass over the edges).

    Optionally of one relation, and only open ones or those valid at a time; with
    ``active_only`` the time is ignored, as the open ones are asked for.
    """
    rows = edges if relation is None else edges.filter(F.col("rel_type") == relation)
    if active_only:
        rows = rows.filter(F.col("valid_to").isNull())
    elif at is not None:
        rows = rows.filter(as_of(at))
    end = lambda a, b, d: F.struct(F.col(a).alias("syn_id"), F.col(b).alias("related_id"), F.lit(d).alias("direction"))
    ends = {"out": [end("src_syn_id", "dst_syn_id", "out")], "in": [end("dst_syn_id", "src_syn_id", "in")]}
    rows = rows.withColumn("_end", F.explode(F.array(*ends.get(direction, ends["out"] + ends["in"])))).select("*", "_end.*").drop("_end")
    names = entities.select(F.col("syn_id").alias("related_id"), F.col("canonical_name").alias("related_name"))
    return rows.join(names, "related_id", "left")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page: limit from 1 to 1000, offset from 0; the order must be total."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(1000, max(1, limit)))


def edge_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("valid_to").isNull()).alias("active"), F.avg("confidence").alias("avg_confidence"))


def search(entities: DataFrame, query: str, limit: int, index: DataFrame | None = None) -> DataFrame:
    """Full-text search of names, best rank first; over a stored ``index`` (``names.write_index``), or one made here."""
    index = names.postings(entities.select(F.col("syn_id").alias("id"), F.col("canonical_name").alias("text"))) if index is None else index
    return names.search(entities, index, query, limit)


def active_identifiers(identifiers: DataFrame, syn_id: str | None = None) -> DataFrame:
    """Open identifiers, of one entity or all, by scheme."""
    rows = identifiers.filter("valid_to is null")
    return (rows if syn_id is None else rows.filter(F.col("syn_id") == syn_id)).orderBy("syn_id", "scheme", "value")


def attributes_of(attributes: DataFrame, syn_id: str | None = None, key: str | None = None, active_only: bool = True) -> DataFrame:
    """Attributes of one entity or all, optionally of one key, by key; with history also by valid_from, newest first."""
    rows = attributes.filter("valid_to is null") if active_only else attributes
    for name, value in (("syn_id", syn_id), ("key", key)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows.orderBy("syn_id", "key", F.desc("valid_from"))


def stats(entities: DataFrame, identifiers: DataFrame, aliases: DataFrame, attributes: DataFrame, edges: DataFrame, quarantine: DataFrame) -> DataFrame:
    """The registry's eight counts in one row, one aggregate a table."""
    live, is_open = F.col("status") == "ACTIVE", F.col("valid_to").isNull()
    parts = [
        entities.agg(F.count_if(live).alias("active_entities"), F.count_if(F.col("status") == "MERGED").alias("merged_entities"), F.countDistinct(F.when(live, F.col("type"))).alias("entity_types_used")),
        identifiers.agg(F.count_if(is_open).alias("active_identifiers")), aliases.agg(F.count(F.lit(1)).alias("total_aliases")), attributes.agg(F.count_if(is_open).alias("active_attributes")),
        edges.agg(F.count_if(is_open).alias("active_edges")), quarantine.agg(F.count_if(F.col("resolved_syn_id").isNull()).alias("unresolved_quarantine")),
    ]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.join(p)
    return out


def refresh_counts(edges: DataFrame, relations: list[str]) -> DataFrame:
    """Distinct open edges by relation, as a refresh job would go through them."""
    rows = edges.filter(F.col("rel_type").isin(relations) & F.col("valid_to").isNull())
    return rows.select("src_syn_id", "dst_syn_id", "rel_type").distinct().groupBy("rel_type").agg(F.count(F.lit(1)).alias("edges"))


def seed_edges(pairs: DataFrame, left: tuple[str, str], right: tuple[str, str], relation: str, identifiers: DataFrame, entities: DataFrame, at: Column) -> DataFrame:
    """Edges between the entities that two identifiers of each pair resolve to; pairs with a missing end are skipped.

    ``left`` and ``right``: the pair's column and the scheme that its values are of.
    """
    rows = pairs.withColumn("at", at)
    for (column, scheme), name in ((left, "src_syn_id"), (right, "dst_syn_id")):
        probes = rows.select(F.lit(scheme).alias("scheme"), F.col(column).alias("value"), "at").distinct()
        found = resolve(probes, identifiers, entities).select(F.col("value").alias(column), F.col("syn_id").alias(name))
        rows = rows.join(found, column)
    return rows.select("src_syn_id", "dst_syn_id", F.lit(relation).alias("rel_type"), F.col("at").alias("observed_at"), F.lit(1.0).alias("confidence"))


def missing_parents(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no parent."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def unique_active_violations(identifiers: DataFrame) -> DataFrame:
    """Active (scheme, value) pairs that several entities hold."""
    return identifiers.filter("valid_to is null").groupBy("scheme", "value").agg(F.countDistinct("syn_id").alias("holders")).filter("holders > 1")


def add_identifiers(current: DataFrame, staged: DataFrame, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows to append, and rows refused because another entity holds the value (blanks around it don't count).

    A value of a scheme belongs to the entity that holds it openly, or else to that of its first
    staged row by ``order`` (valid_from if not given), then by syn_id; staged rows of all others
    are refused. Of what is left, an entity's first row for a scheme and start goes in, unless
    the table has one; the others are repetitions.
    """
    staged = staged.withColumn("value", F.trim("value"))
    place = F.struct(*(order or ["valid_from"]), "syn_id")
    held = current.filter("valid_to is null").groupBy("scheme", F.trim("value").alias("value")).agg(F.sort_array(F.collect_set("syn_id")).alias("_stored"))  # a few, as a rule one
    first = staged.groupBy("scheme", "value").agg(F.min_by("syn_id", place).alias("_first"))
    rows = staged.join(first, ["scheme", "value"]).join(held, ["scheme", "value"], "left")
    mine = F.when(F.col("_stored").isNull(), F.col("syn_id") == F.col("_first")).otherwise((F.size("_stored") == 1) & F.array_contains("_stored", F.col("syn_id")))
    rows = rows.withColumn("_mine", mine)
    key = ["syn_id", "scheme", "valid_from"]
    fresh = rows.filter("_mine").join(current.select(*key), key, "left_anti")
    one = fresh.groupBy(*key).agg(F.min_by(F.struct(*staged.columns), F.struct(*(order or ["valid_from"]), "value")).alias("_r"))
    return one.select(*[F.col(f"_r.{c}").alias(c) for c in staged.columns]), rows.filter("not _mine").select(*staged.columns)


def insert_missing(table: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    """Insert that leaves existing keys alone; of seed rows that share a key, the smallest by its other columns goes in."""
    one = seed.groupBy(*keys).agg(F.min(F.struct(*[c for c in seed.columns if c not in keys] or keys)).alias("_r"))
    fresh = one.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in seed.columns])
    return table.unionByName(fresh.join(table.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def cascade_delete(child: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    return child.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def rank_in(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= most)
