"""Writes to the registry: input checks, new rows, merges of entities, and the quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import id_valid
from ..schema import DATATYPES, ENTITY_PREFIXES, RELATIONS, SCHEMES
from .registry import add_identifiers, page
from .validate import first_error

STATUSES = ("ACTIVE", "INACTIVE", "MERGED")


def _filled(c: str) -> Column:
    return F.length(F.trim(F.col(c))) > 0


def _share(c: str) -> Column:
    return F.col(c).between(0.0, 1.0)


#: Least and most characters of a request's texts (fixed values).
LENGTHS = {
    "canonical_name": (1, 500), "syn_id": (1, 30), "scheme": (1, 30), "value": (1, 500), "alias": (1, 500), "lang": (0, 10), "source": (0, 50),
    "src_syn_id": (1, 30), "dst_syn_id": (1, 30), "rel_type": (1, 30), "key": (1, 100),
}


def length_error(columns: list[str]) -> Column:
    """Which of the columns has a text that is too short or too long; null if none has. A missing text counts where one is needed."""
    out = F.lit(None).cast("string")
    for c in reversed([c for c in columns if c in LENGTHS]):
        least, most = LENGTHS[c]
        out = F.when(~F.coalesce(F.length(c), F.lit(0)).between(least, most), F.lit(f"{c} has not {least} to {most} characters")).otherwise(out)
    return out


def entity_error() -> Column:
    """What is wrong with a new entity (type, canonical_name, status); null if nothing is."""
    return first_error([(_filled("canonical_name"), "no name"), (F.col("type").isin(list(ENTITY_PREFIXES)), "unknown type"), (F.col("status").isin(*STATUSES), "unknown status")])


def identifier_error() -> Column:
    return first_error([(id_valid(F.col("syn_id")), "bad syn_id"), (F.col("scheme").isin(SCHEMES), "unknown scheme"), (_filled("value"), "no value")])


def alias_error() -> Column:
    return first_error([(id_valid(F.col("syn_id")), "bad syn_id"), (_filled("alias"), "no alias"), (_share("confidence"), "confidence not in 0..1")])


def edge_error() -> Column:
    return first_error([
        (id_valid(F.col("src_syn_id")), "bad src_syn_id"), (id_valid(F.col("dst_syn_id")), "bad dst_syn_id"), (F.col("src_syn_id") != F.col("dst_syn_id"), "source is destination"),
        (F.col("rel_type").isin(RELATIONS), "unknown relation"), (_share("confidence"), "confidence not in 0..1"),
    ])


def attribute_error() -> Column:
    """Also: the one value that is set must be of the datatype."""
    values = ("value_string", "value_number", "value_json")
    one = F.lit(False)
    for kind, c in zip(DATATYPES, values):
        others = [F.col(o).isNull() for o in values if o != c]
        one = one | ((F.col("datatype") == kind) & F.col(c).isNotNull() & others[0] & others[1])
    return first_error([
        (id_valid(F.col("syn_id")), "bad syn_id"), (_filled("key"), "no key"), (F.col("datatype").isin(DATATYPES), "unknown datatype"), (_share("confidence"), "confidence not in 0..1"),
        (one, "value isn't of the datatype"), ((F.col("datatype") != "JSON") | canonical_json(F.col("value_json")).isNotNull(), "value isn't JSON"),
    ])


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no blanks, so that equal values are equal texts; null if it can't be read."""
    return F.to_json(F.try_parse_json(text))


def no_empty_json(text: Column) -> Column:
    """``canonical_json``, where an empty object counts as missing."""
    c = canonical_json(text)
    return F.when(c != "{}", c)


def split_checked(staged: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """The staged rows without fault, and the others with their error."""
    rows = staged.withColumn("error", error)
    return rows.filter("error is null").drop("error"), rows.filter("error is not null")


def insert_entities(entities: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with the new entities (syn_id, type, canonical_name, status; names trimmed), and those refused."""
    good, bad = split_checked(staged.withColumn("status", F.coalesce("status", F.lit("ACTIVE"))), entity_error())
    return entities.unionByName(good.withColumn("canonical_name", F.trim("canonical_name")), allowMissingColumns=True), bad


def insert_identifiers(identifiers: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with the new identifiers, and those refused: at fault, or open for another entity. Known rows are left alone."""
    good, bad = split_checked(staged, identifier_error())
    fresh, clash = add_identifiers(identifiers, good)
    bad = bad.unionByName(clash.withColumn("error", F.lit("another entity holds the value")).select(bad.columns))
    return identifiers.unionByName(fresh.select([c for c in fresh.columns if c in identifiers.columns]), allowMissingColumns=True), bad


def insert_aliases(aliases: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with the new aliases (trimmed; confidence 1 if not given), and those refused."""
    good, bad = split_checked(staged.withColumn("confidence", F.coalesce("confidence", F.lit(1.0))), alias_error())
    return aliases.unionByName(good.withColumn("alias", F.trim("alias")), allowMissingColumns=True), bad


def merge_entities(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Entities after merges (from_syn_id, into_syn_id): MERGED, and the lineage in ``replaces_syn_id`` of the one that stays."""
    if "replaces_syn_id" not in entities.columns:
        entities = entities.withColumn("replaces_syn_id", F.array().cast("array<string>"))
    gone = merges.select(F.col("from_syn_id").alias("syn_id")).distinct().withColumn("_gone", F.lit(True))
    taken = merges.groupBy(F.col("into_syn_id").alias("syn_id")).agg(F.array_sort(F.collect_set("from_syn_id")).alias("_taken"))
    rows = entities.join(gone, "syn_id", "left").join(taken, "syn_id", "left")
    none = F.array().cast("array<string>")
    lineage = F.array_distinct(F.concat(F.coalesce("replaces_syn_id", none), F.coalesce("_taken", none)))
    return rows.withColumns({"status": F.when(F.col("_gone"), "MERGED").otherwise(F.col("status")), "replaces_syn_id": lineage}).drop("_gone", "_taken")


def quarantine_items(items: DataFrame, resolved: bool, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of open items by arrival, or of resolved ones by their resolution, newest first."""
    rows = items.filter(F.col("resolved_syn_id").isNotNull() if resolved else F.col("resolved_syn_id").isNull())
    return page(rows, [F.desc("resolved_at" if resolved else "ingested_at"), F.col("id")], limit, offset)


def quarantine_totals(items: DataFrame) -> DataFrame:
    return items.groupBy(F.col("resolved_syn_id").isNotNull().alias("resolved")).agg(F.count(F.lit(1)).alias("n"))


def resolve_items(items: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items after decisions (id, syn_id, resolved_by, resolved_at), and the decisions that took no effect with the reason.

    A decision needs a valid syn_id and an item that is still open; of several for an item the
    earliest counts, of equally early ones the smallest syn_id.
    """
    checked = decisions.withColumn("error", F.when(~id_valid(F.col("syn_id")), "bad syn_id"))
    is_open = items.filter("resolved_syn_id is null").select("id", F.lit(True).alias("_open"))
    checked = checked.join(is_open, "id", "left").withColumn("error", F.coalesce("error", F.when(F.col("_open").isNull(), "not found or resolved"))).drop("_open")
    first = checked.filter("error is null").groupBy("id").agg(F.min(F.struct("resolved_at", "syn_id", "resolved_by")).alias("_d"))
    rows = items.join(first, "id", "left")
    put = lambda c, new: F.coalesce(c, F.col(f"_d.{new}"))
    rows = rows.withColumns({"resolved_syn_id": put("resolved_syn_id", "syn_id"), "resolved_at": put("resolved_at", "resolved_at"), "resolved_by": put("resolved_by", "resolved_by")}).drop("_d")
    late = checked.filter("error is null").join(first, "id").filter(F.struct("resolved_at", "syn_id", "resolved_by") != F.col("_d")).withColumn("error", F.lit("not found or resolved")).drop("_d")
    return rows, checked.filter("error is not null").unionByName(late.select(checked.columns))


def check_violations(rows: DataFrame) -> DataFrame:
    """Rows of a table with validity or confidence that break its checks: an end not after the start, confidence not in 0..1."""
    rules = F.lit(None).cast("string")
    if "confidence" in rows.columns:
        rules = F.when(~_share("confidence"), "confidence not in 0..1").otherwise(rules)
    if "valid_to" in rows.columns:
        rules = F.when(F.col("valid_to") <= F.col("valid_from"), "ends before it starts").otherwise(rules)
    return rows.withColumn("violation", rules).filter("violation is not null")
