"""CSV and JSON seeds, and settings with environment overrides."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ENTITY_PREFIXES


def read_seed_csv(spark: SparkSession, path: str, columns: list[str], required: list[str]) -> DataFrame:
    """A CSV with header: trimmed values, rows that lack a required one are skipped."""
    rows = spark.read.option("header", True).schema(", ".join(f"{c} string" for c in columns)).csv(path)
    rows = rows.select(*[F.trim(c).alias(c) for c in columns])
    for c in required:
        rows = rows.filter(F.coalesce(F.length(c), F.lit(0)) > 0)
    return rows


def load_companies(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and identifiers of a CSV ticker,name,figi,lei,isin; rows without a name are skipped."""
    return _entities(read_seed_csv(spark, path, ["ticker", "name", "figi", "lei", "isin"], ["name"]), "COMPANY", {"TICKER": "ticker", "FIGI": "figi", "LEI": "lei", "ISIN": "isin"})


def load_exchanges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and identifiers of a CSV mic,name,country; rows without mic or name are skipped."""
    return _entities(read_seed_csv(spark, path, ["mic", "name", "country"], ["mic", "name"]), "EXCHANGE", {"MIC": "mic"})


def load_commodities(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and identifiers of a CSV code,name,class; rows without code or name are skipped."""
    return _entities(read_seed_csv(spark, path, ["code", "name", "class"], ["code", "name"]), "COMMODITY", {"COMMODITY_CODE": "code"})


def _entities(rows: DataFrame, kind: str, schemes: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Ids come from all of a row's values, so that loading a file again gives the same entities."""
    values = F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(c, F.lit("")) for c in rows.columns])
    rows = rows.withColumn("syn_id", F.concat(F.lit(ENTITY_PREFIXES[kind] + "_"), F.upper(F.substring(F.sha2(values, 256), 1, 26))))
    entities = rows.select("syn_id", F.lit(kind).alias("type"), F.col("name").alias("canonical_name"), F.lit("ACTIVE").alias("status")).distinct()
    pairs = F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(c).alias("value")) for s, c in schemes.items()])
    identifiers = rows.select("syn_id", F.explode(pairs).alias("p")).select("syn_id", "p.*").filter("length(value) > 0").distinct()
    return entities, identifiers


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] = (0, 0), partitions: int = 1, properties: dict[str, str] | None = None) -> DataFrame:
    """A database table; with a numeric ``column``, read by ranges of it in parallel. Statements time out after 5 s unless ``properties`` say otherwise."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("queryTimeout", 5).options(**(properties or {}))
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


CASES = "test_cases array<struct<id:string,text:string,expected_syn_id:string,expected_name:string,expected_type:string,expected_confidence:double,expected_confidence_min:double,expected_confidence_max:double,category:string>>"


def read_gold_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASES).option("multiLine", True).json(path).select(F.explode("test_cases").alias("c")).select("c.*")


def load_settings(path: str, prefix: str = "TIDELOG_", env: dict[str, str] | None = None) -> dict:
    """Two levels of ``key: value`` lines; PREFIX_section__key in the environment wins."""
    out: dict = {}
    section: dict = out
    for line in Path(path).read_text().splitlines():
        line = line.split(" #")[0].rstrip()
        if not line or line.lstrip().startswith("#"):
            continue
        key, _, value = line.strip().partition(":")
        if not line.startswith(" "):
            section = out
        if value.strip():
            section[key] = _typed(value.strip())
        else:
            section = out.setdefault(key, {})
    for name, value in (os.environ if env is None else env).items():
        if name.startswith(prefix):
            *parts, last = name[len(prefix) :].lower().split("__")
            at = out
            for p in parts:
                at = at.setdefault(p, {})
            at[last] = _typed(value)
    return out


def _typed(text: str):
    text = text.strip("\"'")
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text
