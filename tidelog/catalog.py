"""The registry for SQL: views of its tables, functions that return tables, and the view of its counts.

They are temporary, of the session that registers them. The functions take columns, so they
work with LATERAL over any number of entities; Catalyst turns that into joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import registry

#: Name, parameters, columns and query of each function.
FUNCTIONS = [
    ("active_identifiers", "p_syn_id STRING", "scheme STRING, value STRING, valid_from TIMESTAMP_NTZ", "SELECT i.scheme, i.value, cast(i.valid_from AS timestamp_ntz) FROM identifiers i WHERE i.syn_id = p_syn_id AND i.valid_to IS NULL"),
    (
        "active_attributes", "p_syn_id STRING", "key STRING, datatype STRING, value_string STRING, value_number DOUBLE, value_json STRING, source STRING, confidence DOUBLE, observed_at TIMESTAMP_NTZ",
        "SELECT a.key, a.datatype, a.value_string, a.value_number, a.value_json, a.source, a.confidence, a.observed_at FROM attributes a WHERE a.syn_id = p_syn_id AND a.valid_to IS NULL",
    ),
    (
        "active_edges", "p_syn_id STRING, p_direction STRING DEFAULT 'out', p_rel_type STRING DEFAULT NULL", "src_syn_id STRING, dst_syn_id STRING, rel_type STRING, attrs STRING, source STRING, confidence DOUBLE, observed_at TIMESTAMP_NTZ",
        # each edge is listed under both of its ends, so that an entity's edges are found by one equality
        "SELECT e.src_syn_id, e.dst_syn_id, e.rel_type, e.attrs, e.source, e.confidence, e.observed_at FROM edge_ends e WHERE e.syn_id = p_syn_id AND (p_direction = 'both' AND e.counts OR e.direction = p_direction) AND (p_rel_type IS NULL OR e.rel_type = p_rel_type)",
    ),
]


def register(spark: SparkSession, entities: DataFrame, identifiers: DataFrame, aliases: DataFrame, attributes: DataFrame, edges: DataFrame, quarantine: DataFrame) -> None:
    """Make the views entity_registry, identifiers, aliases, attributes, edges, entity_quarantine and ontology_stats and the functions active_identifiers, active_attributes and active_edges.

    An edge of an entity with itself is listed once for direction "both".
    """
    tables = {"entity_registry": entities, "identifiers": identifiers, "aliases": aliases, "attributes": attributes, "edges": edges, "entity_quarantine": quarantine}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    registry.stats(entities, identifiers, aliases, attributes, edges, quarantine).createOrReplaceTempView("ontology_stats")
    spark.sql("""
      CREATE OR REPLACE TEMPORARY VIEW edge_ends AS
      SELECT inline(array(struct(src_syn_id AS syn_id, 'out' AS direction, true AS counts), struct(dst_syn_id AS syn_id, 'in' AS direction, src_syn_id <> dst_syn_id AS counts))),
        src_syn_id, dst_syn_id, rel_type, attrs, source, confidence, observed_at FROM edges WHERE valid_to IS NULL""")
    for name, parameters, columns, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
