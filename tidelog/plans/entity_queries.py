"""Entity registry and linker queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids as idf
from .. import catalog
from ..operators import linker, registry, scd2, store
from . import query
from . import views as V

ASOF = "1998-06-01"


@query(f"""WITH {V.ENTITIES}, {V.IDENTIFIERS}, pr AS (SELECT DISTINCT scheme, value FROM ids), h AS (SELECT pr.scheme, pr.value, ids.syn_id, ids.valid_from FROM pr JOIN ids USING (scheme, value)
  WHERE ids.valid_from <= TIMESTAMP '{ASOF}' AND (ids.valid_to IS NULL OR ids.valid_to > TIMESTAMP '{ASOF}'))
SELECT scheme, value, count(*) AS holders FROM h GROUP BY 1, 2""")
def resolve_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entities held each value at a point in time."""
    i = V.identifiers(spark, sf_dir).filter(scd2.as_of(F.lit(ASOF).cast("timestamp_ntz")))
    return i.groupBy("scheme", "value").agg(F.count(F.lit(1)).alias("holders"))


@query(f"""WITH {V.ENTITIES}, {V.IDENTIFIERS}, h AS (SELECT *, row_number() OVER (PARTITION BY scheme, value ORDER BY valid_from DESC, syn_id) AS k FROM ids
  WHERE valid_from <= TIMESTAMP '{ASOF}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{ASOF}'))
SELECT h.value, h.syn_id, en.canonical_name, 1.0 AS confidence, h.scheme AS matched_via FROM h JOIN en USING (syn_id) WHERE k = 1""")
def resolve_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-in-time resolution of every (scheme, value); most are shared, so the latest start and then the smallest id answers."""
    i = V.identifiers(spark, sf_dir)
    probes = i.select("scheme", "value").distinct().withColumn("at", F.lit(ASOF).cast("timestamp_ntz"))
    return registry.resolve(probes, i, V.entities(spark, sf_dir)).select("value", "syn_id", "canonical_name", "confidence", "matched_via")


@query(f"WITH {V.IDENTIFIERS} SELECT syn_id, scheme, value FROM ids WHERE valid_to IS NULL")
def identifiers_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.identifiers(spark, sf_dir).filter(scd2.active()).select("syn_id", "scheme", "value")


@query(f"WITH {V.IDENTIFIERS} SELECT syn_id, scheme, value, CAST(valid_from AS TIMESTAMP) AS valid_from, CAST(valid_to AS TIMESTAMP) AS valid_to FROM ids ORDER BY scheme, valid_from DESC, syn_id")
def identifiers_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.identifiers(spark, sf_dir).orderBy("scheme", F.desc("valid_from"), "syn_id")


@query(f"""WITH {V.ENTITIES}, {V.IDENTIFIERS}, {V.ALIASES}, i AS (SELECT syn_id, count(*) AS n FROM ids WHERE valid_to IS NULL GROUP BY 1), a AS (SELECT syn_id, count(*) AS n FROM al GROUP BY 1)
SELECT en.syn_id, en.type, CAST(coalesce(i.n, 0) AS BIGINT) AS identifiers, CAST(coalesce(a.n, 0) AS BIGINT) AS aliases FROM en LEFT JOIN i USING (syn_id) LEFT JOIN a USING (syn_id)""")
def entity_detail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = registry.entity_detail(V.entities(spark, sf_dir), V.identifiers(spark, sf_dir), V.aliases(spark, sf_dir))
    return d.select("syn_id", "type", F.size("identifiers").cast("long").alias("identifiers"), F.size("aliases").cast("long").alias("aliases"))


@query(f"WITH {V.IDENTIFIERS} SELECT scheme, value, count(DISTINCT syn_id) AS holders FROM ids WHERE valid_to IS NULL GROUP BY 1, 2 HAVING count(DISTINCT syn_id) > 1")
def unique_active_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.unique_active_violations(V.identifiers(spark, sf_dir))


@query(f"WITH {V.ENTITIES}, {V.EDGES} SELECT src_syn_id, dst_syn_id FROM ed WHERE dst_syn_id NOT IN (SELECT syn_id FROM en WHERE status = 'ACTIVE')")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose target isn't an active entity."""
    live = V.entities(spark, sf_dir).filter("status = 'ACTIVE'")
    return registry.missing_parents(V.edges(spark, sf_dir), "dst_syn_id", live, "syn_id").select("src_syn_id", "dst_syn_id")


@query(f"""WITH {V.IDENTIFIERS}, st AS (SELECT syn_id, scheme, value FROM ids WHERE valid_to IS NULL),
sx AS (SELECT replace(syn_id, 'CO_0', 'CO_1') AS syn_id, scheme, value FROM st) SELECT DISTINCT sx.syn_id, sx.scheme, sx.value FROM sx JOIN ids USING (scheme, value) WHERE ids.valid_to IS NULL AND ids.syn_id <> sx.syn_id""")
def identifier_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New identifiers that are refused as another entity holds the value."""
    i = V.identifiers(spark, sf_dir)
    staged = i.filter("valid_to is null").withColumn("syn_id", F.regexp_replace("syn_id", "CO_0", "CO_1"))
    return registry.add_identifiers(i, staged.select("syn_id", "scheme", "value", "valid_from"))[1].select("syn_id", "scheme", "value").distinct()


_NB = "SELECT {a} AS syn_id, {b} AS related_id, '{d}' AS direction, rel_type, canonical_name AS related_name FROM ed LEFT JOIN en ON en.syn_id = {b}"
_OUT, _IN = _NB.format(a="src_syn_id", b="dst_syn_id", d="out"), _NB.format(a="dst_syn_id", b="src_syn_id", d="in")


def _near(spark, sf_dir, direction):
    return registry.neighbours(V.edges(spark, sf_dir), V.entities(spark, sf_dir), direction).select("syn_id", "related_id", "direction", "rel_type", "related_name")


@query(f"WITH {V.ENTITIES}, {V.EDGES} {_OUT}")
def edges_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, "out")


@query(f"WITH {V.ENTITIES}, {V.EDGES} {_IN}")
def edges_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, "in")


@query(f"WITH {V.ENTITIES}, {V.EDGES} {_OUT} UNION ALL {_IN}")
def edges_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, "both")


@query(f"WITH {V.EDGES} SELECT src_syn_id, dst_syn_id, rel_type, observed_at, round(confidence, 6) AS confidence FROM ed WHERE valid_to IS NULL ORDER BY observed_at DESC, confidence DESC, src_syn_id, dst_syn_id LIMIT 50 OFFSET 20")
def edges_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.edges(spark, sf_dir).filter(scd2.active())
    return registry.page(e, [F.desc("observed_at"), F.desc("confidence"), F.col("src_syn_id"), F.col("dst_syn_id")], 50, 20).select("src_syn_id", "dst_syn_id", "rel_type", "observed_at", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {V.EDGES} SELECT rel_type, count(*) AS total, count(*) FILTER (WHERE valid_to IS NULL) AS active, round(avg(confidence), 6) AS avg_confidence FROM ed GROUP BY 1")
def edge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.edge_stats(V.edges(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(f"WITH {V.EDGES} SELECT count(*) AS total, count(*) FILTER (WHERE valid_to IS NULL) AS active, count(valid_to) AS historical FROM ed")
def edge_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = registry.edge_stats(V.edges(spark, sf_dir)).agg(F.sum("total").alias("total"), F.sum("active").alias("active"))
    return s.withColumn("historical", F.col("total") - F.col("active"))


@query(f"""WITH {V.ENTITIES}, {V.IDENTIFIERS}, {V.EDGES}, {V.ALIASES}, {V.ATTRIBUTES}, {V.QUARANTINE} SELECT (SELECT count(*) FROM en WHERE status = 'ACTIVE') AS active_entities, (SELECT count(*) FROM en WHERE status = 'MERGED') AS merged_entities,
  (SELECT count(*) FROM ids WHERE valid_to IS NULL) AS active_identifiers, (SELECT count(*) FROM al) AS total_aliases, (SELECT count(*) FROM att WHERE valid_to IS NULL) AS active_attributes,
  (SELECT count(*) FROM ed WHERE valid_to IS NULL) AS active_edges, (SELECT count(*) FROM qu WHERE resolved_syn_id IS NULL) AS unresolved_quarantine, (SELECT count(DISTINCT type) FROM en WHERE status = 'ACTIVE') AS entity_types_used""")
def ontology_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight counts, one aggregate row per table."""
    return registry.stats(*[f(spark, sf_dir) for f in (V.entities, V.identifiers, V.aliases, V.attributes, V.edges, V.quarantine)])


def _staged(spark, sf_dir) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey", F.col("o_orderdate").alias("valid_from")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("value"), F.min_by(F.floor(F.col("o_totalprice") / 100000) / 100, "o_orderkey").alias("confidence"))


_MERGED = """WITH RECURSIVE st AS (SELECT o_custkey, o_orderdate AS valid_from, min_by(o_orderpriority, o_orderkey) AS value, min_by(floor(o_totalprice / 100000) / 100, o_orderkey) AS confidence FROM orders GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY valid_from) AS i FROM st),
f AS (SELECT o_custkey, i, valid_from, value, confidence, true AS keep, value AS kv, confidence AS kc FROM n WHERE i = 1
  UNION ALL SELECT n.o_custkey, n.i, n.valid_from, n.value, n.confidence, n.value <> f.kv OR abs(n.confidence - f.kc) > 0.01,
    CASE WHEN n.value <> f.kv OR abs(n.confidence - f.kc) > 0.01 THEN n.value ELSE f.kv END, CASE WHEN n.value <> f.kv OR abs(n.confidence - f.kc) > 0.01 THEN n.confidence ELSE f.kc END
  FROM f JOIN n ON n.o_custkey = f.o_custkey AND n.i = f.i + 1),
v AS (SELECT o_custkey, value, confidence, CAST(valid_from AS TIMESTAMP) AS valid_from, CAST(lead(valid_from) OVER (PARTITION BY o_custkey ORDER BY valid_from) AS TIMESTAMP) AS valid_to FROM f WHERE keep) """


def _merged(spark, sf_dir) -> DataFrame:
    return scd2.merge(None, _staged(spark, sf_dir), ["o_custkey"], ["value"], ["confidence"], ["valid_from"])


@query(_MERGED + "SELECT o_custkey, value, round(confidence, 6) AS confidence, valid_from, valid_to FROM v")
def scd2_merge_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute versions: closed when value changes or confidence drifts by over 0.01 from the kept version."""
    return _merged(spark, sf_dir).select("o_custkey", "value", F.round("confidence", 6).alias("confidence"), "valid_from", "valid_to")


@query(f"""WITH day AS (SELECT l_suppkey, l_shipdate AS valid_from, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2), l AS (SELECT *, lag(flag) OVER (PARTITION BY l_suppkey ORDER BY valid_from) AS was FROM day)
SELECT l_suppkey, flag, CAST(valid_from AS TIMESTAMP) AS valid_from, CAST(lead(valid_from) OVER (PARTITION BY l_suppkey ORDER BY valid_from) AS TIMESTAMP) AS valid_to FROM l WHERE was IS NULL OR was <> flag""")
def scd2_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge versions of suppliers by return flag; half are stored first, the rest is merged into them."""
    day = V.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_shipdate").alias("valid_from")).agg(F.min("l_returnflag").alias("flag"))
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    args = (["l_suppkey"], ["flag"], [], ["valid_from"])
    stored = scd2.merge(None, day.filter(F.col("valid_from") < cut), *args)
    return scd2.merge(stored, day.filter(F.col("valid_from") >= cut), *args).select("l_suppkey", "flag", "valid_from", "valid_to")


@query(_MERGED + "SELECT o_custkey, value FROM v WHERE valid_to IS NULL")
def scd2_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _merged(spark, sf_dir)
    return scd2.latest(rows, ["o_custkey"], [F.desc("valid_from")]).select("o_custkey", "value")


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, o_orderdate + INTERVAL 60 DAY AS valid_to FROM orders),
y AS (SELECT *, max(valid_to) OVER (PARTITION BY o_custkey ORDER BY valid_from, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM x) SELECT o_custkey, o_orderkey FROM y WHERE e > valid_from""")
def scd2_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order periods of 60 days that start within an earlier one of the same customer."""
    o = V.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("interval 60 days")).alias("valid_to"))
    return scd2.overlaps(o, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query(f"WITH {V.EDGES} SELECT src_syn_id, dst_syn_id, CASE WHEN valid_to IS NULL AND rel_type = 'SUPPLIES' AND right(src_syn_id, 1) = '3' THEN TIMESTAMP '2002-01-01' ELSE valid_to END AS valid_to FROM ed")
def scd2_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.edges(spark, sf_dir)
    keys = e.filter((F.col("rel_type") == "SUPPLIES") & F.col("src_syn_id").endswith("3"))
    return scd2.close(e, keys, ["src_syn_id", "dst_syn_id", "rel_type"], F.lit("2002-01-01").cast("timestamp_ntz")).select("src_syn_id", "dst_syn_id", "valid_to")


@query(f"WITH {V.ENTITIES}, x AS (SELECT CASE WHEN right(syn_id, 1) = '5' THEN substr(syn_id, 1, 28) WHEN right(syn_id, 1) = '6' THEN 'XX' || substr(syn_id, 3) ELSE syn_id END AS syn_id, type FROM en) SELECT syn_id, right(syn_id, 1) NOT IN ('6') AND length(syn_id) = 29 AS valid, CASE WHEN right(syn_id, 1) NOT IN ('6') AND length(syn_id) = 29 THEN type END AS type FROM x")
def entity_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.entities(spark, sf_dir)
    last = F.substring("syn_id", -1, 1)
    e = e.select(F.when(last == "5", F.substring("syn_id", 1, 28)).when(last == "6", F.concat(F.lit("XX"), F.substring("syn_id", 3, 40))).otherwise(F.col("syn_id")).alias("syn_id"))
    return e.select("syn_id", idf.id_valid(F.col("syn_id")).alias("valid"), idf.id_type(F.col("syn_id")).alias("type"))


def _tickers(spark, sf_dir) -> DataFrame:
    """Identifiers whose values look like tickers: their letters."""
    return V.identifiers(spark, sf_dir).withColumn("value", F.regexp_replace("value", "[^A-Z]", ""))


def _ticker_mentions(spark, sf_dir) -> DataFrame:
    return _tickers(spark, sf_dir).select(F.col("value").alias("text")).distinct().select(F.xxhash64("text").alias("mention_id"), "text")


def _cascade_mentions(spark, sf_dir) -> DataFrame:
    """Part names and tickers, stored once for a session: every strategy reads them, and making them reads all orders."""
    made = V.mentions(spark, sf_dir).unionByName(_ticker_mentions(spark, sf_dir))
    return spark.read.schema(made.schema).parquet(V.stored_once(spark, sf_dir, "cascade-mentions", "_SUCCESS", lambda p: made.write.mode("overwrite").parquet(p)))


@query(f"""WITH {V.ENTITIES}, {V.IDENTIFIERS}, t AS (SELECT syn_id, upper(substr(value, 1, 3)) AS value FROM ids WHERE valid_to IS NULL), m AS (SELECT value AS text FROM t UNION SELECT '  ' || value || chr(9) || chr(160) FROM t)
SELECT DISTINCT m.text, en.syn_id, 1.0 AS confidence FROM m JOIN t ON t.value = trim(m.text, ' ' || chr(9) || chr(160)) JOIN en ON en.syn_id = t.syn_id WHERE en.status = 'ACTIVE' AND regexp_matches(t.value, '^[A-Z]{{1,5}}(\\.[A-Z])?$')""")
def link_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = V.identifiers(spark, sf_dir).withColumn("value", F.substring("value", 1, 3))
    held = F.upper("value")
    m = i.filter("valid_to is null").select(F.explode(F.array(held, F.concat(F.lit("  "), held, F.lit("\t\u00a0")))).alias("text")).distinct().withColumn("mention_id", F.col("text"))
    return linker.ticker_candidates(m, i, V.entities(spark, sf_dir)).select(F.col("mention_id").alias("text"), "syn_id", "confidence")


_CONF = "CASE WHEN al.confidence IS NULL OR al.confidence = 0 THEN 1.0 ELSE al.confidence END"
_NORM = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


@query(f"""WITH {V.ENTITIES}, {V.ALIASES}, {V.MENTIONS}, c AS (SELECT DISTINCT mention_id, al.syn_id, least({_CONF}, 0.95) AS confidence FROM mn JOIN al ON al.alias = {_NORM} JOIN en ON en.syn_id = al.syn_id WHERE status = 'ACTIVE'),
r AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY confidence DESC, syn_id) AS k FROM c) SELECT mention_id, syn_id, round(confidence, 6) AS confidence FROM r WHERE k <= 10""")
def link_alias_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linker.alias_candidates(V.mentions(spark, sf_dir), V.aliases(spark, sf_dir), V.entities(spark, sf_dir)).select("mention_id", "syn_id", F.round("confidence", 6).alias("confidence"))


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: length(w) > 0), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH {V.ENTITIES}, {V.ALIASES}, {V.MENTIONS}, m AS (SELECT mention_id, {_GRAMS.format(x=_NORM)} AS g FROM mn), a AS (SELECT alias, {_GRAMS.format(x='alias')} AS h FROM (SELECT DISTINCT alias FROM al)),
p AS (SELECT mention_id, alias, len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) AS sim FROM m, a),
c AS (SELECT DISTINCT mention_id, al.syn_id, sim, least(CASE WHEN sim >= 0.9 THEN 0.9 WHEN sim >= 0.8 THEN 0.8 ELSE 0.7 END, {_CONF}) AS confidence FROM p JOIN al USING (alias) JOIN en ON en.syn_id = al.syn_id WHERE sim >= 0.3 AND status = 'ACTIVE'),
r AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY sim DESC, syn_id, confidence DESC) AS k FROM c) SELECT mention_id, syn_id, round(confidence, 6) AS confidence, round(sim, 6) AS similarity FROM r WHERE k <= 10""")
def link_alias_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = linker.fuzzy_candidates(V.mentions(spark, sf_dir), V.aliases(spark, sf_dir), V.entities(spark, sf_dir))
    return c.select("mention_id", "syn_id", F.round("confidence", 6).alias("confidence"), F.round("similarity", 6).alias("similarity"))


@query()
def link_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linker.canonical_candidates(V.mentions(spark, sf_dir), V.entities(spark, sf_dir), V.canonical_index(spark, sf_dir)).select("mention_id", "syn_id", F.round("confidence", 6).alias("confidence"))


def _ranked(spark, sf_dir) -> DataFrame:
    m, e, a = _cascade_mentions(spark, sf_dir), V.entities(spark, sf_dir), V.aliases(spark, sf_dir)
    return linker.cascade([linker.ticker_candidates(m, _tickers(spark, sf_dir), e), linker.alias_candidates(m, a, e), linker.canonical_candidates(m, e, V.canonical_index(spark, sf_dir)), linker.fuzzy_candidates(m, a, e)])


@query()
def link_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _cascade_mentions(spark, sf_dir)
    return linker.decide(m, _ranked(spark, sf_dir)).select("mention_id", "text", "resolved_id", F.round("confidence", 6).alias("confidence"), "reason")


@query("""WITH x AS (SELECT l_orderkey, l_partkey, max(l_discount * 10) AS c FROM lineitem GROUP BY 1, 2), k AS (SELECT l_orderkey, c, row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, l_partkey) AS i FROM x),
t AS (SELECT l_orderkey, max(CASE WHEN i = 1 THEN c END) AS c1, max(CASE WHEN i = 2 THEN c END) AS c2, count(*) AS n FROM k GROUP BY 1)
SELECT l_orderkey AS mention_id, CASE WHEN c1 >= 0.95 THEN NULL WHEN c1 - c2 < 0.1 THEN 'Ambiguous: ' || n || ' candidates with similar confidence' ELSE printf('Low confidence: best=%.2f < threshold=0.95', c1) END AS reason FROM t""")
def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why orders as mentions stay unresolved, with their parts as candidates and discount as confidence."""
    c = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mention_id"), F.format_string("%020d", "l_partkey").alias("syn_id"), F.lit("").alias("name"), (F.col("l_discount") * 10).alias("confidence"))
    m = c.select("mention_id").distinct().withColumn("text", F.lit(""))
    return linker.decide(m, linker.dedup(c)).select("mention_id", "reason")


@query("""WITH x AS (SELECT l_orderkey, l_partkey, max(l_discount) AS c FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey AS mention_id, l_partkey AS syn_id, round(c, 6) AS confidence, row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, l_partkey) AS rank FROM x""")
def candidate_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mention_id"), F.col("l_partkey").alias("syn_id"), F.lit("").alias("name"), F.col("l_discount").alias("confidence"))
    return linker.dedup(c).select("mention_id", "syn_id", F.round("confidence", 6).alias("confidence"), F.col("rank").cast("long").alias("rank"))


_CASES = "c AS (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS expected, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END END AS resolved, 0.5 + (o_orderkey % 50) / 100.0 AS conf FROM orders)"
_CAL = f"""WITH {_CASES}, s AS (SELECT count(*) FILTER (WHERE expected = resolved) AS tp, count(*) FILTER (WHERE resolved IS NOT NULL AND (expected IS NULL OR expected <> resolved)) AS fp, count(*) FILTER (WHERE expected IS NULL AND resolved IS NULL) AS tn,
  count(*) FILTER (WHERE expected IS NOT NULL AND resolved IS NULL) AS fn, avg(CASE WHEN expected IS NOT NULL AND resolved IS NOT NULL THEN power(conf - CASE WHEN expected = resolved THEN 1.0 ELSE 0.0 END, 2) END) AS brier FROM c) """


def _cases(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return V.table(spark, sf_dir, "orders").select(F.when(k % 5 != 0, F.col("o_custkey")).alias("expected"), F.when(k % 7 != 0, F.col("o_custkey") + F.when(k % 11 == 0, 1).otherwise(0)).alias("resolved"), (F.lit(0.5) + (k % 50) / 100.0).alias("confidence"))


def _calibrated(spark, sf_dir) -> DataFrame:
    return linker.calibration(_cases(spark, sf_dir))


@query(_CAL + "SELECT tp, fp, tn, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(brier, 6) AS brier, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s")
def calibration_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir).select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy", "brier", "f1")])


@query(_CAL + "SELECT tp / (tp + fp) >= 0.95 AS precision_ok, tp / (tp + fn) >= 0.70 AS recall_ok, brier <= 0.10 AS brier_ok FROM s")
def calibration_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linker.gates(_calibrated(spark, sf_dir))


@query(f"""WITH {V.ENTITIES}, w AS (SELECT syn_id, canonical_name, list_transform(string_split(replace(lower(canonical_name), '#', ' '), ' '), lambda x: CASE WHEN x IN ('widget', 'widgets') THEN 'widget' ELSE x END) AS w FROM en),
h AS (SELECT *, len(list_filter(w, lambda x: x IN ('red', 'widget'))) AS hits, least(list_position(w, 'red'), list_position(w, 'widget')) AS first FROM w WHERE list_contains(w, 'red') AND list_contains(w, 'widget'))
SELECT syn_id, canonical_name, round(hits / (len(w) + first - 1), 6) AS rank FROM h ORDER BY rank DESC, canonical_name, syn_id LIMIT 20""")
def search_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full-text query against the stored index of all names."""
    return registry.search(V.entities(spark, sf_dir), "the red widgets", 20, V.name_index(spark, sf_dir)).select("syn_id", "canonical_name", F.round("rank", 6).alias("rank"))


@query(f"""WITH {V.ENTITIES}, w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS lexeme FROM part WHERE p_partkey % 10 <> 9),
e AS (SELECT syn_id, list_distinct(string_split(lower(canonical_name), ' ')) AS w, string_split(lower(canonical_name), ' ') AS every FROM en WHERE type = 'COMMODITY')
SELECT CASE lexeme WHEN 'large' THEN 'larg' ELSE lexeme END AS lexeme, count(*) AS texts, CAST(sum(list_position(every, lexeme)) AS BIGINT) AS first_positions FROM w JOIN e ON list_contains(e.w, lexeme) GROUP BY lexeme""")
def name_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index by lexeme: how many part names have it, and where."""
    index = V.name_index(spark, sf_dir).filter("id like 'CM_%'")
    live = index.filter(F.substring("id", -1, 1) != "9").select("lexeme").distinct()
    return index.join(live, "lexeme", "left_semi").groupBy("lexeme").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("positions")[0]).cast("long").alias("first_positions"))


@query(f"WITH {V.ENTITIES}, {V.EDGES} SELECT src_syn_id, dst_syn_id FROM ed WHERE src_syn_id NOT IN (SELECT syn_id FROM en WHERE status = 'INACTIVE')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = V.entities(spark, sf_dir).filter("status = 'INACTIVE'")
    return registry.cascade_delete(V.edges(spark, sf_dir), "src_syn_id", gone, "syn_id").select("src_syn_id", "dst_syn_id")


_GOOD = "'{p}_' || lpad(CAST({k} AS VARCHAR), {n}, '0')"


def _new_entities(spark, sf_dir) -> DataFrame:
    """Suppliers as new entities with planted faults."""
    k = F.col("s_suppkey")
    return V.table(spark, sf_dir, "supplier").select(idf.make_id("OR", k + 1_000_000).alias("syn_id"), F.when(k % 5 == 1, "PLANET").otherwise("ORG").alias("type"), F.when(k % 5 == 2, " ").otherwise(F.concat(F.lit(" "), "s_name")).alias("canonical_name"), F.when(k % 5 == 3, "GONE").when(k % 5 == 4, None).otherwise("ACTIVE").alias("status"))


@query(f"""WITH {V.ENTITIES}, n AS (SELECT s_suppkey AS k, {_GOOD.format(p="OR", k="s_suppkey + 1000000", n=26)} AS syn_id, s_name FROM supplier)
SELECT syn_id, canonical_name, status, CAST(NULL AS VARCHAR) AS error FROM en UNION ALL SELECT syn_id, s_name, 'ACTIVE', NULL FROM n WHERE k % 5 IN (0, 4)
UNION ALL SELECT syn_id, CASE WHEN k % 5 = 2 THEN ' ' ELSE ' ' || s_name END, CASE WHEN k % 5 = 3 THEN 'GONE' ELSE 'ACTIVE' END, CASE k % 5 WHEN 1 THEN 'unknown type' WHEN 2 THEN 'no name' ELSE 'unknown status' END FROM n WHERE k % 5 IN (1, 2, 3)""")
def insert_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, bad = store.insert_entities(V.entities(spark, sf_dir), _new_entities(spark, sf_dir))
    return table.select("syn_id", "canonical_name", "status", F.lit(None).cast("string").alias("error")).unionByName(bad.select("syn_id", "canonical_name", "status", "error"))


@query(f"""WITH {V.ALIASES}, n AS (SELECT p_partkey AS k, {_GOOD.format(p="CM", k="p_partkey", n="CASE WHEN p_partkey % 4 = 1 THEN 20 ELSE 26 END")} AS syn_id, p_name, CASE WHEN p_partkey % 4 = 2 THEN 1.5 WHEN p_partkey % 4 = 0 THEN 0.5 END AS c FROM part)
SELECT syn_id, alias, round(confidence, 6) AS confidence, CAST(NULL AS VARCHAR) AS error FROM al UNION ALL SELECT syn_id, p_name, coalesce(c, 1.0), NULL FROM n WHERE k % 4 IN (0, 3)
UNION ALL SELECT syn_id, ' ' || p_name, coalesce(c, 1.0), CASE k % 4 WHEN 1 THEN 'bad syn_id' ELSE 'confidence not in 0..1' END FROM n WHERE k % 4 IN (1, 2)""")
def insert_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    new = V.table(spark, sf_dir, "part").select(F.when(k % 4 == 1, F.concat(F.lit("CM_"), F.lpad(k.cast("string"), 20, "0"))).otherwise(idf.make_id("CM", k)).alias("syn_id"), F.concat(F.lit(" "), "p_name").alias("alias"), F.when(k % 4 == 2, 1.5).when(k % 4 == 0, 0.5).alias("confidence"))
    table, bad = store.insert_aliases(V.aliases(spark, sf_dir), new)
    out = table.withColumn("error", F.lit(None).cast("string")).unionByName(bad.select("syn_id", "alias", "confidence", "error"))
    return out.withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {V.IDENTIFIERS}, o AS (SELECT * FROM ids WHERE valid_to IS NULL), n AS (SELECT 'CO_' || lpad(CAST(c_custkey AS VARCHAR), 26, '0') AS syn_id, CASE WHEN c_custkey % 3 = 1 THEN 'NICK' ELSE 'TICKER' END AS scheme, 'X' || (c_custkey - c_custkey % 2) AS value, c_custkey AS k FROM customer)
SELECT syn_id, scheme, value, CASE WHEN k % 3 = 1 THEN 'unknown scheme' WHEN EXISTS (SELECT 1 FROM o WHERE o.scheme = n.scheme AND o.value = n.value AND o.syn_id <> n.syn_id) THEN 'another entity holds the value'
  WHEN NOT EXISTS (SELECT 1 FROM o WHERE o.scheme = n.scheme AND o.value = n.value) AND EXISTS (SELECT 1 FROM n x WHERE x.k % 3 <> 1 AND x.scheme = n.scheme AND x.value = n.value AND x.syn_id < n.syn_id) THEN 'another entity holds the value' END AS error FROM n
  UNION ALL SELECT syn_id, scheme, value, 'another entity holds the value' FROM n WHERE k % 3 <> 1 AND k % 5 = 0 AND (EXISTS (SELECT 1 FROM o WHERE o.scheme = n.scheme AND o.value = n.value AND o.syn_id <> n.syn_id)
    OR EXISTS (SELECT 1 FROM n x WHERE x.k % 3 <> 1 AND x.scheme = n.scheme AND x.value = n.value AND x.syn_id < n.syn_id))
  UNION ALL SELECT syn_id, scheme, value, 'unknown scheme' FROM n WHERE k % 3 = 1 AND k % 5 = 0""")
def insert_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New identifiers of all customers, two of whom ask for each value and some of whom ask twice: which go in, and why the others don't."""
    k = F.col("c_custkey")
    new = V.table(spark, sf_dir, "customer").select(idf.make_id("CO", k).alias("syn_id"), F.when(k % 3 == 1, "NICK").otherwise("TICKER").alias("scheme"), F.concat(F.lit("X"), k - k % 2).alias("value"), F.lit("2030-01-01").cast("timestamp_ntz").alias("valid_from"))
    new = new.unionByName(new.filter(F.substring("syn_id", -1, 1).isin("0", "5")).withColumn("value", F.concat(F.lit(" "), "value", F.lit(" "))))
    i = V.identifiers(spark, sf_dir)
    table, bad = store.insert_identifiers(i, new)
    fresh = table.filter("valid_from = timestamp_ntz'2030-01-01'").select("syn_id", "scheme", "value", F.lit(None).cast("string").alias("error"))
    return fresh.unionByName(bad.select("syn_id", "scheme", F.trim("value").alias("value"), "error"))


@query(f"""WITH e AS (SELECT s_suppkey AS k, {_GOOD.format(p="OR", k="s_suppkey", n=26)} AS src_syn_id, CASE WHEN s_suppkey % 6 = 1 THEN 'XX_1' WHEN s_suppkey % 6 = 2 THEN {_GOOD.format(p="OR", k="s_suppkey", n=26)} ELSE {_GOOD.format(p="CM", k="s_suppkey", n=26)} END AS dst_syn_id FROM supplier)
SELECT src_syn_id, CASE k % 6 WHEN 1 THEN 'bad dst_syn_id' WHEN 2 THEN 'source is destination' WHEN 3 THEN 'unknown relation' WHEN 4 THEN 'confidence not in 0..1' END AS error FROM e""")
def edge_input_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    own = idf.make_id("OR", k)
    e = V.table(spark, sf_dir, "supplier").select(own.alias("src_syn_id"), F.when(k % 6 == 1, "XX_1").when(k % 6 == 2, own).otherwise(idf.make_id("CM", k)).alias("dst_syn_id"), F.when(k % 6 == 3, "LIKES").otherwise("SUPPLIES").alias("rel_type"), F.when(k % 6 == 4, -0.1).otherwise(0.5).alias("confidence"))
    return e.select("src_syn_id", store.edge_error().alias("error"))


@query(f"""WITH {V.ATTRIBUTES} SELECT syn_id, key, CASE WHEN key = 'SEGMENT' AND right(syn_id, 1) = '3' THEN 'value isn''t of the datatype' WHEN key = 'PROFILE' AND right(syn_id, 1) = '4' THEN 'value isn''t JSON' WHEN key = 'BALANCE' AND right(syn_id, 1) = '5' THEN 'unknown datatype' END AS error FROM att""")
def attribute_input_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.substring("syn_id", -1, 1)
    a = V.attributes(spark, sf_dir).withColumns({
        "value_string": F.when((F.col("key") == "SEGMENT") & (last == "3"), None).otherwise(F.col("value_string")), "value_json": F.when((F.col("key") == "PROFILE") & (last == "4"), "{no json").otherwise(F.col("value_json")),
        "datatype": F.when((F.col("key") == "BALANCE") & (last == "5"), "DATE").otherwise(F.col("datatype")),
    })
    return a.select("syn_id", "key", store.attribute_error().alias("error"))


@query(f"""WITH {V.ATTRIBUTES}, o AS (SELECT *, TIMESTAMP '1995-01-01' AS valid_from FROM att WHERE valid_to IS NULL), c AS (SELECT * FROM o WHERE (key = 'SEGMENT' AND value_string <> 'BUILDING') OR (key = 'BALANCE' AND value_number <> round(value_number)))
SELECT syn_id, key, CASE WHEN key = 'SEGMENT' THEN value_string END AS value_string, CAST(valid_from AS TIMESTAMP) AS valid_from, CASE WHEN (syn_id, key) IN (SELECT (syn_id, key) FROM c) THEN TIMESTAMP '2001-01-01' ELSE valid_to END AS valid_to FROM (SELECT *, TIMESTAMP '1995-01-01' AS valid_from FROM att)
UNION ALL SELECT syn_id, key, CASE WHEN key = 'SEGMENT' THEN 'BUILDING' END, TIMESTAMP '2001-01-01', NULL FROM c""")
def attribute_upsert_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open attributes staged again: segments all set to BUILDING, balances rounded, profiles with their JSON keys in another order, which is no change."""
    a = V.attributes(spark, sf_dir)
    staged = a.filter("valid_to is null").withColumns({
        "value_string": F.when(F.col("key") == "SEGMENT", "BUILDING"), "value_number": F.round("value_number"), "valid_from": F.lit("2001-01-01").cast("timestamp_ntz"),
        "value_json": F.regexp_replace("value_json", r'\{("segment": "[^"]*"), ("nation": \d+)\}', "{ $2,  $1 }"),
    })
    tidy = lambda d: d.withColumn("value_json", store.no_empty_json(F.col("value_json")))
    exact = ["datatype", "value_string", "value_number", "value_json", "source"]
    return scd2.merge(tidy(a), tidy(staged), ["syn_id", "key"], exact, ["confidence"], ["valid_from"]).select("syn_id", "key", "value_string", "valid_from", "valid_to")


@query(f"""WITH {V.EDGES}, n AS (SELECT count(*) AS open FROM ed WHERE valid_to IS NULL AND rel_type = 'BELONGS_TO' AND left(src_syn_id, 2) = 'SC')
SELECT 'good' AS batch, true AS applied, CAST(open AS BIGINT) AS n FROM n UNION ALL SELECT 'late', false, CAST(open AS BIGINT) FROM n UNION ALL SELECT 'faulty', false, 1 FROM n""")
def atomic_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over the nations' edges: one is applied (versions updated), two are refused as a whole (rows at fault)."""
    e = V.edges(spark, sf_dir).filter("valid_to is null and rel_type = 'BELONGS_TO' and src_syn_id like 'SC%'").withColumn("valid_from", F.col("observed_at"))
    keys, at = ["src_syn_id", "dst_syn_id", "rel_type"], F.lit("2002-01-01").cast("timestamp_ntz")
    staged = e.drop("valid_to", "observed_at").withColumns({"confidence": F.lit(0.5), "valid_from": at})
    first = staged.agg(F.min("src_syn_id")).first()[0]
    batches = {"good": staged, "late": staged.withColumn("valid_from", F.lit("1990-01-01").cast("timestamp_ntz")), "faulty": staged.withColumn("confidence", F.when(F.col("src_syn_id") == first, 7.0).otherwise(F.col("confidence")))}
    out = None
    for name, rows in batches.items():
        merged, errors = scd2.merge_batch(e, rows, keys, [], ["confidence"], ["valid_from"], store.edge_error())
        counted = (errors if merged is None else merged.filter("action = 'updated'")).agg(F.count(F.lit(1)).alias("n"))
        part = counted.select(F.lit(name).alias("batch"), F.lit(merged is not None).alias("applied"), "n")
        out = part if out is None else out.unionAll(part)
    return out


@query(f"WITH {V.QUARANTINE} SELECT resolved_syn_id IS NOT NULL AS resolved, count(*) AS n FROM qu GROUP BY 1")
def quarantine_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.quarantine_totals(V.quarantine(spark, sf_dir))


@query(f"WITH {V.QUARANTINE} (SELECT 'open' AS kind, id, raw_identifier FROM qu WHERE resolved_syn_id IS NULL ORDER BY ingested_at DESC, id LIMIT 100 OFFSET 50) UNION ALL (SELECT 'resolved', id, raw_identifier FROM qu WHERE resolved_syn_id IS NOT NULL ORDER BY resolved_at DESC, id LIMIT 100)")
def quarantine_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.quarantine(spark, sf_dir)
    part = lambda kind, rows: rows.select(F.lit(kind).alias("kind"), "id", "raw_identifier")
    return part("open", store.quarantine_items(q, False, 100, 50)).unionAll(part("resolved", store.quarantine_items(q, True)))


@query(f"""WITH {V.QUARANTINE} SELECT id, CASE WHEN resolved_syn_id IS NULL AND id % 3 = 0 THEN 'CO_' || lpad(CAST(id AS VARCHAR), 26, '0') ELSE resolved_syn_id END AS resolved_syn_id,
  CASE WHEN resolved_syn_id IS NULL AND id % 3 = 0 THEN 'me' ELSE resolved_by END AS resolved_by, CASE WHEN id % 3 = 1 THEN 'bad syn_id' WHEN id % 3 = 0 AND resolved_syn_id IS NOT NULL THEN 'not found or resolved' END AS error FROM qu""")
def quarantine_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all items decided well, a third with a bad id; those resolved before stay as they are."""
    q, i = V.quarantine(spark, sf_dir), F.col("id")
    asked = q.filter(i % 3 != 2).select("id", F.when(i % 3 == 0, idf.make_id("CO", i)).otherwise(F.lit("nobody")).alias("syn_id"), F.lit("me").alias("resolved_by"), F.lit("2003-01-01").cast("timestamp_ntz").alias("resolved_at"))
    rows, errors = store.resolve_items(q, asked)
    return rows.join(errors.select("id", "error"), "id", "left").select("id", "resolved_syn_id", "resolved_by", "error")


@query(f"""WITH {V.ENTITIES}, s AS (SELECT syn_id, CAST(substr(syn_id, 4) AS BIGINT) AS k, status FROM en WHERE type = 'ORG')
SELECT syn_id, CASE WHEN k % 4 = 1 THEN 'MERGED' ELSE status END AS status, CASE WHEN k % 4 = 0 AND k + 1 IN (SELECT k FROM s) THEN 'OR_' || lpad(CAST(k + 1 AS VARCHAR), 26, '0') END AS replaces FROM s""")
def merge_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth supplier merged into the one before it."""
    e = V.entities(spark, sf_dir).filter("type = 'ORG'")
    k = F.substring("syn_id", 4, 26).cast("long")
    pairs = e.filter(k % 4 == 1).select(F.col("syn_id").alias("from_syn_id"), idf.make_id("OR", k - 1).alias("into_syn_id"))
    return store.merge_entities(e, pairs).select("syn_id", "status", F.get("replaces_syn_id", F.lit(0)).alias("replaces"))


@query(f"WITH {V.EDGES} SELECT rel_type, count(*) AS edges FROM (SELECT DISTINCT src_syn_id, dst_syn_id, rel_type FROM ed WHERE valid_to IS NULL AND rel_type IN ('LISTED_ON', 'BELONGS_TO')) GROUP BY 1")
def edge_refresh_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.refresh_counts(V.edges(spark, sf_dir), ["LISTED_ON", "BELONGS_TO"])


@query(f"""WITH {V.ENTITIES}, {V.IDENTIFIERS}, h AS (SELECT ids.*, row_number() OVER (PARTITION BY value ORDER BY valid_from DESC, syn_id) AS k FROM ids WHERE valid_from <= TIMESTAMP '{ASOF}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{ASOF}')),
w AS (SELECT value, syn_id FROM h JOIN en USING (syn_id) WHERE k = 1), p AS (SELECT DISTINCT substr(o_orderpriority, 3, 3) || (o_custkey % 50) AS a, substr(o_orderpriority, 3, 3) || (o_custkey % 60) AS b FROM orders)
SELECT x.syn_id AS src_syn_id, y.syn_id AS dst_syn_id, 'LISTED_ON' AS rel_type FROM p JOIN w x ON x.value = a JOIN w y ON y.value = b""")
def seed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tickers as edges between the entities that hold them at a time; a missing end drops the pair."""
    o = V.table(spark, sf_dir, "orders")
    value = lambda n: F.concat(F.substring("o_orderpriority", 3, 3), F.col("o_custkey") % n)
    pairs = o.select(value(50).alias("a"), value(60).alias("b")).distinct()
    e = registry.seed_edges(pairs, ("a", "TICKER"), ("b", "TICKER"), "LISTED_ON", V.identifiers(spark, sf_dir), V.entities(spark, sf_dir), F.lit(ASOF).cast("timestamp_ntz"))
    return e.select("src_syn_id", "dst_syn_id", "rel_type")


@query(f"WITH {V.IDENTIFIERS} SELECT DISTINCT a.value || a.syn_id AS mention_id, b.syn_id FROM ids a JOIN ids b ON a.scheme = b.scheme AND a.value = b.value WHERE a.valid_to IS NOT NULL AND b.valid_to IS NULL")
def link_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed identifiers as mentions, and who holds them now."""
    i = V.identifiers(spark, sf_dir)
    m = i.filter("valid_to is not null").select(F.concat("value", "syn_id").alias("mention_id"), "scheme", "value")
    return linker.identifier_candidates(m, i)


@query(f"WITH {V.ALIASES} SELECT syn_id, alias, CAST(row_number() OVER (PARTITION BY alias ORDER BY confidence DESC NULLS FIRST, syn_id) AS BIGINT) AS k FROM al")
def aliases_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alias' holders in order: those without a confidence first, then the surest."""
    return registry.rank_in(V.aliases(spark, sf_dir), ["alias"], [F.desc_nulls_first("confidence"), F.col("syn_id")], 1 << 30).select("syn_id", "alias", F.col("rank").cast("long").alias("k"))


@query(f"WITH {V.ATTRIBUTES} SELECT syn_id, key, datatype, value_string, value_number FROM att WHERE valid_to IS NULL")
def attributes_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.attributes_of(V.attributes(spark, sf_dir)).select("syn_id", "key", "datatype", "value_string", "value_number")


@query(f"WITH {V.ATTRIBUTES} SELECT syn_id, key, valid_to FROM att WHERE key = 'SEGMENT'")
def attributes_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.attributes_of(V.attributes(spark, sf_dir), key="SEGMENT", active_only=False).select("syn_id", "key", "valid_to")


@query(f"WITH {V.ENTITIES}, {V.EDGES} {_OUT} WHERE rel_type = 'SUPPLIES' AND observed_at <= TIMESTAMP '{ASOF}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{ASOF}')")
def edges_of_relation_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.edges(spark, sf_dir).withColumn("valid_from", F.col("observed_at"))
    return registry.neighbours(e, V.entities(spark, sf_dir), "out", "SUPPLIES", at=F.lit(ASOF).cast("timestamp_ntz")).select("syn_id", "related_id", "direction", "rel_type", "related_name")


@query(f"WITH {_CASES} SELECT CASE WHEN expected = resolved THEN 'tp' WHEN expected IS NOT NULL AND resolved IS NULL THEN 'fn' WHEN expected IS NULL AND resolved IS NULL THEN 'tn' ELSE 'fp' END AS verdict, count(*) AS n, round(avg(CASE WHEN expected IS NOT NULL AND resolved IS NOT NULL THEN power(conf - CASE WHEN expected = resolved THEN 1.0 ELSE 0.0 END, 2) END), 6) AS brier FROM c GROUP BY 1")
def case_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linker.case_verdicts(_cases(spark, sf_dir)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("brier"), 6).alias("brier"))


@query(f"WITH {V.EDGES}, x AS (SELECT src_syn_id, dst_syn_id, confidence * 1.5 AS c, observed_at, valid_to FROM ed) SELECT src_syn_id, dst_syn_id, CASE WHEN valid_to <= observed_at THEN 'ends before it starts' ELSE 'confidence not in 0..1' END AS violation FROM x WHERE valid_to <= observed_at OR NOT c BETWEEN 0 AND 1")
def check_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose confidence is raised by half, and that end when they are observed."""
    e = V.edges(spark, sf_dir).withColumns({"confidence": F.col("confidence") * 1.5, "valid_from": F.col("observed_at")})
    return store.check_violations(e).select("src_syn_id", "dst_syn_id", "violation")


@query("""SELECT p_name AS name, 'old' AS origin FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_name, min('new' || p_size) FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0) GROUP BY p_name""")
def seed_insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names, many of them repeated, seeded into a table that has some: known ones are left alone, and each new one goes in once."""
    p = V.table(spark, sf_dir, "part")
    have = p.filter("p_partkey % 2 = 0").select(F.col("p_name").alias("name"), F.lit("old").alias("origin"))
    return registry.insert_missing(have, p.select(F.col("p_name").alias("name"), F.concat(F.lit("new"), "p_size").alias("origin")), ["name"])


@query("""WITH RECURSIVE d AS (SELECT l_suppkey AS s, l_partkey % 20 AS p, l_shipdate AS t, min(l_returnflag) AS flag, min(l_linestatus) AS st, min(l_discount) * 0.3 AS c FROM lineitem GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY s, p ORDER BY t) AS i FROM d),
f AS (SELECT s, p, t, flag, st, c, i, true AS keep, flag AS lf, st AS ls, c AS lc FROM n WHERE i = 1
  UNION ALL SELECT n.s, n.p, n.t, n.flag, n.st, n.c, n.i, n.flag <> lf OR n.st <> ls OR abs(n.c - lc) > 0.01, CASE WHEN n.flag <> lf OR n.st <> ls OR abs(n.c - lc) > 0.01 THEN n.flag ELSE lf END,
    CASE WHEN n.flag <> lf OR n.st <> ls OR abs(n.c - lc) > 0.01 THEN n.st ELSE ls END, CASE WHEN n.flag <> lf OR n.st <> ls OR abs(n.c - lc) > 0.01 THEN n.c ELSE lc END FROM f JOIN n ON n.s = f.s AND n.p = f.p AND n.i = f.i + 1)
SELECT s AS supplier, p AS part, '{"flag":"' || flag || '"}' AS attrs, st AS evidence, round(c, 6) AS confidence, CAST(t AS TIMESTAMP) AS valid_from, CAST(t AS TIMESTAMP) + INTERVAL 1 DAY AS observed_at,
  CAST(lead(t) OVER (PARTITION BY s, p ORDER BY t) AS TIMESTAMP) AS valid_to FROM f WHERE keep""")
def edge_upsert_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge versions by attrs, evidence and a drifting confidence, with when they were observed; half are stored first, the rest is merged into them."""
    li = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), (F.col("l_partkey") % 20).alias("part"), F.col("l_shipdate").alias("valid_from"))
    day = li.agg(F.format_string('{ "flag" : "%s" }', F.min("l_returnflag")).alias("attrs"), F.min("l_linestatus").alias("evidence"), (F.min("l_discount") * 0.3).alias("confidence"))
    day = day.withColumns({"attrs": store.no_empty_json(F.col("attrs")), "observed_at": F.col("valid_from") + F.expr("interval 1 day")})
    cut, args = F.lit("1997-01-01").cast("timestamp_ntz"), (["supplier", "part"], ["attrs", "evidence"], ["confidence"], ["valid_from"], ["observed_at"])
    first = scd2.merge(None, day.filter(F.col("valid_from") < cut), *args)
    path = V.shared_path(spark, "edge-versions")  # the merge reads what is stored twice, for its open rows and the others
    first.write.parquet(path)
    stored = spark.read.schema(first.schema).parquet(path)
    return scd2.merge(stored, day.filter(F.col("valid_from") >= cut), *args).drop("action").withColumn("confidence", F.round("confidence", 6))


@query("SELECT 'COMPANY' AS type, count(*) AS n FROM customer UNION ALL SELECT 'COMMODITY', count(*) FROM part UNION ALL SELECT 'ORG', count(*) FROM supplier UNION ALL SELECT 'SECTOR', count(*) FROM nation UNION ALL SELECT 'THEME', count(*) FROM region")
def seed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.entities(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {V.ENTITIES}, {V.ALIASES}, {V.MENTIONS}, c AS (SELECT DISTINCT mention_id, al.syn_id, least({_CONF}, 0.95) AS confidence, type FROM mn JOIN al ON al.alias = {_NORM} JOIN en ON en.syn_id = al.syn_id WHERE status = 'ACTIVE'),
r AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY confidence DESC, syn_id) AS k FROM c) SELECT mention_id, syn_id, round(confidence, 6) AS confidence FROM r WHERE k <= 10 AND type = 'COMMODITY'""")
def link_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.entities(spark, sf_dir)
    found = linker.alias_candidates(V.mentions(spark, sf_dir), V.aliases(spark, sf_dir), e)
    return linker.cascade([found], e, "COMMODITY").select("mention_id", "syn_id", F.round("confidence", 6).alias("confidence"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 'alias has not 1 to 500 characters' WHEN p_partkey % 4 = 2 THEN 'lang has not 0 to 10 characters' END AS error FROM part""")
def request_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that are empty or of 501 characters, and languages of 11, among good ones."""
    k = F.col("p_partkey")
    rows = V.table(spark, sf_dir, "part").select(k, F.when(k % 8 == 1, "").when(k % 8 == 5, F.repeat(F.lit("x"), 501)).otherwise(F.col("p_name")).alias("alias"), F.when(k % 4 == 2, F.repeat(F.lit("e"), 11)).otherwise(F.lit("en")).alias("lang"))
    return rows.select("p_partkey", store.length_error(["alias", "lang"]).alias("error"))


_B32 = "substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST(({x} >> {k}) & 31 AS INTEGER) + 1, 1)"
_MS = " || ".join(_B32.format(x="ms", k=5 * k) for k in range(9, -1, -1))
_NOISE = " || ".join(_B32.format(x=f"CAST('0x' || substr(h, {5 * p + 1}, 5) AS BIGINT)", k=5 * k) for p in range(4) for k in range(3, -1, -1))


@query(f"""WITH o AS (SELECT o_orderkey, o_orderdate, epoch_ms(o_orderdate) AS ms, sha256(o_custkey || chr(31) || o_orderkey) AS h FROM orders),
i AS (SELECT o_orderkey, o_orderdate AS made_at, 'SE_' || {_MS} || {_NOISE} AS syn_id FROM o) SELECT o_orderkey, syn_id, made_at, row_number() OVER (ORDER BY syn_id) = rank() OVER (ORDER BY made_at) + count(*) OVER (PARTITION BY made_at ORDER BY syn_id) - 1 AS in_order FROM i""")
def sortable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id for each order from its date and keys, the time read back from it, and whether its place among a day's ids follows that time."""
    o = V.table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", "o_orderdate", idf.sortable_id("SE", F.col("o_orderdate"), F.col("o_custkey"), F.col("o_orderkey")).alias("syn_id"))
    made = idf.id_time(F.col("syn_id")).cast("timestamp_ntz")
    days = rows.groupBy("o_orderdate").agg(F.min("syn_id").alias("low"), F.max("syn_id").alias("high"))
    before = days.withColumn("_last", F.lag("high").over(Window.partitionBy(F.lit(0)).orderBy("o_orderdate")))  # one row a day
    checked = rows.join(before, "o_orderdate")
    return checked.select("o_orderkey", "syn_id", made.alias("made_at"), F.coalesce(F.col("syn_id") > F.col("_last"), F.lit(True)).alias("in_order"))


@query(f"""WITH {V.ENTITIES}, {V.IDENTIFIERS}, {V.ATTRIBUTES}, {V.EDGES}
SELECT en.syn_id, 'identifier' AS kind, scheme AS name, value FROM en JOIN ids USING (syn_id) WHERE ids.valid_to IS NULL AND en.type = 'COMPANY'
UNION ALL SELECT en.syn_id, 'attribute', key, coalesce(value_string, value_json, CAST(CAST(round(value_number * 100) AS BIGINT) AS VARCHAR)) FROM en JOIN att USING (syn_id) WHERE att.valid_to IS NULL AND en.type = 'COMPANY'
UNION ALL SELECT en.syn_id, 'edge out', rel_type, dst_syn_id FROM en JOIN ed ON src_syn_id = en.syn_id WHERE ed.valid_to IS NULL AND en.type IN ('COMPANY', 'SECTOR')
UNION ALL SELECT en.syn_id, 'edge both', rel_type, CASE WHEN src_syn_id = en.syn_id THEN dst_syn_id ELSE src_syn_id END FROM en JOIN ed ON src_syn_id = en.syn_id OR dst_syn_id = en.syn_id WHERE ed.valid_to IS NULL AND en.type = 'SECTOR' AND rel_type = 'BELONGS_TO'
UNION ALL SELECT 'all', 'stats', 'active_edges', CAST((SELECT count(*) FROM ed WHERE valid_to IS NULL) AS VARCHAR)""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry asked in SQL alone: three functions that return tables, in LATERAL joins, and the view of its counts."""
    edges = V.edges(spark, sf_dir).withColumns({"attrs": F.lit(None).cast("string"), "source": F.lit("driver")})
    catalog.register(spark, V.entities(spark, sf_dir), V.identifiers(spark, sf_dir), V.aliases(spark, sf_dir), V.attributes(spark, sf_dir).withColumn("observed_at", F.col("valid_from")), edges, V.quarantine(spark, sf_dir))
    return spark.sql("""
      SELECT e.syn_id, 'identifier' AS kind, f.scheme AS name, f.value FROM entity_registry e, LATERAL active_identifiers(e.syn_id) f WHERE e.type = 'COMPANY'
      UNION ALL SELECT e.syn_id, 'attribute', f.key, coalesce(f.value_string, f.value_json, cast(cast(round(f.value_number * 100) AS bigint) AS string)) FROM entity_registry e, LATERAL active_attributes(e.syn_id) f WHERE e.type = 'COMPANY'
      UNION ALL SELECT e.syn_id, 'edge out', f.rel_type, f.dst_syn_id FROM entity_registry e, LATERAL active_edges(e.syn_id) f WHERE e.type IN ('COMPANY', 'SECTOR')
      UNION ALL SELECT e.syn_id, 'edge both', f.rel_type, CASE WHEN f.src_syn_id = e.syn_id THEN f.dst_syn_id ELSE f.src_syn_id END FROM entity_registry e, LATERAL active_edges(e.syn_id, 'both', 'BELONGS_TO') f WHERE e.type = 'SECTOR'
      UNION ALL SELECT 'all', 'stats', 'active_edges', cast(active_edges AS string) FROM ontology_stats""")
