"""Stand-ins for market and entity data, built from the test tables; and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import make_id
from ..operators import names
from ..sources.eventlog import as_events, read_log, write_log
from ..streaming.ingest import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as the event log: purchases are trades, clicks depth, signups and errors orders, views heartbeats."""
    e = table(spark, sf_dir, "events")
    ns, k, seq = F.unix_micros(F.col("ts").cast("timestamp")) * 1000, F.get_json_object("props", "$.k").cast("double"), F.col("event_id") + 1
    kind = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 5).otherwise(3)
    depth, order, priced = kind == 1, kind == 3, kind != 5
    rows = e.select(
        ns.alias("ts_event_ns"), (ns + 1000).alias("ts_receive_ns"), (ns + 500).alias("ts_monotonic_ns"), kind.alias("event_type"), F.lit("SIM").alias("venue"),
        F.concat(F.lit("U"), "user_id").alias("symbol"), F.lit("driver").alias("source"), seq.alias("seq"),
        F.when(depth, seq % 2).alias("side"), F.when(priced, F.col("value")).alias("price"), F.when(priced, k).alias("size"), F.when(depth, k % 10).alias("level"), F.when(depth, seq % 3).alias("op"),
        F.when(kind == 2, F.lit(2)).alias("aggressor"), F.when(order, F.concat(F.lit("O"), seq)).alias("order_id"), F.when(order, F.when(F.col("event_type") == "error", 5).otherwise(0)).alias("state"),
        F.when(order, k / 2).alias("filled"), F.when(F.col("event_type") == "error", F.lit("error")).alias("reason"),
    )
    return as_events(rows)


EVENTS = """ev AS (SELECT epoch_us(ts) * 1000 AS ts_event_ns, epoch_us(ts) * 1000 + 1000 AS ts_receive_ns, epoch_us(ts) * 1000 + 500 AS ts_monotonic_ns,
  CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 WHEN 'view' THEN 5 ELSE 3 END AS kind, event_type AS was, 'U' || user_id AS symbol, event_id + 1 AS seq,
  value, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, ts, event_id, user_id FROM events)"""


_paths: dict[tuple[str, str, str], str] = {}


def stored_once(spark: SparkSession, sf_dir: str, name: str, last: str, write: Callable[[str], None]) -> str:
    """The path of what ``write`` has written for a session, or writes now if its ``last`` file isn't there (any more)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    path = _paths.get(key)
    if path is not None:
        there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{last}")
        if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            path = None
    if path is None:
        path = _paths[key] = shared_path(spark, name)
        write(path)
    return path


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a written log, by date and then by time; written once for a session."""
    path = stored_once(spark, sf_dir, "log", "manifest", lambda p: write_log(events(spark, sf_dir), p, "driver", "replay", layout=("event_date",), order=("ts_event_ns", "seq")))
    out = read_log(spark, path)
    out.log_path = path
    return out


#: Which stand-in events the log's writer accepts (0 or 1).
OK = "CASE WHEN kind = 2 AND (value <= 0 OR k <= 0) THEN 0 WHEN kind = 1 AND value <= 0 AND seq % 3 <> 2 THEN 0 WHEN kind = 3 AND k <= 0 THEN 0 ELSE 1 END"
LOG = f"{EVENTS}, lg AS (SELECT * FROM ev WHERE {OK} = 1)"


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as trades of a part; dates are shifted by 30 years into the log's bounds."""
    li = table(spark, sf_dir, "lineitem")
    ns = F.unix_micros((F.col("l_shipdate") + F.expr("interval 30 years")).cast("timestamp")) * 1000
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("part"), ns.alias("ts_event_ns"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"),
                     F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2).alias("aggressor"), "l_shipdate")


TRADES = """tr AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey AS part, epoch_us(CAST(l_shipdate AS TIMESTAMP) + INTERVAL 30 YEAR) * 1000 AS ts_event_ns,
  l_extendedprice / l_quantity AS price, l_quantity AS size, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS aggressor, l_shipdate FROM lineitem)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are companies, suppliers organisations, parts commodities, nations sectors, regions themes."""
    parts = [("customer", "c_custkey", "c_name", "CO", "COMPANY"), ("supplier", "s_suppkey", "s_name", "OR", "ORG"), ("part", "p_partkey", "p_name", "CM", "COMMODITY"), ("nation", "n_nationkey", "n_name", "SC", "SECTOR"), ("region", "r_regionkey", "r_name", "TH", "THEME")]
    out = None
    for name, key, label, prefix, kind in parts:
        part = table(spark, sf_dir, name).select(make_id(prefix, F.col(key)).alias("syn_id"), F.lit(kind).alias("type"), F.col(label).alias("canonical_name"), F.when(F.col(key) % 10 == 9, "INACTIVE").otherwise("ACTIVE").alias("status"))
        out = part if out is None else out.unionByName(part)
    return out


def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored full-text index of all entities' names, written once for a session."""
    path = stored_once(spark, sf_dir, "names", "_SUCCESS", lambda p: names.write_index(entities(spark, sf_dir).select(F.col("syn_id").alias("id"), F.col("canonical_name").alias("text")), p))
    return names.read_index(spark, path)


def canonical_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index of the active entities' distinct names in lower case, written once for a session."""
    names_ = entities(spark, sf_dir).filter("status = 'ACTIVE'").select(F.lower("canonical_name").alias("id")).distinct()
    path = stored_once(spark, sf_dir, "canonical", "_SUCCESS", lambda p: names.write_index(names_.withColumn("text", F.col("id")), p))
    return names.read_index(spark, path)


def _entity(name: str, key: str, label: str, prefix: str, kind: str) -> str:
    return f"SELECT '{prefix}_' || lpad(CAST({key} AS VARCHAR), 26, '0') AS syn_id, '{kind}' AS type, {label} AS canonical_name, CASE WHEN {key} % 10 = 9 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status FROM {name}"


ENTITIES = "en AS (" + " UNION ALL ".join(_entity(*x) for x in [("customer", "c_custkey", "c_name", "CO", "COMPANY"), ("supplier", "s_suppkey", "s_name", "OR", "ORG"), ("part", "p_partkey", "p_name", "CM", "COMMODITY"), ("nation", "n_nationkey", "n_name", "SC", "SECTOR"), ("region", "r_regionkey", "r_name", "TH", "THEME")]) + ")"


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer, changes of order priority by date as versions of a TICKER."""
    o = table(spark, sf_dir, "orders")
    day = o.groupBy("o_custkey", F.col("o_orderdate").alias("valid_from")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("p"))
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("valid_from")
    points = day.withColumn("last", F.lag("p").over(w)).filter("last is null or last <> p")
    return points.select(make_id("CO", F.col("o_custkey")).alias("syn_id"), F.lit("TICKER").alias("scheme"), F.concat(F.substring("p", 3, 3), F.col("o_custkey") % 50).alias("value"), "valid_from", F.lead("valid_from").over(w).alias("valid_to"))


IDENTIFIERS = """day AS (SELECT o_custkey, o_orderdate AS valid_from, min_by(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1, 2),
pts AS (SELECT *, lag(p) OVER (PARTITION BY o_custkey ORDER BY valid_from) AS last FROM day),
ids AS (SELECT 'CO_' || lpad(CAST(o_custkey AS VARCHAR), 26, '0') AS syn_id, 'TICKER' AS scheme, substr(p, 3, 3) || CAST(o_custkey % 50 AS VARCHAR) AS value, valid_from,
  lead(valid_from) OVER (PARTITION BY o_custkey ORDER BY valid_from) AS valid_to FROM pts WHERE last IS NULL OR last <> p)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and nation memberships, and which supplier supplies which part."""
    sup = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_shipdate").alias("observed_at"), F.count(F.lit(1)).alias("n"))
    sup = sup.select(make_id("OR", F.col("l_suppkey")).alias("src_syn_id"), make_id("CM", F.col("l_partkey")).alias("dst_syn_id"), F.lit("SUPPLIES").alias("rel_type"), "observed_at",
                     F.least(F.lit(1.0), F.col("n") / 10.0).alias("confidence"), F.when(F.year("observed_at") < 1998, F.col("observed_at")).alias("valid_to"))
    start = F.lit("1995-01-01").cast("timestamp_ntz")
    one, none = F.lit(1.0).alias("confidence"), F.lit(None).cast("timestamp_ntz").alias("valid_to")
    cus = table(spark, sf_dir, "customer").select(make_id("CO", F.col("c_custkey")).alias("src_syn_id"), make_id("SC", F.col("c_nationkey")).alias("dst_syn_id"), F.lit("BELONGS_TO").alias("rel_type"), start.alias("observed_at"), one, none)
    nat = table(spark, sf_dir, "nation").select(make_id("SC", F.col("n_nationkey")).alias("src_syn_id"), make_id("TH", F.col("n_regionkey")).alias("dst_syn_id"), F.lit("BELONGS_TO").alias("rel_type"), start.alias("observed_at"), one, none)
    return sup.unionByName(cus).unionByName(nat)


def _sid(prefix: str, key: str) -> str:
    return f"'{prefix}_' || lpad(CAST({key} AS VARCHAR), 26, '0')"


EDGES = f"""sup AS (SELECT l_suppkey, l_partkey, max(l_shipdate) AS observed_at, count(*) AS n FROM lineitem GROUP BY 1, 2),
ed AS (SELECT {_sid('OR', 'l_suppkey')} AS src_syn_id, {_sid('CM', 'l_partkey')} AS dst_syn_id, 'SUPPLIES' AS rel_type, CAST(observed_at AS TIMESTAMP) AS observed_at, least(1.0, n / 10.0) AS confidence,
  CASE WHEN year(observed_at) < 1998 THEN CAST(observed_at AS TIMESTAMP) END AS valid_to FROM sup
 UNION ALL SELECT {_sid('CO', 'c_custkey')}, {_sid('SC', 'c_nationkey')}, 'BELONGS_TO', TIMESTAMP '1995-01-01', 1.0, NULL FROM customer
 UNION ALL SELECT {_sid('SC', 'n_nationkey')}, {_sid('TH', 'n_regionkey')}, 'BELONGS_TO', TIMESTAMP '1995-01-01', 1.0, NULL FROM nation)"""


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-cased part names; confidence by size, missing for every seventh part."""
    p = table(spark, sf_dir, "part")
    return p.select(make_id("CM", F.col("p_partkey")).alias("syn_id"), F.lower("p_name").alias("alias"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") / 50.0).alias("confidence"))


ALIASES = f"al AS (SELECT {_sid('CM', 'p_partkey')} AS syn_id, lower(p_name) AS alias, CASE WHEN p_partkey % 7 <> 0 THEN p_size / 50.0 END AS confidence FROM part)"


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer its segment (text), balance (number) and profile (JSON); a sixth are closed."""
    c = table(spark, sf_dir, "customer")
    kinds = [
        ("BALANCE", "NUMBER", F.lit(None).cast("string"), F.col("c_acctbal"), F.lit(None).cast("string")), ("SEGMENT", "STRING", F.col("c_mktsegment"), F.lit(None).cast("double"), F.lit(None).cast("string")),
        ("PROFILE", "JSON", F.lit(None).cast("string"), F.lit(None).cast("double"), F.format_string('{"segment": "%s", "nation": %d}', "c_mktsegment", "c_nationkey")),
    ]
    each = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(d).alias("datatype"), a.alias("value_string"), b.alias("value_number"), j.alias("value_json")) for k, d, a, b, j in kinds])
    rows = c.select(make_id("CO", F.col("c_custkey")).alias("syn_id"), F.when(F.col("c_custkey") % 6 == 0, F.lit("1997-01-01").cast("timestamp_ntz")).alias("valid_to"), F.explode(each).alias("a"))
    return rows.select("syn_id", "a.*", F.lit("1995-01-01").cast("timestamp_ntz").alias("valid_from"), "valid_to", F.lit("driver").alias("source"), F.lit(1.0).alias("confidence"))


_ATT = "SELECT 'CO_' || lpad(CAST(c_custkey AS VARCHAR), 26, '0') AS syn_id, '{k}' AS key, '{d}' AS datatype, {a} AS value_string, {b} AS value_number, {j} AS value_json, CASE WHEN c_custkey % 6 = 0 THEN TIMESTAMP '1997-01-01' END AS valid_to FROM customer"
ATTRIBUTES = "att AS (" + " UNION ALL ".join([
    _ATT.format(k="BALANCE", d="NUMBER", a="NULL", b="c_acctbal", j="NULL"), _ATT.format(k="SEGMENT", d="STRING", a="c_mktsegment", b="NULL", j="NULL"),
    _ATT.format(k="PROFILE", d="JSON", a="NULL", b="NULL", j="'{\"segment\": \"' || c_mktsegment || '\", \"nation\": ' || c_nationkey || '}'"),
]) + ")"


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as unresolved names; the finished ones are resolved to their customer five days later."""
    o = table(spark, sf_dir, "orders")
    done = F.col("o_orderstatus") == "F"
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("raw_identifier"), F.lit("No candidates found").alias("reason"), F.col("o_orderdate").cast("timestamp_ntz").alias("ingested_at"),
        F.when(done, make_id("CO", F.col("o_custkey"))).alias("resolved_syn_id"), F.when(done, F.col("o_orderdate").cast("timestamp_ntz") + F.expr("interval 5 days")).alias("resolved_at"), F.when(done, "ops").alias("resolved_by"),
    )


QUARANTINE = """qu AS (SELECT o_orderkey AS id, o_orderpriority AS raw_identifier, CAST(o_orderdate AS TIMESTAMP) AS ingested_at, CASE WHEN o_orderstatus = 'F' THEN 'CO_' || lpad(CAST(o_custkey AS VARCHAR), 26, '0') END AS resolved_syn_id,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 5 DAY END AS resolved_at, CASE WHEN o_orderstatus = 'F' THEN 'ops' END AS resolved_by FROM orders)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names with noise in case and spacing."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("k"))
    noisy = F.when(F.col("k") % 3 == 0, F.concat(F.lit("  "), F.upper("name"))).when(F.col("k") % 3 == 1, F.concat(F.col("name"), F.lit("s"))).otherwise(F.col("name"))
    return p.select(F.col("k").alias("mention_id"), noisy.alias("text"))


MENTIONS = "mn AS (SELECT min(p_partkey) AS mention_id, CASE WHEN min(p_partkey) % 3 = 0 THEN '  ' || upper(p_name) WHEN min(p_partkey) % 3 = 1 THEN p_name || 's' ELSE p_name END AS text FROM part GROUP BY p_name)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type a counter that restarts every 500 events, sampled at each event (seconds)."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "event_id", (n % 500).cast("double").alias("value"))


SAMPLES = "sm AS (SELECT event_type AS series, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS \"at\", event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) % 500 AS DOUBLE) AS value FROM events)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters at each event with labels kind and zone (one of three): requests_total, value_sum, value_count and value_bucket by le."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), (F.col("user_id") % 3).cast("string").alias("zone"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "value")
    w = Window.partitionBy("kind", "zone").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(F.lit(1)).over(w).cast("double")
    e = e.withColumns({"n": n, "s": F.sum("value").over(w), **{f"b{k}": F.count_if(F.col("value") <= le).over(w).cast("double") for k, le in enumerate(LES)}})
    labels = lambda *more: F.create_map(F.lit("kind"), F.col("kind"), F.lit("zone"), F.col("zone"), *more)
    one = lambda name, value, *more: F.struct(F.lit(name).alias("name"), labels(*more).alias("labels"), value.alias("value"))
    rows = [one("requests_total", F.col("n")), one("value_sum", F.col("s")), one("value_count", F.col("n"))]
    rows += [one("value_bucket", F.col(f"b{k}"), F.lit("le"), F.lit("+Inf" if le > 1e300 else str(le))) for k, le in enumerate(LES)]
    return e.select("event_id", "at", F.explode(F.array(*rows)).alias("x")).select("event_id", "at", "x.*")


LES = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 1.7e308]
#: Growth of each labelled counter at each event (the first sample of a series has none).
LABELLED = """le AS (SELECT event_id, event_type AS kind, CAST(user_id % 3 AS VARCHAR) AS zone, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS "at", value,
  row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY event_id) > 1 AS grows FROM events)"""
#: Evaluation time of the metric queries: 2024-01-15 00:00 UTC.
AT = 1_705_276_800
