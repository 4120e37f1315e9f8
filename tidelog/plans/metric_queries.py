"""Monitoring and portfolio queries."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features, metrics, portfolio
from ..sources import eventlog
from . import query
from . import views as V

DAY = 86_400
_STEP = 'st AS (SELECT *, CASE WHEN p IS NULL THEN NULL WHEN value < p THEN value ELSE value - p END AS step FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY "at", event_id) AS p FROM sm))'
_RATE = f'{V.SAMPLES}, {_STEP}, rt AS (SELECT series, coalesce(sum(step), 0) / {DAY} AS rate FROM st WHERE "at" > {V.AT - DAY} AND "at" <= {V.AT} GROUP BY series)'


@query(f'WITH {V.SAMPLES}, l AS (SELECT series, max_by(value, ("at", event_id)) AS v FROM sm WHERE "at" <= {V.AT} GROUP BY 1) SELECT coalesce(sum(v), 0.0) AS value FROM l')
def counter_latest_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.samples(spark, sf_dir)
    return metrics.latest_sum(s, V.AT, "event_id")


def _rates(spark, sf_dir) -> DataFrame:
    return metrics.rates(V.samples(spark, sf_dir), ["series"], "event_id", V.AT, DAY)


@query(f"WITH {_RATE} SELECT round(sum(rate), 9) AS rate FROM rt")
def counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir).agg(F.round(F.sum("rate"), 9).alias("rate"))


@query(f"WITH {_RATE} SELECT series, round(rate, 9) AS rate FROM rt")
def rate_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir).select("series", F.round("rate", 9).alias("rate"))


@query(f"WITH {V.SAMPLES}, {_STEP} SELECT series, round(coalesce(sum(step), 0), 6) AS growth, count(*) FILTER (WHERE value < p) AS resets FROM st GROUP BY series")
def counter_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth and restarts of every counter over all its samples, merged from states of six hours."""
    states = metrics.growth(V.samples(spark, sf_dir), ["series"], "event_id")
    return metrics.merged_growth(states, ["series"]).withColumn("growth", F.round("growth", 6))


EDGES = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, float("inf")]


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counts of event values by bucket edge: one aggregate, then one row per edge."""
    v = V.table(spark, sf_dir, "events").agg(*[F.count_if(F.col("value") <= e).alias(str(k)) for k, e in enumerate(EDGES)])
    return v.select(F.explode(F.array(*[F.struct(F.lit(e).alias("le"), F.col(str(k)).alias("count")) for k, e in enumerate(EDGES)])).alias("b")).select("b.*")


@query("""WITH e AS (SELECT unnest([1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 1e308]) AS le), b AS (SELECT le, (SELECT count(*) FROM events WHERE value <= le) AS c FROM e),
l AS (SELECT le, c, coalesce(lag(le) OVER (ORDER BY le), 0) AS low, coalesce(lag(c) OVER (ORDER BY le), 0) AS u FROM b), q AS (SELECT unnest([0.5, 0.95, 0.99]) AS q),
h AS (SELECT q, min_by(le, le) AS le, min_by(low, le) AS low, min_by(u, le) AS u, min_by(c, le) AS c FROM q, l WHERE c >= q * (SELECT count(*) FROM events) GROUP BY q)
SELECT CAST(q AS DOUBLE) AS q, round(CASE WHEN le > 1e300 THEN 250.0 ELSE low + (le - low) * (q * (SELECT count(*) FROM events) - u) / (c - u) END, 6) AS value FROM h""")
def bucket_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bucket_quantiles(histogram(spark, sf_dir), [0.5, 0.95, 0.99]).select("q", F.round("value", 6).alias("value"))


_GROWN = f"{V.LABELLED}, gw AS (SELECT *, \"at\" > {V.AT - DAY} AND \"at\" <= {V.AT} AS inside FROM le WHERE grows)"


def _instant(spark, sf_dir, kind: str, name: str, **more) -> DataFrame:
    return metrics.query_instant(V.labelled(spark, sf_dir), metrics.Expr(kind, name, window=DAY, **more), V.AT, "event_id")


@query(f"WITH {_GROWN} SELECT kind, round(sum(value) / count(*), 6) AS mean FROM gw WHERE inside GROUP BY 1")
def mean_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of the sums over rate of the counts, by kind."""
    return _instant(spark, sf_dir, "mean", "value", by=("kind",)).select("kind", F.round("value", 6).alias("mean"))


@query(f"WITH {_GROWN} SELECT zone, round(count(*) / {DAY}.0, 9) AS rate FROM gw WHERE inside AND kind = 'view' GROUP BY 1")
def label_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request rates of one kind by zone."""
    return _instant(spark, sf_dir, "sum_rate", "requests_total", where={"kind": "view"}, by=("zone",)).select("zone", F.round("value", 9).alias("rate"))


@query(f"WITH {V.LABELLED} SELECT zone, CAST(count(*) AS DOUBLE) AS value FROM le WHERE \"at\" <= {V.AT} GROUP BY 1")
def label_latest_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instant(spark, sf_dir, "sum", "requests_total", by=("zone",)).select("zone", "value")


@query(f"WITH {_GROWN} SELECT zone, round(count(*) FILTER (WHERE kind = 'error') / count(*), 9) AS ratio FROM gw WHERE inside GROUP BY 1")
def label_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = metrics.Expr("sum_rate", "requests_total", by=("zone",), window=DAY)
    return _instant(spark, sf_dir, "ratio", "requests_total", where={"kind": "error"}, by=("zone",), over=every).select("zone", F.round("value", 9).alias("ratio"))


_LES = ", ".join("1e308" if x > 1e300 else str(x) for x in V.LES)


@query(f"""WITH {_GROWN}, e AS (SELECT unnest([{_LES}]) AS le), b AS (SELECT zone, le, count(*) FILTER (WHERE value <= le) AS c FROM gw, e WHERE inside GROUP BY 1, 2),
l AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(c) OVER w, 0) AS u, max(c) OVER (PARTITION BY zone) AS n FROM b WINDOW w AS (PARTITION BY zone ORDER BY le)), h AS (SELECT zone, min_by(le, le) AS le, min_by(low, le) AS low, min_by(u, le) AS u, min_by(c, le) AS c, any_value(n) AS n FROM l WHERE c >= 0.95 * n GROUP BY 1)
SELECT zone, round(CASE WHEN le > 1e300 THEN 250.0 WHEN c = u THEN le ELSE low + (le - low) * (0.95 * n - u) / (c - u) END, 6) AS p95 FROM h""")
def bucket_rate_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile of the rates of a histogram's buckets, summed by le in each zone."""
    return _instant(spark, sf_dir, "quantile", "value_bucket", by=("zone",), q=0.95).select("zone", F.round("value", 6).alias("p95"))


@query(f"""WITH {V.LABELLED}, g AS (SELECT unnest(range({V.AT - 2 * DAY}, {V.AT} + 1, 21600)) AS t)
SELECT CAST(t AS BIGINT) AS "at", zone, round(count(*) / {DAY}.0, 9) AS value FROM g JOIN le ON le."at" > t - {DAY} AND le."at" <= t WHERE grows AND kind <> 'none' GROUP BY 1, 2""")
def label_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request rates by zone on a grid of six hours."""
    e = metrics.Expr("sum_rate", "requests_total", by=("zone",), window=DAY)
    return metrics.query_range(V.labelled(spark, sf_dir), e, V.AT - 2 * DAY, V.AT, 21_600, "event_id").select("at", "zone", F.round("value", 9).alias("value"))


@query(f"""WITH {V.LABELLED}, x AS (SELECT kind, zone, count(*) AS n FROM le WHERE "at" <= {V.AT} GROUP BY 1, 2) SELECT 'requests_total{{kind="' || kind || '",zone="' || zone || '"}} ' || n || '.0' AS line FROM x""")
def metric_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.matching(V.labelled(spark, sf_dir), "requests_total").filter(F.col("at") <= V.AT)
    last = s.groupBy("name", F.array_sort(F.map_entries("labels")).alias("e")).agg(F.max("value").alias("value"))
    return metrics.exposition(last.select("name", F.map_from_entries("e").alias("labels"), "value"))


@query("""WITH h AS (SELECT event_type, user_id % 4 AS p, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) // 21600 AS w FROM events), k AS (SELECT DISTINCT event_type, p FROM h),
g AS (SELECT unnest(range(1704499200, 1705276800 + 1, 21600)) AS t), c AS (SELECT event_type, p, t, EXISTS (SELECT 1 FROM (SELECT event_type, user_id % 4 AS p, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) AS i FROM events) e
  WHERE e.event_type = k.event_type AND e.p = k.p AND e.i > 1 AND e.s > t - 21600 AND e.s <= t) AS flow FROM k, g)
SELECT event_type, p, CAST(t AS BIGINT) AS "at", t - 1704499200 >= 43200 AND max(CASE WHEN flow THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, p ORDER BY t RANGE BETWEEN 43200 PRECEDING AND CURRENT ROW) = 0 AS alert FROM c""")
def zero_flow_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by type and part that haven't grown for half a day, on a grid of six hours."""
    e = V.table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 4).alias("p"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    n = F.row_number().over(Window.partitionBy("event_type", "p").orderBy("event_id")).cast("double")
    return metrics.zero_flow(e.withColumn("value", n), ["event_type", "p"], 1_704_499_200, 1_705_276_800, 21_600, 43_200, "event_id")


@query(f"WITH {_RATE} SELECT round(sum(CASE WHEN series = 'error' THEN rate END) / nullif(sum(rate), 0), 6) AS ratio FROM rt")
def miss_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rates(spark, sf_dir).agg(F.sum(F.when(F.col("series") == "error", F.col("rate"))).alias("miss"), F.sum("rate").alias("every"))
    return r.select(F.round(metrics.share(F.col("miss"), F.col("every")), 6).alias("ratio"))


@query(f"""WITH {V.SAMPLES}, {_STEP}, g AS (SELECT unnest(range({V.AT - 2 * DAY}, {V.AT} + 1, 21600)) AS t)
SELECT series, CAST(t AS BIGINT) AS "at", round(coalesce(sum(step), 0) / {DAY}, 9) AS rate FROM g JOIN st ON st."at" > t - {DAY} AND st."at" <= t GROUP BY 1, 2""")
def range_query_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = metrics.rate_grid(V.samples(spark, sf_dir), ["series"], "event_id", V.AT - 2 * DAY, V.AT, 21_600, DAY)
    return g.select("series", "at", F.round("rate", 9).alias("rate"))


@query(f"""WITH {_RATE}, v AS (SELECT 'zero_flow' AS id, sum(rate) AS value FROM rt UNION ALL SELECT 'connection_errors', sum(CASE WHEN series = 'error' THEN rate END) FROM rt
  UNION ALL SELECT 'high_cache_miss_rate', sum(CASE WHEN series = 'view' THEN rate END) / sum(rate) FROM rt UNION ALL SELECT 'disconnected', 0.0)
SELECT id, round(value, 9) AS value FROM v WHERE (id IN ('zero_flow', 'disconnected') AND value = 0) OR (id = 'connection_errors' AND value > 0) OR (id = 'high_cache_miss_rate' AND value > 0.5)""")
def alert_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: F.sum(F.when(F.col("series") == s, F.col("rate")))
    r = _rates(spark, sf_dir).agg(F.sum("rate").alias("every"), of("error").alias("error"), of("view").alias("view"))
    pairs = [("zero_flow", F.col("every")), ("connection_errors", F.col("error")), ("high_cache_miss_rate", F.col("view") / F.col("every")), ("disconnected", F.lit(0.0))]
    values = r.select(F.explode(F.array(*[F.struct(F.lit(i).alias("id"), v.alias("value")) for i, v in pairs])).alias("v")).select("v.*")
    return metrics.alerts(values).select("id", F.round("value", 9).alias("value"))


@query(f"""WITH {V.EVENTS}, w AS (SELECT symbol, count(*) AS n FROM ev WHERE kind <> 3 GROUP BY 1), r AS (SELECT symbol, count(*) / 86400.0 AS n FROM ev WHERE kind = 2 GROUP BY 1), o AS (SELECT symbol, count(*) AS n FROM ev WHERE kind = 1 GROUP BY 1), e AS (SELECT symbol, count(*) AS n FROM ev WHERE was = 'error' GROUP BY 1)
SELECT w.symbol, CAST(w.n AS DOUBLE) AS events_written, round(coalesce(r.n, 0), 9) AS rate, CAST(coalesce(o.n, 0) AS DOUBLE) AS rows_written, CAST(coalesce(e.n, 0) AS DOUBLE) AS validation_errors FROM w LEFT JOIN r USING (symbol) LEFT JOIN o USING (symbol) LEFT JOIN e USING (symbol)""")
def per_symbol_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four metrics by symbol, joined onto the symbols of the written counter."""
    e = V.events(spark, sf_dir)
    by = lambda cond, scale=1.0: e.filter(cond).groupBy("symbol").agg((F.count(F.lit(1)) / scale).cast("double").alias("value"))
    out = metrics.per_symbol(by("event_type <> 3"), by("event_type = 2", 86_400.0), by("event_type = 1"), by("state = 5"))
    return out.withColumn("rate", F.round("rate", 9))


_VENUES = [("NYSE", "U1"), ("NASDAQ", "U2"), ("LSE", "U3"), ("TSE", "none"), ("HKEX", "U4"), ("CME", "nobody")]


@query(f"""WITH {V.EVENTS}, d AS (SELECT * FROM (VALUES {", ".join(str(v) for v in _VENUES)}) AS t(venue, symbol)), l AS (SELECT symbol, avg(k) AS v FROM ev WHERE kind = 5 GROUP BY 1)
SELECT d.venue, round(l.v, 6) AS latency, CASE WHEN d.venue = 'CME' THEN 'unknown' WHEN l.v IS NOT NULL THEN 'connected' ELSE 'disconnected' END AS status FROM d LEFT JOIN l USING (symbol)""")
def venue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension of six venues with the latencies that are known; one lookup failed."""
    venues = spark.createDataFrame(_VENUES, "venue string, symbol string")
    k = F.get_json_object("props", "$.k").cast("double")
    lat = V.table(spark, sf_dir, "events").filter("event_type = 'view'").groupBy(F.concat(F.lit("U"), "user_id").alias("symbol")).agg(F.avg(k).alias("value"))
    lat = lat.join(F.broadcast(venues), "symbol").select("venue", "value")
    return metrics.venue_status(venues, lat, venues.filter("venue = 'CME'")).select("venue", F.round("latency", 6).alias("latency"), "status")


@query(f"WITH {V.EVENTS}, s AS (SELECT symbol, count(*) FILTER (WHERE kind = 2) / 60.0 AS r FROM ev GROUP BY 1) SELECT symbol, r > 0 AS live FROM s")
def live_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = V.events(spark, sf_dir).groupBy("symbol").agg((F.count_if(F.col("event_type") == 2) / 60.0).alias("value"))
    return metrics.live_symbols(rates)


@query("SELECT p_partkey, round(p_retailprice * ((p_size - 25) * 0.10371) / 100, 2) AS change FROM part")
def ticker_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of a price by a percentage."""
    return V.table(spark, sf_dir, "part").select("p_partkey", metrics.ticker_change(F.col("p_retailprice"), (F.col("p_size") - 25) * 0.10371).alias("change"))


@query("""WITH x AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'tick' WHEN 1 THEN 'flush' ELSE 'network' END AS kind, quantile_cont(l_discount, 0.99) AS s FROM lineitem GROUP BY 1)
SELECT kind, round(s, 9) AS seconds, s * 1000 < CASE kind WHEN 'tick' THEN 10 WHEN 'flush' THEN 50 ELSE 100 END AS good FROM x""")
def latency_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    x = V.table(spark, sf_dir, "lineitem").groupBy(F.when(n == 0, "tick").when(n == 1, "flush").otherwise("network").alias("kind")).agg(F.percentile("l_discount", 0.99).alias("seconds"))
    return metrics.latency_verdicts(x).select("kind", F.round("seconds", 9).alias("seconds"), "good")


@query("""WITH x AS (SELECT o_orderkey, o_custkey * o_custkey * 7 AS us FROM orders) SELECT o_orderkey, CASE WHEN us < 1000 THEN us || 'us' WHEN us < 1000000 THEN printf('%.1fms', us / 1000.0) ELSE printf('%.2fs', us / 1000000.0) END AS text FROM x""")
def latency_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = (F.col("o_custkey") * F.col("o_custkey") * 7).cast("double")
    return V.table(spark, sf_dir, "orders").select("o_orderkey", metrics.latency_text(us).alias("text"))


@query("""WITH v AS (SELECT 'disconnected' AS id, 0.0 AS v UNION ALL SELECT 'zero_flow', 0.0 UNION ALL SELECT 'high_latency', 0.01 UNION ALL SELECT 'connection_errors', (SELECT count(*) FROM events WHERE event_type = 'error') UNION ALL SELECT 'high_cache_miss_rate', 0.9)
SELECT severity, count(*) AS n FROM (SELECT CASE WHEN id IN ('disconnected', 'zero_flow') AND v = 0 THEN 'critical' WHEN id = 'connection_errors' AND v > 0 THEN 'warning' WHEN id = 'high_cache_miss_rate' AND v > 0.5 THEN 'info' END AS severity FROM v) WHERE severity IS NOT NULL GROUP BY 1""")
def alert_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = V.table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "error").cast("double").alias("value")).select(F.lit("connection_errors").alias("id"), "value")
    given = spark.createDataFrame([("disconnected", 0.0), ("zero_flow", 0.0), ("high_latency", 0.01), ("high_cache_miss_rate", 0.9)], "id string, value double")
    return metrics.alert_counts(metrics.alerts(given.unionByName(errors)))


@query("SELECT CAST(round(avg(p_size * 2)) AS BIGINT) AS overall, count(*) FILTER (WHERE p_size = 50) AS completed, count(*) FILTER (WHERE p_size BETWEEN 1 AND 49) AS in_progress FROM part")
def mean_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    return metrics.progress(V.table(spark, sf_dir, "part").select((s * 2).alias("progress"), F.when(s == 50, "complete").otherwise("in-progress").alias("status")))


@query("SELECT o_orderkey, message FROM (SELECT o_orderkey, o_orderdate AS ts, 'order of customer ' || o_custkey AS message, o_orderpriority AS level FROM orders) WHERE contains(message, 'customer 1') AND level = '1-URGENT' AND ts >= TIMESTAMP '1995-01-01' ORDER BY ts DESC, message LIMIT 100")
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"), F.concat(F.lit("order of customer "), "o_custkey").alias("message"), F.col("o_orderpriority").alias("level"))
    return metrics.search_logs(o, "Customer 1", "1-urgent", datetime.datetime(1995, 1, 1)).select("o_orderkey", "message")


@query("SELECT p_partkey, coalesce(try_cast(CASE WHEN p_size % 5 = 0 THEN p_name ELSE CAST(p_retailprice AS VARCHAR) END AS DOUBLE), 0) AS value FROM part")
def metric_value_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(F.col("p_retailprice").cast("string"))
    return V.table(spark, sf_dir, "part").select("p_partkey", metrics.parse_value(text).alias("value"))


@query("SELECT user_id, date_trunc('day', ts) AS start, count(*) AS n, count(*) >= 3 AS limited FROM events GROUP BY 1, 2")
def request_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per user and fixed window (a day here), and whether a limit of 3 is reached."""
    w = V.table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return w.withColumn("limited", F.col("n") >= 3)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed quantity per part (returned ones negative) at the retail price."""
    li = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))).alias("quantity"), F.min("l_suppkey").alias("s_suppkey"))
    part = V.table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("sector"), "p_retailprice")
    nation = V.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country")), "s_nationkey")
    return li.join(part, "p_partkey").join(nation, "s_suppkey").select("p_partkey", "sector", "country", (F.col("quantity") * F.col("p_retailprice")).alias("market_value"))


_POS = """q AS (SELECT l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS quantity, min(l_suppkey) AS s FROM lineitem GROUP BY 1),
ps AS (SELECT l_partkey, p_type AS sector, n_name AS country, quantity * p_retailprice AS mv FROM q JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = s JOIN nation ON n_nationkey = s_nationkey)"""
_EXP = "round(sum(abs(mv)), 2) AS gross, round(sum(mv), 2) AS net, count(*) FILTER (WHERE mv > 0) AS longs, count(*) FILTER (WHERE mv < 0) AS shorts"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"gross": F.round("gross", 2), "net": F.round("net", 2)})


@query(f"WITH {_POS} SELECT {_EXP} FROM ps")
def exposure_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(portfolio.exposures(positions(spark, sf_dir), []))


@query(f"WITH {_POS} SELECT sector, {_EXP} FROM ps GROUP BY 1")
def exposure_by_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(portfolio.exposures(positions(spark, sf_dir), ["sector"]))


@query(f"WITH {_POS}, t AS (SELECT country, sum(abs(mv)) AS g FROM ps GROUP BY 1 ORDER BY g DESC, country LIMIT 5) SELECT country, round(g, 2) AS gross, round(g / max(g) OVER (), 6) AS share_of_max FROM t")
def top5_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.top_shares(positions(spark, sf_dir), "country").select("country", F.round("gross", 2).alias("gross"), F.round("share_of_max", 6).alias("share_of_max"))


@query(f"WITH {_POS} SELECT count(*) FILTER (WHERE mv > 0) AS longs, count(*) FILTER (WHERE mv < 0) AS shorts FROM ps")
def long_short_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.exposures(positions(spark, sf_dir), []).select("longs", "shorts")


@query(f"WITH {V.TRADES} SELECT count(*) AS total, count(*) FILTER (WHERE aggressor = 0) AS buys, count(*) FILTER (WHERE aggressor = 1) AS sells, sum(size) AS volume FROM tr WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-02-01'")
def trade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.trades(spark, sf_dir).filter((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1998-02-01").cast("timestamp_ntz")))
    return portfolio.trade_summary(t)


_FILES = "fl AS (SELECT 'U' || user_id AS symbol, CAST(ts AS DATE) AS day, count(*) * 4096 AS bytes FROM events GROUP BY 1, 2)"
_BY = f"{_FILES}, bs AS (SELECT symbol, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS files, min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) AS distinct_days FROM fl GROUP BY 1)"


def _files(spark, sf_dir) -> DataFrame:
    e = V.table(spark, sf_dir, "events").groupBy(F.concat(F.lit("U"), "user_id").alias("symbol"), F.to_date("ts").alias("day"))
    return e.agg((F.count(F.lit(1)) * 4096).alias("bytes"))


@query(f"WITH {_BY} SELECT *, printf('%.2f', bytes / (1024.0 * 1024.0)) AS size_mb FROM bs")
def storage_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.storage_by_symbol(_files(spark, sf_dir))


@query(f"WITH {_BY}, d AS (SELECT first_day AS x FROM bs UNION SELECT last_day FROM bs) SELECT CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(files) AS BIGINT) AS files, min(first_day) AS first_day, max(last_day) AS last_day, (SELECT count(*) FROM d) AS days_of_data_ref, printf('%.2f', sum(bytes) / (1024.0 * 1024.0 * 1024.0)) AS size_gb FROM bs")
def storage_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.storage_total(eventlog.storage_by_symbol(_files(spark, sf_dir)))


@query("SELECT CAST(count(*) AS BIGINT) AS events, round(count(*) / 23400.0, 6) AS events_per_s FROM events")
def session_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("events"), F.round(F.count(F.lit(1)) / 23_400, 6).alias("events_per_s"))


@query("""WITH t AS (SELECT 'U' || (user_id % 50) AS symbol, CAST(ts AS DATE) AS day, event_id AS n, value AS price, 1.0 AS size FROM events WHERE event_type = 'purchase' AND value > 0),
q AS (SELECT 'U' || (user_id % 50) AS symbol, CAST(ts AS DATE) AS day, value * (1 - CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 10000) AS bid, value * (1 + CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 10000) AS ask FROM events WHERE event_type = 'click'),
a AS (SELECT symbol, day, max_by(price, n) AS close, sum(size) AS volume FROM t GROUP BY 1, 2),
b AS (SELECT symbol, day, sum((ask - bid) / ((ask + bid) / 2) * 10000) AS spreads, count(*) AS quotes FROM q WHERE bid > 0 AND bid < ask GROUP BY 1, 2),
s AS (SELECT DISTINCT symbol FROM t UNION SELECT symbol FROM q), d AS (SELECT symbol, CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day FROM s),
c AS (SELECT symbol, day, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day) AS close, volume, spreads, quotes FROM d LEFT JOIN a USING (symbol, day) LEFT JOIN b USING (symbol, day)),
r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS r FROM c)
SELECT symbol, day, round(close, 6) AS close, round(sqrt(avg(r * r) OVER w), 6) AS realized_vol, round(sum(spreads) OVER w / nullif(sum(quotes) OVER w, 0), 4) AS avg_spread_bps, CAST(coalesce(sum(volume) OVER w, 0) AS DOUBLE) AS volume
FROM r WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 4 PRECEDING)""")
def daily_market_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close, volatility, spread and volume of five days, for every symbol and day of the month."""
    e = V.table(spark, sf_dir, "events").withColumns({"symbol": F.concat(F.lit("U"), F.col("user_id") % 50), "day": F.to_date("ts"), "k": F.get_json_object("props", "$.k").cast("double") / 10_000})
    trades = e.filter("event_type = 'purchase' and value > 0").select("symbol", "day", F.col("event_id").alias("at"), F.col("value").alias("price"), F.lit(1.0).alias("size"))
    quotes = e.filter("event_type = 'click'").select("symbol", "day", (F.col("value") * (1 - F.col("k"))).alias("bid"), (F.col("value") * (1 + F.col("k"))).alias("ask"))
    out = features.market_features(trades, quotes, "2024-01-01", "2024-01-30")
    return out.withColumns({"close": F.round("close", 6), "realized_vol": F.round("realized_vol", 6), "avg_spread_bps": F.round("avg_spread_bps", 4)})


@query("""WITH l AS (SELECT l_suppkey, l_partkey, min(l_shipdate) AS a, max(l_shipdate) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2),
k AS (SELECT l_partkey, greatest(CAST(a AS DATE), CAST(a AS DATE) + CAST(l_suppkey % 10 AS INTEGER)) AS known, CASE WHEN n % 2 = 1 THEN CAST(b AS DATE) + 300 END AS gone FROM l),
p AS (SELECT DISTINCT l_partkey FROM l), d AS (SELECT l_partkey, CAST(unnest(generate_series(TIMESTAMP '1997-01-01', TIMESTAMP '1997-01-31', INTERVAL 1 DAY)) AS DATE) AS day FROM p)
SELECT d.l_partkey AS part, d.day, count(k.known) AS suppliers FROM d LEFT JOIN k ON k.l_partkey = d.l_partkey AND k.known <= d.day AND (k.gone IS NULL OR k.gone > d.day) GROUP BY 1, 2""")
def daily_supplier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every part and day of a month the suppliers known that day; a supplier is observed some days after its first delivery, and some leave."""
    li = V.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_partkey").alias("part")).agg(F.to_date(F.min("l_shipdate")).alias("valid_from"), F.to_date(F.max("l_shipdate")).alias("last"), F.count(F.lit(1)).alias("n"))
    links = li.select("part", "valid_from", F.date_add("valid_from", (F.col("l_suppkey") % 10).cast("int")).alias("observed_at"), F.when(F.col("n") % 2 == 1, F.date_add("last", 300)).alias("valid_to"))
    return features.link_counts(links, "part", "1997-01-01", "1997-01-31", "suppliers")


@query("""WITH q AS (SELECT l_partkey AS part, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS quantity, sum(l_extendedprice) / sum(l_quantity) AS avg_price FROM lineitem GROUP BY 1)
SELECT part, round(quantity * p_retailprice, 2) AS market_value, round((p_retailprice - avg_price) * quantity, 2) AS unrealized_pnl, round((p_retailprice - avg_price) * quantity * 100 / nullif(abs(quantity) * avg_price, 0), 4) AS unrealized_pnl_percent FROM q JOIN part ON p_partkey = part""")
def position_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of all parts at the retail price, with gain or loss against the average price paid."""
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    held = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.sum(signed).alias("quantity"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("avg_price"))
    rows = held.join(V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("price")), "part")
    out = portfolio.valued(rows)
    return out.select("part", F.round("market_value", 2).alias("market_value"), F.round("unrealized_pnl", 2).alias("unrealized_pnl"), F.round("unrealized_pnl_percent", 4).alias("unrealized_pnl_percent"))
