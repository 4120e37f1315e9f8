"""Event log queries: replay, projections, validation, ordering, partitions, clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import ordering, slices, validate
from ..sources import eventlog
from ..streaming import ingest
from . import query
from . import views as V

T0, T1 = 1_704_499_200 * clock.NS, 1_705_708_800 * clock.NS
S0, S1 = 100, 7_000
_HEAD = "symbol, seq, ts_event_ns, CAST(kind AS BIGINT) AS event_type"


def _head(df: DataFrame) -> DataFrame:
    return df.select("symbol", "seq", "ts_event_ns", F.col("event_type").cast("long").alias("event_type"))


@query(f"WITH {V.LOG} SELECT {_HEAD} FROM lg WHERE ts_event_ns BETWEEN {T0} AND {T1}")
def replay_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _head(eventlog.in_range(V.log(spark, sf_dir), time=(T0, T1)))


@query(f"WITH {V.LOG} SELECT {_HEAD} FROM lg WHERE seq BETWEEN {S0} AND {S1}")
def replay_seq_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _head(eventlog.in_range(V.log(spark, sf_dir), seq=(S0, S1)))


@query(f"WITH {V.LOG} SELECT symbol, seq, ts_event_ns, round(value, 6) AS price, k AS size FROM lg WHERE kind = 2 AND ts_event_ns BETWEEN {T0} AND {T1} AND seq BETWEEN {S0} AND {S1}")
def replay_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = eventlog.in_range(V.log(spark, sf_dir), (T0, T1), (S0, S1))
    return eventlog.replay(eventlog.of_type(rows, "trade")).select("symbol", "seq", "ts_event_ns", F.round("price", 6).alias("price"), "size")


@query(f"WITH {V.EVENTS} SELECT {_HEAD} FROM ev ORDER BY symbol, seq LIMIT 10")
def replay_ordered_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _head(eventlog.replay(V.events(spark, sf_dir)).limit(10))


@query("SELECT count(*) AS event_count FROM events")
def event_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.events(spark, sf_dir).agg(F.count(F.lit(1)).alias("event_count"))


@query(f"WITH {V.EVENTS} SELECT symbol, seq, round(value, 6) AS price, k AS size, CAST(2 AS BIGINT) AS aggressor FROM ev WHERE kind = 2")
def type_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.of_type(V.events(spark, sf_dir), "trade").select("symbol", "seq", F.round("price", 6).alias("price"), "size", F.col("aggressor").cast("long").alias("aggressor"))


@query(f"WITH {V.EVENTS} SELECT symbol, seq, 'O' || seq AS order_id, CAST(CASE was WHEN 'error' THEN 5 ELSE 0 END AS BIGINT) AS state, k / 2 AS filled, CASE was WHEN 'error' THEN 'error' END AS reason FROM ev WHERE kind = 3")
def type_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.of_type(V.events(spark, sf_dir), "order").select("symbol", "seq", "order_id", F.col("state").cast("long").alias("state"), "filled", "reason")


@query(f"WITH {V.EVENTS} SELECT symbol, seq, seq % 2 AS side, CAST(k AS BIGINT) % 10 AS level, seq % 3 AS op FROM ev WHERE kind = 1")
def type_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.of_type(V.events(spark, sf_dir), "depth").select("symbol", "seq", F.col("side").cast("long").alias("side"), "level", F.col("op").cast("long").alias("op"))


@query(f"WITH {V.EVENTS} SELECT ts_event_ns, ts_receive_ns, ts_monotonic_ns, CAST(kind AS BIGINT) AS event_type, 'SIM' AS venue, symbol, 'driver' AS source, seq FROM ev")
def header_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.events(spark, sf_dir).select("ts_event_ns", "ts_receive_ns", "ts_monotonic_ns", F.col("event_type").cast("long").alias("event_type"), "venue", "symbol", "source", "seq")


@query(f"WITH {V.EVENTS} SELECT CAST(kind AS BIGINT) AS event_type, count(*) AS n, count(CASE WHEN kind = 1 THEN 1 END) AS with_level, count(CASE WHEN kind = 3 THEN 1 END) AS with_order FROM ev GROUP BY kind")
def union_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir)
    kinds = {k: eventlog.of_type(e, k) for k in ("depth", "trade", "order", "heartbeat")}
    return eventlog.union_events(kinds).groupBy(F.col("event_type").cast("long").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.count("level").alias("with_level"), F.count("order_id").alias("with_order"))


@query(f"WITH {V.EVENTS} SELECT seq, CAST(round(value * 1000000) AS BIGINT) AS price_micros, CAST(round(k * 1000) AS BIGINT) AS size_millis FROM ev WHERE kind <> 5")
def decimal_dual_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = validate.with_decimals(V.events(spark, sf_dir).filter("event_type <> 5"))
    return e.select("seq", (F.col("price_decimal") * 1_000_000).cast("long").alias("price_micros"), (F.col("size_decimal") * 1000).cast("long").alias("size_millis"))


def _errors(spark, sf_dir, kind: str) -> DataFrame:
    e = V.events(spark, sf_dir).filter(F.col("event_type") == {"depth": 1, "trade": 2, "order": 3}[kind])
    return e.select("seq", F.coalesce(validate.event_error(), F.lit("ok")).alias("verdict"))


@query(f"""WITH {V.EVENTS}, x AS (SELECT *, CASE seq % 9 WHEN 1 THEN -1 WHEN 2 THEN 0 ELSE seq END AS s2, CASE WHEN seq % 9 = 3 THEN ts_event_ns - 90000000000 ELSE ts_receive_ns END AS r2,
  CASE WHEN seq % 9 = 4 THEN '' ELSE symbol END AS y2, CASE WHEN seq % 9 = 5 THEN 1 ELSE ts_event_ns END AS e2 FROM ev)
SELECT seq, CASE WHEN e2 NOT BETWEEN {clock.MIN_WALL_NS} AND {clock.MAX_WALL_NS} THEN 'event time out of range' WHEN r2 < e2 - 60000000000 THEN 'received before event'
  WHEN s2 <= 0 THEN 'sequence not positive' WHEN length(y2) = 0 THEN 'no symbol' ELSE 'ok' END AS verdict FROM x""")
def validate_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with planted faults."""
    q = F.col("seq") % 9
    e = V.events(spark, sf_dir).withColumn("was", F.col("seq"))
    e = e.withColumns({"seq": F.when(q == 1, -1).when(q == 2, 0).otherwise(F.col("seq")), "ts_receive_ns": F.when(q == 3, F.col("ts_event_ns") - 90 * clock.NS).otherwise(F.col("ts_receive_ns")), "symbol": F.when(q == 4, "").otherwise(F.col("symbol")), "ts_event_ns": F.when(q == 5, 1).otherwise(F.col("ts_event_ns"))})
    return e.select(F.col("was").alias("seq"), F.coalesce(validate.first_error(validate.header_rules()), F.lit("ok")).alias("verdict"))


@query(f"WITH {V.EVENTS} SELECT seq, CASE WHEN value <= 0 THEN 'bad price' WHEN k <= 0 THEN 'bad size' ELSE 'ok' END AS verdict FROM ev WHERE kind = 2")
def validate_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir, "trade")


@query(f"WITH {V.EVENTS} SELECT seq, CASE WHEN value <= 0 AND seq % 3 <> 2 THEN 'bad price' ELSE 'ok' END AS verdict FROM ev WHERE kind = 1")
def validate_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir, "depth")


@query(f"WITH {V.EVENTS} SELECT seq, CASE WHEN k <= 0 THEN 'bad size' ELSE 'ok' END AS verdict FROM ev WHERE kind = 3")
def validate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir, "order")


_BARS = f"""{V.TRADES}, bars AS (SELECT part, CAST(l_shipdate AS DATE) AS day, min(ts_event_ns) AS t, max(price) AS high, min(price) AS low, min_by(price, (l_orderkey, l_linenumber, l_suppkey, size, price)) AS open,
  max_by(price, (l_orderkey, l_linenumber, l_suppkey, size, price)) AS close, sum(size) AS volume FROM tr GROUP BY 1, 2)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "size", "price")
    t = V.trades(spark, sf_dir).groupBy("part", F.to_date("l_shipdate").alias("day"))
    return t.agg(F.min("ts_event_ns").alias("ts_open_ns"), F.max("price").alias("high"), F.min("price").alias("low"), F.min_by("price", order).alias("open"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"))


@query(f"WITH {_BARS} SELECT part, day, CASE WHEN part % 11 = 0 AND low - 1 < low AND open > low - 1 THEN 'high not highest' WHEN part % 13 = 0 THEN 'bar closes before it opens' ELSE 'ok' END AS verdict FROM bars")
def validate_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each part with planted faults: a high below the low, and a close before the open."""
    b = bars(spark, sf_dir).withColumns({"high": F.when(F.col("part") % 11 == 0, F.col("low") - 1).otherwise(F.col("high")), "ts_close_ns": F.when((F.col("part") % 13 == 0) & (F.col("part") % 11 != 0), F.col("ts_open_ns")).otherwise(F.col("ts_open_ns") + 60 * clock.NS)})
    return b.select("part", "day", F.coalesce(validate.first_error(validate.type_rules("bar")), F.lit("ok")).alias("verdict"))


_OK = V.OK


@query(f"WITH {V.EVENTS} SELECT CAST(kind AS BIGINT) AS event_type, count(*) AS received, CAST(sum({_OK}) AS BIGINT) AS written, CAST(sum(1 - {_OK}) AS BIGINT) AS invalid FROM ev GROUP BY kind")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir).withColumn("error", validate.event_error())
    return e.groupBy(F.col("event_type").cast("long").alias("event_type")).agg(F.count(F.lit(1)).alias("received"), F.count_if(F.col("error").isNull()).alias("written"), F.count_if(F.col("error").isNotNull()).alias("invalid"))


@query(f"""WITH RECURSIVE {V.EVENTS}, v AS (SELECT symbol, seq, ts_monotonic_ns AS m, row_number() OVER (PARTITION BY symbol ORDER BY (seq * 37) % 101, seq) AS i FROM ev WHERE {_OK} = 1),
f AS (SELECT symbol, i, seq, true AS accepted, m AS last_m, seq AS last_s FROM v WHERE i = 1
  UNION ALL SELECT v.symbol, v.i, v.seq, v.m >= f.last_m AND v.seq > f.last_s, CASE WHEN v.m >= f.last_m AND v.seq > f.last_s THEN v.m ELSE f.last_m END,
    CASE WHEN v.m >= f.last_m AND v.seq > f.last_s THEN v.seq ELSE f.last_s END FROM f JOIN v ON v.symbol = f.symbol AND v.i = f.i + 1)
SELECT symbol, seq, accepted FROM f""")
def order_check_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid events in a permuted arrival order, judged against the last accepted one."""
    good, _ = validate.split_valid(V.events(spark, sf_dir))
    rows = good.select("symbol", "seq", "source", "ts_monotonic_ns", ((F.col("seq") * 37) % 101).alias("arrival"))
    return ordering.accept_in_order(rows, ["arrival", "seq"]).select("symbol", "seq", "accepted")


@query(f"WITH {V.EVENTS} SELECT symbol, event_id, CAST(row_number() OVER (PARTITION BY symbol ORDER BY event_id) AS BIGINT) AS seq FROM ev WHERE kind = 2 AND value > 0 AND k > 0")
def seq_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = eventlog.of_type(V.events(spark, sf_dir), "trade").filter(ingest.tick_gate(F.col("price"), F.col("size"))).withColumn("event_id", F.col("seq") - 1)
    return ordering.assign_sequence(e, "symbol", ["event_id"]).select("symbol", "event_id", "seq")


@query(f"""WITH {V.EVENTS}, x AS (SELECT symbol, seq, ts_event_ns, lag(seq) OVER w AS s, lag(ts_event_ns) OVER w AS t FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY (seq * 37) % 101, seq))
SELECT symbol, seq FROM x WHERE seq < s OR ts_event_ns < t""")
def replay_monotonic_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir).withColumn("arrival", (F.col("seq") * 37) % 101)
    return ordering.replay_violations(e, "symbol", ["arrival", "seq"]).select("symbol", "seq")


@query(f"WITH {V.EVENTS} SELECT symbol, seq, CAST((row_number() OVER (PARTITION BY symbol ORDER BY seq) - 1) // 20 AS BIGINT) AS flush FROM ev")
def flush_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.flush_batches(V.events(spark, sf_dir), "symbol", ["seq"], 20).select("symbol", "seq", "flush")


@query(f"WITH {V.EVENTS} SELECT seq, 'base/' || symbol || '/' || strftime(ts, '%Y/%m/%d') || '.parquet' AS path FROM ev")
def partition_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.events(spark, sf_dir).select("seq", eventlog.legacy_path("base").alias("path"))


@query(f"WITH {V.EVENTS} SELECT seq, symbol, CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, CAST(day(ts) AS BIGINT) AS day FROM ev")
def parse_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = V.events(spark, sf_dir).select("seq", eventlog.legacy_path("base").alias("path"))
    return paths.select("seq", eventlog.path_symbol(F.col("path")).alias("symbol"), *eventlog.path_date(F.col("path")))


@query(f"WITH {V.EVENTS} SELECT DISTINCT symbol FROM ev ORDER BY symbol")
def list_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.events(spark, sf_dir).select("symbol").distinct().orderBy("symbol")


@query(f"""WITH {V.EVENTS} SELECT symbol || '/' || strftime(ts, '%Y-%m-%d') AS file, count(*) AS events, min_by(ts_event_ns, seq) AS first_ts_ns, max_by(ts_event_ns, seq) AS last_ts_ns, min_by(symbol, seq) AS first_symbol,
  'SIM' AS first_venue, 'driver' AS first_source FROM ev GROUP BY 1""")
def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir)
    return eventlog.file_facts(e, F.concat_ws("/", "symbol", clock.utc_date("ts_event_ns").cast("string")))


@query(f"""WITH {V.EVENTS}, g AS (SELECT symbol, CAST((row_number() OVER (PARTITION BY symbol ORDER BY seq) - 1) // 16 AS BIGINT) AS row_group, ts_event_ns FROM ev)
SELECT symbol, row_group, count(*) AS rows, min(ts_event_ns) AS low, max(ts_event_ns) AS high, min(ts_event_ns) <= {T1} AND max(ts_event_ns) >= {T0} AS touched FROM g GROUP BY 1, 2""")
def row_group_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.row_groups(V.events(spark, sf_dir), ["seq"], (T0, T1), 16)


@query(f"WITH {V.EVENTS} SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(ts_event_ns % 1000000000 AS VARCHAR), 9, '0') || 'Z' AS iso FROM ev")
def iso8601_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.events(spark, sf_dir).select("seq", clock.iso8601("ts_event_ns").alias("iso"))


@query(f"WITH {V.EVENTS} SELECT seq, CASE WHEN seq % 5 = 0 THEN 0 ELSE ts_event_ns END AS ns FROM ev")
def iso8601_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir).withColumn("iso", clock.iso8601("ts_event_ns"))
    e = e.withColumn("iso", F.when(F.col("seq") % 5 == 0, F.regexp_replace("iso", "Z$", "")).otherwise(F.col("iso")))
    return e.select("seq", clock.parse_iso8601(F.col("iso")).alias("ns"))


_YEAR = "y AS (SELECT event_id, ts + to_days(CAST(event_id % 366 AS INTEGER)) AS t FROM events)"


def _over_a_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times spread over a year, so that both changes of clocks are in it."""
    return V.table(spark, sf_dir, "events").select("event_id", F.timestamp_add("DAY", (F.col("event_id") % 366).cast("int"), F.col("ts")).alias("t"))


@query(f"""WITH {_YEAR}, x AS (SELECT event_id, CASE WHEN (t >= TIMESTAMP '2024-03-10 07:00' AND t < TIMESTAMP '2024-11-03 06:00') OR t >= TIMESTAMP '2025-03-09 07:00' THEN t - INTERVAL 4 HOUR ELSE t - INTERVAL 5 HOUR END AS l FROM y)
SELECT event_id, isodow(l) <= 5 AND hour(l) * 60 + minute(l) >= 570 AND hour(l) * 60 + minute(l) < 960 AS is_open, isodow(l) <= 5 AND hour(l) * 60 + minute(l) >= 570 AND hour(l) * 60 + minute(l) <= 960 AS is_open_inclusive FROM x""")
def market_open_utc_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New York hours, 09:30 to 16:00, in summer and winter."""
    t = F.col("t").cast("timestamp")
    zone = "America/New_York"
    return _over_a_year(spark, sf_dir).select("event_id", clock.market_open(t, zone, 570, 960).alias("is_open"), clock.market_open(t, zone, 570, 960, True).alias("is_open_inclusive"))


@query(f"""WITH {_YEAR}, d AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN TIMESTAMP '2024-03-10 01:59' + to_minutes(CAST(event_id % 90 AS INTEGER)) WHEN 1 THEN TIMESTAMP '2024-11-03 00:30' + to_minutes(CAST(event_id % 120 AS INTEGER)) ELSE t END AS l FROM y)
SELECT event_id, CASE WHEN (l >= TIMESTAMP '2024-03-10 02:00' AND l < TIMESTAMP '2024-11-03 01:00') OR l >= TIMESTAMP '2025-03-09 02:00' THEN l + INTERVAL 4 HOUR ELSE l + INTERVAL 5 HOUR END AS utc FROM d""")
def localize_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New York local times in UTC, many of them in the hours that are skipped or occur twice."""
    i = F.col("event_id")
    at = lambda start, n: F.timestamp_add("MINUTE", (i % n).cast("int"), F.lit(start).cast("timestamp_ntz"))
    l = F.when(i % 5 == 0, at("2024-03-10 01:59:00", 90)).when(i % 5 == 1, at("2024-11-03 00:30:00", 120)).otherwise(F.col("t"))  # noqa: E741
    return _over_a_year(spark, sf_dir).select("event_id", clock.localize(l, F.lit("NYSE"), F.col("t")).alias("utc"))


_QUOTED = "tq AS (SELECT l_orderkey, l_linenumber, part, price, size, p_retailprice * 0.99 AS bid, p_retailprice * 1.01 AS ask FROM tr JOIN part ON part = p_partkey)"


@query(f"""WITH {V.TRADES}, {_QUOTED} SELECT CAST(CASE WHEN price >= ask THEN 0 WHEN price <= bid THEN 1 WHEN price > (bid + ask) / 2 + greatest((ask - bid) * 0.1, price * 0.0001) THEN 0
  WHEN price < (bid + ask) / 2 - greatest((ask - bid) * 0.1, price * 0.0001) THEN 1 ELSE 2 END AS BIGINT) AS aggressor, count(*) AS n FROM tq GROUP BY 1""")
def aggressor_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), (F.col("p_retailprice") * 0.99).alias("bid"), (F.col("p_retailprice") * 1.01).alias("ask"))
    t = V.trades(spark, sf_dir).join(part, "part").withColumn("aggressor", ingest.infer_aggressor(F.col("price"), F.col("bid"), F.col("ask")).cast("long"))
    return t.groupBy("aggressor").agg(F.count(F.lit(1)).alias("n"))


_HOUR = 3_600_000_000_000


@query(f"""WITH q AS (SELECT user_id % 20 AS sym, (epoch_us(ts) // 3600000000) * {_HOUR} AS t, value * 0.99 AS bid, value * 1.01 AS ask, event_id FROM events WHERE event_type <> 'view' AND day(ts) > 3),
u AS (SELECT sym, t, max_by(bid, event_id) AS bid, max_by(ask, event_id) AS ask FROM q GROUP BY 1, 2),
t AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_partkey % 20 AS sym, 1704067200000000000 + (l_orderkey % 720) * {_HOUR} AS t, l_quantity AS price FROM lineitem),
j AS (SELECT t.*, u.bid, u.ask FROM t ASOF LEFT JOIN u ON t.sym = u.sym AND t.t >= u.t)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(bid, 6) AS bid, round(ask, 6) AS ask, CAST(CASE WHEN bid IS NULL OR bid = 0 OR ask = 0 OR bid >= ask THEN 2 WHEN price >= ask THEN 0 WHEN price <= bid THEN 1
  WHEN price > (bid + ask) / 2 + greatest((ask - bid) * 0.1, price * 0.0001) THEN 0 WHEN price < (bid + ask) / 2 - greatest((ask - bid) * 0.1, price * 0.0001) THEN 1 ELSE 2 END AS BIGINT) AS aggressor FROM j""")
def prevailing_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with the quote that held at their time and the aggressor it implies; hourly times, so many tie, and trades before any quote."""
    e = V.table(spark, sf_dir, "events").filter("event_type <> 'view' and day(ts) > 3")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) * _HOUR
    quotes = e.select((F.col("user_id") % 20).alias("sym"), hour.alias("t"), (F.col("value") * 0.99).alias("bid"), (F.col("value") * 1.01).alias("ask"), "event_id")
    li = V.table(spark, sf_dir, "lineitem")
    trades = li.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", (F.col("l_partkey") % 20).alias("sym"), (F.lit(1_704_067_200 * clock.NS) + (F.col("l_orderkey") % 720) * _HOUR).alias("t"), F.col("l_quantity").alias("price"))
    rows = slices.prevailing(trades, quotes, ["sym"], "t", ["bid", "ask"], ["event_id"], 24 * _HOUR)
    side = ingest.infer_aggressor(F.col("price"), F.col("bid"), F.col("ask")).cast("long")
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.round("bid", 6).alias("bid"), F.round("ask", 6).alias("ask"), side.alias("aggressor"))


@query(f"WITH {V.EVENTS} SELECT CAST(kind AS BIGINT) AS event_type, count(*) AS n, min(k / 2) AS low, max(k / 2) AS high FROM ev WHERE k / 2 > 0 AND k / 2 < 60 GROUP BY kind")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies of half a second per unit of props.k; what isn't in (0, 60) is left out."""
    e = V.table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 5).otherwise(3).cast("long").alias("event_type"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    rows = e.withColumn("s", ingest.latency_seconds(F.col("k") * (clock.NS // 2), F.lit(0))).filter("s is not null")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))


@query(f"WITH {V.EVENTS} SELECT kind = 2 AND value > 0 AND k > 0 AS passes, count(*) AS n FROM ev GROUP BY 1")
def tick_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir)
    return e.groupBy(((F.col("event_type") == 2) & ingest.tick_gate(F.col("price"), F.col("size"))).alias("passes")).agg(F.count(F.lit(1)).alias("n"))


_BODY = ["seq", "symbol", "ts_event_ns", "ts_receive_ns", "ts_monotonic_ns", "venue", "source", "price", "size", "level", "order_id", "filled", "reason", "feed_mode"]
_CODES = ["event_type", "side", "op", "aggressor", "state"]
_UNUSED = ["ts_open_ns", "ts_close_ns", "open", "high", "low", "close", "volume", "open_decimal", "high_decimal", "low_decimal", "close_decimal", "volume_decimal"]


@query(f"""WITH {V.LOG} SELECT seq, symbol, ts_event_ns, ts_receive_ns, ts_monotonic_ns, 'SIM' AS venue, 'driver' AS source, CAST(CASE WHEN kind <> 5 THEN value END AS DOUBLE) AS price, CASE WHEN kind <> 5 THEN k END AS size,
  CASE WHEN kind = 1 THEN CAST(k AS BIGINT) % 10 END AS level, CASE WHEN kind = 3 THEN 'O' || seq END AS order_id, CASE WHEN kind = 3 THEN k / 2 END AS filled, CASE WHEN was = 'error' THEN 'error' END AS reason, 'replay' AS feed_mode,
  CAST(kind AS BIGINT) AS event_type, CASE WHEN kind = 1 THEN seq % 2 END AS side, CASE WHEN kind = 1 THEN seq % 3 END AS op, CASE WHEN kind = 2 THEN CAST(2 AS BIGINT) END AS aggressor, CASE WHEN kind = 3 THEN CAST(CASE was WHEN 'error' THEN 5 ELSE 0 END AS BIGINT) END AS state,
  CASE WHEN kind <> 5 THEN CAST(round(value * 1000000) AS BIGINT) END AS price_micros, CASE WHEN kind <> 5 THEN CAST(round(k * 1000) AS BIGINT) END AS size_millis, CASE WHEN kind = 3 THEN CAST(round(k / 2 * 1000) AS BIGINT) END AS filled_millis, CAST(0 AS BIGINT) AS others FROM lg""")
def write_read_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written with its manifest and read back: what was valid, all columns of it, once."""
    log = V.log(spark, sf_dir)
    micros = [(F.col(f"{c}_decimal") * unit).cast("long").alias(f"{c}_{name}") for c, unit, name in (("price", 1_000_000, "micros"), ("size", 1000, "millis"), ("filled", 1000, "millis"))]
    others = sum((F.col(c).isNotNull().cast("long") for c in _UNUSED), F.lit(0).cast("long"))
    return log.select(*_BODY, *[F.col(c).cast("long").alias(c) for c in _CODES], *micros, others.alias("others"))


@query(f"""WITH RECURSIVE {V.EVENTS}, v AS (SELECT symbol, CAST(ts AS DATE) AS d, seq, ts_monotonic_ns AS m, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY (seq * 37) % 101, seq) AS i FROM ev WHERE {_OK} = 1),
f AS (SELECT symbol, d, i, seq, CAST(NULL AS VARCHAR) AS error, m AS last_m, seq AS last_s FROM v WHERE i = 1
  UNION ALL SELECT v.symbol, v.d, v.i, v.seq, CASE WHEN v.m < f.last_m THEN 'monotonic clock went back' WHEN v.seq <= f.last_s THEN 'sequence didn''t grow' END, CASE WHEN v.m >= f.last_m AND v.seq > f.last_s THEN v.m ELSE f.last_m END,
    CASE WHEN v.m >= f.last_m AND v.seq > f.last_s THEN v.seq ELSE f.last_s END FROM f JOIN v ON v.symbol = f.symbol AND v.d = f.d AND v.i = f.i + 1)
SELECT symbol, seq, error FROM f WHERE error IS NOT NULL
UNION ALL SELECT symbol, seq, CASE WHEN kind = 3 THEN 'bad size' WHEN value <= 0 THEN 'bad price' ELSE 'bad size' END FROM ev WHERE {_OK} = 0""")
def append_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an append in a permuted order of arrival refuses, by validation or by the order check of a symbol's day."""
    e = V.events(spark, sf_dir).withColumn("arrival", (F.col("seq") * 37) % 101)
    return eventlog.check(e, ["arrival", "seq"]).filter("error is not null").select("symbol", "seq", "error")


@query(f"""WITH RECURSIVE {V.EVENTS}, n AS (SELECT symbol, seq, ts_event_ns AS t, row_number() OVER (PARTITION BY symbol ORDER BY ts_event_ns, seq) AS i FROM ev),
f AS (SELECT symbol, seq, i, CAST(0 AS BIGINT) AS flush, 1 AS c, t AS since FROM n WHERE i = 1
  UNION ALL SELECT n.symbol, n.seq, n.i, CASE WHEN f.c >= 3 OR n.t - f.since >= 172800000000000 THEN f.flush + 1 ELSE f.flush END, CASE WHEN f.c >= 3 OR n.t - f.since >= 172800000000000 THEN 1 ELSE f.c + 1 END,
    CASE WHEN f.c >= 3 OR n.t - f.since >= 172800000000000 THEN n.t ELSE f.since END FROM f JOIN n ON n.symbol = f.symbol AND n.i = f.i + 1)
SELECT symbol, seq, flush FROM f""")
def flush_by_rows_or_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flushes of a symbol's buffer at three rows, or two days after its first one."""
    e = V.events(spark, sf_dir).select("symbol", "seq", "ts_event_ns")
    return ordering.timed_flushes(e, "symbol", "ts_event_ns", ["seq"], 3, 172_800 * clock.NS).select("symbol", "seq", "flush")


@query(f"""WITH {V.LOG}, d AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n, min(ts_event_ns) AS low, max(ts_event_ns) AS high FROM lg GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, min(low) AS low, max(high) AS high, CAST(sum(n) FILTER (WHERE low <= {T1} AND high >= {T0}) AS BIGINT) AS touched_rows FROM d""")
def footer_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the written log by its zone map, and of the zones that a time range touches."""
    log = V.log(spark, sf_dir)
    groups = eventlog.touched(eventlog.read_zones(spark, log.log_path), (T0, T1))
    return groups.agg(F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum(F.when(F.col("touched"), F.col("rows"))).alias("touched_rows"))


@query(f"WITH {V.LOG} SELECT CAST(ts AS DATE) AS day, count(*) AS events, min_by(ts_event_ns, seq) AS first_ts_ns, max_by(ts_event_ns, seq) AS last_ts_ns FROM lg GROUP BY 1")
def manifest_of_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written log's manifest, by day."""
    m = eventlog.read_manifest(spark, V.log(spark, sf_dir).log_path).filter("write_complete")
    day = F.to_date(F.regexp_extract("file", "event_date=([0-9-]+)", 1))
    return m.groupBy(day.alias("day")).agg(F.sum("events").alias("events"), F.min_by("first_ts_ns", "first_seq").alias("first_ts_ns"), F.max_by("last_ts_ns", "last_seq").alias("last_ts_ns"))


@query(f"WITH {V.EVENTS} SELECT seq, CASE kind WHEN 1 THEN 'depth' WHEN 2 THEN 'trade' WHEN 3 THEN 'order' ELSE 'heartbeat' END AS name FROM ev")
def event_type_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.events(spark, sf_dir).select("seq", eventlog.type_name(F.col("event_type")).alias("name"))


@query(f"WITH {_BARS} SELECT CAST(part AS VARCHAR) AS symbol, t AS ts_open_ns, t + 60000000000 AS ts_close_ns, CAST(floor(open * 1000) AS BIGINT) AS open, CAST(floor(high * 1000) AS BIGINT) AS high, CAST(floor(low * 1000) AS BIGINT) AS low, CAST(floor(close * 1000) AS BIGINT) AS close, volume FROM bars")
def type_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumns({"symbol": F.col("part").cast("string"), "ts_event_ns": F.col("ts_open_ns"), "ts_close_ns": F.col("ts_open_ns") + 60 * clock.NS})
    r = eventlog.of_type(eventlog.union_events({"bar": b, "trade": V.trades(spark, sf_dir).filter("false")}), "bar")
    return r.select("symbol", "ts_open_ns", "ts_close_ns", *[F.floor(F.col(c) * 1000).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query(f"WITH {V.EVENTS} SELECT symbol, seq, ts_event_ns FROM ev WHERE kind = 5")
def type_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.of_type(V.events(spark, sf_dir), "heartbeat").select("symbol", "seq", "ts_event_ns")


@query(f"WITH {V.LOG} SELECT symbol, seq, ts_event_ns FROM lg ORDER BY ts_event_ns DESC, seq DESC, symbol LIMIT 100")
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.newest(V.log(spark, sf_dir)).select("symbol", "seq", "ts_event_ns")


@query("SELECT event_type, CAST(floor(count(*) * 1000 / 250000.0) AS BIGINT) AS row_groups FROM events GROUP BY 1")
def row_group_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups that a thousand times the events would fill."""
    n = V.table(spark, sf_dir, "events").groupBy("event_type").agg((F.count(F.lit(1)) * 1000).alias("n"))
    return n.select("event_type", eventlog.row_group_estimate(F.col("n")).alias("row_groups"))


@query(f"WITH {V.EVENTS} SELECT seq, ts_monotonic_ns - 1704844800000000000 > 0 AND ts_monotonic_ns <= 1705708800000000000 + 1000000000 AS valid FROM ev")
def monotonic_clock_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monotonic clocks counted from a boot time, against a fixed now."""
    boot = 1_704_844_800 * clock.NS
    return V.events(spark, sf_dir).select("seq", ordering.monotonic_valid(F.col("ts_monotonic_ns") - boot, F.lit(T1 - boot)).alias("valid"))


@query("SELECT l_orderkey, l_linenumber, CAST(least(power(2, l_linenumber) * 5, 60) AS DOUBLE) AS wait FROM lineitem")
def reconnect_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ingest.backoff_seconds(F.col("l_linenumber")).alias("wait"))


@query()
def mock_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many random ticks as there are orders, through the gate and as trades."""
    n = V.table(spark, sf_dir, "orders").count()
    t = ingest.ticks_to_trades(ingest.mock_ticks(spark, n, ["AAPL", "MSFT", "SPY"], seed=7))
    return t.filter(validate.event_error().isNull()).select("symbol", "seq", "price", "size", "venue", "aggressor")


@query("SELECT count(*) AS received, count(*) FILTER (WHERE value > 0) AS written, count(*) FILTER (WHERE NOT value > 0) AS invalid, epoch_us(max(ts)) * 1000 AS last_ts_ns FROM events")
def feed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events").select(F.col("value").alias("price"), F.lit(1.0).alias("size"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_event_ns"))
    return ingest.feed_counters(e)


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS \"at\", 'U' || user_id AS symbol, count(*) AS events FROM events GROUP BY 1, 2")
def heartbeat_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events").select(F.concat(F.lit("U"), "user_id").alias("symbol"), F.col("ts").alias("at"))
    return ingest.heartbeats(e, "at", "1 hour")


@query(f"WITH {_YEAR} SELECT event_id, strftime(CASE WHEN (t >= TIMESTAMP '2024-03-10 07:00' AND t < TIMESTAMP '2024-11-03 06:00') OR t >= TIMESTAMP '2025-03-09 07:00' THEN t - INTERVAL 4 HOUR ELSE t - INTERVAL 5 HOUR END, '%H:%M') AS clock FROM y")
def venue_local_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_a_year(spark, sf_dir).select("event_id", clock.local_clock(F.col("t"), F.lit("America/New_York")).alias("clock"))
