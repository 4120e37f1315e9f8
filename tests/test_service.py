"""The endpoint layer, and reading a table from a database."""

import datetime as dt

from pyspark.sql import functions as F

from tidelog.functions.ids import make_id
from tidelog.operators import metrics
from tidelog.plans import views as V
from tidelog.service import Monitor, Registry
from tidelog.sources import files

SMALL = "/root/testdata/sf0.001"


def day(n):
    return F.lit(dt.datetime(2024, 1, n))


def test_registry(spark):
    edges = V.edges(spark, SMALL).withColumns({"valid_from": F.col("observed_at"), "source": F.lit("driver")})
    r = Registry(*[f(spark, SMALL) for f in (V.entities, V.identifiers, V.aliases, V.attributes)], edges, V.quarantine(spark, SMALL))
    before = r.stats().first()
    one = spark.range(1)
    r, bad = r.add_entities(one.select(make_id("CO", F.lit(99_999)).alias("syn_id"), F.lit("COMPANY").alias("type"), F.lit(" New ").alias("canonical_name"), F.lit(None).cast("string").alias("status")))
    assert bad.count() == 0 and r.stats().first().active_entities == before.active_entities + 1
    r, bad = r.add_aliases(one.select(make_id("CO", F.lit(99_999)).alias("syn_id"), F.lit("").alias("alias"), F.lit(1.0).alias("confidence")))
    assert [x.error for x in bad.collect()] == ["no alias"]
    r, bad = r.add_identifiers(one.select(make_id("CO", F.lit(99_999)).alias("syn_id"), F.lit("ISIN").alias("scheme"), F.lit("X1").alias("value"), day(2).alias("valid_from")))
    probe = one.select(F.lit("ISIN").alias("scheme"), F.lit("X1").alias("value"), day(3).alias("at"))
    assert bad.count() == 0 and [x.canonical_name for x in r.resolve(probe).collect()] == ["New"]
    edge = one.select(make_id("CO", F.lit(99_999)).alias("src_syn_id"), make_id("SC", F.lit(1)).alias("dst_syn_id"), F.lit("BELONGS_TO").alias("rel_type"), F.lit("me").alias("source"), F.lit(0.5).alias("confidence"), day(2).alias("valid_from"))
    more, bad = r.add_edges(edge)
    assert bad.count() == 0 and more.edges.filter("source = 'me'").count() == 1
    assert [x.error for x in r.add_edges(edge.withColumn("rel_type", F.lit("LIKES")))[1].collect()] == ["unknown relation"]
    assert more.close_edges(edge, day(5)).edges.filter("source = 'me' and valid_to is null").count() == 0
    full = edge.withColumns({"attrs": F.lit('{"b": 1, "a": 2}'), "evidence": F.lit("e"), "observed_at": day(3), "note": F.lit("n")})
    more, bad = more.add_edges(full.withColumn("valid_from", day(3)))
    again, bad2 = more.add_edges(full.withColumns({"valid_from": day(4), "attrs": F.lit('{"a":2,"b":1}'), "observed_at": day(4)}))  # the same values
    changed, bad3 = again.add_edges(full.withColumns({"valid_from": F.lit(None).cast("timestamp_ntz"), "attrs": F.lit('{"a": 3}'), "observed_at": day(7)}))
    assert bad.count() == bad2.count() == bad3.count() == 0
    versions = changed.edges.filter("source = 'me'").orderBy("valid_from").collect()
    assert [(v.attrs, v.evidence, v.observed_at.day, v.note, v.valid_from.day, v.valid_to and v.valid_to.day) for v in versions[1:]] == [('{"a":2,"b":1}', "e", 3, "n", 3, 7), ('{"a":3}', "e", 7, "n", 7, None)]
    assert [x.observed_at.day for x in changed.edges_of(versions[0].src_syn_id, active_only=False).collect()][1:3] == [7, 3]  # the first one was observed now
    att = one.select(make_id("CO", F.lit(1)).alias("syn_id"), F.lit("PROFILE").alias("key"), F.lit("JSON").alias("datatype"), F.lit(None).cast("string").alias("value_string"), F.lit(None).cast("double").alias("value_number"), F.lit('{"a":  1}').alias("value_json"), F.lit("driver").alias("source"), F.lit(1.0).alias("confidence"), day(2).alias("valid_from"))
    with_att, bad = r.add_attributes(att)
    assert bad.count() == 0 and with_att.attributes.filter("value_json = '{\"a\":1}' and valid_to is null").count() == 1
    assert r.add_attributes(att.withColumn("value_json", F.lit(None).cast("string")))[1].count() == 1
    name = r.aliases.filter("confidence is null").first()
    decided, held = r.link(spark.createDataFrame([(1, name.alias), (2, "qqq zzz")], "mention_id long, text string"))
    assert {x.mention_id: x.reason for x in decided.collect()}[2] == "No candidates found" and held.filter("mention_id = 2").count() == 1
    page, totals = r.quarantine(limit=5)
    item = page.first().id
    after, bad = r.resolve_quarantined(one.select(F.lit(item).alias("id"), make_id("CO", F.lit(1)).alias("syn_id"), F.lit("me").alias("resolved_by"), day(9).alias("resolved_at")))
    assert bad.count() == 0 and after.stats().first().unresolved_quarantine == before.unresolved_quarantine - 1
    sid = r.edges.filter("rel_type = 'SUPPLIES' and valid_to is null").first().src_syn_id
    assert r.edges_of(sid, "out", "SUPPLIES", limit=3).count() <= 3 and {x.syn_id for x in r.edges_of(sid).collect()} == {sid}
    assert r.entity(sid).count() == 1 and totals.count() == 2 and r.edge_stats().count() == 2


def test_monitor(spark):
    rows = [("network_latency_seconds", {"venue": "NYSE"}, 10, 0.01), *[("events_written_total", {"symbol": s}, at, v) for s, vs in (("A", (1.0, 4.0)), ("B", (2.0, 2.0))) for at, v in zip((10, 40), vs)]]
    m = Monitor(spark.createDataFrame(rows, "name string, labels map<string,string>, at long, value double"))
    venues = spark.createDataFrame([("NYSE",), ("LSE",)], "venue string")
    assert {r.venue: r.status for r in m.venues(venues, 50).collect()} == {"NYSE": "connected", "LSE": "disconnected"}
    quotes = spark.createDataFrame([("A", 478.254, 1.5), ("B", 10.0, -2.0), ("C", 1.0, 0.0)], "symbol string, price double, change_percent double")
    assert {r.symbol: (r.price, r.change, r.live) for r in m.tickers(quotes, 50).collect()} == {"A": (478.25, 7.17, True), "B": (10.0, -0.2, False), "C": (1.0, 0.0, False)}
    assert m.range(metrics.Expr("sum_rate", "events_written_total"), 0, 60, 15).count() >= 2
    fired, counts = m.alerts(spark.createDataFrame([("disconnected", 0.0), ("high_latency", 1.0)], "id string, value double"))
    assert fired.count() == 2 and {r.severity: r.n for r in counts.collect()} == {"critical": 1, "warning": 1}


def test_jdbc(spark, tmp_path):
    """An embedded database, read whole and by ranges of a column in parallel."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(100).select(F.col("id").alias("ID"), (F.col("id") * 2).alias("TWICE")).coalesce(1).write.format("jdbc").option("url", url).option("dbtable", "T").options(**driver).save()
    whole = files.read_jdbc(spark, url, "T", properties=driver)
    parts = files.read_jdbc(spark, url, "T", "ID", (0, 100), 4, driver)
    assert whole.count() == 100 and parts.rdd.getNumPartitions() == 4 and parts.filter("TWICE = 2 * ID").count() == 100
