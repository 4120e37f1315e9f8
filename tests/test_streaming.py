"""Streams over several files: restart, late rows, sequences, windows, live buffers, mock ticks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelog.operators import metrics
from tidelog.service import Monitor
from tidelog.sources import eventlog
from tidelog.streaming import feed, ingest, observe

BASE = 1_704_844_800_000_000_000


@pytest.fixture
def files_in(spark, tmp_path):
    """Writes one input file for each call, and opens them as a stream of one file a batch."""

    class Feed:
        path = str(tmp_path / "in")

        def put(self, rows, schema):
            self.schema = spark.createDataFrame([], schema).schema
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(self.path)

        def open(self):
            return spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)

    return Feed()


def test_log_restarts(spark, files_in, tmp_path):
    """A second run goes on where the first one ended; nothing is written twice."""
    path, checkpoint = f"file://{tmp_path}/log", f"file://{tmp_path}/checkpoint"
    schema = "symbol string, price double, size double, ts_event_ns long, ts_receive_ns long, ts_monotonic_ns long, venue string, source string, seq long, bid double, ask double"
    tick = lambda k, price=1.0: ("S", price, 1.0, BASE + k, BASE + k, BASE + k, "", "t", k, None, None)
    files_in.put([tick(1), tick(2, -1.0), tick(3)], schema)
    run = lambda mode: eventlog.append_stream(ingest.ticks_to_trades(files_in.open()), path, checkpoint, "s", mode, every=None).awaitTermination()
    run("live")
    run("live")
    assert sorted(r.seq for r in eventlog.read_log(spark, path).collect()) == [1, 3]
    files_in.put([tick(4), tick(5)], schema)
    run("delayed")
    got = eventlog.read_log(spark, path)
    assert sorted((r.seq, r.venue, r.feed_mode) for r in got.collect()) == [(1, "SMART", "live"), (3, "SMART", "live"), (4, "SMART", "delayed"), (5, "SMART", "delayed")]
    assert eventlog.incomplete_files(got, eventlog.read_manifest(spark, path)).count() == 0


def test_append_refuses_late_events(spark, files_in, tmp_path):
    """An event that is late against an earlier micro-batch, or an earlier run, is refused; nanoseconds and nulls stay as they are."""
    path, checkpoint = f"file://{tmp_path}/log", f"file://{tmp_path}/checkpoint"
    schema = "symbol string, seq long, ts_event_ns long, ts_receive_ns long, ts_monotonic_ns long, event_type int, venue string, source string, price double, size double, level long, ts_open_ns long, ts_close_ns long, open double, high double, low double, close double, volume double"
    trade = lambda seq, ns, symbol="S", price=1.0, source="t": (symbol, seq, BASE + ns, BASE + ns, BASE + ns, 2, "V", source, price, 1.0, None, None, None, None, None, None, None, None)
    bar = lambda seq, ns: ("S", seq, BASE + ns, BASE + ns, BASE + ns, 4, "V", "t", None, None, None, BASE + 1, BASE + 2, 1.0, 1.0, 1.0, 1.0, 5.0)
    run = lambda: eventlog.append_stream(files_in.open(), path, checkpoint, "s", "live", every=None).awaitTermination()
    files_in.put([trade(5, 500), trade(6, 600, price=-1.0)], schema)
    files_in.put([trade(3, 300), trade(6, 500, source="other"), trade(1, 1, "T")], schema)
    run()
    files_in.put([trade(6, 550), bar(7, 560), trade(7, 700)], schema)
    run()
    log = eventlog.read_log(spark, path)
    assert sorted((r.symbol, r.seq, r.ts_event_ns - BASE) for r in log.collect()) == [("S", 5, 500), ("S", 6, 500), ("S", 6, 550), ("S", 7, 560), ("T", 1, 1)]
    kept = log.filter("event_type = 4").first()
    assert (kept.ts_open_ns, kept.ts_close_ns, kept.level, kept.price) == (BASE + 1, BASE + 2, None, None)
    refused = spark.read.parquet(f"{path}/refused")
    assert sorted((r.seq, r.error) for r in refused.collect()) == [(3, "monotonic clock went back"), (6, "bad price"), (7, "sequence didn't grow")]


def test_listener_counts(spark, files_in, tmp_path):
    """Received, written and refused events and the last time, from what the stream observes; over micro-batches."""
    schema = "symbol string, price double, size double, ts_event_ns long, ts_receive_ns long, ts_monotonic_ns long, venue string, source string, seq long, bid double, ask double"
    tick = lambda k: ("S", 1.0, 1.0, BASE + k * 10**9, BASE + k * 10**9, BASE + k, "", "t", k, None, None)
    files_in.put([tick(1), tick(5)], schema)
    files_in.put([tick(3), tick(6), tick(7)], schema)
    heard = observe.IngestListener()
    spark.streams.addListener(heard)
    try:
        query = eventlog.append_stream(ingest.ticks_to_trades(files_in.open()), f"file://{tmp_path}/log", f"file://{tmp_path}/c", "s", "live", every=None, name="heard")
        query.awaitTermination()
        assert heard.wait(str(query.runId))
    finally:
        spark.streams.removeListener(heard)
    monitor = Monitor(heard.samples(spark))
    value = lambda name: monitor.instant(metrics.Expr("sum", name, {"query": "heard"}), 1 << 40).first().value
    assert [value(n) for n in (*observe.COUNTERS.values(), observe.LAST)] == [5.0, 4.0, 1.0, BASE / 1e9 + 7]


def test_silence(spark, files_in):
    """A key that falls silent is noticed without a further event of its own, and so is its return."""
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    files_in.put([("a", t(0)), ("b", t(0)), ("a", t(10)), ("c", t(5)), ("c", t(100))], "symbol string, at timestamp")
    files_in.put([("b", t(60)), ("b", t(70)), (None, t(70))], "symbol string, at timestamp")
    files_in.put([("a", t(90)), ("b", t(90)), ("a", t(15))], "symbol string, at timestamp")
    files_in.put([("b", t(130)), ("b", t(300))], "symbol string, at timestamp")
    got = ingest.run_available(ingest.silences(files_in.open(), "symbol", "at", 30, "60 seconds"))
    seconds = lambda x: int((x.replace(tzinfo=None) - t(0)).total_seconds())
    found = sorted((r.symbol or "", seconds(r["at"]), r.silent, seconds(r["last"])) for r in got.collect())
    assert found == [
        ("", 100, True, 70), ("a", 40, True, 10), ("a", 90, False, 10), ("a", 120, True, 90), ("b", 30, True, 0), ("b", 60, False, 0), ("b", 120, True, 90), ("b", 130, False, 90), ("b", 160, True, 130), ("b", 300, False, 130),
        ("c", 35, True, 5), ("c", 100, False, 5), ("c", 130, True, 100),
    ]


def test_state_over_batches(spark, files_in, tmp_path):
    schema = "symbol string, seq long, ts_monotonic_ns long, arrival long"
    files_in.put([("a", 1, 10, 1), ("a", 3, 12, 2), ("b", 1, 5, 3)], schema)
    first = ingest.run_available(ingest.order_check(files_in.open()), checkpoint=f"file://{tmp_path}/c", out=f"file://{tmp_path}/o")
    assert {(r.symbol, r.seq, r.accepted) for r in first.collect()} == {("a", 1, True), ("a", 3, True), ("b", 1, True)}
    files_in.put([("a", 2, 13, 4), ("a", 4, 11, 5), ("a", 4, 13, 6), ("b", 2, 5, 7)], schema)
    later = ingest.run_available(ingest.order_check(files_in.open()), checkpoint=f"file://{tmp_path}/c", out=f"file://{tmp_path}/o").filter("batch > 0")
    assert sorted((r.symbol, r.seq, r.accepted) for r in later.collect()) == [("a", 2, False), ("a", 4, False), ("a", 4, True), ("b", 2, True)]
    numbers = ingest.run_available(ingest.sequence_numbers(files_in.open()))
    assert sorted((r.symbol, r.arrival, r.seq) for r in numbers.collect()) == [("a", 1, 1), ("a", 2, 2), ("a", 4, 3), ("a", 5, 4), ("a", 6, 5), ("b", 3, 1), ("b", 7, 2)]


def test_late_rows(spark, files_in):
    """With a watermark, a row that comes after its window has closed is dropped; without, none is."""
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    for rows in ([("k", t(0)), ("k", t(200))], [("k", t(1)), ("k", t(195))], [("k", t(2)), ("k", t(400))]):
        files_in.put(rows, "key string, at timestamp")

    def counts(late):
        out = ingest.run_available(ingest.window_counts(files_in.open(), "at", ["key"], "1 hour", late=late), "update")
        return {r.start: r.n for r in out.groupBy(F.col("start").cast("timestamp_ntz").alias("start")).agg(F.max_by("n", "batch").alias("n")).collect()}

    every = counts(None)
    assert every == {t(0): 3, t(180): 2, t(360): 1}
    strict = counts("10 minutes")
    assert strict[t(180)] == 2 and strict[t(0)] < 3


def test_live_buffer(spark):
    batch = lambda *ks: spark.createDataFrame([(f"s{k}", k, BASE + k) for k in ks], "symbol string, seq long, ts_event_ns long")
    kept = ingest.keep_newest(spark, batch(1, 2, 3), None, 4)
    kept = ingest.keep_newest(spark, batch(5, 4), kept, 4)
    assert [r.seq for r in kept.collect()] == [5, 4, 3, 2]


def test_mock_ticks(spark):
    ticks = ingest.mock_ticks(spark, 2000, ["A", "B"], seed=3)
    assert ticks.repartition(7).select("symbol", "price", "size", "seq").exceptAll(ingest.mock_ticks(spark, 2000, ["A", "B"], seed=3).select("symbol", "price", "size", "seq")).count() == 0
    facts = ticks.agg(F.min("price"), F.max("price"), F.min("size"), F.max("size"), F.count_distinct("symbol"), F.count_distinct("price")).first()
    assert 100 <= facts[0] < 105 and 195 < facts[1] < 200 and 1 <= facts[2] < 20 and 980 < facts[3] <= 1000 and facts[4] == 2 and facts[5] > 1900


def test_tick_feed(spark, tmp_path):
    """Ticks of a live source into the log; a second run goes on after the first, with the same ticks as one run."""
    feed.register(spark)
    path, checkpoint = f"file://{tmp_path}/log", f"file://{tmp_path}/checkpoint"

    def run(rows):
        ticks = spark.readStream.format("tick_feed").option("symbols", "spy, AAPL,SPY").option("rows", rows).option("batch", 200).load()
        query = eventlog.append_stream(ingest.ticks_to_trades(ticks), path, checkpoint, "s", "live", every="0 seconds")
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run(500)
    assert eventlog.read_log(spark, path).count() == 500
    run(900)
    log = eventlog.read_log(spark, path)
    reader = feed.Ticks(["AAPL", "SPY"], 900, 900, 0)
    assert sorted((r.seq, r.symbol, r.price) for r in log.collect()) == sorted((t[8], t[0], t[1]) for t in map(reader.tick, range(900)))
    assert {r.symbol for r in log.select("symbol").distinct().collect()} == {"AAPL", "SPY"} and log.filter("aggressor = 2").count() > 0


def test_expressions(spark):
    rows = [("m_total", {"s": s}, at, float(v)) for s, steps in (("a", (0, 5, 9, 2)), ("b", (1, 1, 1, 1))) for at, v in zip((0, 10, 20, 30), steps)]
    rows += [("h_bucket", {"le": le}, at, v) for le, vs in (("1", (0.0, 2.0)), ("5", (0.0, 3.0)), ("+Inf", (0.0, 4.0))) for at, v in zip((10, 30), vs)]
    d = spark.createDataFrame(rows, "name string, labels map<string,string>, at long, value double")
    one = lambda e, at=30: [tuple(r) for r in metrics.query_instant(d, e, at).collect()]
    assert one(metrics.Expr("sum", "m_total")) == [(3.0,)]
    assert one(metrics.Expr("sum", "m_total", by=("s",)), 15) == [("a", 5.0), ("b", 1.0)] or sorted(one(metrics.Expr("sum", "m_total", by=("s",)), 15)) == [("a", 5.0), ("b", 1.0)]
    assert one(metrics.Expr("sum_rate", "m_total", {"s": "a"}, window=60)) == [(11 / 60,)]  # 5, 4 and, after the restart, 2
    assert one(metrics.Expr("quantile", "h_bucket", q=0.5, window=60)) == [(1.0,)]
    assert one(metrics.Expr("quantile", "h_bucket", q=0.99, window=60)) == [(5.0,)]
    assert one(metrics.Expr("sum", "none")) == []
    labelled = metrics.query_instant(d, metrics.Expr("rate", "m_total", window=60), 30).collect()
    assert {(r.labels["s"], round(r.value * 60)) for r in labelled} == {("a", 11), ("b", 0)}
    with pytest.raises(ValueError):
        metrics.query_instant(d, metrics.Expr("max", "m_total"), 30)


def test_order_check_of_large_groups(spark, files_in, monkeypatch):
    """A group's rows are never one frame, many files share a call, and a null among its numbers leaves nanoseconds whole."""
    from tidelog.streaming import state

    frames = []
    monkeypatch.setattr(state.pd, "concat", lambda *a, **k: frames.append(a))
    monkeypatch.setattr(state, "HELD", 3)
    calls = []
    check = state.OrderCheck(["error", "n"], state.pa.schema([("check_file", state.pa.string()), ("check_clock", state.pa.int64()), ("check_seq", state.pa.int64()), ("check_source", state.pa.string()), ("check_arrival0", state.pa.int64())]))

    class Value:
        kept = None
        exists = lambda self: self.kept is not None
        get = lambda self: self.kept

        def update(self, value):
            self.kept = value
            calls.append(1)

    check.last = Value()
    rows = [(f"f{k % 4}", 10 + k - 5 * (k == 9), k + 1 - 8 * (k == 14), None if k % 2 else "s", k, None if k != 6 else "bad", k) for k in range(16)]
    frame = state.pd.DataFrame(rows, columns=["check_file", "check_clock", "check_seq", "check_source", "check_arrival0", "error", "n"])
    got = [r for part in (frame[:8], frame[8:]) for f in check.handleInputRows((0,), iter([part[k : k + 2] for k in range(0, 8, 2)]), None) for r in f.itertuples(index=False)]
    assert [(r.n, r.error) for r in got if r.error] == [(6, "bad"), (9, "monotonic clock went back"), (14, "sequence didn't grow")] and [r.n for r in got] == list(range(16))
    assert not frames and len(calls) == 2
    files_in.put([("a", 1, BASE + 1, 1), ("a", 2, BASE + 3, 2), ("a", None, BASE + 2, 3), ("a", 3, BASE + 2, 4)], "symbol string, seq long, ts_monotonic_ns long, arrival long")
    out = ingest.run_available(ingest.order_check(files_in.open()))
    assert sorted((r.seq or 0, r.accepted) for r in out.collect() if r.seq) == [(1, True), (2, True), (3, False)]
