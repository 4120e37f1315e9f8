"""Event log: golden round trip, validator vectors, filters, order fold, clocks."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions import clock
from tidelog.operators import ordering, validate
from tidelog.schema import EVENT
from tidelog.sources import eventlog, files
from tidelog.streaming import ingest

BASE = 1_704_844_800_000_000_000
HEADER = dict(ts_event_ns=BASE, ts_receive_ns=BASE + 1000, ts_monotonic_ns=500, event_type=2, venue="TEST", symbol="AAPL", source="t", seq=1)


def events(spark, rows):
    full = [tuple((HEADER | r).get(c) for c in EVENT.names) for r in rows]
    import pyspark.sql.types as T

    return spark.createDataFrame(full, T.StructType([T.StructField(f.name, f.dataType, True) for f in EVENT]))


def golden(spark):
    """83 events of four symbols: the rule of the golden data set."""
    out = []

    def add(kind, symbol="AAPL", **body):
        n = len(out)
        out.append(dict(ts_event_ns=BASE + n * 1_000_000, ts_receive_ns=BASE + n * 1_000_000 + 1000, ts_monotonic_ns=BASE + n * 1_000_000 + 500, event_type=kind, symbol=symbol, source="golden", seq=n + 1) | body)

    add(5)
    for level in range(3):
        add(1, side=0, price=178.00 - 0.01 * level, size=100.0 * (level + 1), level=level, op=0)
        add(1, side=1, price=178.02 + 0.01 * level, size=100.0 * (level + 1), level=level, op=0)
    add(2, price=178.01, size=50.0, aggressor=0)
    add(1, side=0, price=178.00, size=150.0, level=0, op=1)
    add(1, side=1, price=178.04, size=0.0, level=2, op=2)
    for state, filled in ((0, 0.0), (1, 0.0), (4, 100.0)):
        add(3, order_id="ORDER-001", state=state, price=178.0, size=100.0, filled=filled)
    add(4, ts_open_ns=BASE, ts_close_ns=BASE + 60 * clock.NS, open=177.95, high=178.10, low=177.90, close=178.01, volume=10000.0)
    add(2, price=178.01, size=0.001, aggressor=2)
    add(1, side=0, price=177.99, size=1_000_000.0, level=1, op=1)
    add(3, order_id="ORDER-002", state=5, price=180.0, size=100.0, filled=0.0, reason="Price too far from market")
    for s in ("MSFT", "SPY", "TSLA"):
        add(5, s)
        add(2, s, price=100.0, size=100.0, aggressor=1)
    for i in range(60):
        if i % 3 == 0:
            add(2, price=178 + (i % 10) * 0.01, size=10.0 * (i % 5 + 1), aggressor=0 if i % 2 == 0 else 1)
        elif i % 3 == 1:
            add(1, side=0 if i % 2 == 0 else 1, price=178.0, size=10.0, level=0, op=1)
        else:
            add(5)
    return events(spark, out)


def test_golden_round_trip(spark, tmp_path):
    e = golden(spark)
    assert e.count() == 83
    path = f"file://{tmp_path}/log"
    assert eventlog.write_log(e, path, "s1", "replay").count() == 0
    back = eventlog.read_log(spark, path)
    columns = [c for c in EVENT.names if not c.endswith("_decimal")]
    assert back.select(columns).exceptAll(e.select(columns)).count() == e.select(columns).exceptAll(back.select(columns)).count() == 0
    assert back.filter("price_decimal <> cast(price as decimal(18,6))").count() == 0
    assert ordering.replay_violations(back, "symbol", ["seq"]).count() == 0
    manifest = eventlog.read_manifest(spark, path)
    assert manifest.agg(F.sum("events")).first()[0] == 83 and manifest.count() == 4
    assert eventlog.incomplete_files(back, manifest).count() == 0
    assert [r.symbol for r in eventlog.list_files(spark, path).select("symbol").collect()] == ["AAPL", "MSFT", "SPY", "TSLA"]
    by_symbol = eventlog.storage_by_symbol(eventlog.storage_files(spark, path)).collect()
    assert {r.symbol: (r.files, r.distinct_days) for r in by_symbol} == {s: (1, 1) for s in ("AAPL", "MSFT", "SPY", "TSLA")} and all(r.bytes > 1000 for r in by_symbol)
    for _ in range(2):  # a commit that is written again replaces itself
        eventlog.write_log(events(spark, [dict(symbol="NEW", price=1.0, size=1.0)]), path, "s2", "live", commit="c2")
    assert eventlog.read_manifest(spark, path).count() == 5 and eventlog.read_log(spark, path).count() == 84
    back.limit(1).drop("commit", "symbol", "event_date").write.parquet(f"{path}/events/commit=torn/symbol=X/event_date=2024-01-10")
    torn = eventlog.read_log(spark, path)
    assert [r.file.split("commit=")[1].split("/")[0] for r in eventlog.incomplete_files(torn, eventlog.read_manifest(spark, path)).collect()] == ["torn"]


def test_append_refuses(spark, tmp_path):
    """Validation first, then the order of a symbol's day; a refused event doesn't advance the state."""
    day = 86_400 * clock.NS
    rows = [dict(level=k, price=1.0, size=1.0, ts_monotonic_ns=m, seq=q) | more for k, (m, q, more) in enumerate([
        (10, 1, {}), (50, 9, {"price": -1.0}), (5, 2, {}), (20, 2, {}), (20, 2, {}), (30, 1, {"source": "other"}), (30, 1, {"symbol": "MSFT"}), (40, 3, {"ts_event_ns": BASE + day, "ts_receive_ns": BASE + day}), (31, 3, {}),
    ])]
    bad = eventlog.write_log(events(spark, rows), f"file://{tmp_path}/log", "s", "live", arrival=["level"]).collect()
    assert {r.level: r.error for r in bad} == {1: "bad price", 2: ordering.CLOCK_BACK, 4: ordering.SEQUENCE_BACK}
    assert sorted(r.level for r in eventlog.read_log(spark, f"file://{tmp_path}/log").collect()) == [0, 3, 5, 6, 7, 8]


def test_fold_against_loop():
    rng = np.random.default_rng(2)
    for n in range(300):
        clock_, seq = rng.integers(0, 30, n % 40).cumsum() // 8 - rng.integers(0, 3, n % 40), rng.integers(0, 12, n % 40)
        source = rng.choice(np.array(["a", "b"], dtype=object), n % 40)
        want, last = [], None
        for m, s, q in zip(clock_, source, seq):
            bad = 0 if last is None else 1 if m < last[0] else 2 if s == last[1] and q <= last[2] else 0
            last = last if bad else (m, s, q)
            want.append(bad)
        cut = n % 7  # in two parts, with the state between
        first, state = ordering.fold(clock_[:cut], source[:cut], seq[:cut], ordering.NOTHING)
        rest, state = ordering.fold(clock_[cut:], source[cut:], seq[cut:], state)
        assert [*first, *rest] == want and (not want or state == last)


def test_row_groups_of_files(spark, tmp_path):
    """600,000 trades over 100 minutes in groups of 250,000 rows at most; a narrow range touches few of them."""
    path = f"file://{tmp_path}/log"
    rows = spark.range(600_000).select(*[F.lit(v).alias(k) for k, v in HEADER.items() if k not in ("ts_event_ns", "ts_receive_ns", "seq")], (F.lit(BASE) + F.col("id") * 10_000_000).alias("ts_event_ns"), (F.lit(BASE) + F.col("id") * 10_000_000).alias("ts_receive_ns"), (F.col("id") + 1).alias("seq"), F.lit(1.0).alias("price"), F.lit(1.0).alias("size"))
    assert eventlog.write_log(rows, path, "s", "replay").count() == 0
    groups = eventlog.read_zones(spark, path)
    assert groups.agg(F.sum("rows"), F.max("rows")).first()[0] == 600_000 and groups.filter("rows > 250000").count() == 0 and groups.count() >= 3
    early = (BASE, BASE + 60 * clock.NS)
    hit = eventlog.touched(groups, early)
    assert 0 < hit.filter("touched").count() < 0.7 * groups.count()
    assert eventlog.read_zones(spark, path, early).count() < groups.count() and eventlog.read_zones(spark, path, (0, 1)).count() == 0
    found = eventlog.in_range(eventlog.read_log(spark, path), early)
    assert found.count() == 6001
    some = eventlog.read_range(spark, path, early)
    assert some.count() == 6001 and len(some.inputFiles()) < len(found.inputFiles())
    assert eventlog.read_range(spark, path, early, (100, 199)).count() == 100 and eventlog.read_range(spark, path, (0, 1)).count() == 0
    # what a writer that died has left behind is in no manifest
    spark.read.schema(eventlog.ZONES).parquet(f"{path}/zones").limit(1).drop("commit").withColumn("file", F.lit("torn")).write.parquet(f"{path}/zones/commit=torn")
    assert eventlog.read_zones(spark, path).filter("file = 'torn'").count() == 0


def test_first_and_last_event(spark, tmp_path):
    """The manifest has the times of the first and the last accepted event, not the extremes."""
    rows = [dict(seq=k + 1, ts_event_ns=BASE + t, ts_receive_ns=BASE + 100, ts_monotonic_ns=k, price=1.0, size=1.0) for k, t in enumerate((10, 30, 20))]
    assert eventlog.write_log(events(spark, rows), f"file://{tmp_path}/log", "s", "live").count() == 0
    m = eventlog.read_manifest(spark, f"file://{tmp_path}/log").first()
    z = eventlog.read_zones(spark, f"file://{tmp_path}/log").first()
    assert (m.first_ts_ns - BASE, m.last_ts_ns - BASE, m.first_seq, m.last_seq, m.events) == (10, 20, 1, 3, 3) and (z.low - BASE, z.high - BASE) == (10, 30)


@pytest.mark.parametrize("batch", [10_000, 3])
def test_order_check_over_many_files(spark, batch):
    """Files with and without faults, in Arrow batches that cut through them, against the fold of each file."""
    rng = np.random.default_rng(batch)
    rows = [(f"s{rng.integers(0, 40)}", int(k // 3 - rng.integers(0, 2) * (rng.random() < 0.1)), [None, "a", "b"][rng.integers(0, 3)], int(k - rng.integers(0, 9) * (rng.random() < 0.2)), k) for k in range(600)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {r.at: r.order_error for r in ordering.order_errors(spark.createDataFrame(rows, "symbol string, ts_monotonic_ns long, source string, seq long, at long"), ["at"], ["symbol"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    names = [None, ordering.CLOCK_BACK, ordering.SEQUENCE_BACK]
    for s in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == s]
        found, _ = ordering.fold(*(np.array([r[k] for r in mine], dtype=object if k == 2 else np.int64) for k in (1, 2, 3)), ordering.NOTHING)
        assert [got[r[4]] for r in mine] == [names[x] for x in found]


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({"price": 1.0, "size": 1.0}, None), ({"ts_event_ns": 1, "price": 1.0, "size": 1.0}, "event time out of range"), ({"seq": 0}, "sequence not positive"), ({"venue": ""}, "no venue"),
        ({"price": -1.0, "size": 1.0}, "bad price"), ({"price": float("nan"), "size": 1.0}, "bad price"), ({"price": float("inf"), "size": 1.0}, "bad price"), ({"price": 1.0, "size": 0.0}, "bad size"), ({"size": 1.0}, "bad price"),
        ({"event_type": 1, "level": 0, "op": 0, "price": 1.0, "size": 0.0}, None), ({"event_type": 1, "level": 0, "op": 2, "price": 0.0, "size": 0.0}, None), ({"event_type": 1, "level": 1000, "op": 0, "price": 1.0, "size": 1.0}, "level too deep"),
        ({"event_type": 3, "order_id": "x", "price": 0.0, "size": 1.0, "filled": 2.0}, "filled more than ordered"),
        ({"event_type": 4, "ts_open_ns": 1, "ts_close_ns": 2, "open": 1.0, "high": 1.0, "low": 2.0, "close": 1.0, "volume": 0.0}, "high not highest"),
        ({"event_type": 9}, "unknown event type"),
    ],
)
def test_validator(spark, change, error):
    assert events(spark, [change]).select(validate.event_error()).first()[0] == error


def test_order_fold(spark):
    rows = [dict(ts_monotonic_ns=m, seq=s, level=k) for k, (m, s) in enumerate([(1, 1), (5, 1), (3, 2)])]
    got = ordering.accept_in_order(events(spark, rows), ["level"]).orderBy("level").collect()
    assert [r.accepted for r in got] == [True, False, True]


def test_ranges(spark):
    e = events(spark, [dict(seq=k, ts_event_ns=BASE + k * 10_000_000, price=1.0, size=1.0) for k in range(1, 1001)])
    assert eventlog.in_range(e, seq=(1, 100)).count() == 100
    assert eventlog.in_range(e, seq=(250, 350)).count() == 101
    assert eventlog.in_range(e, time=(BASE, BASE + 10**12), seq=(400, 600)).count() == 201
    assert eventlog.in_range(e, time=(0, 1)).count() == 0
    groups = eventlog.row_groups(e, ["seq"], (BASE, BASE + 100 * 10_000_000), 250).collect()
    assert [g.touched for g in sorted(groups, key=lambda g: g.row_group)] == [True, False, False, False]


def test_decimals_and_paths(spark):
    got = events(spark, [dict(price=2.5e-6 / 5 * 1, size=0.0005)]).select(validate.to_decimal(F.col("price"), 6), validate.to_decimal(F.col("size"), 3), validate.to_decimal(F.lit(float("nan")), 3)).first()
    assert [str(x) for x in got] in (["0.000001", "0.001", "0.000"], ["0.000000", "0.001", "0.000"])
    row = events(spark, [dict(ts_event_ns=1736380800 * clock.NS)]).withColumn("p", eventlog.legacy_path("base"))
    assert row.select("p").first()[0] == "base/AAPL/2025/01/09.parquet"
    assert tuple(row.select(eventlog.path_symbol(F.col("p")), *eventlog.path_date(F.col("p"))).first()) == ("AAPL", 2025, 1, 9)
    assert tuple(row.select(eventlog.path_symbol(F.lit("bad")), *eventlog.path_date(F.lit("bad"))).first()) == ("", 0, 0, 0)


def test_clock(spark):
    d = spark.createDataFrame([("2024-01-10T00:00:00.000001500Z",), ("2024-01-10T00:00:00.5Z",), ("2024-01-10T00:00:00Z",), ("bad",)], "s string")
    assert [r[0] for r in d.select(clock.parse_iso8601(F.col("s"))).collect()] == [BASE + 1500, BASE + 500_000_000, 0, 0]
    t = spark.createDataFrame([(dt.datetime(2025, 11, 2, 1, 30),), (dt.datetime(2025, 3, 9, 2, 30),), (dt.datetime(2025, 7, 1, 9, 30),), (None,)], "t timestamp_ntz")
    got = [r[0] for r in t.select(clock.localize(F.col("t"), F.lit("NYSE"), F.lit(None).cast("timestamp_ntz"))).collect()]
    assert got == [dt.datetime(2025, 11, 2, 6, 30), dt.datetime(2025, 3, 9, 6, 30), dt.datetime(2025, 7, 1, 13, 30), None]
    text = spark.createDataFrame([("2025-07-01 09:30:00",), ("2025-07-01T09:30:00+02:00",), ("2025-07-01T09:30:00Z",), ("bad",), (None,)], "s string")
    got = [r[0] for r in text.select(clock.localize_text(F.col("s"), F.lit("NYSE"), F.lit("2000-01-01").cast("timestamp_ntz"))).collect()]
    assert got == [dt.datetime(2025, 7, 1, 13, 30), dt.datetime(2025, 7, 1, 7, 30), dt.datetime(2025, 7, 1, 9, 30), dt.datetime(2000, 1, 1), dt.datetime(2000, 1, 1)]


def test_localize_like_zoneinfo(spark):
    """Every quarter of an hour of the days on which clocks change, in zones of both hemispheres."""
    from zoneinfo import ZoneInfo

    days = [dt.datetime(2025, *d) for d in ((3, 9), (3, 30), (4, 6), (10, 5), (10, 26), (11, 2))]
    rows = [(v, d + dt.timedelta(minutes=15 * k)) for v in ("NYSE", "LSE", "ASX", "XETRA", "KRX", "NSE") for d in days for k in range(96)]
    got = spark.createDataFrame(rows, "v string, t timestamp_ntz").select("v", "t", clock.localize(F.col("t"), F.col("v"), F.lit(None).cast("timestamp_ntz")).alias("u")).collect()
    for r in got:
        z = ZoneInfo(clock.VENUE_ZONES[r.v])
        early, late = (r.t.replace(tzinfo=z, fold=f).utcoffset() for f in (0, 1))
        offset = min(early, late) if early > late else max(early, late)  # twice: standard time; skipped: summer time
        assert r.u == r.t - offset, (r, offset)


def test_aggressor(spark):
    rows = [(10.0, 9.0, 10.0), (9.0, 9.0, 10.0), (9.5, 9.0, 10.0), (9.7, 9.0, 10.0), (9.2, 9.0, 10.0), (9.5, 10.0, 9.0), (9.5, None, 10.0), (9.5, 0.0, 10.0)]
    d = spark.createDataFrame(rows, "p double, b double, a double")
    assert [r[0] for r in d.select(ingest.infer_aggressor(F.col("p"), F.col("b"), F.col("a"))).collect()] == [0, 1, 2, 0, 1, 2, 2, 2]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ticker,name\n AAPL , Apple Inc. \n,Nobody\n")
    assert [tuple(r) for r in files.read_seed_csv(spark, f"file://{tmp_path}/a.csv", ["ticker", "name"], ["ticker"]).collect()] == [("AAPL", "Apple Inc.")]
    (tmp_path / "g.json").write_text('{"test_cases": [{"id": "1", "text": "x"}, {"id": "2", "text": "y"}]}')
    assert files.read_gold_set(spark, f"file://{tmp_path}/g.json").count() == 2
    (tmp_path / "s.yaml").write_text("# c\nserver:\n  port: 9000\n  debug: false\nname: x\n")
    assert files.load_settings(str(tmp_path / "s.yaml"), env={"TIDELOG_SERVER__PORT": "9001"}) == {"server": {"port": 9001, "debug": False}, "name": "x"}


def test_now_and_sessions(spark):
    import time
    import uuid

    from tidelog.functions.ids import session_id

    now = spark.range(1).select(clock.wall_ns()).first()[0]
    assert abs(now - time.time_ns()) < 60 * clock.NS and uuid.UUID(session_id()).version == 4 and session_id() != session_id()
    assert spark.range(1).select(ordering.monotonic_valid(F.lit(0), F.lit(5)), ordering.monotonic_valid(F.lit(6), F.lit(5)), ordering.monotonic_valid(F.lit(2 * clock.NS), F.lit(5))).first()[:] == (False, True, False)
