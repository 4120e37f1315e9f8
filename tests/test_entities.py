"""Entity registry, type-2 history, linker and metrics on hand-made rows."""

import datetime as dt
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions import ids, text
from tidelog.functions.stem import stem
from tidelog.operators import features, linker, metrics, names, portfolio, registry, scd2, slices, store
from tidelog.sources import files


def day(n):
    return dt.datetime(2024, 1, n)


def test_merge_judges_against_the_kept_version(spark):
    staged = spark.createDataFrame([(1, day(1), "a", 0.50), (1, day(2), "a", 0.508), (1, day(3), "a", 0.516), (1, day(4), "b", 0.516), (1, day(5), "b", 0.516)], "k long, valid_from timestamp_ntz, v string, c double")
    got = scd2.merge(None, staged, ["k"], ["v"], ["c"], ["valid_from"]).orderBy("valid_from").collect()
    assert [(r.valid_from.day, r.valid_to and r.valid_to.day) for r in got] == [(1, 3), (3, 4), (4, None)]
    more = spark.createDataFrame([(1, day(6), "b", 0.516), (2, day(6), "z", None)], staged.schema)
    stored = spark.createDataFrame([tuple(r) for r in got], "k long, valid_from timestamp_ntz, v string, c double, valid_to timestamp_ntz, action string")
    again = scd2.merge(stored, more, ["k"], ["v"], ["c"], ["valid_from"])
    assert again.count() == 4 and again.filter("action = 'inserted'").count() == 1
    assert scd2.merge_errors(stored, spark.createDataFrame([(1, day(3), "q", 0.1)], staged.schema), ["k"]).count() == 1
    assert scd2.overlaps(stored, ["k"], ["v"]).count() == 0
    assert scd2.close(stored, more, ["k"], F.lit(day(9))).filter("valid_to is null").count() == 0


def test_registry(spark):
    entities = spark.createDataFrame([("CO_1", "COMPANY", "Test Corp", "ACTIVE"), ("CO_2", "COMPANY", "Apple Inc.", "ACTIVE")], "syn_id string, type string, canonical_name string, status string")
    held = spark.createDataFrame([("CO_1", "TICKER", "TEST", day(1), day(5)), ("CO_2", "TICKER", "TEST", day(5), None)], "syn_id string, scheme string, value string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    probes = spark.createDataFrame([("TICKER", "TEST", day(n)) for n in (1, 4, 5, 9)] + [("TICKER", "NONE", day(1))], "scheme string, value string, at timestamp_ntz")
    assert [(r["at"].day, r.syn_id) for r in registry.resolve(probes, held, entities).orderBy("at").collect()] == [(1, "CO_1"), (4, "CO_1"), (5, "CO_2"), (9, "CO_2")]
    fresh, clash = registry.add_identifiers(held, spark.createDataFrame([("CO_1", "TICKER", "TEST", day(6), None), ("CO_1", "ISIN", "X", day(6), None)], held.schema))
    assert (fresh.count(), clash.count()) == (1, 1)
    assert [r.syn_id for r in registry.search(entities, "apple", 5).collect()] == ["CO_2"]
    assert registry.missing_parents(held, "syn_id", entities.filter("syn_id = 'CO_1'"), "syn_id").count() == 1


def test_ids_and_text(spark):
    row = spark.range(1).select(ids.make_id("CO", F.lit(7)).alias("i"), ids.ulid_id("PE").alias("u"))
    assert row.select(ids.id_valid(F.col("i")), ids.id_valid(F.col("u")), ids.id_type(F.col("u")), ids.id_valid(F.lit("XX_1"))).first()[:] == (True, True, "PERSON", False)
    d = spark.createDataFrame([("AAPL",), ("BRK.B",), ("ABCDE.F",), ("aapl",), ("",)], "t string")
    assert [r[0] for r in d.select(text.ticker_like(F.col("t"))).collect()] == [True, True, False, False, False]
    sim = text.similarity(text.trigrams(F.lit("large gizmo")), text.trigrams(F.lit("larg gizmos")))
    assert abs(spark.range(1).select(sim).first()[0] - 0.6) < 1e-12
    assert spark.range(1).select(text.normalize_text(F.lit("  A \t b "))).first()[0] == "a b"


def test_stems(spark):
    words = (
        "running run, hopping hop, hoping hope, happily happili, relational relat, generously generous, generate generat, caresses caress, ties tie, cries cri, gas gas, kiwis kiwi, luxuriated luxuri, agreed agre, "
        "feed feed, consistency consist, knightly knight, say say, by by, enjoy enjoy, skies sky, news news, proceeds proceed, innings inning, companies compani, international intern, technologies technolog, "
        "hopefulness hope, replacement replac, adoption adopt, rolling roll, shed shed, sized size, apples appl, sensibility sensibl"
    )
    for pair in words.split(", "):
        word, want = pair.split()
        assert stem(word) == want
    d = spark.createDataFrame([("The Running Widgets of Companies",), ("",), (None,)], "t string")
    found = names.postings(d.select(F.col("t").alias("id"), F.col("t").alias("text")).filter("t is not null"))
    assert sorted((r.positions[0], r.lexeme) for r in found.collect()) == [(2, "run"), (3, "widget"), (5, "compani")]


def test_cascade(spark):
    entities = spark.createDataFrame([("CO_1", "red widget", "ACTIVE"), ("CO_2", "blue bolt", "ACTIVE"), ("CO_3", "red widgets", "INACTIVE")], "syn_id string, canonical_name string, status string")
    aliases = spark.createDataFrame([("CO_1", "Red Widget", 0.0), ("CO_2", "blue bolt", 0.4)], "syn_id string, alias string, confidence double")
    tickers = spark.createDataFrame([("CO_2", "TICKER", "BB", None)], "syn_id string, scheme string, value string, valid_to timestamp")
    m = spark.createDataFrame([(1, " red  WIDGET"), (2, "BB"), (3, "blue bolt"), (4, "blu bolt"), (5, "nothing")], "mention_id long, text string")
    ranked = linker.cascade([linker.ticker_candidates(m, tickers, entities), linker.alias_candidates(m, aliases, entities), linker.canonical_candidates(m, entities), linker.fuzzy_candidates(m, aliases, entities)])
    got = {r.mention_id: (r.resolved_id, r.reason) for r in linker.decide(m, ranked).collect()}
    assert got[1] == ("CO_1", None) and got[2] == ("CO_2", None)
    assert got[3] == (None, "Low confidence: best=0.40 < threshold=0.95") and got[5] == (None, "No candidates found") and got[4][0] is None
    assert linker.quarantine(linker.decide(m, ranked), ranked).filter("context is not null").count() == 2


def test_metrics(spark):
    s = spark.createDataFrame([("a", 1, 1, 5.0), ("a", 2, 2, 9.0), ("a", 3, 3, 2.0)], "series string, at long, id long, value double")
    assert metrics.rates(s, ["series"], "id", 3, 2).first().rate == 3.0
    assert metrics.latest_sum(s, 2, "id").first().value == 9.0
    grid = {r["at"]: r.rate for r in metrics.rate_grid(s, ["series"], "id", 1, 4, 1, 2).collect()}
    assert grid == {1: 0.0, 2: 2.0, 3: 3.0, 4: 1.0}
    b = spark.createDataFrame([(1.0, 10), (2.0, 20), (float("inf"), 21)], "le double, count long")
    assert [(r.q, r.value) for r in metrics.bucket_quantiles(b, [0.5, 0.99]).orderBy("q").collect()] == [(0.5, 1.05), (0.99, 2.0)]
    assert metrics.bucket_quantiles(b.withColumn("count", F.lit(0).cast("long")), [0.5]).count() == 0
    v = spark.createDataFrame([("zero_flow", 0.0), ("high_latency", None), ("connection_errors", 0.1)], "id string, value double")
    assert sorted(r.id for r in metrics.alerts(v).collect()) == ["connection_errors", "zero_flow"]
    held = metrics.held_alert(spark.createDataFrame([("a", t, t >= 60) for t in range(0, 200, 30)], "k string, at long, firing boolean"), ["k"], 60)
    assert [r["at"] for r in held.filter("alert").orderBy("at").collect()] == [120, 150, 180]


def test_portfolio(spark):
    p = spark.createDataFrame([("x", 10.0), ("x", -4.0), ("y", 3.0)], "sector string, market_value double")
    assert tuple(portfolio.exposures(p, []).first()) == (17.0, 9.0, 2, 1)
    assert [(r.sector, r.share_of_max) for r in portfolio.top_shares(p, "sector").collect()] == [("x", 1.0), ("y", 3 / 14)]


def test_cascade_gets_tickers(spark):
    from tidelog.plans import entity_queries as Q
    from tidelog.plans import views as V

    data = "/root/testdata/sf0.001"
    held = {r.value[:3] for r in V.identifiers(spark, data).join(V.entities(spark, data).filter("status = 'ACTIVE'"), "syn_id").filter("valid_to is null").collect()}
    got = {r.text: r for r in Q.link_cascade(spark, data).collect()}
    assert held and all(got[t].resolved_id.startswith("CO_") and got[t].confidence == 1.0 for t in held)
    assert {r.mention_id for r in Q._ranked(spark, data).filter("strategy = 1").collect()} == {got[t].mention_id for t in held}
    assert {r.text for r in V.mentions(spark, data).collect()} <= got.keys()


SMALL = "/root/testdata/sf0.001"


def grams(x):
    return {("  " + w + " ")[i : i + 3] for w in re.findall(r"[^\W_]+", x.lower()) for i in range(len(w) + 1)}


def test_fuzzy_against_all_pairs(spark):
    """The prefix filter loses no pair, at any threshold."""
    rng = random.Random(8)
    words = ["aluminium", "alu", "bolt", "bolts", "blue", "blew", "widget", "wid", "red", "a", "ax"]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(60)})
    entities = spark.createDataFrame([(f"E{k}", n, "ACTIVE") for k, n in enumerate(names)], "syn_id string, canonical_name string, status string")
    aliases = spark.createDataFrame([(f"E{k}", n, None) for k, n in enumerate(names)], "syn_id string, alias string, confidence double")
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(40)] + ["", "zzz", "..."]
    m = spark.createDataFrame(list(enumerate(texts)), "mention_id long, text string")
    for least in (0.3, 0.5, 0.8):
        found = {(r.mention_id, r.syn_id): r.similarity for r in linker.fuzzy_candidates(m, aliases, entities, least).collect()}
        for i, t in enumerate(texts):
            want = sorted(((-len(grams(t) & grams(n)) / len(grams(t) | grams(n)), f"E{k}") for k, n in enumerate(names) if grams(t) and len(grams(t) & grams(n)) >= least * len(grams(t) | grams(n)) - 1e-12))[:10]
            assert {k: round(v, 9) for (j, k), v in found.items() if j == i} == {k: round(-v, 9) for v, k in want}


def test_cascade_against_loop(spark):
    """The whole cascade over the stand-ins, mention by mention."""
    from tidelog.plans import entity_queries as Q
    from tidelog.plans import views as V

    live = {r.syn_id: r.canonical_name for r in V.entities(spark, SMALL).filter("status = 'ACTIVE'").collect()}
    tickers = [(r.value.upper(), r.syn_id) for r in Q._tickers(spark, SMALL).filter("valid_to is null").collect() if r.syn_id in live]
    aliases = [r for r in V.aliases(spark, SMALL).collect() if r.syn_id in live]
    conf = lambda c: c if c else 1.0
    lex = lambda x: {stem(w) for w in re.findall(r"[^\W_]+", x.lower()) if w not in text.STOP_WORDS}
    tier = lambda s: 0.9 if s >= 0.9 else 0.8 if s >= 0.8 else 0.7
    got = {r.mention_id: r for r in Q.link_cascade(spark, SMALL).collect()}
    canonical = {}
    for r in Q.link_canonical(spark, SMALL).collect():
        canonical.setdefault(r.mention_id, {})[r.syn_id] = r.confidence
    for r in Q._cascade_mentions(spark, SMALL).collect():
        n = re.sub(r"\s+", " ", r.text.lower()).strip()
        found = {s: 1.0 for t, s in tickers if re.fullmatch(r"[A-Z]{1,5}(\.[A-Z])?", r.text.strip()) and t == r.text.strip().upper()}
        if not found:
            for a in aliases:
                if a.alias.lower() == n:
                    found[a.syn_id] = max(found.get(a.syn_id, 0), min(conf(a.confidence), 0.95))
        by_name = {s: SequenceMatcher(None, n, name.lower()).ratio() * 0.85 for s, name in live.items() if lex(n) and lex(n) <= lex(name)}
        top = sorted(by_name.items(), key=lambda x: (-x[1], x[0]))[:10]
        assert {s: round(v, 6) for s, v in top} == canonical.get(r.mention_id, {}) or r.mention_id not in {m.mention_id for m in V.mentions(spark, SMALL).collect()}
        if not found:
            found = dict(top)
        if not found:
            sims = sorted({(-len(grams(n) & grams(a.alias)) / max(1, len(grams(n) | grams(a.alias))), a.syn_id, -min(tier(len(grams(n) & grams(a.alias)) / max(1, len(grams(n) | grams(a.alias)))), conf(a.confidence))) for a in aliases})
            for s, i, c in [x for x in sims if -x[0] >= 0.3][:10]:
                found[i] = max(found.get(i, 0), -c)
        ranked = sorted(found.items(), key=lambda x: (-x[1], x[0]))[: 10 if found else 0]
        g = got[r.mention_id]
        if not ranked:
            assert (g.resolved_id, g.reason) == (None, "No candidates found")
        elif ranked[0][1] >= 0.95:
            assert (g.resolved_id, g.reason) == (ranked[0][0], None)
        else:
            assert g.resolved_id is None and round(ranked[0][1], 6) == g.confidence and g.reason.startswith("Ambiguous" if len(ranked) > 1 and ranked[0][1] - ranked[1][1] < 0.1 else "Low")


def test_resolve_ties(spark):
    ids_ = [(f"CO_{k}", "TICKER", "T", day(1 + k % 2), None) for k in range(1, 9)]
    held = spark.createDataFrame(ids_, "syn_id string, scheme string, value string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    entities = held.select("syn_id")
    probe = spark.createDataFrame([("TICKER", "T", day(1)), ("TICKER", "T", day(3))], "scheme string, value string, at timestamp_ntz")
    assert [r.syn_id for r in registry.resolve(probe, held, entities).orderBy("at").collect()] == ["CO_2", "CO_1"]


def test_store(spark, tmp_path):
    good = ids.make_id("CO", F.lit(1))
    j = spark.createDataFrame([('{"b": 1, "a": [1, {"y": null, "x": 2}]}', '{ "a":[1,{"x":2,"y":null}],"b":1}'), ("{}", None), ("{x", None)], "a string, b string")
    rows = j.select(store.canonical_json(F.col("a")).alias("a"), store.canonical_json(F.col("b")).alias("b"), store.no_empty_json(F.col("a")).alias("n")).collect()
    assert rows[0].a == rows[0].b and rows[1].a == "{}" and rows[1].n is None and rows[2].a is None
    items = spark.createDataFrame([(1, day(1), None, None, None), (2, day(2), "CO_9", day(3), "x"), (3, day(3), None, None, None)], "id long, ingested_at timestamp_ntz, resolved_syn_id string, resolved_at timestamp_ntz, resolved_by string")
    d = spark.createDataFrame([(1, 2, day(6), "late"), (1, 1, day(5), "early"), (2, 1, day(5), "taken"), (7, 1, day(5), "none")], "id long, k long, resolved_at timestamp_ntz, resolved_by string").withColumn("syn_id", ids.make_id("CO", F.col("k"))).drop("k")
    table, refused = store.resolve_items(items, d)
    assert {r.id: r.resolved_by for r in table.collect()} == {1: "early", 2: "x", 3: None}
    assert sorted((r.id, r.resolved_by) for r in refused.collect()) == [(1, "late"), (2, "taken"), (7, "none")]
    assert [r.id for r in store.quarantine_items(items, False).collect()] == [3, 1]
    e = spark.range(1).select(good.alias("src_syn_id"), good.alias("dst_syn_id"), F.lit("OWNS").alias("rel_type"), F.lit(1.0).alias("confidence"))
    assert e.select(store.edge_error()).first()[0] == "source is destination"
    (tmp_path / "c.csv").write_text("ticker,name,figi,lei,isin\nAAPL, Apple Inc.,F1,,\n,Nameless\nX,,,,\n")
    entities, held = files.load_companies(spark, f"file://{tmp_path}/c.csv")
    assert entities.count() == 2 and entities.filter(~ids.id_valid(F.col("syn_id"))).count() == 0
    assert sorted((r.scheme, r.value) for r in held.collect()) == [("FIGI", "F1"), ("TICKER", "AAPL")]
    (tmp_path / "x.csv").write_text("mic,name,country\nXNAS,Nasdaq,US\n,No,US\n")
    assert [r.value for r in files.load_exchanges(spark, f"file://{tmp_path}/x.csv")[1].collect()] == ["XNAS"]


def test_batch_is_atomic(spark):
    current = spark.createDataFrame([(1, day(3), "a", 0.5, None)], "k long, valid_from timestamp_ntz, v string, confidence double, valid_to timestamp_ntz")
    staged = spark.createDataFrame([(1, day(5), "b", 0.5), (2, day(5), "b", 0.5), (2, day(5), "c", 0.5)], "k long, valid_from timestamp_ntz, v string, confidence double")
    args = ["k"], ["v"], ["confidence"], ["valid_from", "v"], F.when(F.col("confidence") > 1, "too sure")
    merged, errors = scd2.merge_batch(current, staged, *args)
    assert merged is None and [(r.v, r.error) for r in errors.collect()] == [("c", "valid_from isn't after the version before")]
    merged, errors = scd2.merge_batch(current, staged.filter("v = 'b'"), *args)
    assert sorted((r.k, r.v, r.action) for r in merged.collect()) == [(1, "a", "kept"), (1, "b", "updated"), (2, "b", "inserted")] and errors.count() == 0
    with pytest.raises(ValueError):
        scd2.merge_batch(current, staged.limit(0), *args)


def test_one_owner_from_one_batch(spark):
    """Of staged rows that ask for a value the first one gets it; blanks around it don't matter; repetitions are left alone."""
    none = spark.createDataFrame([], "syn_id string, scheme string, value string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    staged = spark.createDataFrame([("A", "S", "X", day(1), None), ("B", "S", " X ", day(2), None), ("A", "S", "X", day(1), None), ("C", "S", "Y", day(3), None), ("D", "S", "Y", day(2), None)], none.schema)
    fresh, refused = registry.add_identifiers(none, staged)
    assert sorted((r.syn_id, r.value) for r in fresh.collect()) == [("A", "X"), ("D", "Y")] and sorted(r.syn_id for r in refused.collect()) == ["B", "C"]
    assert registry.unique_active_violations(none.unionByName(fresh)).count() == 0
    fresh, refused = registry.add_identifiers(none.unionByName(fresh), spark.createDataFrame([("B", "S", "X", day(9), None), ("A", "S", "X", day(1), None), ("A", "S", "Z", day(9), None)], none.schema))
    assert [(r.syn_id, r.value) for r in fresh.collect()] == [("A", "Z")] and [r.syn_id for r in refused.collect()] == ["B"]


def test_seed_with_repeated_keys(spark):
    have = spark.createDataFrame([("a", 1)], "k string, v long")
    got = registry.insert_missing(have, spark.createDataFrame([("a", 9), ("b", 3), ("b", 2), ("b", 2)], have.schema), ["k"])
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1), ("b", 2)]


def test_ticker_with_blanks(spark):
    e = spark.createDataFrame([("CO_1", "Apple", "ACTIVE")], "syn_id string, canonical_name string, status string")
    i = spark.createDataFrame([("CO_1", "TICKER", "aapl", None)], "syn_id string, scheme string, value string, valid_to string")
    m = spark.createDataFrame([(1, "AAPL"), (2, "  AAPL "), (3, "\u2003AAPL\n"), (4, "AA PL"), (5, None), (6, "aapl")], "mention_id long, text string")
    assert sorted(r.mention_id for r in linker.ticker_candidates(m, i, e).collect()) == [1, 2, 3]
    assert [r[0] for r in m.limit(3).select(text.normalize_text(F.concat(F.col("text"), F.lit("\u00a0\u3000X")))).collect()] == ["aapl x"] * 3


@pytest.mark.parametrize("batch", [10_000, 4])
def test_kept_versions_against_loop(spark, batch):
    """Drift inside the tolerance, nulls and changes, in Arrow batches that cut through keys."""
    rng = np.random.default_rng(batch)
    rows = [(int(rng.integers(0, 12)), k, [None, "a", "b"][rng.integers(0, 3)] if rng.random() < 0.2 else "a", None if rng.random() < 0.1 else round(0.5 + float(rng.integers(0, 4)) * (0.005 if k % 2 else 0.03), 4)) for k in range(400)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = sorted((r.k, r.valid_from, r.more) for r in scd2.merge(None, spark.createDataFrame([(*r, r[1] * 2) for r in rows], "k long, valid_from long, v string, c double, more long"), ["k"], ["v"], ["c"], ["valid_from"], ["more"]).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, last = [], {}
    for k, at, v, c in sorted(rows):
        old = last.get(k)
        if old is None or old[0] != v or (old[1] is None) != (c is None) or c is not None and abs(old[1] - c) > scd2.TOLERANCE:
            last[k] = (v, c)
            want.append((k, at, at * 2))
    assert got == want


def test_gold_set_bounds(spark, tmp_path):
    """The bounds of a gold set's confidences reach the verdicts."""
    (tmp_path / "gold.json").write_text('{"test_cases": [{"id": "1", "text": "t", "expected_syn_id": "A", "expected_confidence_min": 0.9}, {"id": "2", "text": "u", "expected_confidence_max": 0.8}]}')
    cases = files.read_gold_set(spark, f"file://{tmp_path}/gold.json").withColumns({"expected": F.col("expected_syn_id"), "resolved": F.lit("A"), "confidence": F.lit(0.7)})
    assert {r.id: r.verdict for r in linker.case_verdicts(cases).collect()} == {"1": "fp", "2": "tn"}


def test_name_search(spark):
    """All of a query's lexemes must be there; rank by occurrences, length and the first place."""
    t = spark.createDataFrame([("a", "Red widgets, red"), ("b", "the big red widget"), ("c", "widget"), ("d", "red"), ("e", ""), ("f", "A widget of red")], "id string, text string")
    index = names.postings(t)
    q = spark.createDataFrame([("the red widgets",), ("of the",), ("red purple",), ("WIDGET",)], "query string")
    got = {(r.query, r.id): round(r.rank, 6) for r in names.matches(q, index).collect()}
    assert got == {("the red widgets", "a"): 1.0, ("the red widgets", "b"): round(2 / 6, 6), ("the red widgets", "f"): round(2 / 5, 6), ("WIDGET", "a"): round(1 / 4, 6), ("WIDGET", "b"): round(1 / 7, 6), ("WIDGET", "c"): 1.0, ("WIDGET", "f"): round(1 / 5, 6)}


def test_sortable_ids(spark):
    """The order of ids is that of their times; a time reads back; equal keys and times give equal ids."""
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=7 * k * k) for k in range(300)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(at)], "k long, t timestamp").withColumn("i", ids.sortable_id("CO", F.col("t"), F.col("k")))
    got = rows.select("k", "t", "i", ids.id_time(F.col("i")).alias("back"), ids.id_valid(F.col("i")).alias("ok")).orderBy("i").collect()
    assert [r.k for r in got] == list(range(300)) and all(r.back == r.t and r.ok for r in got) and len({r.i for r in got}) == 300
    assert rows.select("i").exceptAll(rows.select(ids.sortable_id("CO", F.col("t"), F.col("k")))).count() == 0
    odd = spark.createDataFrame([("CO_short",), (None,), ("CO_" + "u" * 26,), ("CO_" + "Z" * 26,)], "i string")
    assert [r[0] for r in odd.select(ids.id_time(F.col("i"))).collect()] == [None] * 4


@pytest.mark.parametrize("width", [1, 3, 100])
def test_slices(spark, width):
    """Neighbours and prevailing values over slices, against plain loops; ties, gaps, nulls and null keys."""
    rng = random.Random(width)
    facts = [(rng.choice(["a", "b", None]), rng.randint(0, 60), k, rng.choice([None, float(k)])) for k in range(80)]
    rows = [(rng.choice(["a", "b", None, "c"]), rng.randint(-5, 70), k) for k in range(80)]
    f = spark.createDataFrame(facts, "key string, at long, n long, v double").repartition(3)
    r = spark.createDataFrame(rows, "key string, at long, id long").repartition(3)
    want = {}
    for key, at, i in rows:
        before = [(t, n, v) for k, t, n, v in facts if k == key and t <= at]
        want[i] = max(before)[1:] if before else (None, None)
    got = {x.id: (x.n, x.v) for x in slices.prevailing(r, f, ["key"], "at", ["n", "v"], ["n"], width).collect()}
    assert got == want
    near = {x.n: (x.low, x.high) for x in slices.neighbour(slices.neighbour(f, ["key"], ["at", "n"], "v", "low", width), ["key"], ["at", "n"], "v", "high", width, back=False).collect()}
    for key in ("a", "b", None):
        mine = sorted((t, n, v) for k, t, n, v in facts if k == key)
        for j, (_, n, _) in enumerate(mine):
            assert near[n] == (mine[j - 1][2] if j else None, mine[j + 1][2] if j + 1 < len(mine) else None)


def test_merged_growth(spark):
    rng = random.Random(1)
    rows, value = [], 0.0
    for k in range(200):
        value = 0.0 if rng.random() < 0.05 else value + rng.randint(0, 5)
        rows.append(("s", k * 3_000, k, value))
    got = metrics.merged_growth(metrics.growth(spark.createDataFrame(rows, "series string, at long, n long, value double"), ["series"], "n"), ["series"]).first()
    pairs = [(a[3], b[3]) for a, b in zip(rows, rows[1:])]
    assert (got.growth, got.resets) == (sum(b if b < a else b - a for a, b in pairs), sum(b < a for a, b in pairs))


def test_features_never_look_ahead(spark):
    """Rows of later days, or observed later, change no value of an earlier day."""
    rng = random.Random(6)
    d = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    trades = [(rng.choice("ab"), d(rng.randint(0, 20)), k, float(rng.randint(1, 9)), 1.0) for k in range(60)]
    quotes = [(rng.choice("ab"), d(rng.randint(0, 20)), float(rng.randint(0, 5)), float(rng.randint(3, 9))) for k in range(60)]
    links = [(rng.choice("ab"), d(a := rng.randint(0, 20)), d(a + rng.randint(-3, 9)), rng.choice([None, d(a + rng.randint(0, 12))])) for _ in range(60)]
    seen = []
    for last in (d(30), d(11)):
        t = spark.createDataFrame([r for r in trades if r[1] <= last], "symbol string, day date, at long, price double, size double")
        q = spark.createDataFrame([r for r in quotes if r[1] <= last], "symbol string, day date, bid double, ask double")
        m = spark.createDataFrame([(k, a, o, e if e and e <= last else None) for k, a, o, e in links if max(a, o) <= last], "key string, valid_from date, observed_at date, valid_to date")
        market = features.market_features(t, q, "2024-01-01", "2024-01-21")
        counts = features.link_counts(m, "key", "2024-01-03", "2024-01-21", "n")
        near = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
        seen.append((sorted((near(r) for r in market.filter("day <= '2024-01-12'").collect())), sorted(tuple(r) for r in counts.filter("day <= '2024-01-12'").collect())))
        if last == d(30):
            want = sorted((k, d(n), sum(x == k and max(a, o) <= d(n) and (e is None or e > d(n)) for x, a, o, e in links)) for k in "ab" for n in range(2, 21))
            assert sorted(tuple(r) for r in counts.collect()) == want
    assert seen[0] == seen[1]


def test_identifier_pairs_arent_shuffled(spark):
    """Repeated rows and mentions of several values give each pair once; pairs of a mention with one value pass no aggregate."""
    m = spark.createDataFrame([("m", "T", "x"), ("m", "T", "x"), ("n", "T", "x"), ("n", "T", "y"), ("o", "I", "x"), (None, "T", "y")], "mention_id string, scheme string, value string")
    i = spark.createDataFrame([("a", "T", "x", None), ("a", "T", "x", None), ("a", "T", "y", None), ("b", "T", "y", None), ("c", "T", "x", 1)], "syn_id string, scheme string, value string, valid_to int")
    found = linker.identifier_candidates(m, i)
    assert Counter(map(tuple, found.collect())) == Counter([("m", "a"), ("n", "a"), ("n", "b"), (None, "a"), (None, "b")])
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_versions_are_merged_once(spark):
    """What is stored first isn't made again for each part of the merge that reads it."""
    from tidelog import plans

    found = plans.QUERIES["edge_upsert_full"](spark, "/root/testdata/sf0.001")
    assert any("edge-versions" in f for f in found.inputFiles())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_common_lexeme_and_shared_name_are_dealt_out(spark, monkeypatch):
    """All texts have one lexeme, and a query asks for it: neither its postings nor a shared name's entities meet in one task."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    monkeypatch.setattr(names, "CHUNK", 100)
    texts = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("common x"), F.col("id") % 1000, F.when(F.col("id") % 3 == 0, " common").otherwise("")).alias("text"))
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        index = names.postings(texts)
        parts = [r["count"] for r in index.filter("lexeme = 'common'").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(parts) == 2000 and max(parts) < 1000
        assert {r.frequency for r in index.filter("lexeme = 'common'").collect()} == {2000} and {r.frequency for r in index.filter("lexeme <> 'common'").collect()} == {2}
        asked = spark.createDataFrame([("common",), ("commons x7",), ("x7 x8",), ("common y",), ("the",)], "query string")
        found = names.matches(asked, index)
        assert sum(r["count"] for r in found.filter("query = 'common'").groupBy(F.spark_partition_id()).count().collect()) == 2000
        assert len(re.findall(r"Generate posexplode\(_words#\d+\), \[query#", found._jdf.queryExecution().executedPlan().toString())) == 1  # a query's words are looked up once
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    want = {("common", str(k)): ((2 if k % 3 == 0 else 1) / (3 if k % 3 == 0 else 2)) for k in range(2000)}
    want |= {("commons x7", str(k)): (3 / 3 if k % 3 == 0 else 2 / 2) for k in (7, 1007)}
    assert {(r.query, r.id): r["rank"] for r in found.collect()} == want
    held = spark.range(3000).select(F.format_string("CO_%05d", "id").alias("syn_id"), F.lit("one").alias("_name"))
    got = linker._holders(held, "_name", [F.col("syn_id")])
    assert sorted(r.syn_id for r in got.collect()) == [f"CO_{k:05d}" for k in range(10)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [") == 1  # dealt out before anything is sorted


def test_cascade_spreads_a_mention(spark):
    """A ticker may have any number of holders: they are counted by partial aggregates, and no table or index is broadcast because its file is small."""
    from tidelog.plans import QUERIES
    from tidelog.plans import entity_queries as Q

    assert all("cascade-mentions" in f for f in Q._cascade_mentions(spark, SMALL).inputFiles())  # orders are read for the mentions once
    for name in ("link_cascade", "link_ticker", "link_alias_exact", "link_alias_fuzzy", "link_canonical"):
        assert not re.search(r"BroadcastHashJoin \[(syn_id|lexeme|_word|_name)#", QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString())
    holders = spark.range(2000).select(F.format_string("CO_%05d", "id").alias("syn_id"), F.lit("x").alias("name"), F.lit(1.0).alias("confidence"))
    first = holders.select(F.lit(1).cast("long").alias("mention_id"), "*", F.lit(1).alias("strategy"))
    other = holders.filter("syn_id < 'CO_00003'").crossJoin(spark.createDataFrame([(1, 2), (2, 3), (2, 4)], "mention_id long, strategy int")).select("mention_id", "syn_id", "name", F.lit(0.9).alias("confidence"), "strategy")
    ranked = linker.cascade([first, other.filter("strategy < 4"), other.filter("strategy = 4")])
    decided = linker.decide(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "mention_id long, text string"), ranked)
    assert not re.search(r"windowspecdefinition\(mention_id#\d+L?, confidence#\d+ DESC NULLS LAST, syn_id", decided._jdf.queryExecution().optimizedPlan().toString())
    assert {r.mention_id: (r.resolved_id, r.reason) for r in decided.collect()} == {1: ("CO_00000", None), 2: (None, "Ambiguous: 3 candidates with similar confidence"), 3: (None, "No candidates found")}
    got = ranked.collect()
    assert sorted((r.mention_id, r["rank"], r.syn_id, r.strategy) for r in got) == [(1, k + 1, f"CO_{k:05d}", 1) for k in range(2000)] + [(2, k + 1, f"CO_{k:05d}", 3) for k in range(3)]


def test_decide_against_loop(spark):
    """Ties, missing confidences and mentions of one candidate, as by a full order of the candidates."""
    rng = random.Random(5)
    rows = [(k, f"E{j}", rng.choice([None, 0.5, 0.85, 0.9, 0.94, 0.95, 1.0])) for k in range(200) for j in rng.sample(range(20), rng.randint(0, 5))]
    m = spark.createDataFrame([(k, f"t{k}") for k in range(200)], "mention_id long, text string")
    got = {r.mention_id: r for r in linker.decide(m, spark.createDataFrame(rows, "mention_id long, syn_id string, confidence double")).collect()}
    assert len(got) == 200
    for k in range(200):
        mine = sorted((c is None, -(c or 0), s, c) for i, s, c in rows if i == k)
        c1, c2 = (mine[i][3] if len(mine) > i else None for i in (0, 1))
        reason = None
        if c1 is None:
            reason = "No candidates found"
        elif c1 < 0.95:
            reason = f"Ambiguous: {len(mine)} candidates with similar confidence" if c2 is not None and c1 - c2 < 0.1 else f"Low confidence: best={c1:.2f} < threshold=0.95"
        assert (got[k].resolved_id, got[k].confidence, got[k].reason) == (mine[0][2] if c1 is not None and c1 >= 0.95 else None, c1, reason)


def test_identifier_of_a_common_value_is_dealt_out(spark, monkeypatch):
    """A value that most rows have is met in several tasks, each pair once, also if all rows have one scheme as a constant."""
    monkeypatch.setattr(linker, "BLOCK", 8, raising=False)
    m = spark.range(60).select(F.concat(F.lit("m"), "id").alias("mention_id"), F.lit("T").alias("scheme"), F.when(F.col("id") < 50, "x").when(F.col("id") < 55, "y:0").when(F.col("id") < 58, "z").alias("value"))
    i = spark.range(40).select(F.concat(F.lit("e"), "id").alias("syn_id"), F.lit("T").alias("scheme"), F.when(F.col("id") < 30, "x").when(F.col("id") < 34, "y:0").when(F.col("id") < 36, "y").alias("value"), F.lit(None).cast("int").alias("valid_to"))
    found = linker.identifier_candidates(m.union(m), i.union(i))
    want = [(f"m{a}", f"e{b}") for a in range(50) for b in range(30)] + [(f"m{a}", f"e{b}") for a in range(50, 55) for b in range(30, 34)]
    assert Counter(map(tuple, found.collect())) == Counter(want)
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 1 and max(tasks) < 1000
    assert not linker.identifier_candidates(m, i.filter("false")).collect() and not linker.identifier_candidates(m.filter("false"), i).collect()
