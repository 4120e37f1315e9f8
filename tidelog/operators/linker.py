"""Text-to-entity linking: a cascade of strategies, quarantine and calibration.

Mentions: (mention_id, text). Candidates: (mention_id, syn_id, name, confidence, strategy).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text, sequence_ratio, similarity, ticker_like, trigrams, trimmed
from . import names
from .registry import rank_in

TICKER, ALIAS, CANONICAL, FUZZY = 1, 2, 3, 4
RESOLVE_AT, AMBIGUOUS_GAP, TRIGRAM_AT = 0.95, 0.1, 0.3
MOST = 10
#: Parts that the entities of one text are ranked in first.
PARTS = 64
#: Mentions, and entities, of one value that meet in one task.
BLOCK = 4096


def ticker_candidates(mentions: DataFrame, identifiers: DataFrame, entities: DataFrame) -> DataFrame:
    held = identifiers.filter("scheme = 'TICKER' and valid_to is null").select("syn_id", F.upper("value").alias("_t"))
    hit = mentions.withColumn("_t", trimmed(F.col("text"))).filter(ticker_like(F.col("_t"))).join(held, "_t").join(_live(entities), "syn_id")
    return hit.select("mention_id", "syn_id", "name", F.lit(1.0).alias("confidence"), F.lit(TICKER).alias("strategy")).distinct()


def _dealt(rows: DataFrame, key: str, own: str, other: str, blocks: DataFrame) -> DataFrame:
    """Rows in one of the blocks that their value's ``own`` side has, once for each block of the ``other`` side.

    A pair of blocks is named by one text (no two by the same): of several columns one may be a constant, and a join that leaves it
    out deals its rows out anew, over as few partitions as their size asks for.
    """
    rows = rows.join(F.broadcast(blocks), ["scheme", "value"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(1)).cast("int")
    place = F.pmod(F.xxhash64(key), count(own)).cast("int").alias(f"_at{own}")
    rows = rows.select("scheme", "value", key, place, F.explode(F.sequence(F.lit(0), count(other) - 1)).alias(f"_at{other}"))
    return rows.select(F.concat(F.length("scheme"), F.lit(":"), "scheme", "value", F.lit(":"), "_at_m", F.lit(":"), "_at_e").alias("_cell"), key)


def identifier_candidates(mentions: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Exact (scheme, value); its own query, not part of the cascade.

    There may be far more pairs than rows, so repetitions go before the join, and what a
    mention with one value finds isn't shuffled. Only one with several may find an entity twice.
    Mentions and entities of a common value are dealt out to blocks of BLOCK rows, and each pair of
    blocks is made by itself: a mention meets a block's entities as one list.
    """
    keys = ["scheme", "value"]
    known = F.col("scheme").isNotNull() & F.col("value").isNotNull()
    asked = mentions.filter(known).select("mention_id", *keys).distinct()
    held = identifiers.filter(known & F.col("valid_to").isNull()).select(*keys, "syn_id").distinct()
    # Only values with more than a block on either side, so fewer than one for BLOCK rows.
    many = [rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(c)).filter(F.col(c) > 1) for rows, c in ((asked, "_m"), (held, "_e"))]
    blocks = many[0].join(many[1], keys, "full")
    parts = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as sizes of the inputs say nothing about the pairs
    lists = _dealt(held, "syn_id", "_e", "_m", blocks).groupBy("_cell").agg(F.collect_list("syn_id").alias("_ids"))
    values = F.count(F.lit(1)).over(Window.partitionBy("mention_id"))  # the values of one mention
    asked = asked.withColumn("_values", values)

    def find(rows: DataFrame) -> DataFrame:
        met = _dealt(rows, "mention_id", "_m", "_e", blocks).repartition(parts, "_cell").hint("merge").join(lists, "_cell")
        return met.select("mention_id", F.explode("_ids").alias("syn_id"))

    return find(asked.filter("_values = 1")).unionByName(find(asked.filter("_values > 1")).distinct())


def _alias_confidence(c: Column) -> Column:
    return F.when(c.isNull() | (c == 0), 1.0).otherwise(c)


def _holders(rows: DataFrame, text: str, order: list[Column]) -> DataFrame:
    """Of the rows that share a text, those of its first MOST entities in ``order``: no more can be among a mention's candidates.

    All entities may share one, so they are dealt out by id and ranked in each part first.
    """
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("syn_id"), F.lit(PARTS))).repartition(text, "_part")
    for keys in ([text, "_part"], [text]):
        place = F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order))
        rows = rows.withColumn("_place", place).filter(F.col("_place") <= MOST).drop("_place")
    return rows.drop("_part")


def _live(entities: DataFrame) -> DataFrame:
    """Never broadcast: a small file may hold many entities, and every task would have all of them in memory."""
    return entities.filter("status = 'ACTIVE'").select("syn_id", F.col("canonical_name").alias("name")).hint("merge")


def alias_candidates(mentions: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    sure = F.least(_alias_confidence(F.col("confidence")), F.lit(0.95))
    held = aliases.select("syn_id", F.lower("alias").alias("_n"), sure.alias("confidence")).join(_live(entities), "syn_id").distinct()
    held = _holders(held, "_n", [F.desc("confidence"), F.col("syn_id")])
    rows = mentions.select("mention_id", normalize_text(F.col("text")).alias("_n")).join(held, "_n").select("mention_id", "syn_id", "name", "confidence", F.lit(ALIAS).alias("strategy")).distinct()
    return rank_in(rows, ["mention_id"], [F.desc("confidence"), F.col("syn_id")], MOST).drop("rank")


def signatures(texts: DataFrame, key: str, frequency: DataFrame, least: float) -> DataFrame:
    """gram, position, size, key: of each text (key, grams) the rarest trigrams, one of which a pair of similarity ``least`` must share.

    Of n trigrams a pair shares ``least`` * n at least, so it shares one of the n - ceil(least * n) + 1
    that come first in any order that both sides keep; here by ``frequency``, which leaves
    common trigrams out.
    """
    rows = texts.select(key, F.size("grams").alias("size"), F.explode("grams").alias("gram")).join(frequency, "gram", "left")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("n", F.lit(0)), "gram"))  # the trigrams of one text
    rows = rows.withColumn("position", place).filter(F.col("position") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1)
    return rows.select("gram", "position", "size", key)


def fuzzy_candidates(mentions: DataFrame, aliases: DataFrame, entities: DataFrame, least: float = TRIGRAM_AT) -> DataFrame:
    """Trigram similarity of at least ``least``, by a rarity-ordered signature index instead of comparing all pairs.

    Only ids, positions and sizes meet: sizes and positions bound what a pair can share, and
    the texts are fetched for pairs that may be near enough, so no pair is lost.
    """
    asked = mentions.select("mention_id", trigrams(normalize_text(F.col("text"))).alias("grams"))
    texts = aliases.select(F.lower("alias").alias("_a")).distinct().select("_a", F.xxhash64("_a").alias("_id"), trigrams(F.col("_a")).alias("grams"))
    frequency = texts.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    m = signatures(asked, "mention_id", frequency, least).select("gram", F.col("position").alias("_pm"), F.col("size").alias("_sm"), "mention_id")
    t = signatures(texts, "_id", frequency, least)
    shared = 1 + F.least(F.col("_sm") - F.col("_pm"), F.col("size") - F.col("position"))
    needed = F.ceil((F.col("_sm") + F.col("size")) * (least / (1 + least)) - 1e-9)
    sizes = F.least("size", "_sm") >= F.greatest("size", "_sm") * least - 1e-9
    pairs = m.join(t, "gram").filter(sizes & (shared >= needed)).select("mention_id", "_id").distinct()
    near = pairs.join(asked.withColumnRenamed("grams", "_gm").hint("merge"), "mention_id").join(texts.withColumnRenamed("grams", "_g").hint("merge"), "_id")
    near = near.withColumn("similarity", similarity(F.col("_gm"), F.col("_g"))).filter(F.col("similarity") >= least).select("mention_id", "_a", "similarity")
    held = aliases.select("syn_id", F.lower("alias").alias("_a"), _alias_confidence(F.col("confidence")).alias("_c")).join(_live(entities), "syn_id").distinct()
    hit = near.join(_holders(held, "_a", [F.col("syn_id")]), "_a")
    tier = F.when(F.col("similarity") >= 0.9, 0.90).when(F.col("similarity") >= 0.8, 0.80).otherwise(0.70)
    rows = hit.select("mention_id", "syn_id", "name", F.least(tier, F.col("_c")).alias("confidence"), F.lit(FUZZY).alias("strategy"), "similarity").distinct()
    return rank_in(rows, ["mention_id"], [F.desc("similarity"), F.col("syn_id"), F.desc("confidence")], MOST).drop("rank")


def canonical_candidates(mentions: DataFrame, entities: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Full-text match of names, confidence 0.85 times the sequence ratio; each name is looked at once, however many entities have it.

    ``index`` are the postings of the lower-cased names (``names.postings``), made here if not given.
    """
    held = _live(entities).withColumn("_name", F.lower("name"))
    index = names.postings(held.select(F.col("_name").alias("id"), F.col("_name").alias("text")).distinct()) if index is None else index
    asked = mentions.select("mention_id", normalize_text(F.col("text")).alias("_n"))
    match = names.matches(asked.select(F.col("_n").alias("query")).distinct(), index)
    scored = match.withColumn("confidence", sequence_ratio(F.col("query"), F.col("id")) * 0.85).select(F.col("query").alias("_n"), F.col("id").alias("_name"), "confidence")
    rows = asked.join(scored, "_n").join(_holders(held, "_name", [F.col("syn_id")]).hint("merge"), "_name").select("mention_id", "syn_id", "name", "confidence", F.lit(CANONICAL).alias("strategy"))
    return rank_in(rows, ["mention_id"], [F.desc("confidence"), F.col("syn_id")], MOST).drop("rank")


def cascade(candidates: list[DataFrame], entities: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """Each mention keeps the candidates of its first strategy that found any, one per entity, best first.

    ``candidates`` come in the order of their strategies. The first may find any number for a
    mention (all holders of a ticker), the others MOST each, so the first one's are kept as they
    are, and the others' only where it found none. With ``kind``, only entities of that type are
    left, after the strategy is chosen.
    """
    rows, *others = (c.select("mention_id", "syn_id", "name", "confidence", "strategy") for c in candidates)
    if others:
        rest = reduce(DataFrame.unionByName, others).join(rows.select("mention_id").distinct(), "mention_id", "left_anti")
        first = F.min("strategy").over(Window.partitionBy("mention_id"))  # at most MOST rows a strategy
        rows = rows.unionByName(rest.withColumn("_first", first).filter(F.col("strategy") == F.col("_first")).drop("_first"))
    if kind is not None:
        rows = rows.join(entities.filter(F.col("type") == kind).select("syn_id"), "syn_id", "left_semi")
    return dedup(rows)


def dedup(candidates: DataFrame) -> DataFrame:
    """One candidate per mention and entity: the highest confidence; ``rank`` orders a mention's candidates.

    Nothing here reads ``rank``, so a mention's candidates meet in one task only for callers that do.
    """
    best = rank_in(candidates, ["mention_id", "syn_id"], [F.desc("confidence"), F.col("name")], 1).drop("rank")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("confidence"), "syn_id")))


def decide(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """mention_id, resolved id if the best is sure enough, else the reason for quarantine.

    ``candidates`` has one row per mention and entity. A mention may have any number, so those
    of one confidence are counted first, by partial aggregates.
    """
    tied = candidates.groupBy("mention_id", "confidence").agg(F.min("syn_id").alias("best"), F.count(F.lit(1)).alias("n"))
    tied = tied.withColumn("_place", F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("confidence"))))
    of = lambda place, c: F.max(F.when(F.col("_place") == place, F.col(c)))
    second = F.when(of(1, "n") > 1, of(1, "confidence")).otherwise(of(2, "confidence"))
    top = tied.groupBy("mention_id").agg(of(1, "best").alias("best"), of(1, "confidence").alias("c1"), second.alias("c2"), F.sum("n").alias("n"))
    low = F.format_string("Low confidence: best=%.2f < threshold=0.95", "c1")
    ambiguous = F.format_string("Ambiguous: %d candidates with similar confidence", "n")
    reason = F.when(F.col("c1").isNull(), "No candidates found").when(F.col("c1") >= RESOLVE_AT, None).when(F.col("c1") - F.col("c2") < AMBIGUOUS_GAP, ambiguous).otherwise(low)
    rows = mentions.select("mention_id", "text").join(top, "mention_id", "left")
    return rows.select("mention_id", "text", F.when(F.col("c1") >= RESOLVE_AT, F.col("best")).alias("resolved_id"), F.col("c1").alias("confidence"), reason.alias("reason"))


def quarantine(decided: DataFrame, ranked: DataFrame) -> DataFrame:
    """Unresolved mentions with their candidates as JSON."""
    context = ranked.groupBy("mention_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("rank", "syn_id", "name", "confidence")))).alias("context"))
    return decided.filter("resolved_id is null").join(context, "mention_id", "left")


def case_verdicts(cases: DataFrame) -> DataFrame:
    """Cases (expected, resolved, confidence) with ``verdict`` (tp, fp, tn or fn), ``correct`` and ``brier``.

    The Brier score is there only for cases that should and did resolve. Optional columns
    narrow what is correct: expected_type against resolved_type, expected_confidence (within
    0.05, if not 0), expected_confidence_min and, where nothing was expected,
    expected_confidence_max, up to which a resolution counts as none.
    """
    e, r = F.col("expected").isNotNull(), F.col("resolved").isNotNull()
    right = F.coalesce(F.col("expected") == F.col("resolved"), F.lit(False))
    have = set(cases.columns)
    if {"expected_type", "resolved_type"} <= have:
        right = right & F.coalesce(F.col("expected_type") == F.col("resolved_type"), F.col("expected_type").isNull())
    if "expected_confidence" in have:
        right = right & ~F.coalesce((F.col("expected_confidence") != 0) & (F.abs(F.col("confidence") - F.col("expected_confidence")) > 0.05), F.lit(False))
    if "expected_confidence_min" in have:
        right = right & ~F.coalesce(F.col("confidence") < F.col("expected_confidence_min"), F.lit(False))
    let_off = F.coalesce((F.col("expected_confidence_max") != 0) & (F.col("confidence") <= F.col("expected_confidence_max")), F.lit(False)) if "expected_confidence_max" in have else F.lit(False)
    verdict = F.when(e & r & right, "tp").when(e & ~r, "fn").when(~e & (~r | let_off), "tn").otherwise("fp")
    brier = F.when(e & r, F.pow(F.col("confidence") - F.when(right, 1.0).otherwise(0.0), 2))
    return cases.withColumns({"verdict": verdict, "correct": verdict.isin("tp", "tn"), "brier": brier})


def calibration(cases: DataFrame) -> DataFrame:
    """Confusion counts, precision, recall, F1, accuracy and mean Brier of (expected, resolved, confidence)."""
    counts = case_verdicts(cases).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("tp", "fp", "tn", "fn")], F.avg("brier").alias("brier"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp + tn, tp + fp + tn + fn)})
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("brier", F.coalesce("brier", F.lit(0.0)))


def gates(metrics: DataFrame) -> DataFrame:
    return metrics.select((F.col("precision") >= 0.95).alias("precision_ok"), (F.col("recall") >= 0.70).alias("recall_ok"), (F.col("brier") <= 0.10).alias("brier_ok"))
