"""Benchmark decontamination (operator 6).

The benchmark's items form a BM25 inverted index with block maxima. Each passage of each
document is a query; block-max WAND returns every item whose score reaches a share of the
score that the item's own text gets. Retrieved items are then verified on word shingles: both
the question and the answer have to occur.

A benchmark of over SHARD_BYTES of text is cut into shards, each with an index of its own whose
weights come from the whole benchmark's word counts, so the result is that of a single index.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, row_mark, sliced, small_batches, stored

#: Bytes of item text of one index, which is built in the driver and broadcast.
SHARD_BYTES = 4 << 20
K1, B = 1.2, 0.75
#: Items of a block, and block bounds kept at most (larger indexes get larger blocks).
BLOCK, BOUNDS = 2, 1 << 24
SHINGLE = 5
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) else b for b in range(256))
_PART = re.compile(r"(?:\n|(?<=[.?!])\s)\s*")


def folded_words(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return text.lower().encode().translate(_FOLD).split()


def question_answer(text: str) -> tuple[str, str]:
    """The last line or sentence is the answer, what is before it the question."""
    text = text.strip()
    cuts = [m.end() for m in _PART.finditer(text)]
    return (text[: cuts[-1]], text[cuts[-1] :]) if cuts else (text, "")


def shingles(words: list[bytes], width: int = SHINGLE) -> set[tuple[bytes, ...]]:
    width = min(width, len(words))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if width else set()


@dataclass
class Postings:
    items: list[int]
    weights: list[float]
    most: float


@dataclass
class Whole:
    """What a shard has to know of the whole benchmark: items, words, the longest item, items by word."""

    items: int
    words: int
    longest: int
    seen: dict[bytes, int]


class Index:
    """BM25 weights of the items, each divided by the item's score for its own text.

    Items stand in order of length and are cut into blocks that all posting lists share;
    ``block_most`` has every term's largest weight in every block.
    """

    def __init__(self, items: list[tuple[int, str]], whole: Whole | None = None) -> None:
        parts = [(i, *map(folded_words, question_answer(t))) for i, t in items]
        parts = sorted((p for p in parts if p[1] or p[2]), key=lambda p: len(p[1]) + len(p[2]))
        self.ids = [p[0] for p in parts]
        self.question, self.answer = [p[1] for p in parts], [p[2] for p in parts]
        bags = [Counter(q + a) for _, q, a in parts]
        lengths = [sum(b.values()) for b in bags]
        whole = whole or Whole(len(bags), sum(lengths), max(lengths, default=1), Counter(t for b in bags for t in b))
        self.longest, mean = whole.longest, whole.words / max(1, whole.items)
        idf = {t: math.log(1 + (whole.items - n + 0.5) / (n + 0.5)) for t, n in whole.seen.items()}
        lists: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for k, bag in enumerate(bags):
            w = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[k] / mean)) for t, n in bag.items()}
            own = sum(w.values())
            for t, x in w.items():
                lists[t].append((k, x / own))
        self.term = {t: n for n, t in enumerate(lists)}
        self.postings = [Postings([k for k, _ in found], [x for _, x in found], max(x for _, x in found)) for found in lists.values()]
        blocks = max(1, min(-(-len(bags) // BLOCK), BOUNDS // max(1, len(lists))))
        self.block = -(-max(1, len(bags)) // blocks)
        self.block_most = np.zeros((len(lists), blocks), dtype=np.float32)
        for t, p in enumerate(self.postings):
            np.maximum.at(self.block_most[t], np.array(p.items) // self.block, np.array(p.weights) * (1 + 1e-6))

    def search(self, terms: np.ndarray, least: float) -> list[tuple[int, float]]:
        """Every item with a score of ``least`` or more for a set of terms: block-max WAND."""
        bounds = self.block_most[terms].sum(axis=0)
        open_blocks = np.flatnonzero(bounds >= least - 1e-5).tolist()
        if not open_blocks:
            return []
        lists = [self.postings[t] for t in terms.tolist()]
        end, out = len(self.ids), []
        at = [bisect_left(p.items, open_blocks[0] * self.block) for p in lists]
        here = lambda j: lists[j].items[at[j]] if at[j] < len(lists[j].items) else end
        live = sorted((j for j in range(len(lists)) if at[j] < len(lists[j].items)), key=here)
        while live:
            bound, pivot = 0.0, None
            for k, j in enumerate(live):
                bound += lists[j].most
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            item = here(live[pivot])
            while pivot + 1 < len(live) and here(live[pivot + 1]) == item:
                pivot += 1
            next_open = bisect_left(open_blocks, item // self.block)
            if next_open == len(open_blocks):
                break
            if open_blocks[next_open] == item // self.block:
                score = 0.0
                for j in live[: pivot + 1]:
                    at[j] = bisect_left(lists[j].items, item, at[j])
                    if here(j) == item:
                        score += lists[j].weights[at[j]]
                        at[j] += 1
                if score >= least:
                    out.append((item, score))
            else:
                for j in live:
                    at[j] = bisect_left(lists[j].items, open_blocks[next_open] * self.block, at[j])
            live = sorted((j for j in live if at[j] < len(lists[j].items)), key=here)
        return out


@dataclass
class Found:
    item: int
    score: float
    question: float
    answer: float
    share: float


#: Half passages whose block bounds are added up at a time.
HALVES = 512


def passages(index: Index, words: list[bytes], least: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """Start, end and distinct terms of every passage with a block that can reach ``least``.

    A passage is two halves of ``index.longest`` words; its block bounds are at most the sum
    of its halves' bounds, which are computed once for all passages.
    """
    step, n_terms = index.longest, len(index.postings)
    get = index.term.get
    terms = np.array([get(w, -1) for w in words], dtype=np.int64)
    known = np.flatnonzero(terms >= 0)
    keys = np.unique(known // step * n_terms + terms[known]) if len(known) else known
    half, terms = np.divmod(keys, max(1, n_terms))
    n = max(1, -(-len(words) // step))
    for first in range(0, max(1, n - 1), HALVES):
        lo, hi = np.searchsorted(half, [first, first + HALVES + 1])
        if lo == hi:
            continue
        present, at = np.unique(half[lo:hi], return_index=True)
        bounds = np.zeros((min(HALVES, n - first) + 2, index.block_most.shape[1]), dtype=np.float32)
        bounds[present - first] = np.add.reduceat(index.block_most[terms[lo:hi]], at, axis=0)
        reach = (bounds[:-1] + bounds[1:]).max(axis=1)[: min(HALVES, max(1, n - 1) - first)]
        for k in (np.flatnonzero(reach >= least - 1e-4) + first).tolist():
            a, b = np.searchsorted(half, [k, k + 2])
            yield k * step, min(len(words), (k + 2) * step), np.unique(terms[a:b])


def matches(index: Index, text: str, least: float, overlap: float) -> tuple[int, list[Found]]:
    """Number of passages, and the verified items of a whole text."""
    words = folded_words(text)
    best: dict[int, Found] = {}
    step = index.longest
    for a, b, own in passages(index, words, least):
        found = index.search(own, least)
        there = shingles(words[a:b]) if found else set()
        for k, score in found:
            sizes = [(len(s), sum(x in there for x in s) if len(part) >= SHINGLE else _short(s, words[a:b])) for part in (index.question[k], index.answer[k]) for s in [shingles(part)]]
            total, same = sum(n for n, _ in sizes), sum(m for _, m in sizes)
            if all(m >= overlap * n for n, m in sizes) and (k not in best or same / total > best[k].share):
                q, r = (m / n if n else 1.0 for n, m in sizes)
                best[k] = Found(index.ids[k], score, q, r, same / total)
    return (max(1, -(-(len(words) - step) // step)) if words else 0), [best[k] for k in sorted(best)]


def _short(part: set[tuple[bytes, ...]], words: list[bytes]) -> int:
    """How many of a short part's shingles (of its own length) stand in the passage."""
    width = len(next(iter(part), ()))
    return len(part & shingles(words, width)) if width else 0


_ITEMS = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double>>"


def _map(index, least: float, overlap: float, hits_only: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_passages", pa.int64()), ("items", pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            rows = []
            for doc_id, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text"))):
                n, found = matches(index.value, text or "", least, overlap)
                if found or not hits_only:
                    rows.append({"doc_id": doc_id, "mark": mark, "n_passages": n, "items": [{"item_id": f.item, "score": f.score, "question_overlap": f.question, "answer_overlap": f.answer} for f in found]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("terms", pa.list_(pa.binary()))])
    for batch in sliced(batches, "text"):
        words = [[w for part in question_answer(t) for w in folded_words(part)] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.binary()))], schema=schema)


def indexes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator:
    """The broadcast indexes of all shards of the benchmark, one by one; the driver holds one shard's items at a time."""
    spark = benchmark.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = lambda r: (r.item_id is None, r.item_id or 0, r.text)
    if size <= SHARD_BYTES:
        yield spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in sorted(items.collect(), key=order)]))
        return
    shards = -(-size // SHARD_BYTES)
    items = stored(items.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")), "bench-items")
    words = stored(items.mapInArrow(_item_words, "shard int, n long, terms array<binary>").filter("n > 0"), "bench-words")
    n, total, longest = words.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    each = words.select("shard", F.explode("terms").alias("term")).groupBy("shard", "term").agg(F.count(F.lit(1)).alias("n"))
    each = stored(each, "bench-each")
    seen = stored(each.select("shard", "term").join(each.groupBy("term").agg(F.sum("n").alias("n")), "term"), "bench-seen")
    for k in range(shards):
        whole = Whole(n or 0, total or 0, longest or 1, {bytes(r.term): r.n for r in seen.filter(F.col("shard") == k).select("term", "n").collect()})
        rows = sorted(items.filter(F.col("shard") == k).select("item_id", "text").collect(), key=order)
        yield spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in rows], whole))
    release(items, words, each, seen)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", least: float = 0.6, overlap: float = 0.8,
) -> DataFrame:
    """doc_id, n_passages, items, contaminated: one row per row of ``docs``.

    Passages are as long as two of the longest items and overlap by one, so each item lies
    whole in a passage. ``items`` has the verified items, by item_id, with score (1 is the
    item's own text), question and answer overlap; a document with any is contaminated.
    Verified means that the passage has ``overlap`` of the 5-word shingles of the question and
    of those of the answer; a part of fewer words is one shingle, one without words none.
    Letter case and ASCII punctuation don't count. A null or empty text has no passages; an
    item without words matches nothing; repeated items and rows are each reported. Other
    columns are ignored; an empty table gives no rows. Any size of benchmark will do: each
    SHARD_BYTES of it take one pass over ``docs``.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("mark", F.coalesce(row_mark(F.col("text")), F.lit(-1)))
    schema = f"doc_id long, mark long, n_passages long, items {_ITEMS}"
    found, more = None, None
    for index in indexes(benchmark, item_col, item_text_col):
        if found is None:
            found = docs.mapInArrow(_map(index, least, overlap, False), schema)
        else:
            hits = stored(docs.mapInArrow(_map(index, least, overlap, True), schema).dropDuplicates(["doc_id", "mark"]), "bench-hits")
            index.destroy()
            more = hits if more is None else more.unionAll(hits)
    if more is not None:
        more = more.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("items")).alias("more"))
        more = more.select(F.col("doc_id").alias("id"), F.col("mark").alias("its"), "more")
        found = found.join(more, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("its")), "left")
        found = found.withColumn("items", F.concat("items", F.coalesce("more", F.array().cast(_ITEMS))))
    return found.select("doc_id", "n_passages", F.sort_array("items").alias("items"), (F.size("items") > 0).alias("contaminated"))


def _filter(index, least: float, overlap: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            clean = [not matches(index.value, t or "", least, overlap)[1] for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, as ``decontaminate`` judges, with all columns.

    Each row is judged by itself, so repeated rows and shared or null ids make no difference,
    and columns of any name pass. A null or empty text holds no item and stays; an empty
    benchmark drops nothing; an empty table gives no rows.
    """
    for k, index in enumerate(indexes(benchmark)):
        if k:
            docs = stored(docs, "bench-clean")  # one shard's index at a time in a worker's memory
        docs = docs.mapInArrow(_filter(index, least, overlap, text_col), docs.schema)
    return docs
