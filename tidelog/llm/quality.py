"""Quality classifier by co-training (operator 8).

Two views of a document, its text and its page metadata, each get a logistic model for
"good quality" and one for "toxic". Over rounds a view hands the labels that it is surest of
among unlabelled documents to the other view. Each view is then calibrated on labelled rows
held out from training, a last logistic step combines the calibrated views, and every
document is scored.

What is fitted first comes from a bounded sample: LABELLED labelled documents, those with the
smallest hashes of their ids. The labels handed over are the surest of all unlabelled documents:
a view's features are known before the first round, so one pass stores which of them each
document has, and every round scores those rows and takes the best of them. All documents
are scored in the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, sliced, small_batches, stored

#: Labelled documents that training may see.
LABELLED = 6_000
#: Co-training rounds, labels handed over a round, and how sure a view must be of them.
ROUNDS, HANDED, SURE = 3, 200, 0.97
#: Words that a text model picks at most, documents that must hold one, and how far its odds must be from chance.
WORDS, WORD_DOCS, LEAST_Z = 1_500, 4, 2.7
#: Bytes of a word's beginning that are features of their own.
STEMS = (6,)
BINS = 16
TARGETS = ("quality", "toxic")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) else b for b in range(256))
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_LOWER = bytes(range(97, 123))
_SIGN = bytes(b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))


def shape(text: bytes, tokens: list[bytes]) -> list[float]:
    """Numbers about a whole text's form, none of which depends on which words it uses."""
    n, words = max(1, len(text)), text.split()
    count = lambda chars: n - len(text.translate(None, chars)) if text else 0
    upper, lower = count(_UPPER), count(_LOWER)
    seen = Counter(tokens)
    pairs = len(set(zip(tokens, tokens[1:])))
    lines = text.split(b"\n")
    m = max(1, len(tokens))
    return [
        math.log1p(len(tokens)), upper / max(1, upper + lower), count(_DIGIT) / n, count(_SIGN) / n, text.count(b"|") / max(1, len(words)),
        (text.count(b".") + text.count(b",")) / max(1, len(words)), text.count(b"!") / max(1, len(words)), len(seen) / m,
        len(seen) / math.sqrt(m), max(seen.values(), default=0) / m, pairs / max(1, len(tokens) - 1), sum(map(len, tokens)) / m,
        len(set(lines)) / len(lines), n / len(lines), len(words) / m,
    ]


def text_view(text: str | None) -> tuple[list[float], list[int]]:
    """Shape numbers, and the hashes of the distinct words and of their beginnings."""
    raw = (text or "").encode()
    tokens = raw.translate(_FOLD).split()
    words = set(tokens)
    stems = {w[:k] + b"*" for w in words for k in STEMS if len(w) > k}
    return shape(raw, tokens), sorted(map(xxhash.xxh32_intdigest, words | stems))


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """Hashed categories of the page's metadata."""
    size = -1 if n_chars is None else int(max(0, n_chars)).bit_length()
    return [xxhash.xxh32_intdigest(x) for x in (f"lang={lang}", f"source={source}", f"size={size}", f"lang={lang}/size={size}")]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, start: np.ndarray | None = None, steps: int = 150) -> np.ndarray:
    """Weights (the last is the bias) by accelerated gradient descent on the whole matrix, in float32."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    y = y.astype(np.float32)
    w = v = np.zeros(x.shape[1], dtype=np.float32) if start is None else start
    probe = np.full(x.shape[1], 1 / math.sqrt(x.shape[1]), dtype=np.float32)
    for _ in range(8):  # the largest curvature, by power iteration
        probe = x.T @ (x @ probe)
        top = float(np.linalg.norm(probe))
        probe = probe / np.float32(max(top, 1e-12))
    rate, lead = np.float32(1 / (0.25 * top / len(y) + ridge)), 1.0
    keep = np.full(x.shape[1], ridge, dtype=np.float32)
    keep[-1] = 0
    for _ in range(steps):
        grad = x.T @ (sigmoid(x @ v) - y) / np.float32(len(y)) + keep * v
        new, ahead = v - rate * grad, (1 + math.sqrt(1 + 4 * lead * lead)) / 2
        v = new + np.float32((lead - 1) / ahead) * (new - w)
        w, lead = new, ahead
    return w


@dataclass
class View:
    """One view's features: for numbers their bins' edges, and the columns of hashed features."""

    edges: list[np.ndarray]
    columns: dict[int, int]
    width: int

    @classmethod
    def of(cls, numbers: np.ndarray, hashed: list[list[int]], picked: list[int]) -> View:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in numbers.T] if numbers.size else []
        start = sum(len(e) + 1 for e in edges)
        return cls(edges, {h: start + k for k, h in enumerate(picked)}, start + len(picked))

    def active(self, numbers: list[float], hashed: list[int]) -> list[int]:
        out, start = [], 0
        for e, v in zip(self.edges, numbers):
            out.append(start + int(np.searchsorted(e, v, side="right")))
            start += len(e) + 1
        get = self.columns.get
        hashed = hashed.tolist() if isinstance(hashed, np.ndarray) else hashed
        return out + [c for h in hashed if (c := get(h)) is not None]

    def matrix(self, rows: list[tuple[list[float], list[int]]]) -> np.ndarray:
        return self.of_columns([self.active(numbers, hashed) for numbers, hashed in rows])

    def of_columns(self, rows: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(rows), self.width), dtype=np.float32)
        for k, columns in enumerate(rows):
            out[k, columns] = 1
        return out


def telling(hashed: list[list[int]], y: np.ndarray, most: int) -> list[int]:
    """The hashed features whose presence says most about ``y``: by a smoothed log-odds z-score."""
    pos, neg = Counter(), Counter()
    for h, v in zip(hashed, y):
        (pos if v else neg).update(np.asarray(h).tolist())
    a, b = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    score = {}
    for h in pos.keys() | neg.keys():
        p, q = pos[h], neg[h]
        if p + q >= WORD_DOCS:
            odds = math.log((p + 0.5) / (a - p + 0.5)) - math.log((q + 0.5) / (b - q + 0.5))
            score[h] = abs(odds) / math.sqrt(1 / (p + 0.5) + 1 / (q + 0.5) + 1 / (a - p + 0.5) + 1 / (b - q + 0.5))
    return sorted((h for h in score if score[h] >= LEAST_Z), key=lambda h: (-score[h], h))[:most]


@dataclass
class Model:
    """A target's two views, their weights, calibrations (slope, offset) and combination."""

    text: View
    meta: View
    text_w: np.ndarray
    meta_w: np.ndarray
    calibration: list[tuple[float, float]]
    mix: np.ndarray
    handed: int

    def score(self, numbers: list[float], words: list[int], meta: list[int]) -> float:
        a = self.text_w[self.text.active(numbers, words)].sum() + self.text_w[-1]
        b = self.meta_w[self.meta.active([], meta)].sum() + self.meta_w[-1]
        views = [s * x + o for x, (s, o) in zip((a, b), self.calibration)]
        z = views[0] * self.mix[0] + views[1] * self.mix[1] + self.mix[2]
        return float(1 / (1 + math.exp(-min(30.0, max(-30.0, z)))))


Row = tuple[list[float], list[int], list[int]]  # shape, words, metadata


PARTS = (lambda r: (r[0], r[1])), (lambda r: ([], r[2]))  # what the text view and the metadata view see of a row


@dataclass
class Start:
    """A target's labelled rows, which of them are fitted and held out, and its two views."""

    rows: list[Row]
    y: np.ndarray
    fit: np.ndarray
    held: np.ndarray
    views: list[View]


def start_of(labelled: list[Row], y: np.ndarray) -> Start | None:
    """None if the labels are all one (then there is nothing to tell apart)."""
    if len(set(y.tolist())) < 2:
        return None
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.ones(len(y), dtype=bool)
        fit = held
    else:
        fit = ~held
    rows = [r for r, k in zip(labelled, fit) if k]
    text = View.of(np.array([r[0] for r in rows]), [], telling([r[1] for r in rows], y[fit], WORDS))
    meta = View.of(np.empty(0), [], telling([r[2] for r in rows], y[fit], WORDS))
    return Start(labelled, y, fit, held, [text, meta])


#: (giver, its weights, ids handed over before) -> (id, probability, the taker's columns) of the surest documents
Draw = Callable[[int, np.ndarray, set[int]], list[tuple[int, float, list[int]]]]


def co_train(begin: Start, draw: Draw) -> Model:
    """A target's model, with labels for the unlabelled documents that ``draw`` finds."""
    labelled, y, fit, held, views = begin.rows, begin.y, begin.fit, begin.held, list(zip(begin.views, PARTS))
    text, meta = begin.views
    rows = [r for r, k in zip(labelled, fit) if k]
    own = [(v.matrix([part(r) for r in rows]), y[fit]) for v, part in views]
    handed, weights = set(), []
    for turn in range(ROUNDS + 1):
        weights = [fit_logistic(m, t, 1e-3, weights[k] if turn else None, 60 if turn else 150) for k, (m, t) in enumerate(own)]
        if turn == ROUNDS:
            break
        for giver, taker in ((0, 1), (1, 0)):
            sure = draw(giver, weights[giver], handed)
            if sure:
                handed |= {i for i, _, _ in sure}
                own[taker] = np.vstack([own[taker][0], begin.views[taker].of_columns([c for _, _, c in sure])]), np.append(own[taker][1], [p >= 0.5 for _, p, _ in sure])
    check = [r for r, k in zip(labelled, held) if k]
    raw = [v.matrix([part(r) for r in check]) @ w[:-1] + w[-1] for (v, part), w in zip(views, weights)]
    calibration = [tuple(map(float, fit_logistic(z[:, None].astype(np.float32), y[held], ridge=1e-2))) for z in raw]
    both = np.stack([s * z + o for z, (s, o) in zip(raw, calibration)], axis=1).astype(np.float32)
    return Model(text, meta, weights[0], weights[1], calibration, fit_logistic(both, y[held], ridge=1e-2), len(handed))


_ROW = "doc_id long, numbers array<double>, words array<long>, meta array<long>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("numbers", pa.list_(pa.float64())), ("words", pa.list_(pa.int64())), ("meta", pa.list_(pa.int64()))])
    for batch in sliced(batches, "text"):
        rows = []
        for r in batch.to_pylist():
            numbers, words = text_view(r["text"])
            rows.append({"doc_id": r["doc_id"], "numbers": numbers, "words": words, "meta": meta_view(r["lang"], r["source"], r["n_chars"])})
        yield pa.RecordBatch.from_pylist(rows, schema)


def _sample(docs: DataFrame, ids: DataFrame) -> dict[int, Row]:
    """Features of the documents with the given ids (a bounded sample, so it is broadcast); of rows that share an id the smallest."""
    one = docs.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("d"))
    found = one.select("doc_id", "d.*").mapInArrow(_features, _ROW).toArrow()
    rows = range(found.num_rows)
    return {found["doc_id"][k].as_py(): (found["numbers"][k].as_py(), np.asarray(found["words"][k].values), np.asarray(found["meta"][k].values)) for k in rows}


def _columns(views):
    schema = pa.schema([("doc_id", pa.int64()), *[(f"{t}{k}", pa.list_(pa.int32())) for t in TARGETS for k in (0, 1)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            out = []
            for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang", "source", "n_chars"))):
                row = (*text_view(r[1]), meta_view(*r[2:]))
                out.append((r[0], *[v[k].active(*PARTS[k](row)) if (v := views.value[t]) else [] for t in TARGETS for k in (0, 1)]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def _surest(weights: np.ndarray, handed: set[int]):
    """doc_id, p, taker: rows that a view with ``weights`` is sure of; its columns are the second of the input, the taker's the third."""
    schema = pa.schema([("doc_id", pa.int64()), ("p", pa.float64()), ("taker", pa.list_(pa.int32()))])
    gone = np.array(sorted(handed), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            sums = np.concatenate([[0.0], np.cumsum(weights[lists.flatten().to_numpy()], dtype=np.float64)])
            ends = np.cumsum(lists.value_lengths().to_numpy())
            p = sigmoid(np.diff(sums[np.concatenate([[0], ends])]) + float(weights[-1]))
            keep = (np.abs(p - 0.5) >= SURE - 0.5) & ~np.isin(batch.column(0).to_numpy(), gone)
            found = pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), batch.column(2).cast(schema.types[2])], schema=schema)
            yield found.filter(pa.array(keep))

    return run


def _draw(free: DataFrame, target: str) -> Draw:
    def draw(giver: int, weights: np.ndarray, handed: set[int]) -> list[tuple[int, float, list[int]]]:
        rows, found = free.select("doc_id", f"{target}{giver}", f"{target}{1 - giver}"), {}
        while True:  # again only where rows share an id
            best = rows.mapInArrow(_surest(weights, handed | found.keys()), "doc_id long, p double, taker array<int>")
            got = best.orderBy(F.desc(F.abs(F.col("p") - 0.5)), "doc_id", "p", "taker").limit(HANDED - len(found)).collect()
            for r in got:
                found.setdefault(r.doc_id, (r.doc_id, r.p, r.taker))
            if not got or len(found) == HANDED or len(got) < HANDED and len({r.doc_id for r in got}) == len(got):
                return list(found.values())

    return draw


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> dict[str, Model | None]:
    """A model for each target, from at most ``labelled`` labelled and all unlabelled documents.

    Labels with a null id or value are left out; of repeated labels one stays. Documents
    with a null id aren't learnt from; of repeated ids one is. Where no labels tell two
    classes apart, a target has no model.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *TARGETS).dropna().groupBy("doc_id").agg(*[F.min(t).cast("int").alias(t) for t in TARGETS])
    order = F.xxhash64("doc_id")
    spark = docs.sparkSession
    taken = sorted((r for r in labels.withColumn("o", order).orderBy("o", "doc_id").limit(labelled).collect()), key=lambda r: r.o)
    # As an Arrow table, since rows would take Python workers of their own on the executors.
    rows = _sample(docs, spark.createDataFrame(pa.table({"doc_id": pa.array(sorted({r.doc_id for r in taken}), pa.int64())})))
    known = [r for r in taken if r.doc_id in rows]
    starts = {t: start_of([rows[r.doc_id] for r in known], np.array([float(r[t] > 0) for r in known])) for t in TARGETS}
    if not any(starts.values()):
        return dict.fromkeys(TARGETS)
    columns = _columns(spark.sparkContext.broadcast({t: s and s.views for t, s in starts.items()}))
    shape = "doc_id long, " + ", ".join(f"{t}{k} array<int>" for t in TARGETS for k in (0, 1))
    seen = docs.filter("doc_id is not null").select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(columns, shape)
    free = stored(seen.join(labels.select("doc_id"), "doc_id", "left_anti"), "quality-unlabelled")
    models = {t: s and co_train(s, _draw(free, t)) for t, s in starts.items()}
    release(free)
    return models


def _score(models):
    schema = pa.schema([("doc_id", pa.int64()), ("p_quality", pa.float64()), ("p_toxic", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quality, toxic = (models.value[t] for t in TARGETS)
        for batch in sliced(batches, "text"):
            a, b = [], []
            for r in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars"))):
                numbers, words = text_view(r[0])
                meta = meta_view(*r[1:])
                a.append(quality.score(numbers, words, meta) if quality else 1.0)
                b.append(toxic.score(numbers, words, meta) if toxic else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.float64()), pa.array(b, pa.float64())], schema=schema)

    return run


def classify(docs: DataFrame, labels: DataFrame, least_quality: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """doc_id, p_quality, p_toxic, kept: one row per row of ``docs`` (doc_id, text, lang, source, n_chars).

    A document is kept unless it is probably of low quality or toxic. A null or empty text
    has the shape of an empty text; null metadata are a category of their own. Repeated rows
    get equal scores. Without usable labels everything is kept. Other columns are ignored;
    an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    small_batches(docs.sparkSession)
    models = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    scored = docs.mapInArrow(_score(models), "doc_id long, p_quality double, p_toxic double")
    return scored.withColumn("kept", (F.col("p_quality") >= least_quality) & (F.col("p_toxic") < most_toxic))


def _filter(models, least_quality: float, most_toxic: float):
    score = _score(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            got = pa.Table.from_batches(score([batch])).combine_chunks()
            keep = [q >= least_quality and t < most_toxic for q, t in zip(got.column("p_quality").to_pylist(), got.column("p_toxic").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, least_quality: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all columns (types as in ``documents``).

    Each row is judged by itself: repeated rows and shared or null ids make no difference, and
    columns of any other name pass. A null text counts as empty, null metadata as a kind of
    their own. Without usable labels all rows stay; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    models = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.mapInArrow(_filter(models, least_quality, most_toxic), docs.schema)
