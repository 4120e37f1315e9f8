"""BPE encoding and decoding with a public tokenizer file (operator 5).

A long text is cut into pieces at any code point, the pieces are encoded in parallel, and
neighbours are joined pairwise as a tree: the text around a join is encoded again in a
growing window until, on either side, the window and the piece agree on AGREED whole words
(pre-tokens) in a row. A pre-tokenizer reads on from a word's beginning as if nothing stood
before it, so from there outwards all three encodings are the same, and the result is the
one of the unsplit text. Where a tokenizer knows no words, nothing agrees before the window
is the whole text, which is exact as well. A text of one piece is a tree of one leaf.

Tokenizers that drop white space and never look across it (``space_bound``) remember the ids
of stretches between ASCII white space; all others get whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, sliced, small_batches

#: Code points of a piece, and of a window's half at first.
PIECE, WINDOW = 32_768, 64
#: Words in a row on which a window and a piece must agree.
AGREED = 2
#: Bytes that a worker's memory of stretches takes at most, those of an entry besides its text and ids, and the longest stretch.
REMEMBERED_BYTES, ENTRY_BYTES, REMEMBERED_CHARS = 96 << 20, 180, 40
#: Tokens that are decoded at a time.
TOKENS_AT_ONCE = 1 << 20
#: Bytes of a tokenizer file that is broadcast.
MOST_FILE = 64 << 20
_STRETCH = re.compile(r"[^\x20\x09-\x0D]+")
_coders: dict[str, Coder] = {}
CACHES.append(_coders)


def space_bound(spec: dict) -> bool:
    """Whether white space always ends a word and leaves no trace, judged by the file's own parts."""
    parts = lambda x, name: [] if x is None else x[name] if x["type"] == "Sequence" else [x]
    for n in parts(spec.get("normalizer"), "normalizers"):
        spaces = n["type"] == "Replace" and n["pattern"] in ({"Regex": r"\s+"}, {"Regex": r"\s"}) and n["content"] == " "
        if not spaces and n["type"] not in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"):
            return False
    first = (parts(spec.get("pre_tokenizer"), "pretokenizers") or [{"type": ""}])[0]
    if first["type"] == "Split":
        pattern = first["pattern"].get("Regex", " ")
        outside = re.sub(r"\[\^[^\]]*\\s[^\]]*\]|\\p\{[LN]\}|\[(?:\\p\{[LN]\})+\]", "", pattern)  # what is left may match white space
        splits = first["behavior"] == "Removed" and first["invert"] and not re.search(r"[\s.\\\[(]", outside)
    else:
        splits = first["type"] in ("WhitespaceSplit", "Whitespace", "BertPreTokenizer")
    return splits and not any(re.search(r"\s", t["content"]) for t in spec.get("added_tokens") or []) and spec.get("post_processor") is None


class Piece:
    """A text's tokens: ids, where they start, and whether a word starts with them."""

    __slots__ = ("ids", "starts", "text", "words")

    def __init__(self, text: str, ids: np.ndarray, starts: np.ndarray, words: np.ndarray) -> None:
        self.text, self.ids, self.starts, self.words = text, ids, starts, words


class Coder:
    """A tokenizer, and a memory of stretches between white space if it is ``space_bound``."""

    def __init__(self, spec: str, remembered: int = REMEMBERED_BYTES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.space_bound = space_bound(json.loads(spec))
        self.known: dict[bytes, bytes] = {}
        self.room = remembered
        self.names: pa.Array | None = None

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """The ids of every text, as packed 32-bit integers."""
        if not self.space_bound:
            return [array("i", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        return [b"".join(x) for x in self.stretches([t.split() for t in texts])]

    def stretches(self, split: list[list[bytes]]) -> list[list[bytes]]:
        """The packed ids of every stretch, from memory or encoded in one batch."""
        known = self.known
        new = list(set().union(*split).difference(known))
        got = self.tokenizer.encode_batch_fast([s.decode() for s in new], add_special_tokens=False)
        known.update((s, array("i", e.ids).tobytes()) for s, e in zip(new, got))
        out = [[known[w] for w in words] for words in split]
        for s in new:  # the first seen are the common ones, and stay
            size = ENTRY_BYTES + len(s) + len(known[s])
            if len(s) > REMEMBERED_CHARS or size > self.room:
                del known[s]
            else:
                self.room -= size
        return out

    def piece(self, text: str) -> Piece:
        """The tokens of a text by itself. Between blanks, a stretch counts as one word that begins where it does."""
        if self.space_bound:
            found = [(m.start(), m[0].encode()) for m in _STRETCH.finditer(text)]
            ids = self.stretches([[s for _, s in found]])[0]
            counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            starts = np.repeat(np.fromiter((a for a, _ in found), dtype=np.int64, count=len(found)), counts)
            words = np.zeros(len(starts), dtype=bool)
            words[(np.cumsum(counts) - counts)[counts > 0]] = True
            return Piece(text, np.frombuffer(b"".join(ids), dtype=np.int32), starts, words)
        e = self.tokenizer.encode(text, add_special_tokens=False)
        words = np.fromiter((-k - 2 if w is None else w for k, w in enumerate(e.word_ids)), dtype=np.int64, count=len(e))
        starts = np.fromiter((a for a, _ in e.offsets), dtype=np.int64, count=len(e))
        return Piece(text, np.array(e.ids, dtype=np.int32), starts, np.append(True, words[1:] != words[:-1])[: len(e)])

    def decode_many(self, lists: pa.ListArray) -> pa.Array:
        """The library's text for every list of ids; without a decoder that is the tokens' names and blanks between them."""
        if self.tokenizer.decoder is not None:
            return pa.array([self.tokenizer.decode(x or [], skip_special_tokens=False) for x in lists.to_pylist()], pa.string())
        if self.names is None:
            names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
            self.names = pa.array([names.get(i) for i in range(max(names, default=-1) + 1)], pa.string())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        counts = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
        there = (flat >= 0) & (flat < len(self.names))  # the library skips ids that it doesn't know
        if not there.all():
            owner = np.repeat(np.arange(len(lists)), counts)[there]
            flat, counts = flat[there], np.bincount(owner, minlength=len(lists))
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), self.names.take(pa.array(flat))), " ")


def coder(spec: str, remembered: int = REMEMBERED_BYTES) -> Coder:
    """This worker's coder; another tokenizer, or another size of its memory, takes the place of the one before."""
    key = f"{hashlib.sha256(spec.encode()).hexdigest()}/{remembered}"
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(spec, remembered)
    return _coders[key]


def _agreed(window: Piece, lo: int, own: Piece, shift: int, after: int, before: int, last: bool) -> tuple[int, int] | None:
    """Token numbers in ``window`` and ``own`` from which both have AGREED equal words between the two positions.

    The first such place, or the last one and then behind the words. ``lo`` and ``shift`` are
    the positions of their texts.
    """
    heads, own_heads = np.flatnonzero(window.words), np.flatnonzero(own.words)
    at, own_at = window.starts[heads] + lo, own.starts[own_heads] + shift
    places = range(len(heads) - AGREED)  # the word behind the last agreed one has to begin in both
    for k in reversed(places) if last else places:
        if at[k] <= after or at[k + AGREED] >= before:
            continue
        j = int(np.searchsorted(own_at, at[k]))
        if j + AGREED >= len(own_heads) or not np.array_equal(at[k : k + AGREED + 1], own_at[j : j + AGREED + 1]):
            continue
        a, b = (heads[k], heads[k + AGREED]), (own_heads[j], own_heads[j + AGREED])
        if np.array_equal(window.ids[slice(*a)], own.ids[slice(*b)]) and np.array_equal(window.starts[slice(*a)] + lo, own.starts[slice(*b)] + shift):
            return (int(a[1]), int(b[1])) if last else (int(a[0]), int(b[0]))
    return None


def join_pieces(tool: Coder, left: Piece, right: Piece, window: int = WINDOW) -> Piece:
    """The encoding of two neighbouring pieces' whole text."""
    text, cut = left.text + right.text, len(left.text)
    while True:
        lo, hi = max(0, cut - window), min(len(text), cut + window)
        mid = tool.piece(text[lo:hi])
        first = (0, 0) if lo == 0 else _agreed(mid, lo, left, 0, lo, cut, last=False)
        last = (len(mid.ids), len(right.ids)) if hi == len(text) else _agreed(mid, lo, right, cut, cut, hi, last=True)
        if first is not None and last is not None:
            (a, i), (b, j) = first, last
            parts = ((left, slice(0, i), 0), (mid, slice(a, b), lo), (right, slice(j, None), cut))
            return Piece(
                text, np.concatenate([p.ids[s] for p, s, _ in parts]), np.concatenate([p.starts[s] + by for p, s, by in parts]),
                np.concatenate([p.words[s] for p, s, _ in parts]),
            )
        window *= 2


def join_tree(tool: Coder, pieces: list[Piece]) -> Piece:
    while len(pieces) > 1:
        pieces = [join_pieces(tool, *pieces[k : k + 2]) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
    return pieces[0]


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_BOTH = pa.schema([*_IDS, ("decoded", pa.string())])


def _lists(rows: list[bytes] | list[np.ndarray]) -> pa.ListArray:
    rows = [np.frombuffer(r, dtype=np.int32) if isinstance(r, bytes) else r for r in rows]
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int64).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, dtype=np.int32), *rows])))


def _out(tool: Coder, doc_ids: pa.Array, ids: pa.ListArray, decoded: bool) -> pa.RecordBatch:
    if decoded:
        return pa.RecordBatch.from_arrays([doc_ids, ids, tool.decode_many(ids)], schema=_BOTH)
    return pa.RecordBatch.from_arrays([doc_ids, ids], schema=_IDS)


def _encode(spec, decoded: bool, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(spec.value, remembered)
        for part in sliced(batches, "text", own=_coders):
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield _out(tool, part.column("doc_id"), _lists(tool.encode_many(texts)), decoded)

    return run


def _cut(size: int):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", own=_coders):
            for r in part.to_pylist():
                parts = [r["text"][k : k + size] for k in range(0, len(r["text"]), size)]
                yield pa.RecordBatch.from_pylist([{"row": r["row"], "doc_id": r["doc_id"], "piece": k, "text": t} for k, t in enumerate(parts)], schema)

    return run


def _encode_pieces(spec, remembered: int):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(spec.value, remembered)
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                p = tool.piece(part.column("text")[0].as_py())
                starts = np.where(p.words, p.starts, ~p.starts).astype(np.int32)  # complemented inside a word
                yield pa.RecordBatch.from_arrays([*part.columns, _lists([p.ids]), _lists([starts])], schema=schema)

    return run


def _join(spec, decoded: bool, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(spec.value, remembered)
        for batch in batches:
            for k in range(batch.num_rows):
                pieces = []
                for p in batch.column("pieces")[k]:
                    starts = np.asarray(p["starts"].values, dtype=np.int64)
                    pieces.append(Piece(p["text"].as_py(), np.asarray(p["ids"].values, dtype=np.int32), np.where(starts < 0, ~starts, starts), starts >= 0))
                yield _out(tool, batch.column("doc_id").slice(k, 1), _lists([join_tree(tool, pieces).ids]), decoded)

    return run


def _broadcast(spark, tokenizer_path: str):
    if os.path.getsize(tokenizer_path) > MOST_FILE:
        raise ValueError("a tokenizer file of over 64 MB isn't broadcast")
    with open(tokenizer_path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, decoded: bool = False, remembered: int = REMEMBERED_BYTES) -> DataFrame:
    """doc_id, ids: token ids of every whole text, as the library encodes it unsplit.

    ``decoded`` adds a column of that name, which ``decode`` would give for the ids, without
    a second worker and pass for each task. ``remembered``: bytes of a worker's memory of
    stretches, which saves time only.

    No special tokens are added; their strings in a text become their ids, as the library
    does. A null or empty text has no ids. One row per row, repeated ones too. Other columns
    are ignored; an empty table gives no rows. The tokenizer file is read on the driver
    (a few MB at most, checked) and broadcast. Any kind of tokenizer will do.
    """
    small_batches(docs.sparkSession)
    spec = _broadcast(docs.sparkSession, tokenizer_path)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, ids array<int>" + ", decoded string" * decoded
    short = docs.filter(F.length("text") <= piece).mapInArrow(_encode(spec, decoded, remembered), schema)
    long = docs.filter(F.length("text") > piece).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    # A fixed number of tasks: by their bytes, pieces would be coalesced into too few for the work they are.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = long.mapInArrow(_cut(piece), "row long, doc_id long, piece int, text string").repartition(tasks, "row", "piece")
    coded = cut.mapInArrow(_encode_pieces(spec, remembered), cut.schema.simpleString()[7:-1] + ",ids array<int>,starts array<int>")
    whole = coded.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("piece", "text", "ids", "starts"))).alias("pieces"))
    return short.unionAll(whole.mapInArrow(_join(spec, decoded, remembered), schema))


def _decode(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(spec.value)
        for part in sliced(batches, "ids", TOKENS_AT_ONCE, _coders):
            yield _out(tool, part.column("doc_id"), part.column("ids").cast(pa.list_(pa.int32())), True)

    return run


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids, decoded: the library's text for the ids, one row per row.

    Null or no ids give an empty text. Repeated rows and shared or null ids of documents each
    have their row; other columns are ignored, and an empty table gives no rows.
    """
    spec = _broadcast(encoded.sparkSession, tokenizer_path)
    return encoded.select("doc_id", "ids").mapInArrow(_decode(spec), "doc_id long, ids array<int>, decoded string")
