"""Near-duplicate documents by one-permutation MinHash (operator 4).

1. Every text becomes its set of shingle hashes; equal sets form a class, whose smallest
   doc_id goes on alone. So a group of copies costs one row.
2. A class's signature is a one-permutation MinHash with optimal densification, cut into
   bands. Classes that share a band's key share a bucket.
3. In every bucket the smallest member is the centre of a star of candidate edges, which
   are confirmed on the full sets. Confirmed links are merged into components.
4. A star can leave a bucket with members of several components. Members of such buckets
   are dealt anew by the rare shingles at which a linked pair's first common shingle can be
   (a prefix filter, which loses no linked pair). There every member outside a shingle's
   largest component is the centre of another star, in blocks, until no shingle has an
   untested member. The position of the shingle in both sets bounds a pair's intersection,
   which refutes most pairs without a look at their sets. So each pair that shares a bucket
   is either confirmed, refuted, or already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import HOT_KEYS, Scratch, forget_shuffles, is_empty, join_unique, maybe_in, sliced, small_batches, stored, total_of
from .components import components

BANDS, ROWS = 32, 5
#: Candidate pairs of one shingle in one round of step 4.
BLOCK = 200_000


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
        yield doc_id, K.shingle_set((text or b"").lower().split(), width)


def _signatures(width: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            out = []
            for doc_id, s in _sets(batch, width):
                keys = K.band_keys(K.one_permutation(s, bands * rows), rows) if len(s) else np.empty(0, dtype=np.int64)
                out.append((doc_id, len(s), *K.set_digest(s), keys))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def _full_sets(width: int):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            out = [(i, s.view(np.int64)) for i, s in _sets(batch, width)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, shingles: the full sets of all documents in ``ids`` and of a few others, without a shuffle of texts."""
    found = maybe_in(docs.filter("doc_id is not null").select("doc_id", "text"), "doc_id", ids)
    return stored(found.mapInArrow(_full_sets(width), "id long, shingles array<long>"), "near-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (a, b; a stored table) whose full shingle sets have 100 * intersection >= percent * union.

    Pairs of an a with over 1/HOT_KEYS of all pairs, such as a star's centre (fewer than HOT_KEYS
    of them), are dealt out, and its set is copied once for each part of that size.
    """
    many = stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("pairs")), "near-degrees")
    most = max(1, total_of(many, "pairs") // HOT_KEYS)
    hot = F.broadcast(many.filter(F.col("pairs") > most).select("a", F.ceil(F.col("pairs") / most).cast("int").alias("copies")))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("copies")), F.lit(0)).cast("int").alias("copy"))
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s")).join(hot, "a", "left")
    left = left.select("a", "s", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("t"))
    both = dealt.join(left, ["a", "copy"]).join(right, "b").withColumn("same", F.size(F.array_intersect("s", "t")))
    ok = F.col("same") * 100 >= (F.size("s") + F.size("t") - F.col("same")) * percent
    return stored(both.filter(ok).select("a", "b").distinct(), "near-links")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """bucket, id, n, pos: the shingles at which a linked pair's first common one can be.

    A set's shingles are ordered by the number of sets that hold them, the rarest first; pos
    counts from 1 and shingles that no other set holds come first and give no row. What a
    pair shares lies at or behind its first common shingle in either set, so a shingle with
    fewer than ``percent`` of the set from it on can't be the first of a linked pair.
    """
    # The mark comes before the explode, as next to it a set would be hashed once for each of its shingles.
    whole = sets.select("id", F.xxhash64("shingles").alias("mark"), F.size("shingles").alias("n"), "shingles")
    rows = whole.select("id", "mark", "n", F.explode("shingles").alias("bucket"))
    held = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("freq")).filter("freq > 1"), "near-frequent")
    rows = join_unique(rows, held, ["bucket"], "freq", total_of(held, "freq"))
    one = Window.partitionBy("id", "mark")  # rows that share an id each have a set of their own
    pos = F.col("n") - F.count(F.lit(1)).over(one) + F.row_number().over(one.orderBy("freq", "bucket"))
    rows = rows.withColumn("pos", pos).filter((F.col("n") - F.col("pos") + 1) * 100 >= F.col("n") * percent)
    return stored(rows.select("bucket", "id", "n", "pos"), "near-prefixes")


def unsettled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets whose members have several roots, with root and the bucket's size."""
    rows = stored(rows.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")), "near-live")
    mixed = rows.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("size"))
    mixed = stored(mixed.filter("x < y").select("bucket", "size"), "near-mixed")
    return stored(join_unique(rows, mixed, ["bucket"], "size", total_of(mixed, "size")), "near-open")


def first_of_buckets(rows: DataFrame) -> DataFrame:
    """The BLOCK / size rows (one at least) of every bucket with the smallest ids.

    First within about sqrt(size) parts of a bucket, then among what these leave, so that
    no task sorts a whole hot bucket: at most 3,420 rows of it up to a size of BLOCK, and
    sqrt(size) beyond.
    """
    most = F.greatest(F.lit(1), F.floor(F.lit(BLOCK) / F.col("size")))
    split = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.sqrt("size"))))
    for keys in (["bucket", "salt"], ["bucket"]):
        order = F.row_number().over(Window.partitionBy(*keys).orderBy("id", "n", "pos"))
        split = split.withColumn("k", order).filter(F.col("k") <= most)
    return split.drop("salt", "k")


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    A text's set holds its distinct ``width``-word shingles (A-Z lower-cased, words without
    ASCII white space; a shorter text is one shingle). Documents are linked when 100 *
    intersection >= ``percent`` * union; component_id is the smallest id reachable. With 32
    bands of 5 values a linked pair is missed by all buckets with a chance of 3e-6 at most
    for long texts. A null, empty or blank text has an empty set and is linked with nothing.
    Equal and repeated texts share a component; rows that share an id each go by their own
    text. A row without an id is linked with nothing, its component_id is null and it is
    kept. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    there = docs.filter("doc_id is not null")
    if is_empty(there.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")):
        return _components(docs, width, percent, bands, rows)
    # Rows that share an id get numbers of their own, in the order of the ids.
    numbers = stored(there.orderBy("doc_id", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()), "near-rows")
    found = _components(numbers.select(F.col("row").alias("doc_id"), "text"), width, percent, bands, rows).drop("kept")
    found = stored(found.withColumnRenamed("doc_id", "row").withColumnRenamed("component_id", "first"), "near-found")
    names = numbers.select(F.col("row").alias("first"), F.col("doc_id").alias("component_id"))
    names = found.groupBy("first").agg(F.count(F.lit(1)).alias("members")).join(names, "first")
    named = join_unique(found, names, ["first"], "members", found.count()).join(numbers.select("row", "doc_id"), "row")
    named = named.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return named.unionByName(_components(docs.filter("doc_id is null"), width, percent, bands, rows))


def _components(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """``near_components`` of documents (doc_id, text) whose ids are distinct or null; a stored table, all others are deleted."""
    with Scratch() as s:
        return s.keep(stored(_linked(docs, width, percent, bands, rows), "near-components"))


def _linked(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    spark = docs.sparkSession
    signed = stored(docs.mapInArrow(_signatures(width, bands, rows), "doc_id long, n long, d1 long, d2 long, bands array<long>"), "near-signatures")
    real = signed.filter("n > 0 and doc_id is not null")
    classes = stored(real.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")), "near-classes")
    total = total_of(classes, "copies")
    member = join_unique(real.select("doc_id", "d1", "d2", "n"), classes, ["d1", "d2"], "copies", total)
    member = stored(member.select("doc_id", "d1", "d2", "n", "id"), "near-members")

    leads = classes.select("d1", "d2", F.col("id").alias("doc_id"))
    leads = real.join(leads, ["d1", "d2", "doc_id"], "left_semi").dropDuplicates(["doc_id", "d1"])
    spread = stored(leads.select(F.col("doc_id").alias("id"), "n", F.explode("bands").alias("bucket")), "near-spread")
    buckets = spread.groupBy("bucket").agg(F.min("id").alias("centre"), F.min_by("n", "id").alias("centre_n"), F.count(F.lit(1)).alias("members"))
    buckets = stored(buckets.filter("members > 1"), "near-buckets")
    placed = stored(join_unique(spread, buckets, ["bucket"], "members", total_of(buckets, "members")), "near-placed")
    forget_shuffles(spark)

    # Sizes that differ too much can't reach the threshold: a necessary condition, nothing is lost.
    near_size = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    star = placed.filter((F.col("id") != F.col("centre")) & near_size(F.col("n"), F.col("centre_n")))
    sets = sets_of(docs, placed.select("id"), width)
    links = confirmed(stored(star.select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "near-star"), sets, percent)
    roots = components(links)
    forget_shuffles(spark)
    live = unsettled(placed.select("bucket", "id", "n"), roots)
    if not is_empty(live):
        live = unsettled(prefixes(maybe_in(sets, "id", live.select("id")), percent), roots)
    while not is_empty(live):
        parts = live.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("part"))
        largest = stored(parts.groupBy("bucket").agg(F.max_by("root", F.struct("part", "root")).alias("largest"), F.sum("part").alias("size")), "near-largest")
        live = stored(join_unique(live.drop("size"), largest, ["bucket"], "size", total_of(largest, "size")), "near-parts")
        centre = F.struct(F.col("id").alias("c"), F.col("n").alias("c_n"), F.col("pos").alias("c_pos"), F.col("root").alias("c_root"))
        centres = first_of_buckets(live.filter("root <> largest")).groupBy("bucket", "size").agg(F.collect_list(centre).alias("centres"))  # BLOCK / size at most
        centres = stored(centres, "near-centres")
        met = join_unique(live.drop("size"), centres, ["bucket"], "size", total_of(centres, "size"))

        def able(m: Column) -> Column:
            """By the largest intersection that a pair can have whose first common shingle is this one."""
            most = F.least(F.col("n") - F.col("pos"), m["c_n"] - m["c_pos"]) + 1
            return (F.col("root") != m["c_root"]) & (most * (100 + percent) >= (F.col("n") + m["c_n"]) * percent)

        pairs = met.select("id", F.explode(F.filter("centres", able)).alias("m")).select("id", "m.c")
        pairs = stored(pairs.select(F.least("c", "id").alias("a"), F.greatest("c", "id").alias("b")).distinct(), "near-pairs")
        live = stored(live.select("bucket", "id", "n", "pos").join(centres.select("bucket", F.explode("centres.c").alias("id")), ["bucket", "id"], "left_anti"), "near-rest")
        if not is_empty(pairs):
            more = confirmed(pairs, sets, percent)
            if not is_empty(more):
                links = stored(links.unionAll(more), "near-links")
                roots = components(links)
        live = unsettled(live, roots)
        forget_shuffles(spark)

    placed = member.join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id")
    )
    alone = signed.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
