"""Merkle manifest of a dataset (operator 13).

Rows become digests, which are sorted by group and order over range partitions. The partitions'
sizes give each partition where its first group goes on and where its last one ends, so every
digest knows its place. Each partition builds the complete aligned subtrees in it; only the
ragged nodes at its borders are shuffled, by their coordinates, and finish the upper levels some
levels at a time. The groups' roots are the leaves of one more tree, built the same way. Every
row gets its proof, the siblings on its way to the root.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_unique, release, shared_dir, small_batches, stored, total_of

#: Children of a node.
ARITY = 2
#: Levels that a partition builds by itself, and that a round of the upper levels builds in one block: 16,384 leaves, or nodes, at two children.
LEVELS = 14
#: What stands for a group that is still growing behind a full block.
ENDLESS = 1 << 62


def node_digest(children: bytes) -> bytes:
    """The digest of concatenated digests, which count as lower-case hex text."""
    return hashlib.sha256(children.hex().encode()).digest()


def leaf_digest(*fields: Column) -> Column:
    """Binary SHA-256 over all fields: "-" for null, else the number of UTF-8 bytes, ":" and the value; whole numbers are decimal."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.encode(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), "UTF-8"), 256))


def height(size: int, arity: int = ARITY) -> int:
    """Levels above the leaves of a tree with so many of them."""
    h, span = 0, 1
    while span < size:
        h, span = h + 1, span * arity
    return h


def _paths(levels: dict[int, dict[int, bytes]], top: int, arity: int) -> dict[tuple[int, int], tuple[bytes, int, int]]:
    """Of every node: its siblings up to the highest node above it in ``levels``, and that node's level and coordinate."""
    out: dict[tuple[int, int], tuple[bytes, int, int]] = {}
    for level in range(top, min(levels, default=0) - 1, -1):
        nodes = levels.get(level, {})
        for c in nodes:
            above = out.get((level + 1, c // arity))
            if above is None:
                out[level, c] = (b"", level, c)
            else:
                start = c - c % arity
                siblings = b"".join(nodes[x] for x in range(start, start + arity) if x != c and x in nodes)
                out[level, c] = (siblings + above[0], above[1], above[2])
    return out


def build(levels: dict[int, dict[int, bytes]], size: int, top: int, arity: int = ARITY) -> int:
    """Adds to ``levels`` (level -> coordinate -> digest) every node up to ``top`` all of whose children are there; returns the top, at most the tree's height."""
    top = min(top, height(size, arity))
    for level in range(min(levels, default=0), top):
        nodes, width = levels.get(level, {}), -(-size // arity**level)
        above = levels.setdefault(level + 1, {})
        for parent in {c // arity for c in nodes}:
            run = range(parent * arity, min((parent + 1) * arity, width))
            if all(c in nodes for c in run):
                above[parent] = node_digest(b"".join(nodes[c] for c in run))
    return top


def _local(where: dict[int, tuple[int, int]], arity: int, depth: int, nodes_only: bool) -> Callable:
    """Builds a sorted partition's subtrees, a block of ``arity ** depth`` aligned leaves at a time.

    ``where`` has, per partition, the place of its first row in its group and the size of the
    whole group of its last row. Rows have their partition as ``_part``, as the task that runs
    it may have another number. Gives either the highest nodes, or the rows with their paths
    up to these.
    """
    block = arity**depth

    def flush(group: str, rows: list[pa.RecordBatch], at: int, size: int) -> pa.RecordBatch:
        whole = pa.concat_batches(rows)
        levels = {0: dict(enumerate(whole.column("digest").to_pylist(), at))}
        paths = _paths(levels, build(levels, size, depth, arity), arity)
        if nodes_only:
            tops = [(level, c) for (level, c), x in paths.items() if not x[0] and (level, c) == x[1:]]
            return pa.RecordBatch.from_pydict(
                {"_group": [group] * len(tops), "level": [t[0] for t in tops], "coord": [t[1] for t in tops], "digest": [levels[level][c] for level, c in tops]},
                pa.schema([("_group", pa.string()), ("level", pa.int32()), ("coord", pa.int64()), ("digest", pa.binary())]),
            )
        found = [paths[0, c] for c in range(at, at + whole.num_rows)]
        more = [pa.array(range(at, at + whole.num_rows), pa.int64()), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int64())]
        return pa.RecordBatch.from_arrays([*whole.columns, *more], names=[*whole.schema.names, "pos", "near", "level", "coord"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last_size, group, rows, begin = None, 0, None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if at is None:
                begin, last_size = where[batch.column("_part")[0].as_py()]
                at = begin
            batch = batch.drop_columns(["_part"])
            groups, k = batch.column("_group").to_pylist(), 0
            while k < len(groups):
                if groups[k] != group:
                    if rows:
                        yield flush(group, rows, begin, at)
                    if group is not None:
                        at = 0
                    group, rows, begin = groups[k], [], at
                stop = k
                while stop < len(groups) and groups[stop] == group and at < begin - begin % block + block:
                    stop, at = stop + 1, at + 1
                rows.append(batch.slice(k, stop - k))
                k = stop
                if at % block == 0:
                    yield flush(group, rows, begin, ENDLESS)
                    rows, begin = [], at
        if rows:
            yield flush(group, rows, begin, last_size)

    return run


def _upper(top: int, arity: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        level, coord, digest = (table.column(c).to_pylist() for c in ("level", "coord", "digest"))
        size = table.column("size")[0].as_py()
        levels: dict[int, dict[int, bytes]] = defaultdict(dict)
        for a, c, d in zip(level, coord, digest):
            levels[a][c] = d
        up = build(levels, size, top, arity)
        paths = _paths(levels, up, arity)
        found = [paths[a, c] for a, c in zip(level, coord)]
        return pa.table(
            {"_group": table.column("_group"), "level": pa.array(level, pa.int32()), "coord": pa.array(coord, pa.int64()), "size": table.column("size"), "path": pa.array([x[0] for x in found], pa.binary()),
             "top_level": pa.array([x[1] for x in found], pa.int32()), "top_coord": pa.array([x[2] for x in found], pa.int64()), "top": pa.array([levels[x[1]][x[2]] for x in found], pa.binary())}
        )

    return run


_UPPER = "_group string, level int, coord long, size long, path binary, top_level int, top_coord long, top binary"


def _places(counts: DataFrame) -> dict[int, tuple[int, int]]:
    """Per partition: the place of its first row in its group, and the size of the whole group of its last row.

    Only a partition's first group may begin in an earlier one, and only its last may go on in
    a later one, so the driver needs one row a partition, however many groups there are.
    """
    ends = counts.groupBy("part").agg(F.min(F.struct("_group", "n")).alias("first"), F.max(F.struct("_group", "n")).alias("last"))
    rows = sorted(ends.collect(), key=lambda r: r.part)
    begin, held, of = {}, 0, None
    for r in rows:
        begin[r.part] = held if r.first._group == of else 0
        held = begin[r.part] + r.first.n if r.first._group == r.last._group else r.last.n
        of = r.last._group
    out, of, total = {}, None, 0
    for r in reversed(rows):
        one = r.first._group == r.last._group
        if r.last._group != of:
            total = (begin[r.part] if one else 0) + r.last.n
        out[r.part] = (begin[r.part], total)
        of, total = r.first._group, total if one else begin[r.part] + r.first.n  # an earlier partition's last group may end here, before others
    return out


def _parted(kept: DataFrame) -> DataFrame:
    return kept.withColumn("_part", F.spark_partition_id())


def sorted_and_kept(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` sorted over range partitions and written by ``checkpoint()``, which keeps the partitions as they are."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint(eager=True)


@dataclass(frozen=True)
class Forest:
    """A tree for every group: the sorted rows, their places by partition, the nodes at the partitions' borders and the roots."""

    kept: DataFrame
    where: dict[int, tuple[int, int]]
    #: _group, level, coord, size, path, top: of every highest node of a partition, the siblings up to its group's root, and that root.
    nodes: DataFrame
    #: _group, size, nodes (of the group in ``nodes``), top
    roots: DataFrame
    arity: int
    depth: int

    def proven(self, nodes: DataFrame) -> DataFrame:
        """The rows with pos (place in the group), proof (all siblings up to the group's root) and the columns of ``nodes``."""
        more = _with(self.kept, "pos long, near binary, level int, coord long")
        rows = _parted(self.kept).mapInArrow(_local(self.where, self.arity, self.depth, False), more).join(nodes, ["_group", "level", "coord"])
        return rows.withColumn("proof", F.concat("near", "path")).drop("near", "path", "level", "coord")


def grow(leaves: DataFrame, group: Column, order: list[str], arity: int = ARITY, depth: int = LEVELS) -> Forest:
    """A tree for every group, whose leaves are the ``digest`` of its rows in ``order``.

    Groups are texts; a null one comes first. Rows that are equal in ``order`` follow their digests.
    """
    spark = leaves.sparkSession
    small_batches(spark)
    keyed = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    rows = stored(leaves.withColumn("_group", keyed), "merkle-leaves")
    order_by = [F.col("_group"), *[F.asc_nulls_first(c) for c in order], F.col("digest"), F.col("_file_row")]
    kept = sorted_and_kept(rows.withColumn("_file_row", F.col("_metadata.row_index")), order_by).drop("_file_row")
    counts = stored(kept.groupBy(F.spark_partition_id().alias("part"), "_group").agg(F.count(F.lit(1)).alias("n")), "merkle-counts")
    where = _places(counts)
    borders = stored(_parted(kept.select("_group", "digest")).mapInArrow(_local(where, arity, depth, True), "_group string, level int, coord long, digest binary"), "merkle-borders")
    sizes = counts.groupBy("_group").agg(F.sum("n").alias("size")).join(borders.groupBy("_group").agg(F.count(F.lit(1)).alias("nodes")), "_group")
    sizes = stored(sizes, "merkle-sizes")
    most = sizes.agg(F.max("size")).first()[0] or 1
    nodes = finish(join_unique(borders, sizes, ["_group"], "nodes", borders.count()).drop("nodes"), height(most, arity), arity, depth)
    roots = stored(join_unique(nodes.filter("coord = 0").select("_group", "top"), sizes, ["_group"], "nodes", borders.count()), "merkle-roots")
    release(rows, counts, borders, sizes)
    return Forest(kept, where, nodes, roots, arity, depth)


def _with(rows: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + more


def finish(nodes: DataFrame, highest: int, arity: int, depth: int) -> DataFrame:
    """_group, level, coord, size, path, top of every node: siblings up to its group's root, and that root.

    Each round builds ``depth`` more levels. The nodes under one of that height are few: full
    ones of the round before, and the ragged ones of the partitions in between.
    """
    out, top = None, depth
    power = [min(arity**k, ENDLESS) for k in range(highest + 2 * depth + 1)]
    while True:
        top += depth
        leaf = F.col("coord") * F.get(F.array(*[F.lit(p).cast("long") for p in power[: highest + depth + 1]]), F.col("level"))
        block = leaf - F.pmod(leaf, F.lit(power[min(top, len(power) - 1)]).cast("long"))
        built = stored(nodes.groupBy("_group", block.alias("_block")).applyInArrow(_upper(top, arity), _UPPER), "merkle-upper")
        if out is None:
            out = built
        else:
            to = [F.col("level").alias("_level"), F.col("coord").alias("_coord"), F.col("path").alias("_path"), "top_level", "top_coord", "top"]
            under = out.withColumnsRenamed({"top_level": "_level", "top_coord": "_coord"}).drop("top")
            joined = under.join(built.select("_group", *to), ["_group", "_level", "_coord"])
            before = out
            out = stored(joined.select("_group", "level", "coord", "size", F.concat("path", "_path").alias("path"), "top_level", "top_coord", "top"), "merkle-upper")
            release(before, built)
        if top >= highest:
            return out.drop("top_level", "top_coord")
        nodes = out.select("_group", F.col("top_level").alias("level"), F.col("top_coord").alias("coord"), F.col("top").alias("digest"), "size").distinct()


def manifest(rows: DataFrame, digest: Column, group: str, order: list[str], arity: int = ARITY, depth: int = LEVELS, carry: dict[str, Column] | None = None) -> DataFrame:
    """``order``, ``group``, ``carry``, digest, subroot, root, proof and the places that ``folded`` needs, for every row.

    A group's leaves follow ``order`` (null first, equal ones by digest); its nodes are the
    digests of every ``arity`` consecutive ones, the last of fewer, until one is left: the
    subroot, for a single leaf the leaf itself. The subroots, by group (null first, then by
    bytes), likewise give the root. Rows that are repeated are leaves each. Columns of ``rows``
    that aren't named are ignored, so their names can't clash. An empty table has no root and
    gives no rows.
    """
    extra = carry or {}
    leaves = rows.select(*[F.col(c) for c in dict.fromkeys([*order, group])], digest.alias("digest"), *[x.alias(f"_carry_{k}") for k, x in extra.items()])
    trees = grow(leaves, F.col(group), order, arity, depth)
    over = grow(trees.roots.select(F.col("_group").alias("name"), F.col("nodes"), F.col("top").alias("digest")), F.lit(None), ["name"], arity, depth)
    places = [F.col("pos").alias("group_pos"), F.col("size").alias("groups"), F.col("proof").alias("group_proof"), F.col("top").alias("root")]
    above = stored(over.proven(over.nodes).select(F.col("name").alias("_group"), "nodes", *places), "merkle-groups")
    nodes = stored(join_unique(trees.nodes, above, ["_group"], "nodes", total_of(above, "nodes")).drop("nodes"), "merkle-nodes")
    release(trees.roots, over.roots, above)
    return trees.proven(nodes).select(
        *dict.fromkeys([*order, group]), *[F.col(f"_carry_{k}").alias(k) for k in extra], "digest", F.col("top").alias("subroot"), "root",
        F.concat("proof", "group_proof").alias("proof"), "pos", "size", "group_pos", "groups",
    )


def fold(digest: bytes, proof: bytes, places: list[tuple[int, int]], arity: int = ARITY) -> bytes:
    """The root that a digest and its siblings lead to, by (place, size) in each tree on the way."""
    at = 0
    for pos, size in places:
        while size > 1:
            start = pos - pos % arity
            left, right = (pos - start) * 32, (min(start + arity, size) - pos - 1) * 32
            digest = node_digest(proof[at : at + left] + digest + proof[at + left : at + left + right])
            at, pos, size = at + left + right, pos // arity, -(-size // arity)
    return digest


def _fold(column: str, arity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = (column, "proof", "pos", "size", "group_pos", "groups")
            roots = [fold(d, p, [(x, n), (y, m)], arity) for d, p, x, n, y, m in zip(*(b.column(c).to_pylist() for c in names))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(roots, pa.binary())], names=[*b.schema.names, "folded_root"])

    return run


def folded(proven: DataFrame, column: str = "digest", arity: int = ARITY) -> DataFrame:
    """``proven`` with folded_root, what the digests in ``column`` and the proofs lead to, and verified, whether that is the root."""
    small_batches(proven.sparkSession)
    rows = proven.drop("folded_root", "verified")
    return rows.mapInArrow(_fold(column, arity), _with(rows, "folded_root binary")).withColumn("verified", F.col("folded_root") == F.col("root"))
