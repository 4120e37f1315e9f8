"""Sharding by a permutation-filled lookup table (operator 9).

Every shard has its own preference order over the slots of a table of prime size: a start
and a step from hashes of its name. Shards take turns, each claiming its next free slot, as
often as its weight says, until the table is full. A key's slot is its hash modulo the size.
Shards get nearly equal slots, and when one leaves few other slots change hands.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots: a prime, over a hundred times the shards. It bounds what is broadcast, to some 30 MB at most.
SLOTS = 65_537
MOST_SLOTS = 1_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """The shard's index for every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not is_prime(slots) or slots > MOST_SLOTS or slots < len(shards):
        raise ValueError(f"slots must be a prime from the number of shards up to {MOST_SLOTS}")
    if weights and any(w < 1 for w in weights.values()):
        raise ValueError("a weight is 1 at least")
    at = [xxhash.xxh64_intdigest(s, 1) % slots for s in shards]
    step = [xxhash.xxh64_intdigest(s, 2) % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    turns = [(weights or {}).get(s, 1) for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for k, n in enumerate(turns):
            for _ in range(n):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + step[k]) % slots
                table[at[k]] = k
                free -= 1
                if not free:
                    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def _free(rows: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to differ from all columns."""
    while name.lower() in {c.lower() for c in rows.columns}:
        name += "_"
    return name


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """``rows`` with the columns slot and shard.

    The table has ``slots`` rows whatever the input and is broadcast. A null key goes where
    its hash says, like any other; repeated keys go to the same shard. Columns of ``rows``
    named slot or shard are replaced, even if one is the key. An empty table gives no rows.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame([(k, shards[s]) for k, s in enumerate(fill_table(shards, slots, weights))], "slot int, shard string")
    own = _free(rows, "_slot")
    return rows.withColumn(own, slot_of(F.col(f"`{key}`"), slots)).drop("slot", "shard").withColumnRenamed(own, "slot").join(F.broadcast(table), "slot")


def write_shards(rows: DataFrame, key: str, path: str, shards: list[str], files_per_shard: int = 1, slots: int = SLOTS) -> None:
    """Write ``rows`` as one folder a shard; a shard's rows are spread over ``files_per_shard`` tasks.

    They are spread by their whole content (but for maps), so rows of a hot key go to several
    tasks, and a task that is run again gets the same rows.
    A column named shard would clash with the folders' names and is written as the next free
    name (shard_, shard__ ...); all others keep theirs. Null keys go to one shard, repeated
    rows each are written, and an empty table writes no shard.
    """
    if "shard" in (c.lower() for c in rows.columns):
        name = next(c for c in rows.columns if c.lower() == "shard")
        rows, key = rows.withColumnRenamed(name, _free(rows, "shard")), _free(rows, "shard") if key == name else key
    part, slot = _free(rows, "_part"), _free(rows, "_own_slot")
    kept = rows.withColumnRenamed("slot", slot) if "slot" in rows.columns else rows
    placed = place(kept, slot if key == "slot" else key, shards, slots).drop("slot").withColumnRenamed(slot, "slot")
    content = [f"`{c}`" for c, kind in placed.dtypes if "map<" not in kind and "variant" not in kind]
    placed = placed.withColumn(part, F.pmod(F.xxhash64(*content), F.lit(files_per_shard)))
    placed.repartition(len(shards) * files_per_shard, "shard", part).drop(part).write.partitionBy("shard").parquet(path)
