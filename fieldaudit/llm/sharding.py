"""Sharding by a permutation-filled lookup table, in SQL functions only (operator 3).

The table has a prime number of slots. Every shard prefers the slots in an order of its own, (offset + k * skip) mod slots, from
two hashes of its name; the shards take turns, each claiming the first slot of its order that is free, until the table is
full. Shards differ by at most one slot, and when a shard comes or goes few slots change hands.

The table depends on the names of the shards alone and never on the data: it is made once, with slots * ln(slots) steps, and
has ``SLOTS`` entries (65,537 by default: half a megabyte), which is the proof that it may be broadcast. A row's slot is a
hash of its key; its shard is one lookup in the broadcast table. No shuffle, so no key and no source can be hot.

Defined cases: a null key has a slot of its own hash (that of a text no key has); equal keys go to one shard; a single shard
takes everything; no shard at all is an error; empty tables give no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
NULL_KEY = "\x00null"


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}|{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The position in ``shards`` of the shard that owns each slot; the order of the names does not matter."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("need distinct shards, at least one and no more than slots")
    if any(slots % d == 0 for d in range(2, int(slots ** 0.5) + 1)):
        raise ValueError(f"{slots} is not prime")
    turn = sorted(range(len(shards)), key=lambda i: shards[i])
    at = {i: _hash(shards[i], "offset") % slots for i in turn}
    skip = {i: _hash(shards[i], "skip") % (slots - 1) + 1 for i in turn}
    owner, free = [-1] * slots, slots
    while free:
        for i in turn[:free]:
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            free -= 1
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(NULL_KEY))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def slots_frame(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) as a frame of constants."""
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",")
    names = F.array(*map(F.lit, shards))
    table = spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
    return table.select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def placed(rows: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """``row`` (all columns), slot and shard of every row."""
    lookup = F.broadcast(slots_frame(rows.sparkSession, shards, slots).withColumnRenamed("slot", "its_slot"))
    df = rows.select(F.struct("*").alias("row"), slot_of(F.col(key), slots).alias("slot"))
    return df.join(lookup, F.col("slot") == F.col("its_slot")).drop("its_slot")


def moved_slots(before: Sequence[str], after: Sequence[str], slots: int = SLOTS) -> int:
    """Slots that change hands between two sets of shards, owners compared by name."""
    a, b = lookup_table(before, slots), lookup_table(after, slots)
    return sum(before[i] != after[j] for i, j in zip(a, b))


def write_shards(rows: DataFrame, key: str, shards: Sequence[str], path: str, slots: int = SLOTS) -> None:
    """One folder for each shard; files are cut by size, whatever the number of rows of a shard."""
    placed(rows, key, shards, slots).select("row.*", F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)
