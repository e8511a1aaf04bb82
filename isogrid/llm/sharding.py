"""Sharding by a permutation-filled lookup table, in DataFrame operations only.

Each shard prefers the slots of a prime-sized table in an order of its own (a start and a stride from its name's hash).
Shards take turns claiming their next free slot until the table is full, so each gets an equal share, and losing or
adding a shard moves few slots. The table has a fixed size and is broadcast; placing a key is one hash and one look-up.
"""

from __future__ import annotations

from hashlib import md5
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

#: A prime, well above 100 times the number of shards, so that shares differ by under 1 %.
TABLE_SIZE = 65_537
N_SHARDS = 64


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard (its index) of each slot. Work and space depend on ``size`` alone, not on any data.

    ``size`` must be a prime, so that every stride visits every slot, and there must be a shard.
    """
    if not shards or size < 2 or any(size % k == 0 for k in range(2, isqrt(size) + 1)):
        raise ValueError("lookup_table needs at least one shard and a prime size")
    hashes = [int(md5(s.encode()).hexdigest(), 16) for s in shards]
    place = [h % size for h in hashes]
    stride = [1 + (h >> 64) % (size - 1) for h in hashes]
    table, free = [-1] * size, size
    while free:
        for shard, step in enumerate(stride):
            while table[place[shard]] >= 0:
                place[shard] = (place[shard] + step) % size
            table[place[shard]] = shard
            free -= 1
            if not free:
                break
    return table


def shard_names(n_shards: int) -> list[str]:
    """The names that the shards' preferences are hashed from."""
    return [f"shard-{n:05d}" for n in range(n_shards)]


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """A key's slot: 60 bits of its MD5, modulo the table's size. Null keys share the slot of the empty text."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % size).cast("int")


def place(docs: DataFrame, key_col: str = "doc_id", n_shards: int = N_SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """All columns of ``docs`` with ``slot`` and ``shard`` (which replace columns of those names).

    Rows of equal keys go to one shard; null keys have a shard too, that of the empty text. Keys are hashed whole, however
    long. Other columns may have any name. An empty table gives an empty result. No shuffle: the table, of ``size`` rows
    whatever the data, is broadcast.
    """
    spark: SparkSession = docs.sparkSession
    shards = lookup_table(shard_names(n_shards), size)
    # one row holding the array, so the plan carries no literal of that size and the rows come from the JVM
    table = spark.sql("SELECT posexplode(split(:table, ',')) AS (slot, shard)", args={"table": ",".join(map(str, shards))})
    kept = [c for c in docs.columns if c.lower() not in ("slot", "shard")]
    at, of, to = (unused(kept, n) for n in ("at_slot", "table_slot", "table_shard"))
    table = table.select(F.col("slot").alias(of), F.col("shard").cast("int").alias(to))
    placed = docs.select(*kept, slot_of(F.col(key_col), size).alias(at))
    return placed.join(F.broadcast(table), F.col(at) == F.col(of)).select(*kept, F.col(at).alias("slot"), F.col(to).alias("shard"))
