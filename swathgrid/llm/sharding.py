"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Every shard has its own order of preference over the slots of a table of prime size (an offset and a
step, from hashes of its name). Shards take turns; at its turn a shard claims the first slot of its
order that is still free. A key's slot is its hash modulo the size, and the broadcast table tells the
shard. Shares differ by at most a turn, and when a shard goes, few keys of the others move.

The table depends on the shards' names and weights alone, never on data: it has `size` rows, is filled
on the driver and enters the plan as one literal.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name

#: A prime; at least a hundred times the number of shards keeps the shares within a hundredth.
SIZE = 65537


def fill(shards: list[str], size: int = SIZE, weights: list[int] | None = None) -> list[int]:
    """The shard's number for each slot. weights: how many slots a shard claims at its turn (1 each by default)."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime, or a step may miss slots")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 0 or not any(weights):
        raise ValueError("there must be a weight for each shard, not all of them zero")
    offset = [zlib.crc32(f"offset {s}".encode()) % size for s in shards]
    step = [zlib.crc32(f"step {s}".encode()) % (size - 1) + 1 for s in shards]
    at, table, left = list(offset), [-1] * size, size
    while True:
        for i, turns in enumerate(weights):
            for _ in range(turns):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % size
                table[at[i]] = i
                left -= 1
                if not left:
                    return table


def lookup(spark: SparkSession, shards: list[str], size: int = SIZE, weights: list[int] | None = None) -> DataFrame:
    """(slot, shard) with `size` rows."""
    numbers = ",".join(map(str, fill(shards, size, weights)))
    names = F.array(*map(F.lit, shards))
    held = spark.range(1).select(F.posexplode(F.split(F.lit(numbers), ",")).alias("slot", "_number"))
    return held.select("slot", names[F.col("_number").cast("int")].alias("shard"))


def assign(rows: DataFrame, key_col: str, shards: list[str], size: int = SIZE, weights: list[int] | None = None, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """rows with their slot and shard. Equal keys go to one shard; a null key
    goes to the slot of the hash of nothing, which other keys may share.

    All columns stay, and names that clash get underscores in front. An empty table gives an empty result.
    """
    slot, shard = free_name(rows.columns, slot), free_name(rows.columns, shard)
    at = free_name([*rows.columns, slot, shard], "_slot_")
    table = lookup(rows.sparkSession, shards, size, weights).select(F.col("slot").alias(at), F.col("shard").alias(shard))
    placed = rows.withColumn(slot, F.pmod(F.xxhash64(F.col(key_col)), F.lit(size)).cast("int"))
    return placed.join(F.broadcast(table), F.col(slot) == F.col(at)).drop(at)


def write_shards(rows: DataFrame, path: str, key_col: str, shards: list[str], files_per_shard: int = 4, **how) -> None:
    """Write rows as Parquet, a folder for each shard; a shard's rows are dealt to so many files."""
    held = assign(rows, key_col, shards, **how)
    part = F.pmod(F.xxhash64(F.col(key_col), F.lit(1)), F.lit(files_per_shard))
    held.repartition(len(shards) * files_per_shard, F.col(held.columns[-1]), part).write.partitionBy(held.columns[-1]).parquet(path)
