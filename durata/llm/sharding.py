"""Sharding through a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized
table (start and step from a hash of its name).  Shards take turns claiming
their next free slot, so each owns the same number of slots, give or take
one, and a shard that comes or goes moves few slots of the others.  A key's
hash modulo the table size gives its slot; the table is broadcast, so placing
a row is one look-up without a shuffle.

The table's size is a parameter (65,537 slots by default, about 0.5 MB), so
what is broadcast is bounded whatever the data.

Defined results: a null key column hashes as a marker of its own, equal keys
land in the same shard, an empty table gives an empty table, and columns of
the input that clash with ``slot`` or ``shard`` raise an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill_table(shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> np.ndarray:
    """Owner (index into ``shards``) of every slot.

    In each round shard ``i`` claims ``weights[i]`` slots (1 by default).
    """
    if not _is_prime(size):
        raise ValueError(f"table size {size} is not prime")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and at least one is needed")
    if len(shards) > size:
        raise ValueError("more shards than slots")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("one weight of at least 1 for each shard")
    at = [_number(s, "start") % size for s in shards]
    step = [_number(s, "step") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    owner = np.full(size, -1, np.int32)
    filled = 0
    while filled < size:
        for i, turns in enumerate(weights):
            for _ in range(turns):
                if filled == size:
                    break
                while owner[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % size
                owner[at[i]] = i
                filled += 1
    return owner


def slot_of(keys: list[Column], size: int = TABLE_SIZE) -> Column:
    """Slot of a row: the first 60 bits of an MD5 over its key, modulo the
    size.  Each part is preceded by its length (null: -1), so that ("a", null)
    and (null, "a") differ."""
    parts = []
    for k in keys:
        s = k.cast("string")
        parts += [F.coalesce(F.length(s), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(s, F.lit(""))]
    digest = F.md5(F.concat(*parts))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, shards: list[str], keys: list[str], size: int = TABLE_SIZE,
          weights: list[int] | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` of every row."""
    taken = {c.lower() for c in df.columns} & {"slot", "shard"}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are in the input already")
    owner = fill_table(shards, size, weights)
    spark = df.sparkSession
    table = spark.createDataFrame([(i, shards[o]) for i, o in enumerate(owner.tolist())], "slot int, shard string")
    placed = df.withColumn("slot", slot_of([F.col(f"`{k}`") for k in keys], size))
    return placed.join(F.broadcast(table), "slot", "left").select(*[F.col(f"`{c}`") for c in df.columns], "slot", "shard")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1, spread: list[str] | None = None) -> None:
    """One folder per shard.  Rows of a shard are spread over
    ``files_per_shard`` writers, so a heavy shard is not one task's work."""
    cols = [F.col(f"`{c}`") for c in (spread or placed.columns)]
    salt = F.pmod(F.xxhash64(*cols), F.lit(files_per_shard))
    placed.repartition(F.col("shard"), salt).write.partitionBy("shard").parquet(path)
