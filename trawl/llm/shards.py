"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table
(offset and step from its name's hash); shards take turns claiming their next
free slot.  A key goes to the shard of slot ``hash(key) mod size``.  The table
has ``size`` rows whatever the data, so it is broadcast.

Null key: hashed as the empty string.  Repeated keys go to the same shard.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 16381  # prime; at least 100 slots per shard keeps loads within a few percent
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Index of the shard that owns each slot."""
    def number(name, use):
        return int(hashlib.md5(f"{use}:{name}".encode()).hexdigest()[:15], 16)

    if not shards:
        raise ValueError("no shards")
    at = [number(s, "offset") % size for s in shards]
    step = [number(s, "step") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    free = size
    while free:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def assign(df: DataFrame, key: str = "doc_id", shards: list[str] = list(SHARDS),
           size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with columns slot (long) and shard (string)."""
    spark = df.sparkSession
    names = list(shards)
    table = spark.createDataFrame([(i, names[o]) for i, o in enumerate(fill_table(names, size))],
                                  "slot long, shard string")
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    slot = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % size
    return df.drop("slot", "shard").withColumn("slot", slot).join(F.broadcast(table), "slot")


def placements(docs: DataFrame) -> DataFrame:
    """(doc_id, slot, shard) of every document."""
    return assign(docs.select("doc_id")).select("doc_id", "slot", "shard")
