"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table whose
size is prime: an offset and a step, both from a hash of its name. Shards take
turns; each claims the next slot of its order that is still free, until all
slots are taken. Shares differ by one slot at most, and when a shard comes or
goes few slots change hands. A row's shard is found by one lookup: hash the key,
take the remainder, read the slot.

Filling the table costs about ``slots * ln(slots)`` steps on the driver, for a
parameter that does not grow with the data. Placing rows is one projection and
one broadcast join with the table; nothing is shuffled, so a key that holds a
third of the rows costs no more than any other.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 16381  # prime


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard. Shard names are distinct, and there
    are at most as many as slots; the order in which they are given only decides
    the turns."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one, at most one per slot")
    if not _is_prime(slots):
        raise ValueError("the number of slots must be prime")
    at = [_number(s, "offset") % slots for s in shards]
    step = [_number(s, "step") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    table = [-1] * slots
    free = slots
    while True:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % slots
            table[at[shard]] = shard
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key; a null key has a slot as well. Hashed as text, so that
    a key has one slot whether it is a number or a string."""
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    head = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return F.pmod(head, F.lit(slots).cast("long"))


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The lookup table as rows (_slot, _shard_no, _shard)."""
    filled = ",".join(map(str, lookup_table(shards, slots)))
    names = F.array(*[F.lit(s) for s in shards])
    return (
        spark.range(1, numPartitions=1)
        .select(F.posexplode(F.split(F.lit(filled), ",")).alias("_slot", "_shard_no"))
        .select(
            F.col("_slot").cast("long").alias("_slot"),
            F.col("_shard_no").cast("int").alias("_shard_no"),
        )
        .withColumn("_shard", F.element_at(names, F.col("_shard_no") + 1))
    )


def place(
    df: DataFrame,
    shards: list[str],
    key: str = "doc_id",
    slots: int = SLOTS,
    slot_col: str = "slot",
    shard_col: str = "shard",
) -> DataFrame:
    """``df`` with each row's slot and shard. Every row stays, repeated rows and
    null keys included; equal keys go to one shard. Existing columns of the two
    names are replaced. An empty ``df`` gives an empty result."""
    kept = df.drop(slot_col, shard_col)
    # slots rows of some 20 bytes: a parameter, whatever the data.
    table = F.broadcast(table_frame(df.sparkSession, shards, slots))
    # The rows travel as structs, so that none of their names is in the way.
    rows = kept.select(
        F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"),
        slot_of(F.col(key), slots).alias("__slot_of_key"),
    )
    return rows.join(table, F.col("__slot_of_key") == F.col("_slot"), "left").select(
        "row.*", F.col("_slot").alias(slot_col), F.col("_shard").alias(shard_col)
    )


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]
