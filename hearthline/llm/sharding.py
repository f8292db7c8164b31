"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size. The shards take
turns: each claims its first free slot until the table is full. A row's slot is the hash of its key
modulo the table size, its shard is the slot's owner. The table has a fixed size, so it is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.llm.files import free_name

#: Prime; at least a hundred slots a shard keep shares within about one per cent.
SLOTS = 65_537


def preference(name: str, slots: int) -> tuple[int, int]:
    """(offset, step) of a shard's permutation of the slots, from its name alone."""
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Position in ``shards`` of each slot's owner. The order of the names does not matter.

    Names take turns in ascending order. Repeated names count once. At least one shard is needed, and no
    more than slots.
    """
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not shards or len(set(shards)) > slots:
        raise ValueError("give between one shard and as many as there are slots")
    place = {name: i for i, name in reversed(list(enumerate(shards)))}
    turns = [(place[name], *preference(name, slots)) for name in sorted(place)]
    owner, tried, free = [-1] * slots, [0] * len(turns), slots
    while free:
        for k, (shard, offset, step) in enumerate(turns):
            slot = (offset + tried[k] * step) % slots
            while owner[slot] >= 0:
                tried[k] += 1
                slot = (offset + tried[k] * step) % slots
            owner[slot] = shard
            tried[k] += 1
            free -= 1
            if not free:
                break
    return owner


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    """Slot of a key; null keys have a slot like any other."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def place(docs: DataFrame, keys: list[str], shards: list[str], into: str = "shard", slots: int = SLOTS) -> DataFrame:
    """``docs`` with a column ``into``: the name of the shard of each row.

    One narrow pass: the broadcast table has ``slots`` rows whatever the input. Rows of equal keys share
    a shard, null keys included; a table dealt by a hot key is as uneven as the key, so deal documents
    by their id. ``into`` must be a new name, other columns stay as they are.
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table already has a column {into!r}")
    slot = free_name(docs, "slot")
    table = docs.sparkSession.createDataFrame(
        [(i, shards[s]) for i, s in enumerate(lookup_table(shards, slots))], f"{slot} int, {into} string"
    )
    placed = docs.withColumn(slot, slot_of(*map(F.col, keys), slots=slots))
    return placed.join(F.broadcast(table), slot).drop(slot)


def write_shards(docs: DataFrame, keys: list[str], shards: list[str], folder: str, slots: int = SLOTS) -> DataFrame:
    """Write ``docs`` into one directory a shard (shard=name) and return the table read back.

    Rows of a shard meet in files of a task's size; adaptive execution splits shards that are larger.
    """
    placed = place(docs, keys, shards, "shard", slots)
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.parquet(folder)
