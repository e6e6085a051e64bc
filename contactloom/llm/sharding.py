"""Sharding by a permutation-filled lookup table.

Each shard walks the slots of a prime-sized table in an order of its own (an
offset and a step from its name's digest); the shards take turns, each claiming
its next free slot, until the table is full. So shards hold equal numbers of
slots to within one, and few slots change hands when a shard joins or leaves. A
key's slot is its hash modulo the prime; the table, ``SLOTS`` rows whatever the
corpus holds, is broadcast, so placing rows needs no shuffle and no hot key meets
in a task.

Defined cases: NULL keys share one slot; equal keys share a shard; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard's number at each slot. ``slots`` is a prime, so that every step visits all of them."""
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the number of slots must be a prime, not {slots}")
    if not shards or len(shards) > slots or len(set(shards)) < len(shards):
        raise ValueError("shards must have names of their own, and no more of them than slots")
    at = [_number(s, "offset") % slots for s in shards]
    step = [1 + _number(s, "step") % (slots - 1) for s in shards]
    owner, left = [-1] * slots, slots
    while left:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            owner[at[k]] = k
            left -= 1
            if not left:
                break
    return owner


def shard(docs: DataFrame, doc_id: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """doc_id, slot, shard: one row per document."""
    spark = docs.sparkSession
    table = spark.createDataFrame([(k, shards[o]) for k, o in enumerate(lookup_table(shards, slots))], "slot bigint, shard string")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.pmod(F.xxhash64(F.col(doc_id)), F.lit(slots)).cast("bigint").alias("slot"))
    return rows.join(F.broadcast(table), "slot").select("doc_id", "slot", "shard")  # bounded by the parameter ``slots``
