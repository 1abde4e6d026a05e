"""Sharding by a permutation-filled lookup table.

Every shard has a preference order of the slots, a permutation given by two hashes of
its name. Shards take turns: each claims the next free slot of its order, until all
slots of the prime-sized table are taken. A document's hash names its slot, the table
its shard. Shards get equal numbers of slots, give or take one, and adding or removing
one moves few documents. The table has ``slots`` rows whatever the input: that is the
size bound under which it is broadcast.

Defined cases: a null id has the slot of the empty string; repeated rows go to the
same shard; an empty table gives an empty table; a text is not looked at; columns of
``df`` stay as they are, but one named ``slot`` or ``shard`` (in any case) gives way to the new one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import fresh, quoted

SLOTS = 4099
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
#: Largest table that is broadcast.
MAX_SLOTS = 1 << 20


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:8], 16)


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard's position for each slot."""
    if slots < 2 or slots > MAX_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime of at most {MAX_SLOTS}: {slots}")
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct names, no more than slots")
    offset = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    table, at, left = [-1] * slots, offset[:], slots
    while True:
        for i, step in enumerate(skip):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: the first 32 bits of the MD5 of its text."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with its ``slot`` and ``shard``."""
    table = lookup_table(shards, slots)
    at, name = fresh(df, "slot__", "shard__")
    rows = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(table)], f"{at} int, {name} string")
    placed = df.withColumn(at, slot_of(F.col(*quoted(key)), slots)).join(F.broadcast(rows), at, "left")
    own = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    return placed.select(*quoted(*own), F.col(at).alias("slot"), F.col(name).alias("shard"))


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """Slot and shard of all documents."""
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"))
