"""Sharding by a permutation-filled lookup table (DataFrame functions only).

Every shard has a preference order of all slots of a prime-sized table: an offset
and a skip, both hashed from its name. The shards take turns, each claiming the
next free slot of its order, until the table is full; so all own nearly the same
number of slots, and adding or removing a shard moves few of the others' slots.
The table is broadcast and a row's shard is one lookup of its hashed slot.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots: a prime of at least 100 times the shards keeps their shares within 1 %.
SLOTS = 4099
SHARDS = 32


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i}" for i in range(n)]


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that owns each slot; slots must be a prime above the number of shards."""
    if not names or len(set(names)) < len(names) or slots <= len(names) or slots > 65536 * 16 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime above the number of differently named shards")
    place = [_number(f"offset|{name}") % slots for name in names]
    skip = [_number(f"skip|{name}") % (slots - 1) + 1 for name in names]
    owner, free = [-1] * slots, slots
    while True:
        for i in range(len(names)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % slots
            owner[place[i]] = i
            free -= 1
            if not free:
                return owner


def lookup_table(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the table's fixed number of rows, cut from one binary literal."""
    packed = b"".join(i.to_bytes(4, "big") for i in fill_table(names, slots))
    cell = F.conv(F.hex(F.substring(F.lit(packed), F.col("slot").cast("int") * 4 + 1, F.lit(4))), 16, 10)
    return spark.range(slots).select(F.col("id").alias("slot"), cell.cast("int").alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 15 hex digits of the key's MD5, as text, modulo the slots; a null key counts as an empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots))


def place_rows(rows: DataFrame, key_col: str, names: list[str], slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``rows`` with the slot and shard of each row; nothing is shuffled.

    Equal keys go to one shard, null keys to that of the empty text; repeated rows
    and empty tables are fine. Columns called ``slot_col`` or ``shard_col`` are replaced.
    """
    table = lookup_table(rows.sparkSession, names, slots).toDF("_slot", shard_col)
    slotted = rows.drop(slot_col, shard_col).withColumn(slot_col, slot_of(F.col(key_col), slots))
    return slotted.join(F.broadcast(table), F.col(slot_col) == F.col("_slot")).drop("_slot")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return place_rows(docs.select("doc_id"), "doc_id", shard_names())


OP3_SQL = f"""
WITH RECURSIVE s AS (
  SELECT i, ('0x' || substr(md5('offset|shard-' || i), 1, 15))::BIGINT % {SLOTS} AS place, ('0x' || substr(md5('skip|shard-' || i), 1, 15))::BIGINT % {SLOTS - 1} + 1 AS skip
  FROM range({SHARDS}) t(i)),
fill(step, owner) AS (
  SELECT 0, list_transform(range({SLOTS}), lambda x: -1::BIGINT)
  UNION ALL
  SELECT step + 1, list_transform(owner, lambda v, k: CASE WHEN k - 1 = slot THEN i ELSE v END)
  FROM (SELECT step, owner, i, list_filter(list_transform(range({SLOTS}), lambda j: (place + j * skip) % {SLOTS}), lambda p: owner[p + 1] = -1)[1] AS slot
        FROM fill JOIN s ON i = step % {SHARDS} WHERE step < {SLOTS})),
t AS (SELECT owner FROM fill WHERE step = {SLOTS}),
d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents)
SELECT doc_id, slot, owner[slot + 1]::INTEGER AS shard FROM d, t
"""
