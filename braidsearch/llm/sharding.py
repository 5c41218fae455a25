"""Shards by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own: an offset and a step,
both from a hash of its name, walk through all slots. In turn each shard claims the first slot on
its list that is still free, until none is. So shards own equally many slots, within one, and when a
shard comes or goes most slots keep their owner. A document's key hashes to a slot; the table, one
small row for each slot, is broadcast, so placing a document takes one look-up and no shuffle.

Placing uses DataFrame functions only; the table is filled on the driver from the names alone, and
its size is the parameter ``slots``, not the data.

Defined results: a null key has a slot like any other value; repeated rows go to one shard; texts are
not read; names that repeat count once; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidsearch.llm import words as wd

SLOTS = 5003
SHARDS = tuple(f"shard-{n:02d}" for n in range(48))
# Slots that a broadcast table may have (about 40 bytes each).
MOST_SLOTS = 1_000_003


def _number(name: str) -> int:
    """The first 60 bits of a name's MD5."""
    return int(hashlib.md5(name.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: tuple[str, ...], slots: int = SLOTS) -> list[str]:
    """The owner of every slot."""
    if not _is_prime(slots) or slots > MOST_SLOTS:
        raise ValueError(f"slots must be a prime up to {MOST_SLOTS}")
    names = sorted(set(shards))
    if not names or len(names) > slots:
        raise ValueError("shards must be named, and no more than slots")
    place = [_number(f"{name}|offset") % slots for name in names]
    step = [_number(f"{name}|step") % (slots - 1) + 1 for name in names]
    owner: list[str | None] = [None] * slots
    turn = 0
    for _ in range(slots):
        while owner[place[turn]] is not None:
            place[turn] = (place[turn] + step[turn]) % slots
        owner[place[turn]] = names[turn]
        turn = (turn + 1) % len(names)
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its text, modulo ``slots``; null as ''."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint") % slots


def table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    rows = list(enumerate(lookup_table(shards, slots)))
    return spark.createDataFrame(rows, "slot bigint, shard string")


def place(
    docs: DataFrame, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, key: str = "doc_id"
) -> DataFrame:
    """``docs`` with its ``slot`` and ``shard``, under names that ``docs`` does not use."""
    slot, shard = wd.free_name(docs, "slot"), wd.free_name(docs, "shard")
    owners = table(docs.sparkSession, shards, slots)
    owners = owners.select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    slotted = docs.withColumn(slot, slot_of(F.col(key), slots))
    return slotted.join(F.broadcast(owners), slot).select(*wd.quoted(docs), slot, shard)


def write_shards(docs: DataFrame, path: str, files: int = 1, **options) -> None:
    """Write ``docs`` to a folder for each shard, every shard in up to ``files`` parts."""
    placed = place(docs, **options)
    slot, shard = placed.columns[-2:]
    part = F.pmod(F.xxhash64(*wd.quoted(docs)), F.lit(files))
    placed.repartition(shard, part).drop(slot).write.partitionBy(shard).parquet(path)
