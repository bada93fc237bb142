"""Shard placement by a permutation-filled lookup table.

Every shard has its own permutation of a prime number of slots (an offset and a skip
from its name's hash). Shards take turns; at its turn a shard claims the first free slot
of its permutation. A key's hash modulo the table size is its slot. The table has a fixed
number of rows, so it is broadcast, and placing a row is one lookup. When a shard goes,
its slots are shared out and few others change hands.

A key with more than ``SLACK`` of a shard's fair share of rows is placed in pieces, by
row hash, each piece like a key of its own; there are at most shards / SLACK such keys,
so their list is bounded, too.

Edge cases: a null key is a key like another. Repeated rows share a piece and so a shard. An
empty table gives an empty placement. No shards, more shards than slots and a number of slots
that is not prime are refused. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS, SLACK = 65_537, 0.25


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's place in ``shards`` for each of a prime number of slots."""
    if not 0 < len(shards) <= slots or slots < 3 or any(slots % d == 0 for d in range(2, math.isqrt(slots) + 1)):
        raise ValueError(f"{len(shards)} shards need a prime number of slots, at least as many, not {slots}")
    preferences = []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        preferences.append((int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1))
    table, step, free = [-1] * slots, [0] * len(shards), slots
    while free:
        for i, (offset, skip) in enumerate(preferences):
            while True:
                slot = (offset + step[i] * skip) % slots
                step[i] += 1
                if table[slot] < 0:
                    break
            table[slot] = i
            free -= 1
            if not free:
                break
    return table


def place(rows: DataFrame, key: str, row_id: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``rows`` (``key``, ``row_id``) with the columns piece, slot and shard."""
    spark = rows.sparkSession
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(1.0, SLACK * total / len(shards))
    hot = (counts.where(F.col("n") > most)
           .select(F.col(key).alias("hot_key"), F.ceil(F.col("n") / most).cast("long").alias("pieces")))      # under shards / SLACK rows
    table = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup_table(shards, slots))], "slot long, shard string")
    piece = F.pmod(F.xxhash64(F.col(row_id)), F.coalesce("pieces", F.lit(1)))
    return (rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("hot_key")), "left")
            .withColumn("piece", piece)
            .withColumn("slot", F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull(), "piece"), F.lit(slots)))
            .drop("hot_key", "pieces").join(F.broadcast(table), "slot"))


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def placements(docs: DataFrame, n_shards: int = 64) -> DataFrame:
    """(doc_id, source, piece, slot, shard, shard_after_loss): documents kept together by source
    as far as their number allows, and where each goes when the last shard is lost (null: no other)."""
    names = shard_names(n_shards)
    now = place(docs.select("doc_id", "source"), "source", "doc_id", names)
    after = lookup_table(names[:-1]) if n_shards > 1 else []
    later = docs.sparkSession.createDataFrame([(i, names[s]) for i, s in enumerate(after)], "slot long, shard_after_loss string")
    return now.join(F.broadcast(later), "slot", "left").select("doc_id", "source", "piece", "slot", "shard", "shard_after_loss")
