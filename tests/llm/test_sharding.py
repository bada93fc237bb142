"""Sharding: the table's balance and stability, hot keys, edge cases."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from casegrid.llm import sharding as S


def test_table_by_hand():
    """A small table filled by a plain version of the turns."""
    import hashlib

    names, slots = ["a", "b", "c"], 13
    order = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        order.append([(offset + j * skip) % slots for j in range(slots)])
    table = {}
    while len(table) < slots:
        for i, prefs in enumerate(order):
            free = next((s for s in prefs if s not in table), None)
            if free is not None:
                table[free] = i
    assert S.lookup_table(names, slots) == [table[s] for s in range(slots)]


def test_balance_and_little_movement():
    names = S.shard_names(50)
    a = S.lookup_table(names)
    assert max(Counter(a).values()) - min(Counter(a).values()) <= 1
    b = S.lookup_table(names[:-1])
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != 49)
    assert set(b) == set(range(49)) and moved < 0.1 * S.SLOTS


def test_hot_keys_are_split_and_others_kept_together(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("source"))
    out = S.place(rows, "source", "doc_id", S.shard_names(16)).collect()
    assert len(out) == 6000
    shards = {}
    for r in out:
        shards.setdefault(r.source, set()).add(r.shard)
    assert len(shards["hot"]) > 8 and all(len(v) == 1 for k, v in shards.items() if k != "hot")
    assert max(Counter(r.shard for r in out).values()) < 3 * 6000 / 16


def test_rows(spark, make_docs):
    docs = make_docs([(1, "a"), (1, "a"), (None, "b"), (2, None)], extra=True).withColumn("source", F.when(F.col("doc_id") == 2, None).otherwise(F.col("source")))
    out = S.placements(docs, 4).collect()
    assert len(out) == 4 and all(r.shard and r.shard_after_loss and 0 <= r.slot < S.SLOTS for r in out)
    assert len({(r.slot, r.shard) for r in out if r.doc_id == 1}) == 1
    assert S.placements(docs.limit(0), 4).count() == 0


def test_arguments(make_docs):
    for shards, slots in (([], 13), (["a"] * 14, 13), (["a", "b"], 15), (["a"], 1)):
        with pytest.raises(ValueError):
            S.lookup_table(shards, slots)
    docs = make_docs([(1, "x"), (2, None)]).withColumn("source", F.lit("s"))
    out = S.placements(docs, n_shards=1).collect()
    assert [(r.shard, r.shard_after_loss) for r in out] == [("shard-00000", None)] * 2


def test_placement_by_hand(make_docs):
    """Rows placed by a plain reading: pieces of a hot key, the slot, the table."""
    rows = [(i, "x") for i in range(60)]
    source = F.when(F.col("doc_id") < 40, "hot").when(F.col("doc_id") < 58, F.concat(F.lit("s"), F.col("doc_id") % 6))
    docs = make_docs(rows).withColumn("source", source)
    names = S.shard_names(4)
    table, most = S.lookup_table(names), S.SLACK * 60 / 4
    hashed = docs.select("doc_id", "source", F.xxhash64("doc_id").alias("h")).collect()
    sizes = Counter(r.source for r in hashed)
    pieces = {r.doc_id: r.h % math.ceil(sizes[r.source] / most) if sizes[r.source] > most else 0 for r in hashed}
    out = S.place(docs.select("doc_id", "source"), "source", "doc_id", names).collect()
    assert len(out) == 60 and {r.doc_id: r.piece for r in out} == pieces
    assert all(r.shard == names[table[r.slot]] for r in out)
    by_key = {}
    for r in out:
        assert by_key.setdefault((r.source, r.piece), r.shard) == r.shard
