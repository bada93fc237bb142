"""Document fingerprints: one-permutation MinHash with optimal densification and
packed low-order bits.

Each shingle (``SHINGLE`` words) is hashed once; the hash's top bits choose one of
``BINS`` bins and the bin keeps the least of the rest. An empty bin takes the value of
the first filled bin in its own fixed random order of bins, so two sets fill a bin
alike exactly when they agree there. Each bin keeps ``BITS`` low-order bits; unrelated
bins agree by chance with probability ``2**-BITS``, which ``likeness`` takes out.

Edge cases: null texts count as empty; a wordless text's fingerprint is the empty
string, like another wordless text's (1) and unlike any other (0). Fewer words than
``SHINGLE``: the whole sequence is the one shingle. Rows with one doc_id are ordered by
text; a null doc_id comes after all others. A single document is its own next one.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import CHUNK_BYTES, mix, shingle_hashes, utf8

SHINGLE, BINS, BITS = 5, 256, 4

_U = np.uint64
_EMPTY = _U((1 << 64) - 1)
_BIN_BITS = BINS.bit_length() - 1
_SALT = mix(np.arange(1, BINS + 1, dtype=np.uint64))
#: Row j: the order in which empty bin j looks for a filled one; the same in every run.
_ORDER = np.stack([np.random.default_rng(j).permutation(BINS) for j in range(BINS)])


def fingerprints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(low-order bits, one row of ``BINS`` per text; whether the text has any word)."""
    h, n = shingle_hashes(texts, SHINGLE)
    owner = np.repeat(np.arange(len(texts)), n)
    least = np.full((len(texts), BINS), _EMPTY)
    bins = (h >> _U(64 - _BIN_BITS)).astype(np.int64)
    np.minimum.at(least.reshape(-1), owner * BINS + bins, h & _U((1 << (64 - _BIN_BITS)) - 1))
    filled = least != _EMPTY
    row, col = np.nonzero(~filled & (n > 0)[:, None])
    source = np.full(len(row), -1)
    open_ = np.arange(len(row))
    for k in range(6):                              # most bins find one soon
        at = _ORDER[col[open_], k]
        hit = filled[row[open_], at]
        source[open_[hit]] = at[hit]
        open_ = open_[~hit]
    for s in range(0, len(open_), 4096):
        o = open_[s:s + 4096]
        first = np.take_along_axis(filled[row[o]], _ORDER[col[o]], 1).argmax(1)
        source[o] = _ORDER[col[o], first]
    dense = least.copy()
    dense[row, col] = least[row, source]
    # A copied value's low bits depend on its bin, too: chance agreements stay independent.
    return (mix(dense + _SALT) & _U((1 << BITS) - 1)).astype(np.uint8), n > 0


def packed(bits: np.ndarray, full: np.ndarray) -> list[str]:
    """Hexadecimal text of each row, two bins a byte; empty without words."""
    data = (bits[:, 0::2] << BITS) | bits[:, 1::2]
    return [r.tobytes().hex() if f else "" for r, f in zip(data, full, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, full_a: np.ndarray, full_b: np.ndarray) -> np.ndarray:
    """Estimated similarity per row pair, chance agreement taken out, within 0 and 1."""
    chance = 2.0**-BITS
    found = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    return np.where(full_a & full_b, found, (full_a == full_b).astype(float))


def edited(text: str, following: str) -> str:
    """``text`` with its last third (rounded down) replaced by the start of ``following``."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def _finish(rows: list[tuple], texts: list[str]) -> pd.DataFrame:
    """Result rows of all but the last of ``texts``, each with the one after it."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    raw = utf8(changed)
    bits, full = fingerprints(utf8(texts) + raw)
    m = len(texts)
    own, ed, nxt = slice(0, m - 1), slice(m, None), slice(1, m)
    return pd.DataFrame({
        "doc_id": pd.array(rows[:m - 1], dtype="Int64"), "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t).hexdigest() for t in raw],
        "fingerprint": packed(bits[own], full[own]), "edited_fingerprint": packed(bits[ed], full[ed]),
        "near_edited": likeness(bits[own], bits[ed], full[own], full[ed]),
        "near_next": likeness(bits[own], bits[nxt], full[own], full[nxt])})


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    per row: each text against its edit with the next document, by descending doc_id
    (after the last: the first).

    Ids are cut at approximate quantiles into ordered ranges; a range is streamed in
    order, and its last row gets the next range's first row as a copy, so texts are
    shuffled once and no task holds more than a step's texts."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), place.alias("place"))
    cuts = sorted({int(x) for x in src.select("place").approxQuantile("place", [i / n for i in range(1, n)], 0.1 / n)})
    held = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    # A range holds the ids below the cuts it counts: range 0 the largest ids.
    src = src.withColumn("part", F.size(F.filter(held, lambda c: F.col("place") < c)))
    heads = {r["part"]: r["place"] for r in src.groupBy("part").agg(F.max("place").alias("place")).collect()}   # a row per range
    parts = sorted(heads)
    before = {p: parts[i - 1] for i, p in enumerate(parts)}
    at = lambda d, p: F.array(*[F.lit(d.get(i)) for i in range(len(cuts) + 1)]).cast("array<long>")[p]
    own = F.struct(F.col("part").cast("long").alias("part"), F.lit(0).alias("copy"))
    copy = F.struct(at(before, F.col("part")).alias("part"), F.lit(1).alias("copy"))
    dealt = src.withColumn("to", F.explode(F.when(F.col("place") == at(heads, F.col("part")), F.array(own, copy)).otherwise(F.array(own))))
    rows = (dealt.select("doc_id", "text", "place", "to.part", "to.copy")
            .repartitionById(len(cuts) + 1, F.col("part").cast("int")).sortWithinPartitions("part", "copy", F.desc("place"), F.xxhash64("text"), "text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        texts: list[str] = []
        size, part, done = 0, None, False
        for pdf in batches:
            doc_ids = pdf["doc_id"].astype("Int64")
            for doc_id, text, p, c in zip(doc_ids, pdf["text"], pdf["part"], pdf["copy"], strict=True):
                if p != part:
                    ids, texts, size, part, done = [], [], 0, p, False
                if done:
                    continue
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if c:
                    done = True
                if c or size > CHUNK_BYTES:
                    if len(texts) > 1:
                        yield _finish(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])

    return rows.mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")
