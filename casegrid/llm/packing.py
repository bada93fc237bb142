"""Packing into optimal length buckets.

A row's length is the number of its ids in a tokenizer file, the end id included
(``n_ids``; counted once and written). ``n_tokens`` is the number of its words and the end mark,
and no length or budget is taken from it.

The corpus's length histogram (one aggregate, a row per distinct length) goes to a dynamic
program that chooses the bucket boundaries of least total padding, over all lengths. Inside a bucket,
rows form batches of ``budget // boundary`` rows, each padded to the boundary, so a
batch never exceeds the token budget unless a single row does (it is then a batch of
its own, uncut).

The histogram has at most as many rows as the longest text has ids, and under the square root
of twice the corpus's ids (so many ids the distinct lengths alone take). The program's choices
move one way as its last length grows, so it takes n log n steps a bucket, not n squared.

Rows of a bucket are dealt by hash to chunks of about ``CHUNK_ROWS`` rows, each ordered and
batched on its own: a bucket with most of the corpus is still many small groups. A
chunk's last batch may be short.

Edge cases: null and empty texts have one id, the end id. Rows of one id and text are
separate rows of the same chunk. Ties in the padding go to the fewest, then the
shortest boundaries. An empty table gives an empty plan. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrid.llm.common import chunks, public_tokenizer, written
from casegrid.llm.token_files import _encoder

CHUNK_ROWS = 16_384
_NONE = np.int64(2**62)


def n_tokens(text: str = "text") -> Column:
    """Words between white space and the end mark."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+")) + 1


def n_ids(tokenizer: str, text: str = "text") -> Column:
    """Ids of the text by the tokenizer file, and the end id."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(tokenizer)
        for s in batches:
            texts = ["" if t is None else t for t in s]
            yield pd.Series(np.concatenate([np.zeros(0, np.int64), *(enc.lengths(texts[i:j]) + 1 for i, j in chunks(texts))]))

    return run(F.col(text))


def _layer(best: np.ndarray, ends: np.ndarray, c: np.ndarray, s: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of the first j lengths with one bucket more than ``best`` has (``first``: the
    least number of lengths that ``best`` knows), and where that bucket begins."""
    n = len(ends)
    new, begins = np.full(n + 1, _NONE), np.zeros(n + 1, np.int64)
    todo = [(first + 1, n, first, n - 1)]
    while todo:                             # lengths low..high; their bucket begins in left..right
        low, high, left, right = todo.pop()
        if low > high:
            continue
        j = (low + high) // 2
        i = slice(left, min(j - 1, right) + 1)
        cost = best[i] + ends[j - 1] * (c[j] - c[i]) - (s[j] - s[i])
        at = left + int(np.argmin(cost))
        new[j], begins[j] = cost[at - left], at
        todo += [(low, j - 1, left, at), (j + 1, high, at, right)]
    return new, begins


def boundaries(lengths: np.ndarray, rows: np.ndarray, buckets: int) -> list[int]:
    """The at most ``buckets`` boundaries of least padding for ascending lengths and their rows."""
    n = len(lengths)
    if n == 0:
        return []
    ends, rows = np.asarray(lengths, np.int64), np.asarray(rows, np.int64)
    c, s = np.concatenate(([0], np.cumsum(rows))), np.concatenate(([0], np.cumsum(ends * rows)))
    best = np.full(n + 1, _NONE)
    best[0] = 0
    choice: list[np.ndarray] = []
    total: list[int] = []
    for k in range(min(buckets, n)):
        best, begins = _layer(best, ends, c, s, k)
        choice.append(begins)
        total.append(int(best[n]))
    k = int(np.argmin(total)) + 1
    out, j = [], n
    for begins in choice[k - 1::-1]:
        out.append(int(ends[j - 1]))
        j = int(begins[j])
    return out[::-1]


def pack(docs: DataFrame, budget: int = 32_768, buckets: int = 16, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_ids, bucket, pad_to, chunk, batch, slot) per row of ``docs`` (doc_id, text);
    (bucket, chunk, batch) names a batch and slot a row's place in it. ``tokenizer`` is a
    vocabulary file's path, by default the public byte_bpe_50k."""
    spark = docs.sparkSession
    ids = n_ids(tokenizer or public_tokenizer("byte_bpe_50k.json"))
    rows = written(docs.select("doc_id", n_tokens().cast("long").alias("n_tokens"), ids.alias("n_ids"), F.xxhash64("doc_id", "text").alias("h")), "lengths")
    steps = rows.groupBy("n_ids").agg(F.count("*").alias("rows")).orderBy("n_ids").toPandas()      # a row per distinct length
    ends = boundaries(*(steps[k].to_numpy(np.int64) for k in ("n_ids", "rows")), buckets)
    plan, low = [], 0
    for b, end in enumerate(ends):
        inside = steps[(steps["n_ids"] > low) & (steps["n_ids"] <= end)]
        plan.append((b, low, end, max(1, budget // end), max(1, -(-int(inside["rows"].sum()) // CHUNK_ROWS))))
        low = end
    table = F.broadcast(spark.createDataFrame(plan, "bucket int, above long, pad_to long, batch_rows long, chunks long"))   # `buckets` rows
    placed = (rows.withColumn("bucket", sum((F.col("n_ids") > end).cast("int") for end in ends[:-1]) if len(ends) > 1 else F.lit(0))
              .join(table, "bucket").withColumn("chunk", F.pmod("h", "chunks")))
    nth = F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy("h", "doc_id")) - 1
    return placed.withColumn("nth", nth).select(
        "doc_id", "n_tokens", "n_ids", "bucket", "pad_to", "chunk", F.floor(F.col("nth") / F.col("batch_rows")).alias("batch"),
        F.pmod(F.col("nth").cast("long"), F.col("batch_rows")).alias("slot"))
