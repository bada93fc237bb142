"""A mixture of sources to target weights, in words.

Documents get a hash-random key (MD5 of seed and id), are range-sorted by it within their
source, and a distributed running sum of words says where each stands. A source's budget is
then met exactly: whole epochs first, and of the last epoch the documents from the beginning
of its order, the one on the edge cut at a word.

Targets: source weights repeat ``weights`` in code-point order of the names, null last, and
share all words; no target is above ``max_epochs`` times its source's words, and what is
left over is shared again by weight among the sources below that, until none is above.

Scale: the texts are read once, for a row of five narrow columns per document. Range
partitions split a hot source by its keys; each task adds up its own rows, one small row per
(source, task) carries the sums over, and no source, nor the list of sources, is in one task
or on the driver. Sharing the excess takes a one-row aggregate over the sources per round.
All tables that are read again are written to the shared folder.

Edge cases: a null text has size 0 and takes nothing, as an empty one. A null source is a
source of its own. Null ids get a key as any other. Rows that repeat an id follow each
other by size and text. A source without words has target 0. No documents, no rows. Extra
columns are ignored. Reruns give the same result, whatever the partitions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrid.llm.common import utf8, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@F.pandas_udf(T.LongType())
def n_words(text: pd.Series) -> pd.Series:
    """Words (runs without ASCII white space) of each text."""
    return pd.Series([len(t.split()) for t in utf8(text)], dtype="int64")


def running(rows: DataFrame, group: Column, order: Sequence[Column], value: str, name: str, out: str = "before") -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over the rows of the same group that come
    earlier in ``order``. ``group`` must not be null.

    Rows are range-partitioned by group and order, so each task holds a stretch of the order;
    sums inside a stretch are added up while it streams by, sums before it come from one
    row per (group, stretch).
    """
    keyed = rows.withColumn("__group", group.cast("long"))
    schema = T.StructType([*keyed.schema.fields, T.StructField("__task", T.LongType()), T.StructField("__sum", T.LongType())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, carry = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__group", value))
            total = np.cumsum(v) - v
            start = np.concatenate(([True], g[1:] != g[:-1]))
            first = np.flatnonzero(start)[np.cumsum(start) - 1]          # where the row's group begins in the batch
            before = total - total[first] + np.where(g == last, carry, 0)
            last, carry = g[-1], int(before[-1] + v[-1])
            yield (batch.append_column("__task", pa.array(np.full(len(g), task, np.int64)))
                   .append_column("__sum", pa.array(before.astype(np.int64))))

    stretch = keyed.repartitionByRange("__group", *order).sortWithinPartitions("__group", *order)
    summed = written(stretch.mapInArrow(add_up, schema), name)
    sums = summed.groupBy("__group", "__task").agg(F.sum(value).alias("__total"))
    earlier = Window.partitionBy("__group").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)      # a row per task at most
    offset = sums.select("__group", "__task", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__offset"))
    return (summed.join(offset, ["__group", "__task"])
            .withColumn(out, F.col("__sum") + F.col("__offset")).drop("__group", "__task", "__sum", "__offset"))


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_no, source_size, weight, target) of every source of ``sized`` (source, size)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    numbered = running(sources, F.lit(0), [F.col("source").asc_nulls_last()], "one", "mix-sources", "source_no")
    weight = F.get(F.lit([int(w) for w in weights]), (F.col("source_no") % len(weights)).cast("int")).cast("long")
    table = written(numbered.select("source", "source_no", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("most")), "mix-weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    # What the sources below their most share: all words but those of the sources at it.
    left, shares, capped = total, None, -1
    while True:
        below = F.lit(True) if shares is None else F.col("weight") * F.lit(float(left)) / F.lit(float(shares)) <= F.col("most")
        at = table.agg(F.coalesce(F.sum(F.when(~below, F.col("most"))), F.lit(0)).alias("used"), F.sum(F.when(below, F.col("weight"))).alias("shares"),
                       F.count_if(~below).alias("capped")).first()
        if at["capped"] == capped:
            break
        capped, left, shares = at["capped"], total - at["used"], at["shares"]
        if not shares:              # no sources
            break
    most = F.col("most").cast("double")
    target = most if not shares else F.least(F.col("weight") * F.lit(float(left)) / F.lit(float(shares)), most)
    return table.select("source", "source_no", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken, and the columns ``keep``) of
    every document: it goes whole into ``epochs`` epochs, and ``taken - epochs * size`` of
    its words, from its beginning, into one more."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words("text").alias("size"), key.alias("key"),
                                F.xxhash64("text").alias("text_hash"), *keep), "mix-sizes")
    plan = written(targets(sized.select("source", "size"), weights, max_epochs), "mix-targets")
    # One row per source; Spark broadcasts it if it is small, else splits the hot ones.
    planned = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "source_no", "source_size", "target")
    stands = running(planned, F.col("source_no"), [F.col(c) for c in ("key", "doc_id", "size", "text_hash")], "size", "mix-order")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    full = ((budget - budget % size) / size).cast("long")
    rest = F.least(F.greatest(budget - full * F.col("source_size") - F.col("before"), F.lit(0)), F.col("size"))
    # The last document of a full rest is a whole epoch more.
    whole = full + F.when((rest == F.col("size")) & (rest > 0), 1).otherwise(0)
    return stands.select("doc_id", "source", "size", "source_size", "target", whole.cast("int").alias("epochs"),
                         (full * F.col("size") + rest).alias("taken"), *keep)


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """(doc_id, source, epoch, text): the mixed texts themselves, a row per epoch that a document is in."""
    found = mix(docs, weights, max_epochs, seed, keep=("text",)).where("taken > 0")
    part = F.col("taken") - F.col("epochs") * F.col("size")
    rows = found.withColumn("part", part).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("epochs") + F.when(part > 0, 1).otherwise(0))))
    n = F.when(F.col("epoch") <= F.col("epochs"), F.lit(-1).cast("long")).otherwise(F.col("part"))

    @F.pandas_udf("string")
    def beginning(text: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t if k < 0 else _words_of(t, int(k)) for t, k in zip(text, n, strict=True)], dtype=object)

    return rows.select("doc_id", "source", "epoch", beginning("text", n).alias("text"))


def _words_of(text: str, n: int) -> str:
    """The beginning of ``text`` up to the end of its n-th word."""
    return text[:next(islice(_WORD.finditer(text), n - 1, None)).end()]
