"""Window frames over an order without a partition, or with one hot partition.

A plain window puts each partition in one task. Here rows get their number in the whole order,
are dealt to ranges of equal size by that number, and each range also gets the ``halo`` rows
that come before it, so any frame that looks back at most that far is computed inside the
range. Every task holds a range and its halo, whatever the keys.

Numbers come from a range-partitioned sort: a row's place in its task plus the rows of the
tasks before, one small row per task. The sorted rows are written once to the shared folder
(the numbers must not change when a task is run again).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from casegrid.session import scratch_path

#: Rows of a range.
RANGE_ROWS = 1 << 20

_PLACE_BITS = 33        # of monotonically_increasing_id: the row's place in its task


def number_rows(df: DataFrame, order: Sequence[Column], out: str = "row_no") -> DataFrame:
    """``df`` with each row's number in ``order``, from 0. Rows that tie are numbered in any order."""
    spark = df.sparkSession
    path = scratch_path(spark, "numbered")
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
       .withColumn("__id", F.monotonically_increasing_id()).write.parquet(path))
    rows = spark.read.parquet(path).withColumn("__task", F.shiftright("__id", _PLACE_BITS))
    sizes = rows.groupBy("__task").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)          # one row per task of the sort
    offsets = F.broadcast(sizes.select("__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")))
    number = F.col("__offset") + F.col("__id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return rows.join(offsets, "__task").withColumn(out, number).drop("__task", "__id", "__offset")


def over_ranges(df: DataFrame, order: Sequence[Column], columns: Callable[[WindowSpec], Mapping[str, Column]], halo: int,
                partition: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``columns(window)``, where the window is ordered by ``order`` within ``partition`` and its
    frames begin at most ``halo`` rows before the current one and end at it.

    Equal to the plain window for a complete order; a partition of any size is spread over ranges.
    """
    size = max(range_rows, halo, 1)
    keys = [F.col(c).asc_nulls_first() for c in partition]
    rows = number_rows(df, [*keys, *order], "__no")
    own = F.floor(F.col("__no") / size).cast("long")
    to = F.when(F.col("__no") % size >= size - halo, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = rows.withColumn("__own", own).withColumn("__range", F.explode(to))
    window = Window.partitionBy("__range", *partition).orderBy("__no")
    found = dealt.withColumns(dict(columns(window))).where(F.col("__range") == F.col("__own"))
    return found.drop("__no", "__own", "__range")
