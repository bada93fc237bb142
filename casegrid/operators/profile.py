"""Profile of any columns of a table: counts, range, distinct values, top values (C14).

``profile`` is exact: one scan counts (column, value) pairs, collapsed on the map side, and
everything is derived from those counts. ``profile_approx`` keeps a fixed amount of state per
column instead (HyperLogLog registers, a frequent-items sketch), so nothing of a column's
distinct values is shuffled; ``exact_tops`` turns its candidates into exact counts with a
second scan and says which are proven to be the top.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMMARY = ("column_name", "n_rows", "n_null", "n_distinct", "min_value", "max_value")
#: Types that can't be ordered or told apart as text.
_NESTED = ("array", "map", "struct", "variant", "binary")


def _columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    kinds = dict(df.dtypes)
    found = list(columns) if columns else [c for c in df.columns if not kinds[c].startswith(_NESTED)]
    if not found:
        raise ValueError("no column to profile")
    return found


def _text(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, weight: str | None = None) -> DataFrame:
    """(column_name, value, n): how often each value, as text, stands in each column; null is a value here.
    ``weight``: a column of additive counts instead of one per row."""
    n = F.col(f"`{weight}`") if weight else F.lit(1).cast("long")
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), _text(c).alias("value")) for c in _columns(df, columns)])
    return df.select(n.alias("n"), F.inline(pairs)).groupBy("column_name", "value").agg(F.sum("n").alias("n"))


def _as(kind: str) -> Column:
    return F.col("value").cast(kind)


def profile(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10, weight: str | None = None) -> DataFrame:
    """Exact rows (column_name, n_rows, n_null, n_distinct, min_value, max_value, rank, value, n): a column's
    summary with each of its ``k`` most frequent values (null is one; ties by value, null last).

    Range and distinct values leave nulls out; smallest and largest are by the column's own type.
    A table without rows gives none.
    """
    columns = _columns(df, columns)
    kinds = dict(df.dtypes)
    counts = value_counts(df, columns, weight)
    is_column = {c: F.col("column_name") == c for c in columns}
    low, high = (F.coalesce(*[F.when(is_column[c], fn(F.when(is_column[c], _as(kinds[c]))).cast("string")) for c in columns]) for fn in (F.min, F.max))
    summary = counts.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.count("value").alias("n_distinct"), low.alias("min_value"), high.alias("max_value"))
    # A row-number limit, so each task of the counts passes on k rows per column only.
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return summary.join(top, "column_name").select(*SUMMARY, "rank", "value", "n")


def profile_approx(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10, rsd: float = 0.02, tracked: int = 1024) -> DataFrame:
    """(column_name, n_rows, n_null, n_distinct, min_value, max_value, error, asked, tops) with a bounded state per column.

    ``n_distinct`` is a HyperLogLog estimate of relative standard deviation ``rsd``. ``tops`` are the k
    heaviest of ``tracked`` values, with estimated counts; an estimate is off by ``error`` rows at most.
    Only values that surely stand out are among them: none of a column whose values are all about as
    frequent (``profile`` counts those).
    """
    columns = _columns(df, columns)
    numbered = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    state = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(columns)):
        c = F.col(f"c{i}")
        state += [F.count(c).alias(f"c{i}_n"), F.approx_count_distinct(c, rsd).alias(f"c{i}_d"), F.min(c).cast("string").alias(f"c{i}_min"),
                  F.max(c).cast("string").alias(f"c{i}_max"), F.expr(f"approx_top_k(cast(c{i} as string), {k}, {tracked})").alias(f"c{i}_top")]
    # The sketch holds `size` counters, a power of two; its error is 3.5 / size of the rows at most.
    size = 1 << math.ceil(math.log2(math.ceil(tracked / 0.75)))
    rows = [F.struct(F.lit(c).alias("column_name"), F.col("rows").alias("n_rows"), (F.col("rows") - F.col(f"c{i}_n")).alias("n_null"), F.col(f"c{i}_d").alias("n_distinct"),
                     F.col(f"c{i}_min").alias("min_value"), F.col(f"c{i}_max").alias("max_value"),
                     F.ceil(F.col("rows") * F.lit(3.5 / size)).alias("error"), F.lit(k).alias("asked"), F.col(f"c{i}_top").alias("tops")) for i, c in enumerate(columns)]
    return numbered.agg(*state).select(F.inline(F.array(*rows)))


def exact_tops(df: DataFrame, approx: DataFrame, k: int = 10) -> DataFrame:
    """(column_name, rank, value, n, proven): the candidates of ``approx`` (``profile_approx`` of ``df``, some more
    than k of them) counted exactly by a second scan, the k most frequent.

    ``proven``: the value is surely among the column's k most frequent. If the sketch gave fewer values
    than asked, any other one has at most twice the error; else at most the least estimate and
    the error. Nulls are no value here.
    """
    # Candidates per column: as many as the sketch was asked for, whatever the table's size.
    least = F.array_min(F.transform("tops", lambda t: t["count"]))
    others = F.when(F.size("tops") < F.col("asked"), 2 * F.col("error")).otherwise(least + F.col("error"))
    names = (approx.select("column_name", others.alias("others"), F.explode("tops").alias("top"))
             .select("column_name", "others", F.col("top")["item"].alias("value")).where("value is not null"))
    columns = [r["column_name"] for r in approx.select("column_name").collect()]
    counts = _candidate_counts(df, names, columns)
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("column_name", "rank", "value", "n", (F.col("n") > F.col("others")).alias("proven"))


def _candidate_counts(df: DataFrame, names: DataFrame, columns: list[str]) -> DataFrame:
    """Exact counts of the candidates: pairs are matched by a join before anything is grouped."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), _text(c).alias("value")) for c in columns])
    return (df.select(F.inline(pairs)).where("value is not null").join(names, ["column_name", "value"])
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"), F.max("others").alias("others")))
