"""Composite metrics: ``DataFrame -> DataFrame`` transforms usable with
``df.transform``.

Scale contract: functions that compare rows with all others (share of total,
z-score, latest period) put them in one window by default, for an input already
aggregated to a grain bounded by the dimensions (states, products, months,
quarters). For keys without such a bound (customers, parts) pass
``bounded=False``: totals then come from a one-row aggregate, merged from a row
per task, and no task sees all rows. Lags and rolling frames over an order without
a partition have their counterparts in ``operators.ordered``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrid.functions import asc_nl, band, desc_nl, pct, pct_change, round_half_away, safe_div
from casegrid.operators.ordered import over_ranges


def _all():
    """One frame over all rows of a small, already aggregated input."""
    return Window.partitionBy()


def with_totals(df: DataFrame, totals: Mapping[str, Column], bounded: bool) -> DataFrame:
    """``df`` with aggregates over all its rows as columns: by one window over everything, or by a
    scalar subquery per aggregate, whose partial results are one row per task."""
    if bounded:
        return df.withColumns({name: agg.over(_all()) for name, agg in totals.items()})
    return df.select("*", *[df.agg(agg).scalar().alias(name) for name, agg in totals.items()])


# C15 ---------------------------------------------------------------------

def period_counts(cases: DataFrame, keys: Sequence[Column | str],
                  measures: Mapping[str, str] | None = None) -> DataFrame:
    """Group additive case measures by ``keys``.

    ``cases`` carries the additive measures ``n`` (rows), ``n_relief`` and
    ``n_timely`` - one per case row, or pre-summed in the daily table - so the
    same code serves base rows and the daily table. ``measures`` maps output
    name -> input measure column (default ``{"complaints": "n"}``).
    """
    measures = measures or {"complaints": "n"}
    return cases.groupBy(*keys).agg(*[F.sum(src).alias(out) for out, src in measures.items()])


# C1 ----------------------------------------------------------------------

def share_of_total(df: DataFrame, value: str, out: str = "pct_of_total",
                   scale: int = 2, bounded: bool = True) -> DataFrame:
    """``ROUND(value * 100.0 / SUM(value) OVER (), scale)``; total = rows left after filters."""
    return (with_totals(df, {"__total": F.sum(value)}, bounded)
            .withColumn(out, pct(F.col(value), F.col("__total"), scale)).drop("__total"))


def _framed(df: DataFrame, order: str | Sequence[str], partition: Sequence[str], bounded: bool, halo: int,
            columns: Callable[[WindowSpec], Mapping[str, Column]]) -> DataFrame:
    """Columns over an ordered window that looks back ``halo`` rows: a plain one, or over ranges of the order
    if a partition may be larger than a task (``bounded=False``)."""
    keys = [asc_nl(c) for c in ([order] if isinstance(order, str) else order)]
    if bounded:
        return df.withColumns(dict(columns(Window.partitionBy(*partition).orderBy(*keys))))
    return over_ranges(df, keys, columns, halo, partition)


# M12 ---------------------------------------------------------------------

def with_calendar(df: DataFrame, period: str, keys: Sequence[str], fill: Mapping[str, int | float], *,
                  grain: str = "month", whole: bool = True) -> DataFrame:
    """One row per key and calendar period, so that a lag by row is a lag by calendar.

    Periods run from a key's first to the last of the table (``whole``) or of the key; those
    without a row get the values of ``fill``, NULL in other columns. ``df`` has one row per
    key and period; rows without a period are dropped. NULL keys are keys.
    """
    step = {"day": "INTERVAL 1 DAY", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTHS", "year": "INTERVAL 1 YEAR"}[grain]
    rows = df.filter(F.col(period).isNotNull())
    spans = rows.groupBy(*keys).agg(F.min(period).alias("__from"), F.max(period).alias("__to"))
    if whole:
        spans = spans.withColumn("__to", rows.agg(F.max(period)).scalar())
    spine = spans.select(*keys, F.explode(F.sequence("__from", "__to", F.expr(step))).alias(period))
    same = F.lit(True)
    for c in (*keys, period):
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}"))
    joined = spine.alias("s").join(rows.alias("r"), same, "left")
    out = [F.col(f"s.{c}") if c in (*keys, period)
           else F.coalesce(F.col(f"r.{c}"), F.lit(fill[c])).alias(c) if c in fill else F.col(f"r.{c}") for c in df.columns]
    return joined.select(*out)


# C2 ----------------------------------------------------------------------

def growth_vs_lag(df: DataFrame, order: str | Sequence[str], value: str, *, partition: Sequence[str] = (),
                  lag: int = 1, prev_out: str = "prev", pct_out: str = "growth_pct",
                  scale: int = 2, min_base: int | None = None, bounded: bool = True) -> DataFrame:
    """Lag by row (not by calendar; see ``with_calendar``) and the percent change against it.

    ``min_base``: keep only rows whose lagged value is ``>= min_base``.
    """
    out = _framed(df, order, partition, bounded, lag, lambda w: {prev_out: F.lag(value, lag).over(w)})
    out = out.withColumn(pct_out, pct_change(F.col(value), F.col(prev_out), scale))
    if min_base is not None:
        out = out.filter(F.col(prev_out).isNotNull() & (F.col(prev_out) >= F.lit(min_base)))
    return out


# C3 ----------------------------------------------------------------------

def rate_per(counts: DataFrame, dim: DataFrame, key: str, value: str, base_col: str,
             per: float = 100000.0, out: str = "rate", scale: int = 1) -> DataFrame:
    """Join a small per-key dimension and compute ``value * per / base``.

    Aggregate first, join after: ``counts`` has one row per key, so the join is
    small x small; Spark chooses the join from the measured sizes.
    Inner join: keys missing in ``dim`` drop out (see ``unmatched_keys``).
    """
    joined = counts.join(dim, key, "inner")
    return joined.withColumn(out, round_half_away(
        safe_div(F.col(value).cast("double") * F.lit(float(per)), F.col(base_col)), scale))


# C5 + C6 -------------------------------------------------------------------

def zscore(df: DataFrame, value: str, *, z_out: str = "z_score", scale: int = 2,
           mean_out: str | None = None, mean_scale: int = 0,
           band_out: str | None = None, band_on: str = "rounded",
           cuts: Sequence[float] = (), labels: Sequence[str] = (),
           default: str = "", bounded: bool = True) -> DataFrame:
    """z = (value - mean) / NULLIF(stddev_samp, 0) against one baseline (all rows).

    ``band_on``: ``"rounded"`` bands the rounded z (report Q8), ``"raw"`` bands
    the unrounded z (report K1); the two differ near a cut. NULL z (one row or
    zero spread) falls through to ``default``.
    """
    if band_on not in ("rounded", "raw"):
        raise ValueError("band_on must be 'rounded' or 'raw'")
    # Bind the two window aggregates once (one Window node), then derive
    # everything else in a single projection.
    stats = with_totals(df, {"__mean": F.avg(F.col(value)), "__sd": F.stddev_samp(F.col(value))}, bounded)
    z = safe_div(F.col(value) - F.col("__mean"), F.col("__sd"))
    z_rounded = round_half_away(z, scale)
    derived = {z_out: z_rounded}
    if mean_out:
        derived[mean_out] = round_half_away(F.col("__mean"), mean_scale)
    if band_out:
        derived[band_out] = band(z_rounded if band_on == "rounded" else z, cuts, labels, default)
    return stats.withColumns(derived).drop("__mean", "__sd")


# C7 ----------------------------------------------------------------------

def rolling(df: DataFrame, order: str | Sequence[str], value: str, rows: int, *, fn: str = "sum",
            partition: Sequence[str] = (), out: str = "rolling", bounded: bool = True) -> DataFrame:
    """Frame of the last ``rows`` rows (``ROWS BETWEEN rows-1 PRECEDING AND CURRENT ROW``).

    The first rows of a partition use fewer rows (no NULL padding).
    """
    agg = {"sum": F.sum, "avg": F.avg, "mean": F.avg, "max": F.max, "min": F.min}[fn]
    return _framed(df, order, partition, bounded, rows - 1,
                   lambda w: {out: agg(F.col(value)).over(w.rowsBetween(-(rows - 1), 0))})


def rolling_days(df: DataFrame, date_col: str, value: str, days: int, *,
                 partition: Sequence[str] = (), out: str = "rolling") -> DataFrame:
    """Sum over the last ``days`` calendar days, the row's own included (a ``RANGE`` frame)."""
    day = F.unix_date(F.col(date_col)).cast("long")
    w = Window.partitionBy(*partition).orderBy(day).rangeBetween(-(days - 1), 0)
    return df.withColumn(out, F.sum(F.col(value)).over(w))


# C8 ----------------------------------------------------------------------

def trend_class(df: DataFrame, order: str | Sequence[str], value: str, *, partition: Sequence[str] = (),
                labels: tuple[str, str, str] = ("Accelerating", "Decelerating", "Mixed"),
                growth_out: str = "growth_vs_3mo_ago_pct", trend_out: str = "trend",
                scale: int = 1, bounded: bool = True) -> DataFrame:
    """Three row-lags; growth against lag 3; 'accelerating' = three rises in a
    row, 'decelerating' = two falls in a row, else mixed. Keeps m1..m3."""
    up, down, mixed = labels
    v = F.col(value)
    out = _framed(df, order, partition, bounded, 3, lambda w: {f"m{k}": F.lag(value, k).over(w) for k in (1, 2, 3)})
    m1, m2, m3 = F.col("m1"), F.col("m2"), F.col("m3")
    return out.withColumns({
        growth_out: pct_change(v, m3, scale),
        trend_out: (F.when((v > m1) & (m1 > m2) & (m2 > m3), F.lit(up))
                     .when((v < m1) & (m1 < m2), F.lit(down))
                     .otherwise(F.lit(mixed))),
    })


# C9 ----------------------------------------------------------------------

def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int,
                    rank_out: str = "rank") -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY group ORDER BY order) <= n``.

    Callers pass a complete ordering (value, then key columns) so ties are
    broken deterministically. Spark plans a partial ``WindowGroupLimit`` before
    the shuffle, so at most n rows per group and map task move.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_out, F.row_number().over(w)).filter(F.col(rank_out) <= n)


# C10 ---------------------------------------------------------------------

def latest_per_group(df: DataFrame, group: Sequence[str], order_desc: str,
                     tie: Sequence[str] = ()) -> DataFrame:
    """Latest row per group (largest ``order_desc``, NULL last; then smallest ``tie``).

    One aggregate that keeps the best row per group, on the map side first: no window, and a
    group of any size is one row per task when it is shuffled. An order that can't be
    negated (text) takes a row-number window instead.
    """
    kind = df.schema[order_desc].dataType
    col = F.col(order_desc)
    if isinstance(kind, T.DateType):
        falling = -F.unix_date(col)
    elif isinstance(kind, T.TimestampType):
        falling = -F.unix_micros(col)
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        falling = -col.cast("decimal(20,0)")
    elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        falling = -col
    else:
        w = Window.partitionBy(*group).orderBy(desc_nl(order_desc), *[asc_nl(t) for t in tie])
        return (df.withColumn("__rn", F.row_number().over(w))
                  .filter(F.col("__rn") == 1).drop("__rn"))
    # Structs compare field by field, null first: a flag before each field puts it last.
    key = F.struct(col.isNull().alias("n"), falling.alias("v"),
                   *[x for i, t in enumerate(tie) for x in (F.col(t).isNull().alias(f"n{i}"), F.col(t).alias(f"t{i}"))])
    best = df.groupBy(*group).agg(F.min_by(F.struct(*df.columns), key).alias("__row"))
    return best.select("__row.*")


# C11 ---------------------------------------------------------------------

def at_latest_period(df: DataFrame, period: str, where: Column | None = None, bounded: bool = True) -> DataFrame:
    """Rows satisfying ``where`` whose ``period`` equals the largest such period.

    Same as ``WHERE p AND period = (SELECT MAX(period) FROM t WHERE p)``, as one
    max over the (bounded, aggregated) filtered rows instead of a second scan.
    """
    rows = df if where is None else df.filter(where)
    return (with_totals(rows, {"__latest": F.max(period)}, bounded)
                .filter(F.col(period) == F.col("__latest")).drop("__latest"))


# C12 ---------------------------------------------------------------------

def attach_series(df: DataFrame, period: str, series: DataFrame, *, date_col: str = "date",
                  value_cols: Sequence[str] = ("delinquency_rate",), grain: str = "quarter",
                  how: str = "left") -> DataFrame:
    """Attach a coarser-grained series (e.g. quarterly) to period rows.

    Both sides are keyed by ``trunc(., grain)``; a month row gets its quarter's
    value. ``how="inner"`` keeps only periods with a non-NULL value (a left join
    followed by ``IS NOT NULL``). The series must have one row per key
    (checked at load time, ``sources.series``).
    """
    key = "__k"
    right = series.select(F.trunc(F.col(date_col).cast("date"), grain).alias(key),
                          *value_cols)
    out = df.withColumn(key, F.trunc(F.col(period), grain))
    if how == "inner":
        cond = None
        for c in value_cols:
            cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
        right = right.filter(cond)
        return out.join(right, key, "inner").drop(key)
    return out.join(right, key, how).drop(key)


# C13 ---------------------------------------------------------------------

def unify_categories(df: DataFrame, column: str, mapping: Mapping[str, str],
                     keys: Sequence[str], aggs: Mapping[str, str]) -> DataFrame:
    """Rename categories, then re-aggregate.

    Rows with a NULL key are dropped (as a dataframe ``groupby`` does).
    ``aggs`` maps column -> ``"sum"`` | ``"mean"``; ``mean`` is unweighted.
    """
    fns = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "max": F.max, "min": F.min}
    mapped = df.replace(dict(mapping), subset=[column]) if mapping else df
    not_null = None
    for k in keys:
        not_null = F.col(k).isNotNull() if not_null is None else not_null & F.col(k).isNotNull()
    return (mapped.filter(not_null).groupBy(*keys)
                  .agg(*[fns[fn](F.col(c)).alias(c) for c, fn in aggs.items()]))
