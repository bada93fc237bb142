"""The published reports, as DataFrame plans.

Each report takes ``ReportInputs`` - case rows carrying the additive
measures ``n`` / ``n_relief`` / ``n_timely`` (base rows or the daily table,
see ``plans.daily``) plus the small dimensions - and a ``ReportConfig``. Each
returns a lazy DataFrame; nothing is collected.

Plan shape for every report: scan -> filter (pushed to the scan) -> two-stage
hash aggregate to a grain bounded by the dimensions (state, product, day,
month, quarter) -> windows / small joins on that aggregate -> sort or top-k.
Ties in every ``ORDER BY ... LIMIT`` and ``ROW_NUMBER`` are broken by the key
columns so results are deterministic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid import schema as S
from casegrid.config import DEFAULT, ReportConfig
from casegrid.functions import (asc_nl, before, desc_nl, in_regions, month_of, pct, quarter_of,
                                round_half_away, since)
from casegrid.operators import metrics as M
from casegrid.operators.joins import unmatched_keys
from casegrid.plans.catalog import CASE_PARTITION


@dataclass
class ReportInputs:
    cases: DataFrame                       # case rows or daily table, with n / n_relief / n_timely
    population: DataFrame | None = None    # (state, population)
    series: DataFrame | None = None        # (date, delinquency_rate), one row per quarter


def _base(inp: ReportInputs, cfg: ReportConfig, floor: str, whitelist: bool = True,
          until: str | None = None) -> DataFrame:
    """The shared filter: received since ``floor`` (and inside the whitelist).

    On the year-partitioned case table the implied ``received_year >= year``
    is added as well, so whole year folders are pruned at planning time.
    """
    cond = since("date_received", floor)
    if CASE_PARTITION in inp.cases.columns:
        cond = (F.col(CASE_PARTITION) >= F.year(F.lit(floor).cast("date"))) & cond
    if whitelist:
        cond = cond & in_regions("state", cfg.regions)
    if until:
        cond = cond & before("date_received", until)
    if cfg.exclude_products:
        cond = cond & (F.col("product").isNull() | ~F.col("product").isin(list(cfg.exclude_products)))
    return inp.cases.filter(cond)


# Profile ------------------------------------------------------------------

def profile_range(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Earliest and latest received date and the number of cases."""
    return inp.cases.agg(F.min("date_received").alias("earliest"),
                         F.max("date_received").alias("latest"),
                         F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total_complaints"))


def profile_top_products(inp: ReportInputs, cfg: ReportConfig = DEFAULT, k: int = 10) -> DataFrame:
    """The k products with the most cases."""
    return (M.period_counts(inp.cases, ["product"], {"count": "n"})
            .orderBy(desc_nl("count"), asc_nl("product")).limit(k))


def profile_distinct_states(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Number of distinct non-NULL states."""
    return inp.cases.agg(F.countDistinct("state").alias("distinct_states"))


def profile_null_states(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Number of cases without a state."""
    return (inp.cases.filter(F.col("state").isNull())
            .agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("null_states")))


def profile_responses(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Cases per company response, most first. Needs case rows (the daily
    table does not keep the response)."""
    return (M.period_counts(inp.cases, ["company_response"], {"count": "n"})
            .orderBy(desc_nl("count"), asc_nl("company_response")))


# Q1-Q3 ------------------------------------------------------------------------

def q1_state_share(inp: ReportInputs, cfg: ReportConfig = DEFAULT, k: int = 15) -> DataFrame:
    """Cases per whitelisted state since the baseline floor, with % of the total; top k."""
    counts = M.period_counts(_base(inp, cfg, cfg.baseline_since), ["state"],
                             {"total_complaints": "n"})
    return (M.share_of_total(counts, "total_complaints", "pct_of_total", 2)
            .orderBy(desc_nl("total_complaints"), asc_nl("state")).limit(k))


def q2_monthly(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Per state and month: cases, previous month's cases and % growth (base >= min_base)."""
    counts = M.period_counts(_base(inp, cfg, cfg.recent_since),
                             ["state", month_of("date_received").alias("month")],
                             {"complaint_count": "n"})
    if cfg.calendar_months:
        counts = M.with_calendar(counts, "month", ["state"], {"complaint_count": 0})
    return M.growth_vs_lag(counts, "month", "complaint_count", partition=["state"],
                           prev_out="prev_month_count", pct_out="mom_growth_pct", scale=2,
                           min_base=cfg.min_base)


def q2_mom_growth(inp: ReportInputs, cfg: ReportConfig = DEFAULT, k: int = 20) -> DataFrame:
    """The k state-months with the highest month-over-month growth."""
    return (q2_monthly(inp, cfg)
            .orderBy(desc_nl("mom_growth_pct"), asc_nl("state"), asc_nl("month")).limit(k))


def _state_counts_since_baseline(inp: ReportInputs, cfg: ReportConfig) -> DataFrame:
    # No whitelist and no NULL test here: the join with the dimension filters.
    return M.period_counts(_base(inp, cfg, cfg.baseline_since, whitelist=False),
                           ["state"], {"complaints": "n"})


def q3_rates(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Cases per 100k residents per state (states without population drop out)."""
    counts = _state_counts_since_baseline(inp, cfg)
    return (M.rate_per(counts, inp.population, "state", "complaints", "population",
                       per=100000.0, out="complaints_per_100k", scale=1)
            .select("state", "complaints", "population", "complaints_per_100k"))


def q3_rate_per_100k(inp: ReportInputs, cfg: ReportConfig = DEFAULT, k: int = 15) -> DataFrame:
    """The k states with the most cases per 100k residents."""
    return q3_rates(inp, cfg).orderBy(desc_nl("complaints_per_100k"), asc_nl("state")).limit(k)


def q3_unmatched_keys(inp: ReportInputs, cfg: ReportConfig = DEFAULT,
                      whitelist: bool = True) -> DataFrame:
    """States with cases since the baseline floor but no population row.

    ``whitelist=True``: whitelisted states only (the dimension's gaps, e.g. MO
    and WI). ``whitelist=False``: every non-NULL state Q3's inner join drops,
    territories included (Q3 itself has no whitelist).
    """
    keys = _base(inp, cfg, cfg.baseline_since, whitelist=whitelist).select("state")
    if not whitelist:
        keys = keys.filter(F.col("state").isNotNull())
    return unmatched_keys(keys, inp.population, "state")


# Q4-Q7 ------------------------------------------------------------------------

def q4_product_resolution(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Per product: cases, % of total, relief count, relief and timely rates."""
    # All rows since the floor: no state filter in this report.
    counts = M.period_counts(_base(inp, cfg, cfg.recent_since, whitelist=False), ["product"],
                             {"total_complaints": "n", "resolved_with_relief": "n_relief",
                              "__timely": "n_timely"})
    out = M.share_of_total(counts, "total_complaints", "pct_of_total", 2)
    return (out.select("product", "total_complaints", "pct_of_total", "resolved_with_relief",
                       pct("resolved_with_relief", "total_complaints", 1).alias("relief_rate_pct"),
                       pct("__timely", "total_complaints", 1).alias("timely_response_pct"))
            .orderBy(desc_nl("total_complaints"), asc_nl("product")))


def q5_rows(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Top products per state by cases (ties broken by product name)."""
    counts = M.period_counts(_base(inp, cfg, cfg.recent_since), ["state", "product"],
                             {"complaints": "n"})
    return M.top_n_per_group(counts, ["state"], [desc_nl("complaints"), asc_nl("product")],
                             cfg.top_n, rank_out="rank_in_state")


def q5_top5_per_state(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Top products per state, ordered by state and rank."""
    return q5_rows(inp, cfg).orderBy(asc_nl("state"), asc_nl("rank_in_state"))


def q5_sample_states(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """The top-products report for the configured sample states."""
    return (q5_rows(inp, cfg).filter(F.col("state").isin(list(cfg.sample_states)))
            .orderBy(asc_nl("state"), asc_nl("rank_in_state")))


def q6_rows(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Cases per quarter, their rolling 4-quarter mean and the quarter's series value."""
    counts = M.period_counts(_base(inp, cfg, cfg.history_since),
                             [quarter_of("date_received").alias("quarter")], {"complaints": "n"})
    # Rolling mean first, over all quarters; the series join drops quarters after.
    rolled = M.rolling(counts, "quarter", "complaints", cfg.rolling_quarters, fn="avg",
                       out="__avg")
    rolled = rolled.withColumn("rolling_avg", round_half_away("__avg", 0)).drop("__avg")
    return (M.attach_series(rolled, "quarter", inp.series, how="inner")
            .select("quarter", "complaints", "rolling_avg", "delinquency_rate"))


def q6_quarter_rolling(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Quarterly cases with rolling mean and series value, by quarter."""
    return q6_rows(inp, cfg).orderBy(asc_nl("quarter"))


def q6_last12(inp: ReportInputs, cfg: ReportConfig = DEFAULT, k: int = 12) -> DataFrame:
    """The last 12 quarters of the quarterly report."""
    return q6_rows(inp, cfg).orderBy(desc_nl("quarter")).limit(k).orderBy(asc_nl("quarter"))


def q7_national_trend(inp: ReportInputs, cfg: ReportConfig = DEFAULT, k: int = 24) -> DataFrame:
    """National cases per month with month-over-month and year-over-year %; latest k months."""
    counts = M.period_counts(_base(inp, cfg, cfg.recent_since),
                             [month_of("date_received").alias("month")], {"complaints": "n"})
    # One row per month: the unpartitioned lag runs on a calendar-bounded frame.
    out = M.growth_vs_lag(counts, "month", "complaints", lag=1, prev_out="prev_month",
                          pct_out="mom_pct", scale=1)
    out = M.growth_vs_lag(out, "month", "complaints", lag=12, prev_out="same_month_last_year",
                          pct_out="yoy_pct", scale=1)
    return (out.select("month", "complaints", "prev_month", "same_month_last_year",
                       "mom_pct", "yoy_pct")
            .orderBy(desc_nl("month")).limit(k))


# Q8-Q10 -----------------------------------------------------------------------

def q8_rows(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Cases per state, national mean, z-score and risk band of the rounded z."""
    counts = M.period_counts(_base(inp, cfg, cfg.baseline_since), ["state"], {"complaints": "n"})
    return (M.zscore(counts, "complaints", z_out="z_score", scale=2,
                     mean_out="national_mean", mean_scale=0, band_out="risk_level",
                     band_on="rounded", cuts=S.RISK_CUTS, labels=S.RISK_LABELS,
                     default=S.RISK_DEFAULT)
            .select("state", "complaints", "national_mean", "z_score", "risk_level"))


def q8_zscore_band(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """The z-score report ordered by z."""
    return q8_rows(inp, cfg).orderBy(desc_nl("z_score"), asc_nl("state"))


def q8b_band_counts(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Number of states per risk band."""
    return (q8_rows(inp, cfg).filter(F.col("risk_level").isNotNull())
            .groupBy("risk_level").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(desc_nl("count"), asc_nl("risk_level")))


def q8c_per_capita_z(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Z-score and risk band of the cases per 100k residents instead of the count."""
    return (M.zscore(q3_rates(inp, cfg), "complaints_per_100k", z_out="z_score", scale=2,
                     band_out="risk_level", band_on="rounded", cuts=S.RISK_CUTS,
                     labels=S.RISK_LABELS, default=S.RISK_DEFAULT)
            .select("state", "complaints_per_100k", "z_score", "risk_level")
            .orderBy(desc_nl("z_score"), asc_nl("state")))


def q9_range_90(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """The running total over 90 calendar days instead of 90 rows."""
    counts = M.period_counts(_base(inp, cfg, cfg.current_since),
                             ["state", F.col("date_received").alias("complaint_date")],
                             {"daily_count": "n"})
    return (M.rolling_days(counts, "complaint_date", "daily_count", cfg.rolling_day_rows,
                           partition=["state"], out="rolling_90d_total")
            .orderBy(asc_nl("state"), desc_nl("complaint_date")))


def q9_rows(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Cases per state and day with the running total over the last 90 rows."""
    counts = M.period_counts(_base(inp, cfg, cfg.current_since),
                             ["state", F.col("date_received").alias("complaint_date")],
                             {"daily_count": "n"})
    # Partitioned by state; each partition holds at most one row per calendar day.
    return M.rolling(counts, "complaint_date", "daily_count", cfg.rolling_day_rows, fn="sum",
                     partition=["state"], out="rolling_90d_total")


def q9_rolling_90(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """The 90-row running totals, by state and newest day first."""
    return q9_rows(inp, cfg).orderBy(asc_nl("state"), desc_nl("complaint_date"))


def q9b_latest_top15(inp: ReportInputs, cfg: ReportConfig = DEFAULT, k: int = 15) -> DataFrame:
    """Each state's latest running total; the k highest."""
    latest = M.latest_per_group(q9_rows(inp, cfg), ["state"], "complaint_date")
    return (latest.select("state", "rolling_90d_total")
            .orderBy(desc_nl("rolling_90d_total"), asc_nl("state")).limit(k))


def q10_rows(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Latest month's cases per state, growth against 3 months back, trend class."""
    counts = M.period_counts(_base(inp, cfg, cfg.current_since, until=cfg.trend_until),
                             ["state", month_of("date_received").alias("month")],
                             {"complaints": "n"})
    if cfg.calendar_months:
        counts = M.with_calendar(counts, "month", ["state"], {"complaints": 0})
    lagged = M.trend_class(counts, "month", "complaints", partition=["state"],
                           labels=(S.TREND_ACCELERATING, S.TREND_DECELERATING, S.TREND_MIXED),
                           growth_out="growth_vs_3mo_ago_pct", trend_out="trend", scale=1)
    latest = M.at_latest_period(lagged, "month", F.col("m3").isNotNull())
    return latest.select("state", "month", "complaints", "growth_vs_3mo_ago_pct", "trend")


def q10_trend_class(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """The trend report ordered by growth."""
    return q10_rows(inp, cfg).orderBy(desc_nl("growth_vs_3mo_ago_pct"), asc_nl("state"))


def q10_top20(inp: ReportInputs, cfg: ReportConfig = DEFAULT, k: int = 20) -> DataFrame:
    """The k states with the highest 3-month growth."""
    return q10_trend_class(inp, cfg).limit(k)


def q10b_accelerating(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """States classed 'Accelerating' with their growth."""
    acc = q10_rows(inp, cfg).filter(F.col("trend") == F.lit(S.TREND_ACCELERATING))
    return (acc.select("state", "growth_vs_3mo_ago_pct")
            .orderBy(desc_nl("growth_vs_3mo_ago_pct"), asc_nl("state")))


def q10c_trend_counts(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Number of states per trend class, zero included (the published count of
    accelerating states is printed even when no state is left)."""
    labels = (S.TREND_ACCELERATING, S.TREND_DECELERATING, S.TREND_MIXED)
    per_class = F.array(*[F.struct(F.lit(x).alias("trend"),
                                   F.count_if(F.col("trend") == F.lit(x)).alias("states"))
                          for x in labels])
    return q10_rows(inp, cfg).agg(per_class.alias("c")).selectExpr("inline(c)").orderBy("trend")


# Exports E1, E2, K1-K4 -------------------------------------------------------

def e1_month_with_rate(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Cases per month with the month's quarterly series value (NULL if none)."""
    counts = M.period_counts(_base(inp, cfg, cfg.history_since),
                             [month_of("date_received").alias("period")], {"complaints": "n"})
    # Left join: months of quarters without a rate keep a NULL rate.
    return (M.attach_series(counts, "period", inp.series, how="left")
            .orderBy(asc_nl("period"))
            .select(F.date_format("period", "yyyy-MM-dd").alias("period"),
                    "complaints", "delinquency_rate"))


def k1_state_risk_summary(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Per state: cases, % of total, z-score and risk band of the raw z."""
    counts = M.period_counts(_base(inp, cfg, cfg.baseline_since), ["state"],
                             {"total_complaints": "n"})
    shared = M.share_of_total(counts, "total_complaints", "pct_of_total", 2)
    return (M.zscore(shared, "total_complaints", z_out="z_score", scale=2,
                     band_out="risk_level", band_on="raw", cuts=S.RISK_CUTS,
                     labels=S.RISK_LABELS, default=S.RISK_DEFAULT)
            .orderBy(desc_nl("z_score"), asc_nl("state")))


def k2_state_month(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Cases per state and month."""
    return (M.period_counts(_base(inp, cfg, cfg.monthly_since),
                            ["state", month_of("date_received").alias("month")],
                            {"complaints": "n"})
            .orderBy(asc_nl("state"), asc_nl("month")))


def k3_rows(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Per product and state: cases and relief rate."""
    counts = M.period_counts(_base(inp, cfg, cfg.recent_since), ["product", "state"],
                             {"complaints": "n", "__relief": "n_relief"})
    return counts.select("product", "state", "complaints",
                         pct("__relief", "complaints", 1).alias("relief_rate"))


def k3_product_state_relief(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """The product x state report, most cases first."""
    return k3_rows(inp, cfg).orderBy(desc_nl("complaints"), asc_nl("product"), asc_nl("state"))


def k4_quarter_rate(inp: ReportInputs, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Cases per quarter with the quarter's series value (quarters with a value)."""
    counts = M.period_counts(_base(inp, cfg, cfg.history_since),
                             [quarter_of("date_received").alias("quarter")], {"complaints": "n"})
    return (M.attach_series(counts, "quarter", inp.series, how="inner")
            .select("quarter", "complaints", "delinquency_rate").orderBy(asc_nl("quarter")))


def e2_merge_categories(product_state: DataFrame, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Merge product names in a product x state export (K3 shape), re-aggregate.

    Complaints add up; the merged relief rate is the *unweighted* mean of the
    already rounded rates, as in the published cleaning step.
    """
    return (M.unify_categories(product_state, "product", cfg.merge_map,
                               ["product", "state"],
                               {"complaints": "sum", "relief_rate": "mean"})
            .orderBy(asc_nl("product"), asc_nl("state")))


def e2_product_ranking(merged: DataFrame, k: int = 10) -> DataFrame:
    """Total cases per merged product; the k largest."""
    return (merged.groupBy("product").agg(F.sum("complaints").alias("complaints"))
            .orderBy(desc_nl("complaints"), asc_nl("product")).limit(k))


# Variants of published reports, off by default.
OPTIONAL_REPORTS = {
    "q8c_per_capita_z": q8c_per_capita_z,
    "q9_range_90": q9_range_90,
}

REPORTS = {
    "profile_range": profile_range,
    "profile_top_products": profile_top_products,
    "profile_distinct_states": profile_distinct_states,
    "profile_null_states": profile_null_states,
    "profile_responses": profile_responses,
    "q1_state_share": q1_state_share,
    "q2_mom_growth": q2_mom_growth,
    "q3_rate_per_100k": q3_rate_per_100k,
    "q3_unmatched_keys": q3_unmatched_keys,
    "q4_product_resolution": q4_product_resolution,
    "q5_top5_per_state": q5_top5_per_state,
    "q5_sample_states": q5_sample_states,
    "q6_quarter_rolling": q6_quarter_rolling,
    "q6_last12": q6_last12,
    "q7_national_trend": q7_national_trend,
    "q8_zscore_band": q8_zscore_band,
    "q8b_band_counts": q8b_band_counts,
    "q9_rolling_90": q9_rolling_90,
    "q9b_latest_top15": q9b_latest_top15,
    "q10_trend_class": q10_trend_class,
    "q10_top20": q10_top20,
    "q10b_accelerating": q10b_accelerating,
    "q10c_trend_counts": q10c_trend_counts,
    "e1_month_with_rate": e1_month_with_rate,
    "k1_state_risk_summary": k1_state_risk_summary,
    "k2_state_month": k2_state_month,
    "k3_product_state_relief": k3_product_state_relief,
    "k4_quarter_rate": k4_quarter_rate,
}
