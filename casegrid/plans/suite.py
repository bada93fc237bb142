"""The whole published workflow as one Spark application.

load (CSV -> typed case table, if absent; series file -> table)
  -> daily summary table
  -> every report exported as CSV (header, no index)
  -> product categories merged in the product export, in place.

Reports read the daily table (one scan of the case table feeds all of them);
only the response profile reads case rows. Exports are submitted from a few
driver threads so their small jobs run side by side. Row counts come from
``Observation`` metrics collected while writing (no second pass).
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from casegrid import schema as S
from casegrid.config import DEFAULT, ReportConfig
from casegrid.operators.joins import assert_unique_key
from casegrid.plans import reports as R
from casegrid.plans.catalog import (delete_path, is_written, register_files, replace_table,
                                    write_wide_table)
from casegrid.plans.daily import daily_table, read_daily, with_unit_measures, write_daily
from casegrid.plans.sinks import csv_writer, overwrite_in_place, read_report_csv, with_source_headers
from casegrid.sources import complaints_csv as C
from casegrid.sources.dims import population_table
from casegrid.sources.series import load_series

# Exported reports: one CSV folder per report, named by its key.
EXPORTED = ("q1_state_share", "q2_mom_growth", "q3_rate_per_100k", "q4_product_resolution",
            "q5_top5_per_state", "q6_quarter_rolling", "q7_national_trend", "q8_zscore_band",
            "q9_rolling_90", "q10_trend_class", "e1_month_with_rate", "k1_state_risk_summary",
            "k2_state_month", "k3_product_state_relief", "k4_quarter_rate")
EXPORTS = {name: R.REPORTS[name] for name in EXPORTED}
# The product x state export whose categories are merged in place afterwards.
MERGED_EXPORT = "k3_product_state_relief"
BASE_ROW_EXPORTS = {"profile_responses": R.profile_responses}


def load_case_table(spark: SparkSession, csv_path: str, base_dir: str,
                    table: str = "complaints", date_format: str = "yyyy-MM-dd",
                    multiline: bool = True, infer: bool = False) -> DataFrame:
    """``CREATE TABLE IF NOT EXISTS complaints AS <tolerant CSV read>``.

    Lands the CSV once, writes good rows as the year-partitioned case table
    (all source columns kept) and rejected rows to ``<base_dir>/quarantine``, then
    deletes the landed copy. Skipped when the catalog has the table, or when an earlier
    run finished it under ``base_dir`` (a session with an in-memory catalog): then the
    written files are registered again.
    """
    if spark.catalog.tableExists(table):
        return spark.table(table)
    cases = f"{base_dir}/cases"
    if not is_written(spark, cases):
        landed = f"{base_dir}/landed"
        good, bad = C.read_complaints(spark, csv_path, landed, date_format, multiline, infer)
        bad.write.mode("overwrite").parquet(f"{base_dir}/quarantine")
        write_wide_table(good, cases)       # last: its success mark says that the load is whole
        delete_path(spark, landed)
    return register_files(spark, table, cases)


def build_daily(cases: DataFrame, path: str, cfg: ReportConfig = DEFAULT) -> DataFrame:
    """Write the daily summary table once and return it read back, cached.

    Its size is bounded by days x states x products and every export reads it;
    a lost cached block is re-read from the written table.
    """
    core = cases.select(*S.CASE_SCHEMA.fieldNames())
    write_daily(daily_table(with_unit_measures(core, cfg.relief_response)), path)
    return read_daily(cases.sparkSession, path).cache()


def _export(df: DataFrame, path: str, source_headers: bool = False) -> int:
    obs = Observation()
    df = with_source_headers(df) if source_headers else df
    csv_writer(df.observe(obs, F.count(F.lit(1)).alias("rows")).coalesce(1)).csv(path)
    return obs.get["rows"]


def export_reports(inputs: R.ReportInputs, base_rows: DataFrame, out_dir: str,
                   cfg: ReportConfig = DEFAULT, threads: int = 4) -> dict[str, int]:
    """Write every report as a single-file CSV under ``out_dir``; return row counts.

    Then merge the product categories of the product x state export in place
    (its count is reported as ``e2_merge_categories``).
    """
    base = R.ReportInputs(cases=base_rows, population=inputs.population, series=inputs.series)
    jobs = [(name, fn, inputs) for name, fn in EXPORTS.items()]
    jobs += [(name, fn, base) for name, fn in BASE_ROW_EXPORTS.items()]
    with ThreadPoolExecutor(threads) as pool:
        counts = dict(pool.map(
            lambda j: (j[0], _export(j[1](j[2], cfg), os.path.join(out_dir, j[0]),
                                     cfg.source_headers)), jobs))
    path = os.path.join(out_dir, MERGED_EXPORT)
    names = S.PRODUCT_STATE_SCHEMA.fieldNames()
    frame = base_rows.sparkSession.createDataFrame([], S.PRODUCT_STATE_SCHEMA)
    schema = with_source_headers(frame).schema if cfg.source_headers else S.PRODUCT_STATE_SCHEMA
    merged = R.e2_merge_categories(
        read_report_csv(base_rows.sparkSession, path, schema).toDF(*names), cfg)
    overwrite_in_place(with_source_headers(merged) if cfg.source_headers else merged, path)
    counts["e2_merge_categories"] = read_report_csv(base_rows.sparkSession, path, schema).count()
    return counts


def run(spark: SparkSession, csv_path: str, series_path: str, work_dir: str, out_dir: str,
        cfg: ReportConfig = DEFAULT, threads: int = 4, population: DataFrame | None = None,
        table: str = "complaints", multiline: bool = True, infer: bool = False) -> dict[str, int]:
    """Load, summarise and export everything (the seven published scripts).

    ``population``: the per-state dimension; default the fixed 49-row table.
    ``multiline``: False for extracts without quoted newlines (splittable read).
    ``infer``: give the columns that no report reads the types of their values.
    """
    cases = load_case_table(spark, csv_path, work_dir, table, multiline=multiline, infer=infer)
    # Series and population become (replaced) catalog tables, as in the load step.
    series = replace_table(load_series(spark, series_path), f"{table}_delinquency",
                           f"{work_dir}/delinquency")
    daily = build_daily(cases, f"{work_dir}/daily", cfg)
    if population is None:
        population = population_table(spark)
    else:
        assert_unique_key(population, "state")      # else Q3's join would repeat states
    population = replace_table(population, f"{table}_population", f"{work_dir}/population")
    inputs = R.ReportInputs(cases=daily, population=population, series=series)
    base_rows = with_unit_measures(cases.select(*S.CASE_SCHEMA.fieldNames()), cfg.relief_response)
    return export_reports(inputs, base_rows, out_dir, cfg, threads)
