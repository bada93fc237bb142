"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid import schema as S
from casegrid.config import ReportConfig
from casegrid.operators import metrics as M
from casegrid.operators.profile import exact_tops, profile, profile_approx
from casegrid.plans import reports as R
from casegrid.plans.catalog import (create_if_absent, read_case_table, replace_table,
                                    write_case_table, write_wide_table)
from casegrid.plans.daily import (DAILY_KEYS, MEASURES, daily_table, read_daily,
                                  with_unit_measures, write_daily)
from casegrid.plans.sinks import (csv_writer, overwrite_in_place, read_report_csv,
                                  with_source_headers, write_report_csv)
from casegrid.session import scratch_path
from casegrid.sources import complaints_csv as C
from casegrid.sources import testdata as TD
from casegrid.sources.dims import register
from casegrid.sources.series import load_series, series_range, write_series_csv

Query = Callable[[SparkSession, str], DataFrame]


def mapped_inputs(spark: SparkSession, sf_dir: str, daily: bool = False) -> R.ReportInputs:
    """Report inputs mapped from the test tables (FIXTURES.md section 2)."""
    cases = TD.case_counts(spark, sf_dir)
    if daily:
        path = scratch_path(spark, "daily")
        write_daily(daily_table(cases), path)
        cases = read_daily(spark, path)
    return R.ReportInputs(cases=cases, population=TD.population(spark, sf_dir),
                          series=TD.delinquency(spark, sf_dir))


def _report(fn, cfg: ReportConfig = TD.TESTDATA_CONFIG, daily: bool = False) -> Query:
    return lambda spark, sf_dir: fn(mapped_inputs(spark, sf_dir, daily), cfg)


def _e2_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = TD.TESTDATA_CONFIG
    return R.e2_merge_categories(R.k3_rows(mapped_inputs(spark, sf_dir), cfg), cfg)


def _e2_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.e2_product_ranking(_e2_merge(spark, sf_dir))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_table(TD.case_counts(spark, sf_dir))


def _sparse_inputs(spark: SparkSession, sf_dir: str) -> R.ReportInputs:
    """Cases of state and product as one key: many of these have months without a case."""
    cases = TD.case_counts(spark, sf_dir).withColumn("state", F.concat_ws("/", "state", "product", "company_response"))
    return R.ReportInputs(cases=cases)


def _profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P0 in one: counts, range, distinct and top values of every case column from one scan."""
    return profile(TD.case_fact(spark, sf_dir), k=10)


def _profile_heavy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top values by a frequent-items sketch, its candidates counted exactly by a second scan."""
    cases = TD.case_fact(spark, sf_dir)
    return exact_tops(cases, profile_approx(cases, TD.HEAVY_COLUMNS, k=40), k=10).drop("proven")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _share_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of all line items per part: a total over unbounded keys."""
    counts = _lineitem(spark, sf_dir).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("lines"))
    return M.share_of_total(counts, "lines", scale=4, bounded=False)


def _zscore_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-score and band of each customer's number of orders, over unbounded keys."""
    counts = _orders(spark, sf_dir).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    return M.zscore(counts, "orders", mean_out="mean_orders", mean_scale=2, band_out="risk_level", cuts=S.RISK_CUTS,
                    labels=S.RISK_LABELS, default=S.RISK_DEFAULT, bounded=False)


def _orders_at_latest_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders of the latest day that has one."""
    rows = _orders(spark, sf_dir).select("o_orderkey", F.col("o_orderdate").cast("date").alias("order_day"), "o_orderstatus")
    return M.at_latest_period(rows, "order_day", F.col("o_orderstatus") == "F", bounded=False)


def _orders_lag_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's price against the order before it, over one order of all rows."""
    rows = _orders(spark, sf_dir).select("o_orderkey", "o_totalprice")
    return M.growth_vs_lag(rows, "o_orderkey", "o_totalprice", prev_out="prev_price", bounded=False)


def _lineitem_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum over the last 90 lines per line status (two hot partitions)."""
    rows = _lineitem(spark, sf_dir).select("l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return M.rolling(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "l_partkey", 90, partition=["l_linestatus"], out="rolling_90", bounded=False)


def _latest_order_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest order (smallest key of a day), by an aggregate."""
    rows = _orders(spark, sf_dir).select("o_custkey", F.col("o_orderdate").cast("date").alias("order_day"), "o_orderkey", "o_orderstatus")
    return M.latest_per_group(rows, ["o_custkey"], "order_day", ["o_orderkey"])


def report_queries() -> dict[str, Query]:
    q: dict[str, Query] = {name: _report(fn) for name, fn in R.REPORTS.items()}
    q |= {name: _report(fn) for name, fn in R.OPTIONAL_REPORTS.items()}
    q["q4_excluding_products"] = _report(
        R.q4_product_resolution, TD.TESTDATA_CONFIG.with_(exclude_products=TD.EXCLUDED_PRODUCTS))
    calendar = TD.TESTDATA_CONFIG.with_(calendar_months=True, regions=TD.SPARSE_REGIONS, min_base=1)
    q["q2_calendar_growth"] = lambda spark, sf_dir: R.q2_monthly(_sparse_inputs(spark, sf_dir), calendar)
    q["q10_calendar_trend"] = lambda spark, sf_dir: R.q10_trend_class(_sparse_inputs(spark, sf_dir), calendar)
    q["profile_columns"] = _profile_columns
    q["profile_heavy_values"] = _profile_heavy_values
    q["share_by_part"] = _share_by_part
    q["zscore_by_customer"] = _zscore_by_customer
    q["orders_at_latest_day"] = _orders_at_latest_day
    q["orders_lag_growth"] = _orders_lag_growth
    q["lineitem_rolling"] = _lineitem_rolling
    q["latest_order_per_customer"] = _latest_order_per_customer
    q["e2_merge_categories"] = _e2_merge
    q["e2_product_ranking"] = _e2_ranking
    q["daily_table"] = _daily
    q["q1_from_daily"] = _report(R.q1_state_share, daily=True)
    q["q7_from_daily"] = _report(R.q7_national_trend, daily=True)
    q["k3_from_daily"] = _report(R.k3_product_state_relief, daily=True)
    return q


# Ingest, catalog and sink paths. Each writes into a fresh folder under the
# shared scratch folder (``spark.checkpoint.dir``) and reads the result back.

def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases -> extract-layout CSV (S14) -> tolerant typed read (S1/S13) -> counts."""
    base = scratch_path(spark, "csv-roundtrip")
    csv_writer(C.to_source_layout(TD.case_fact(spark, sf_dir))).csv(f"{base}/csv")
    good, _bad = C.read_complaints(spark, f"{base}/csv", f"{base}/landed")
    return good.groupBy(*S.CASE_SCHEMA.fieldNames()).agg(F.count(F.lit(1)).alias("n"))


def _landed_series(spark: SparkSession, sf_dir: str) -> str:
    """Land the quarterly series as a CSV file, with an empty rate for each quarter that
    has shipments but no orders (the NULL rows the loader must drop)."""
    path = scratch_path(spark, "series")
    rates = TD.delinquency(spark, sf_dir)
    shipped = (TD.case_fact(spark, sf_dir).select(F.trunc("date_received", "quarter").alias("date")).distinct())
    write_series_csv(rates.join(shipped, "date", "full")
                     .select("date", F.col("delinquency_rate").alias("value")), path)
    return path


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_series(spark, _landed_series(spark, sf_dir))


def _series_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_range(_series(spark, sf_dir))


def _table_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population table created, then replaced (S3); read from the catalog."""
    path = scratch_path(spark, "population")
    name = "population_" + path.rsplit("-", 1)[-1]
    pop = TD.population(spark, sf_dir)
    create_if_absent(pop, name, path)
    if create_if_absent(pop, name, path):   # IF NOT EXISTS: must be a no-op
        raise RuntimeError(f"table {name} was created twice")
    return replace_table(pop, name, path + "-v2")


def _view_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame queried under its name (S5): states of at least the mean population."""
    name = "population_view_" + scratch_path(spark, "v").rsplit("-", 1)[-1]
    register(TD.population(spark, sf_dir), name)
    return spark.sql(f"SELECT state, population FROM {name} "
                     f"WHERE population >= (SELECT AVG(population) FROM {name})")


def _landed_extract(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) rows of an extract with unqueried columns, quoted newlines and
    unparsable dates, read back through the ingest."""
    base = scratch_path(spark, "extract")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.col("l_shipdate").cast("date")
    rows = li.select(
        F.when(F.day(day) == TD.BAD_DATE_DAY, F.lit("not a date")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("Date received"),
        F.concat(F.lit('note\n"'), "l_linestatus", F.lit('"')).alias("Note"),
        F.lit("P").alias("Product"), F.lit("S").alias("State"), F.lit("none").alias("Company response to consumer"),
        F.when(F.col("l_linestatus") == TD.TIMELY_STATUS, F.lit("Yes")).otherwise(F.lit("No")).alias("Timely response?"),
        F.col("l_returnflag").alias("Batch code"), F.col("l_orderkey").alias("Complaint ID"))
    csv_writer(rows).csv(f"{base}/csv")
    return C.read_complaints(spark, f"{base}/csv", f"{base}/landed")


def _ingest_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the written case table and its quarantine."""
    good, bad = _landed_extract(spark, sf_dir)
    base = scratch_path(spark, "counted")
    write_wide_table(good, f"{base}/cases")
    bad.write.parquet(f"{base}/quarantine")
    count = lambda name: (spark.read.parquet(f"{base}/{name}")
                          .agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count"))
    return count("cases").union(count("quarantine"))


def _ingest_all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that no report reads survive the ingest whole."""
    good, _bad = _landed_extract(spark, sf_dir)
    return good.groupBy("batch_code").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("complaint_id").cast("long")).alias("order_sum"),
        F.count_if("timely_response").alias("n_timely"), F.countDistinct("note").alias("notes"))


def _typed_extract(spark: SparkSession, sf_dir: str, infer: bool) -> DataFrame:
    """Landed (or, with ``infer``, typed) rows of an extract whose columns are of every type, with empty
    values, a mixed column and one without values."""
    base = scratch_path(spark, "typed-extract")
    day = F.col("l_shipdate").cast("date")
    rows = _lineitem(spark, sf_dir).select(
        F.date_format(day, "yyyy-MM-dd").alias("Date received"), F.lit("P").alias("Product"), F.lit("S").alias("State"),
        F.col("l_orderkey").alias("Order"), F.col("l_quantity").alias("Quantity"),
        F.when(F.col("l_linestatus") == TD.TIMELY_STATUS, F.lit("yes")).otherwise(F.lit("No")).alias("Shipped"),
        F.when(F.col("l_linenumber") != 1, day).alias("Ship day"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("Ship time"),
        F.when(F.col("l_linenumber") == 2, F.lit("n/a")).otherwise(F.col("l_partkey").cast("string")).alias("Mixed"),
        F.when(F.col("l_linenumber") == 2, F.lit("0.5")).otherwise(F.col("l_partkey").cast("string")).alias("Number"),
        F.lit(None).cast("string").alias("Nothing"), F.col("l_returnflag").alias("Code"))
    csv_writer(rows).csv(f"{base}/csv")
    if infer:
        return C.read_complaints(spark, f"{base}/csv", f"{base}/landed", infer=True)[0]
    C.land(C.read_raw(spark, f"{base}/csv"), f"{base}/landed")
    return spark.read.parquet(f"{base}/landed")


def _ingest_inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest type of every column of an extract."""
    return C.landed_types(_typed_extract(spark, sf_dir, infer=False))


def _ingest_typed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates over columns that got their types from the inference."""
    rows = _typed_extract(spark, sf_dir, infer=True)
    return rows.groupBy("code", "shipped").agg(
        F.sum("order").alias("order_sum"), F.sum("quantity").alias("quantity_sum"), F.max("ship_day").alias("last_day"),
        F.count_if(F.hour("ship_time") == 0).alias("at_midnight"), F.count("ship_day").alias("days"), F.min("mixed").alias("least_mixed"))


def _csv_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export K3 as CSV, read it back, merge categories, overwrite the same file."""
    cfg = TD.TESTDATA_CONFIG
    path = scratch_path(spark, "k3-export")
    write_report_csv(R.k3_product_state_relief(mapped_inputs(spark, sf_dir), cfg), path)
    merged = R.e2_merge_categories(read_report_csv(spark, path, S.PRODUCT_STATE_SCHEMA), cfg)
    overwrite_in_place(merged, path)
    return read_report_csv(spark, path, S.PRODUCT_STATE_SCHEMA)


def _export_source_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 exported under the extract's header names and read back by them."""
    cfg = TD.TESTDATA_CONFIG
    path = scratch_path(spark, "k3-source-headers")
    out = with_source_headers(R.k3_product_state_relief(mapped_inputs(spark, sf_dir), cfg))
    write_report_csv(out, path)
    return read_report_csv(spark, path, out.schema)


def _case_table_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1 over the written, year-partitioned case table (partition pruning path)."""
    path = scratch_path(spark, "cases")
    write_case_table(TD.case_fact(spark, sf_dir), path)
    cases = with_unit_measures(read_case_table(spark, path))
    return R.q1_state_share(R.ReportInputs(cases=cases), TD.TESTDATA_CONFIG)


def _stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land extract files, ingest them with the streaming job in several
    micro-batches, and return the daily table re-summed per key."""
    from casegrid.streaming.ingest import start_ingest

    base = scratch_path(spark, "stream")
    csv_writer(C.to_source_layout(TD.case_fact(spark, sf_dir))).csv(f"{base}/landing")
    columns = C.header_columns(spark, f"{base}/landing")
    q = start_ingest(spark, f"{base}/landing", columns, cases_path=f"{base}/cases",
                     daily_path=f"{base}/daily", quarantine_path=f"{base}/bad",
                     checkpoint_path=f"{base}/_checkpoint",
                     relief_response=TD.TESTDATA_CONFIG.relief_response,
                     max_files_per_trigger=2)
    q.awaitTermination()
    daily = spark.read.parquet(f"{base}/daily")
    return daily.groupBy(*DAILY_KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])


def ingest_queries() -> dict[str, Query]:
    return {
        "ingest_csv_roundtrip": _csv_roundtrip,
        "ingest_series": _series,
        "ingest_series_range": _series_range,
        "ingest_row_counts": _ingest_row_counts,
        "ingest_all_columns": _ingest_all_columns,
        "ingest_inferred_types": _ingest_inferred_types,
        "ingest_typed_columns": _ingest_typed_columns,
        "table_replace": _table_replace,
        "view_by_name": _view_by_name,
        "csv_overwrite_in_place": _csv_overwrite,
        "export_source_headers": _export_source_headers,
        "q1_from_case_table": _case_table_q1,
        "stream_ingest_daily": _stream_daily,
    }
