"""Scaled run: the mapped case table replicated N times (default 30, about
18M rows from sf0.1, the size of the published data set).

Replication keeps the set of (day, state, product) keys, so the daily table
keeps its size while the case table grows N times - the situation of real
data, where millions of cases fall on a few hundred thousand keys.

Times the daily-table build and Q2, Q5, Q9, K1 from case rows and from the
daily table. With ``--csv`` it also writes the replicated cases as an
extract-layout CSV (8 files, 5 columns) and times the tolerant CSV ingest
(land, type, split, write the year-partitioned table). Prints one JSON line.
Usage:
    python tools/scale_run.py [sf_dir] [copies] [--csv]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from casegrid import schema as S  # noqa: E402
from casegrid.plans import reports as R  # noqa: E402
from casegrid.plans.sinks import csv_writer  # noqa: E402
from casegrid.sources import complaints_csv as C  # noqa: E402
from casegrid.plans.catalog import read_case_table, write_case_table  # noqa: E402
from casegrid.plans.daily import (daily_table, read_daily, with_unit_measures,  # noqa: E402
                                  write_daily)
from casegrid.plans.registry import mapped_inputs  # noqa: E402
from casegrid.session import local_session, scratch_path  # noqa: E402
from casegrid.sources import testdata as TD  # noqa: E402

REPORTS = ("q2_mom_growth", "q5_top5_per_state", "q9_rolling_90", "k1_state_risk_summary")


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _timed(fn) -> float:
    t0 = time.perf_counter()
    fn()
    return round(time.perf_counter() - t0, 3)


def main() -> None:
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf_dir = args[0] if args else "/root/testdata/sf0.1"
    copies = int(args[1]) if len(args) > 1 else 30
    with_csv = "--csv" in sys.argv
    spark = local_session(8, shuffle_partitions=16, app="casegrid-scale",
                          extra={"spark.driver.memory": "16g"})
    cfg = TD.TESTDATA_CONFIG
    out: dict = {"sf_dir": sf_dir, "copies": copies}

    big_path = scratch_path(spark, f"cases-x{copies}")
    rep = TD.case_fact(spark, sf_dir).withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("__copy")
    out["write_case_table_sec"] = _timed(lambda: write_case_table(rep, big_path))
    cases = with_unit_measures(read_case_table(spark, big_path), cfg.relief_response)
    out["case_rows"] = cases.count()

    daily_path = scratch_path(spark, f"daily-x{copies}")
    out["build_daily_sec"] = _timed(
        lambda: write_daily(daily_table(cases), daily_path))
    daily = read_daily(spark, daily_path)
    out["daily_rows"] = daily.count()

    dims = mapped_inputs(spark, sf_dir)
    on_base = R.ReportInputs(cases=cases, population=dims.population, series=dims.series)
    on_daily = R.ReportInputs(cases=daily, population=dims.population, series=dims.series)
    for name in REPORTS:
        fn = R.REPORTS[name]
        _run(fn(on_base, cfg))   # warm
        out[f"{name}_base_sec"] = _timed(lambda: _run(fn(on_base, cfg)))
        out[f"{name}_daily_sec"] = _timed(lambda: _run(fn(on_daily, cfg)))
        # Replication multiplies every count by `copies`; shares, z-scores, growth
        # and ranks are unchanged. Check one report's counts against the original.
    k1_big = {r.state: r.total_complaints for r in
              R.k1_state_risk_summary(on_daily, cfg).collect()}
    k1_one = {r.state: r.total_complaints for r in
              R.k1_state_risk_summary(mapped_inputs(spark, sf_dir), cfg).collect()}
    out["k1_counts_scale_exactly"] = all(k1_big[s] == copies * k1_one[s] for s in k1_one)

    if with_csv:
        csv_path = scratch_path(spark, f"extract-x{copies}")
        csv_writer(C.to_source_layout(read_case_table(spark, big_path)
                                      .select(*S.CASE_SCHEMA.fieldNames())).repartition(8)).csv(csv_path)
        base = scratch_path(spark, f"ingest-x{copies}")

        def ingest():
            good, bad = C.read_complaints(spark, csv_path, f"{base}/landed")
            write_case_table(good, f"{base}/cases")
            bad.write.mode("overwrite").parquet(f"{base}/quarantine")
        out["csv_ingest_sec"] = _timed(ingest)
        out["csv_ingest_rows"] = read_case_table(spark, f"{base}/cases").count()
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
