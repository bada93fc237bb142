"""Plan census: for every report, count the operators that matter at scale in
its physical plan (over the daily table and over case rows).

Columns: hash/range shuffles, single-partition exchanges (run on aggregated,
bounded rows only), broadcast joins, sort-merge joins, window nodes,
partial top-n pre-limits, and whether the date filter reached the scan.
Prints a markdown table. Usage: python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from casegrid.plans import reports as R  # noqa: E402
from casegrid.plans.catalog import read_case_table, write_case_table  # noqa: E402
from casegrid.plans.daily import (daily_table, read_daily, with_unit_measures,  # noqa: E402
                                  write_daily)
from casegrid.plans.registry import mapped_inputs  # noqa: E402
from casegrid.session import local_session, scratch_path  # noqa: E402
from casegrid.sources import testdata as TD  # noqa: E402


def census(df) -> dict:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    plan = buf.getvalue()
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning)", plan)),
        "single": len(re.findall(r"Exchange SinglePartition", plan)),
        "bhj": plan.count("BroadcastHashJoin"),
        "smj": plan.count("SortMergeJoin"),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "group_limit": plan.count("WindowGroupLimit"),
        "pushed_date": bool(re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(date_received",
                                      plan)),
        "pruned_years": "PartitionFilters: [isnotnull(received_year" in plan,
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, 16)
    cfg = TD.TESTDATA_CONFIG
    cases_path, daily_path = scratch_path(spark, "plan-cases"), scratch_path(spark, "plan-daily")
    write_case_table(TD.case_fact(spark, sf_dir), cases_path)
    cases = with_unit_measures(read_case_table(spark, cases_path), cfg.relief_response)
    write_daily(daily_table(cases), daily_path)
    dims = mapped_inputs(spark, sf_dir)
    kw = dict(population=dims.population, series=dims.series)
    on_daily = R.ReportInputs(cases=read_daily(spark, daily_path), **kw)
    on_cases = R.ReportInputs(cases=cases, **kw)
    print("| report | shuffles | single-partition | broadcast joins | windows | top-n pre-limit "
          "| date filter pushed (daily) | year folders pruned (case rows) |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in R.REPORTS.items():
        d = census(fn(on_daily, cfg)) if name != "profile_responses" else None
        c = census(fn(on_cases, cfg))
        src = d or c
        print(f"| {name} | {src['shuffles']} | {src['single']} | {src['bhj']} | {src['windows']} "
              f"| {src['group_limit']} | {'yes' if d and d['pushed_date'] else '-'} "
              f"| {'yes' if c['pruned_years'] else '-'} |")
    spark.stop()


if __name__ == "__main__":
    main()
