"""The whole workflow end to end on the mapped sf0.001 tables."""

import os

import __spark_entry__ as E
from casegrid.plans import suite
from casegrid.plans.sinks import csv_writer
from casegrid.plans.registry import _landed_series
from casegrid.sources import complaints_csv as C
from casegrid.sources import testdata as TD

SF = "/root/testdata/sf0.001"


def test_suite_exports_match_registered_queries(spark, tmpdir_path):
    csv = os.path.join(tmpdir_path, "extract")
    csv_writer(C.to_source_layout(TD.case_fact(spark, SF))).csv(csv)
    series = _landed_series(spark, SF)
    counts = suite.run(spark, csv, series, os.path.join(tmpdir_path, "work"),
                       os.path.join(tmpdir_path, "out"), cfg=TD.TESTDATA_CONFIG,
                       population=TD.population(spark, SF),
                       table="complaints_" + os.path.basename(tmpdir_path).replace("-", "_"))
    q = E.queries()
    names = [*suite.EXPORTED, "profile_responses", "e2_merge_categories"]
    for name in names:
        assert counts[name] == q[name](spark, SF).count(), name
    files = os.listdir(os.path.join(tmpdir_path, "out", "k1_state_risk_summary"))
    assert len([f for f in files if f.endswith(".csv")]) == 1


def test_second_run_in_one_session(spark, tmpdir_path):
    """The loaded table is used again, also with a new work folder and no extract."""
    csv, series = os.path.join(tmpdir_path, "extract"), _landed_series(spark, SF)
    csv_writer(C.to_source_layout(TD.case_fact(spark, SF))).csv(csv)
    table = "again_" + os.path.basename(tmpdir_path).replace("-", "_")

    def run(csv, work):
        return suite.run(spark, csv, series, os.path.join(tmpdir_path, work), os.path.join(tmpdir_path, "out"),
                         cfg=TD.TESTDATA_CONFIG, population=TD.population(spark, SF), table=table)

    assert run(csv, "work1") == run(os.path.join(tmpdir_path, "gone"), "work2")
