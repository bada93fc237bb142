"""The command line runs the whole workflow in its own process."""

import glob
import json
import os
import shutil
import subprocess
import sys

from casegrid.plans.registry import _landed_series
from casegrid.plans.sinks import csv_writer
from casegrid.sources import complaints_csv as C
from casegrid.sources import testdata as TD

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_command_line_workflow(spark, tmpdir_path):
    extract = os.path.join(tmpdir_path, "extract")
    csv_writer(C.to_source_layout(TD.case_fact(spark, "/root/testdata/sf0.001"))).csv(extract)
    series = os.path.join(tmpdir_path, "series.csv")
    shutil.copy(glob.glob(_landed_series(spark, "/root/testdata/sf0.001") + "/*.csv")[0], series)
    work = os.path.join(tmpdir_path, "work")
    env = {**os.environ, "PYTHONPATH": REPO,
           "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    def cli(csv):
        out = subprocess.run(
            [sys.executable, "-m", "casegrid", "--csv", csv, "--series", series, "--work", work,
             "--out", os.path.join(tmpdir_path, "out"), "--no-multiline", "--threads", "2"],
            capture_output=True, text=True, timeout=600, env=env, cwd=tmpdir_path)
        assert out.returncode == 0, out.stderr[-2000:]
        return json.loads(out.stdout)

    counts = cli(extract)
    assert not os.path.exists(os.path.join(work, "landed"))
    # A new process on the same work folder reuses the load: the extract is not read again.
    assert cli(os.path.join(tmpdir_path, "gone.csv")) == counts
    # Default (published) floors and whitelist: the 1995-2001 test cases fall
    # outside, except the response profile, which has no filter.
    assert counts["profile_responses"] == 3
    assert set(counts) >= {"q1_state_share", "k3_product_state_relief", "e2_merge_categories"}
    assert os.path.isdir(os.path.join(tmpdir_path, "out", "k1_state_risk_summary"))
