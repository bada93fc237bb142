"""Command line: ``python -m casegrid --csv complaints.csv --series series.csv
--work <shared dir> --out <export dir>``.

Runs the full workflow (``plans.suite.run``) in the current Spark
environment (``spark-submit`` or a local session) and prints row counts.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from casegrid.plans.suite import run
from casegrid.session import RECOMMENDED_CONF, size_shuffle_partitions


def main() -> None:
    ap = argparse.ArgumentParser(prog="casegrid")
    ap.add_argument("--csv", required=True, help="complaints extract (file or folder)")
    ap.add_argument("--series", required=True, help="quarterly series file (date,value)")
    ap.add_argument("--work", required=True, help="folder for tables (shared on a cluster)")
    ap.add_argument("--out", required=True, help="folder for CSV exports")
    ap.add_argument("--threads", type=int, default=4)
    ap.add_argument("--no-multiline", action="store_true",
                    help="the extract has no quoted newlines: read it as splittable CSV")
    ap.add_argument("--infer-types", action="store_true",
                    help="give the columns that no report reads the types of their values")
    a = ap.parse_args()
    spark = SparkSession.builder.appName("casegrid").getOrCreate()
    given = spark.sparkContext.getConf()
    for k, v in RECOMMENDED_CONF.items():
        if not given.contains(k):           # what the user passed stays
            spark.conf.set(k, v)
    size_shuffle_partitions(spark, a.csv)
    print(json.dumps(run(spark, a.csv, a.series, a.work, a.out, threads=a.threads,
                         multiline=not a.no_multiline, infer=a.infer_types), indent=1))


if __name__ == "__main__":
    main()
