"""Incremental ingest: files are picked up exactly once, re-runs add nothing."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from casegrid import schema as S
from casegrid.plans.daily import MEASURES
from casegrid.plans.sinks import csv_writer
from casegrid.sources import complaints_csv as C
from casegrid.streaming.ingest import BATCH_COLUMN, compact_daily, start_ingest


def _land(spark, rows, folder):
    df = spark.createDataFrame(rows, S.CASE_SCHEMA)
    csv_writer(C.to_source_layout(df).coalesce(1), mode="overwrite").csv(folder)


def _totals(spark, base):
    d = spark.read.parquet(f"{base}/daily")
    return d.agg(*[F.sum(m).alias(m) for m in MEASURES]).first(), \
        d.select(BATCH_COLUMN).distinct().count()


def test_incremental_ingest_exactly_once(spark, tmpdir_path):
    base = tmpdir_path
    landing = f"{base}/landing"
    day = dt.date(2023, 5, 1)
    first = [(day, "P", "TX", S.RELIEF_RESPONSE, True)] * 3 + [(day, "P", None, None, None)]
    _land(spark, first, f"{landing}/part1")
    columns = C.header_columns(spark, f"{landing}/part1")

    def run():
        q = start_ingest(spark, f"{landing}/*", columns, cases_path=f"{base}/cases",
                         daily_path=f"{base}/daily", quarantine_path=f"{base}/bad",
                         checkpoint_path=f"{base}/_ckpt")
        q.awaitTermination()

    run()
    t, batches = _totals(spark, base)
    assert (t.n, t.n_relief, t.n_timely, batches) == (4, 3, 3, 1)

    run()                                   # nothing new: no new batch, same totals
    t2, batches2 = _totals(spark, base)
    assert (t2.n, batches2) == (4, 1)

    _land(spark, [(day, "P", "TX", None, False)] * 2, f"{landing}/part2")
    run()                                   # only the new file is read
    t3, batches3 = _totals(spark, base)
    assert (t3.n, t3.n_relief, t3.n_timely, batches3) == (6, 3, 3, 2)
    cases = spark.read.parquet(f"{base}/cases")
    assert cases.count() == 6 and os.path.isdir(f"{base}/bad")

    # A new checkpoint would read every landed file again: refused on these outputs.
    with pytest.raises(ValueError, match="belongs to ingest run"):
        start_ingest(spark, f"{landing}/*", columns, cases_path=f"{base}/cases",
                     daily_path=f"{base}/daily", quarantine_path=f"{base}/bad",
                     checkpoint_path=f"{base}/_ckpt_new")
    assert _totals(spark, base)[0].n == 6

    compact = compact_daily(spark, f"{base}/daily", f"{base}/daily_compact")
    assert compact.count() == compact.select("date_received", "state", "product").distinct().count()
    assert compact.agg(F.sum("n")).first()[0] == 6


def test_a_batch_of_one_file_is_read_by_many_tasks(spark, tmpdir_path, monkeypatch):
    day = dt.date(2023, 5, 1)
    _land(spark, [(day, f"P{i % 7}", "TX", None, True) for i in range(2000)], f"{tmpdir_path}/landing")
    seen = []
    monkeypatch.setattr(C, "split", lambda rows, old=C.split: seen.append(rows.rdd.getNumPartitions()) or old(rows))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        start_ingest(spark, f"{tmpdir_path}/landing", cases_path=f"{tmpdir_path}/cases", daily_path=f"{tmpdir_path}/daily",
                     quarantine_path=f"{tmpdir_path}/bad", checkpoint_path=f"{tmpdir_path}/_ckpt").awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert len(seen) == 1 and seen[0] > 3
    assert _totals(spark, tmpdir_path)[0].n == 2000
