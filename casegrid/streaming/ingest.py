"""Incremental ingest of landed extract files with Structured Streaming.

The published load is ``CREATE TABLE IF NOT EXISTS ... FROM csv``: it loads
once and never again. Here new extract files dropped into a folder are
picked up exactly once (the file source records processed files in its
checkpoint), read, typed and split as in the batch ingest, and written to

* the typed case table (partitioned by received year), and
* the daily summary table.

Writing per micro-batch leaves a key ``(day, state, product)`` in several
rows of the daily table when its cases arrive in different batches. That is
harmless by design: every report *sums* the measures, so duplicate keys add
up to the same totals; ``compact_daily`` rewrites them as one row per key.

Run with ``trigger(availableNow=True)`` for scheduled catch-up jobs, or with a
processing-time trigger for a continuously running stream.

Operating rules (they are the file source's contract):

* Land each extract file atomically: write it elsewhere, then move it into
  the landing folder. A file is listed once; one still being copied would be
  read partially, and a file rewritten under the same name is not read again.
* The checkpoint is the record of what was ingested, and holds the stream's run
  id. Each output folder names the run that owns it; another run (a new
  checkpoint would read every landed file again) is refused there.
* The stream itself lists files only; each micro-batch reads its files as the batch ingest
  does, so a few large files keep all cores busy.
* Every file's header is checked against the expected columns: a file with
  reordered or renamed columns fails the stream instead of being misread.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casegrid import schema as S
from casegrid.plans.catalog import CASE_PARTITION
from casegrid.plans.daily import daily_table, read_daily, with_unit_measures
from casegrid.sources import complaints_csv as C

BATCH_COLUMN = "ingest_batch"


#: Columns of the source that lists files; their content is never read through it.
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _batch_writer(columns: list[str], multiline: bool, cases_path: str, daily_path: str, quarantine_path: str,
                  relief_response: str, date_format: str, run_id: str):
    def write(batch: DataFrame, epoch_id: int) -> None:
        # Each epoch owns the folder ingest_batch=<run>-<epoch> of every sink
        # and overwrites it: a batch replayed after a failure replaces its own
        # output instead of appending a second copy.
        sub = f"{BATCH_COLUMN}={run_id}-{epoch_id:06d}"
        files = [C.literal_path(r["path"]) for r in batch.collect()]    # a row per file of the batch
        raw = C.read_raw(batch.sparkSession, files, columns, multiline)
        rows = C.typed(raw, date_format).persist()  # read once by three sinks
        try:
            good, bad = C.split(rows)
            (good.withColumn(CASE_PARTITION, F.year("date_received"))
                 .hint("rebalance", CASE_PARTITION)     # files by size, not by task and year
                 .write.mode("overwrite").partitionBy(CASE_PARTITION)
                 .parquet(f"{cases_path}/{sub}"))
            core = good.select(*S.CASE_SCHEMA.fieldNames())
            (daily_table(with_unit_measures(core, relief_response))
                .hint("rebalance").write.mode("overwrite").parquet(f"{daily_path}/{sub}"))
            bad.write.mode("overwrite").parquet(f"{quarantine_path}/{sub}")
        finally:
            rows.unpersist()
    return write


RUN_FILE = "_casegrid_run"


def _read_or_create(spark: SparkSession, folder: str, value: str) -> str:
    """The text of ``RUN_FILE`` in ``folder`` (any Hadoop file system); written with
    ``value`` if there is none yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{RUN_FILE}")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        stream = fs.open(p)
        try:
            return stream.readLine()
        finally:
            stream.close()
    out = fs.create(p, False)
    try:
        out.writeBytes(value + "\n")
    finally:
        out.close()
    return value


def _own(spark: SparkSession, checkpoint_path: str, *outputs: str) -> str:
    """The run id kept in the checkpoint folder; refuses outputs of another run."""
    run_id = _read_or_create(spark, checkpoint_path, uuid.uuid4().hex[:8])
    for path in outputs:
        owner = _read_or_create(spark, path, run_id)
        if owner != run_id:
            raise ValueError(f"{path} belongs to ingest run {owner}, not to {run_id} of {checkpoint_path}")
    return run_id


def compact_daily(spark: SparkSession, daily_path: str, out_path: str) -> DataFrame:
    """One row per day, state and product, summed over all batches, at a new path."""
    (daily_table(spark.read.parquet(daily_path)).hint("rebalance")
     .write.mode("overwrite").parquet(out_path))
    return read_daily(spark, out_path)


def start_ingest(spark: SparkSession, landing_dir: str, columns: list[str] | None = None, *,
                 cases_path: str, daily_path: str, quarantine_path: str,
                 checkpoint_path: str, relief_response: str = S.RELIEF_RESPONSE,
                 date_format: str = "yyyy-MM-dd", multiline: bool = True,
                 available_now: bool = True, max_files_per_trigger: int | None = None,
                 max_file_age: str | None = None) -> StreamingQuery:
    """Start the stream. ``columns``: the extract's header (string columns);
    by default read from a file already in ``landing_dir``.

    Output folders get one ``ingest_batch=<epoch>`` sub-folder per micro-batch,
    so a re-run epoch overwrites its own output (exactly-once at the folder
    level); readers see ``ingest_batch`` as a partition column.
    """
    columns = columns or C.header_columns(spark, landing_dir, multiline)
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_file_age:       # e.g. "3650d" when old extracts may still be landed
        reader = reader.option("maxFileAge", max_file_age)
    run_id = _own(spark, checkpoint_path, cases_path, daily_path, quarantine_path)
    stream = reader.load(landing_dir).select("path")
    writer = (stream.writeStream
              .foreachBatch(_batch_writer(columns, multiline, cases_path, daily_path, quarantine_path,
                                          relief_response, date_format, run_id))
              .option("checkpointLocation", checkpoint_path))
    writer = (writer.trigger(availableNow=True) if available_now
              else writer.trigger(processingTime="1 minute"))
    return writer.start()
