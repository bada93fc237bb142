"""Tables in the session catalog.

Tables are external Parquet tables whose files live under a caller-given path
(on a cluster: under the shared folder), so they survive executor loss and
the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrid import schema as S

CASE_PARTITION = "received_year"


def create_if_absent(df: DataFrame, name: str, path: str, partition_by: list[str] | None = None) -> bool:
    """``CREATE TABLE IF NOT EXISTS name AS SELECT ...``; True if it was created."""
    spark = df.sparkSession
    if spark.catalog.tableExists(name):
        return False
    w = df.write.mode("ignore").format("parquet").option("path", path)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)
    return True


def register_files(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Register Parquet files already written at ``path`` as an external table
    (no data is rewritten); partition folders are discovered."""
    if not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, path=path, source=fmt)
        if any(c.isPartition for c in spark.catalog.listColumns(name)):
            spark.catalog.recoverPartitions(name)   # a failure here must not pass as an empty table
    return spark.table(name)


def replace_table(df: DataFrame, name: str, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """``DROP TABLE IF EXISTS`` + ``CREATE TABLE AS``; returns the table.

    The new content is a version of its own under ``path`` (``plans.versions``), so the old table
    is there until the new one is complete, and ``df`` may read the table it replaces.
    """
    from casegrid.plans import versions

    versions.publish(df, path, partition_by)
    return versions.point_table(df.sparkSession, name, path)


def describe(df: DataFrame) -> DataFrame:
    """Schema as rows ``(col_name, data_type, nullable)``."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "col_name string, data_type string, nullable boolean")


def row_count(spark: SparkSession, table_or_path: str) -> int:
    """Row count of a *written* table (never of a lazily parsed CSV)."""
    if "/" not in table_or_path and spark.catalog.tableExists(table_or_path):
        return spark.table(table_or_path).count()
    return spark.read.parquet(table_or_path).count()


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is at ``path`` (its writer's success mark is there)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_wide_table(rows: DataFrame, path: str) -> None:
    """Write all source columns, partitioned by received year, from where they are
    read: wide rows (narratives included) are never shuffled."""
    (rows.withColumn(CASE_PARTITION, F.year("date_received"))
         .write.mode("overwrite").partitionBy(CASE_PARTITION).parquet(path))


def write_case_table(cases: DataFrame, path: str) -> None:
    """Write typed case rows as Parquet, partitioned by received year.

    Year folders prune every report's date floor (all floors are 1 January);
    inside a year, files are sorted by date so Parquet row-group statistics
    prune the rest. ``rebalance`` on the partition column lets AQE size the
    write tasks (small years coalesced, a hot year split into several
    tasks), so each folder gets a few well-sized files instead of one file
    per (task, folder).
    """
    case_table_layout(cases).write.mode("overwrite").partitionBy(CASE_PARTITION).parquet(path)


def case_table_layout(cases: DataFrame) -> DataFrame:
    """Case rows with the year column, rebalanced by year and date-sorted."""
    return (cases.withColumn(CASE_PARTITION, F.year("date_received"))
                 .hint("rebalance", CASE_PARTITION)
                 .sortWithinPartitions(CASE_PARTITION, "date_received"))


def read_case_table(spark: SparkSession, path: str) -> DataFrame:
    """The case table with its declared schema (no inference job)."""
    schema = T.StructType(S.CASE_SCHEMA.fields + [T.StructField(CASE_PARTITION, T.IntegerType())])
    return spark.read.schema(schema).parquet(path)
