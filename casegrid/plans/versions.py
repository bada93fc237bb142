"""Tables that are replaced as a whole without a moment in which they are absent.

A table's folder holds one folder per version and one empty marker file per commit::

    <root>/data/0000000007-<id>/...      written first, complete when it has _SUCCESS
    <root>/commits/0000000007-<id>       created last: the version that this names is the table

The marker's creation is the only step that readers see, and it is atomic on every file system
Spark writes to. A job that dies before it leaves the table as it was and an unnamed folder
that ``recover`` removes; one that dies after it leaves the new table. A reader keeps the
version it began with: the one before the newest is kept as well.

One writer at a time is assumed; of two that commit the same number, the one that does not
win gets an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from casegrid.plans.catalog import delete_path

#: Versions that stay after a commit: the table and what its readers may still read.
KEEP = 2


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", ".")))


def step(name: str) -> None:
    """Called between the steps of a commit; tests let it fail."""


def committed(spark: SparkSession, root: str) -> list[str]:
    """Names of the committed versions, oldest first (of two with one number the greater name counts)."""
    last = {name.split("-")[0]: name for name in _names(spark, f"{root}/commits")}
    return [last[n] for n in sorted(last)]


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the table's files, or None if nothing was committed."""
    names = committed(spark, root)
    return f"{root}/data/{names[-1]}" if names else None


def read(spark: SparkSession, root: str) -> DataFrame:
    """The table as of now."""
    path = current(spark, root)
    if path is None:
        raise FileNotFoundError(f"no committed version in {root}")
    return spark.read.parquet(path)


def publish(df: DataFrame, root: str, partition_by: list[str] | None = None, keep: int = KEEP) -> str:
    """Make ``df`` the table in ``root``; returns the folder of its files. ``df`` may read the table itself."""
    spark = df.sparkSession
    names = committed(spark, root)
    number = int(names[-1].split("-")[0]) + 1 if names else 1
    name = f"{number:010d}-{uuid.uuid4().hex[:12]}"
    step("write")
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/data/{name}")
    step("commit")
    fs, marker = _fs(spark, f"{root}/commits/{name}")
    fs.mkdirs(marker.getParent())
    fs.create(marker, False).close()
    step("check")
    if committed(spark, root)[-1] != name:
        raise RuntimeError(f"{root} was replaced by another writer at the same time")
    step("clean")
    _drop_before(spark, root, committed(spark, root)[-keep:][0])
    return f"{root}/data/{name}"


def _drop_before(spark: SparkSession, root: str, oldest: str) -> None:
    """Markers first, so no marker ever names a folder that is gone."""
    for folder in ("commits", "data"):
        for name in _names(spark, f"{root}/{folder}"):
            if name < oldest and name.split("-")[0] != oldest.split("-")[0]:
                step(f"drop {folder}")
                delete_path(spark, f"{root}/{folder}/{name}")


def recover(spark: SparkSession, root: str) -> list[str]:
    """Remove what interrupted writers left (folders that no commit names); returns their names. Not
    to be called while one writes."""
    names = set(committed(spark, root))
    left = [n for n in _names(spark, f"{root}/data") if n not in names]
    for name in left:
        delete_path(spark, f"{root}/data/{name}")
    return left


def point_table(spark: SparkSession, name: str, root: str) -> DataFrame:
    """Have the catalog's table ``name`` read the committed version of ``root``: moved there in one step if its
    columns are the same, else dropped and created (files are never touched)."""
    path = current(spark, root)
    if path is None:
        raise FileNotFoundError(f"no committed version in {root}")
    files = spark.read.parquet(path)
    partitioned = any("=" in n for n in _names(spark, path))
    if spark.catalog.tableExists(name):
        if not partitioned and _columns(spark.table(name)) == _columns(files) and not any(c.isPartition for c in spark.catalog.listColumns(name)):
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
            spark.catalog.refreshTable(name)
            return spark.table(name)
        spark.sql(f"DROP TABLE {name}")
    spark.catalog.createTable(name, path=path, source="parquet")
    if partitioned:
        spark.catalog.recoverPartitions(name)
    return spark.table(name)


def _columns(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
