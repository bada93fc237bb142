"""Report sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from casegrid import schema as S


def csv_writer(df: DataFrame, mode: str = "overwrite"):
    """A CSV ``DataFrameWriter`` in the extract's dialect: header row, values
    quoted when needed, quotes inside values doubled (RFC 4180), which is what
    ``sources.complaints_csv`` and common CSV tools read. Spark's default
    would escape quotes with a backslash and trim spaces around values."""
    return (df.write.mode(mode).option("header", True)
            .option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def write_report_csv(df: DataFrame, path: str, single_file: bool = True) -> None:
    """CSV with a header, no index column.

    ``single_file`` coalesces the *final* stage to one task; use it only for
    report outputs, whose size is bounded by the dimensions (states, months,
    products), never for case-level data.
    """
    csv_writer(df.coalesce(1) if single_file else df).csv(path)


def read_report_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read an exported report back with a declared schema (no inference). A header
    in another order, or a value that does not parse, fails the read."""
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("enforceSchema", False).option("mode", "FAILFAST")
            .option("multiLine", True).schema(schema).csv(path))


def with_source_headers(df: DataFrame) -> DataFrame:
    """Columns under the extract's header names where they have one (``State``, ``Product``)."""
    names = {v: k for k, v in S.SOURCE_COLUMNS.items()}
    return df.withColumnsRenamed({c: names[c] for c in df.columns if c in ("state", "product")})


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p, jvm


def step(name: str) -> None:
    """Called between the steps of a replacement; tests let it fail."""


def overwrite_in_place(df: DataFrame, path: str, single_file: bool = True) -> None:
    """Replace the CSV at ``path`` with ``df``, even when ``df`` is read from it.

    Spark reads lazily, so writing straight to the input path would delete the
    input first. Instead: write the new content to a staging sibling, move the
    old folder aside, move the staging folder into place, then delete the old
    one. A failure at any step leaves a complete old or new copy on disk, and
    ``recover_in_place`` (run before each replacement) puts it back under its name.
    """
    spark = df.sparkSession
    recover_in_place(spark, path)
    tag = uuid.uuid4().hex[:8]
    staging = f"{path.rstrip('/')}.staging-{tag}"
    old_path = f"{path.rstrip('/')}.old-{tag}"
    step("write")
    write_report_csv(df, staging, single_file)
    step("move aside")
    fs, target, jvm = _fs(spark, path)
    Path = jvm.org.apache.hadoop.fs.Path
    old = Path(old_path)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"could not move {path} aside")
    step("move in")
    if not fs.rename(Path(staging), target):
        if fs.exists(old):
            fs.rename(old, target)      # the old content is back under its name
        raise OSError(f"could not move {staging} to {path}")
    step("delete")
    fs.delete(old, True)


def recover_in_place(spark: SparkSession, path: str) -> bool:
    """Finish or undo a replacement of ``path`` that was interrupted; True if there was one.

    If the path is missing, the complete new content takes its place, else the old; what else
    was left beside it is deleted. Not to be called while the path is being replaced.
    """
    fs, target, jvm = _fs(spark, path.rstrip("/"))
    Path = jvm.org.apache.hadoop.fs.Path
    name = target.getName()
    if not fs.exists(target.getParent()):
        return False
    beside = {s.getPath().getName(): s.getPath() for s in fs.listStatus(target.getParent())}
    found = {kind: sorted(n for n in beside if n.startswith(f"{name}.{kind}-")) for kind in ("staging", "old")}
    if not fs.exists(target):
        # Only the writer that moved the old copy aside had a complete new one.
        tags = [n.rsplit("-", 1)[1] for n in found["old"]]
        new = [n for n in found["staging"] if n.rsplit("-", 1)[1] in tags and fs.exists(Path(beside[n], "_SUCCESS"))]
        for n in (new + found["old"])[:1]:
            if not fs.rename(beside[n], target):
                raise OSError(f"could not move {n} to {path}")
    for n in found["staging"] + found["old"]:
        fs.delete(beside[n], True)
    return bool(found["staging"] or found["old"])
