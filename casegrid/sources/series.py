"""External quarterly series.

The published load fetches the series over HTTP on the driver. Here the series
is a landed file (CSV or Parquet) read with a declared schema: two columns by
position -> ``date``, ``delinquency_rate``; rows with a value missing in the file
are dropped, while a value that does not parse fails the load;
one row per quarter is enforced before any join can multiply rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrid.operators.joins import assert_unique_key
from casegrid.plans.sinks import csv_writer


def load_series(spark: SparkSession, path: str, fmt: str = "csv",
                names: tuple[str, str] = ("date", "delinquency_rate"),
                check_unique: bool = True) -> DataFrame:
    """Read a two-column series file; rename by position; drop NULL rows."""
    if fmt == "csv":
        raw_schema = T.StructType([T.StructField("c0", T.StringType()),
                                   T.StructField("c1", T.StringType())])
        raw = spark.read.option("header", True).schema(raw_schema).csv(path)
        bad = lambda c: F.raise_error(F.concat(F.lit("series value does not parse: "), F.col(c)))
        present = lambda c: F.nullif(F.trim(c), F.lit(""))
        parsed = lambda c, v: F.when(present(c).isNull(), F.lit(None)).otherwise(F.coalesce(v, bad(c)))
        df = raw.select(
            parsed("c0", F.try_to_date(F.trim("c0"))).cast("date").alias("c0"),
            parsed("c1", F.trim("c1").try_cast("double")).cast("double").alias("c1"))
    else:
        df = spark.read.format(fmt).load(path)
    series = df.toDF(*names).select(F.col(names[0]).cast("date").alias(names[0]),
                                    F.col(names[1]).cast("double").alias(names[1]))
    series = series.na.drop("any")
    if check_unique:
        assert_unique_key(series.withColumn("__q", F.trunc(names[0], "quarter")), "__q")
    return series


def series_range(series: DataFrame, date_col: str = "date") -> DataFrame:
    """Number of observations and first / last date."""
    return series.agg(F.count(F.lit(1)).alias("observations"),
                      F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"))


def write_series_csv(series: DataFrame, path: str) -> None:
    """Land a (small) series as one CSV file with a header."""
    csv_writer(series.coalesce(1)).csv(path)

