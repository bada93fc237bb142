"""Literal dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casegrid import schema as S


def population_table(spark: SparkSession) -> DataFrame:
    """The 49-row state population dimension from the fixed lists in ``schema``."""
    rows = list(zip(S.POPULATION_STATES, S.POPULATION_VALUES))
    return spark.createDataFrame(rows, S.POPULATION_SCHEMA)


def register(df: DataFrame, name: str) -> DataFrame:
    """Expose a DataFrame to SQL under ``name`` (query a frame by name)."""
    df.createOrReplaceTempView(name)
    return df
