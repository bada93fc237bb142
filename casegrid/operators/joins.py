"""Join helpers.

No join carries a broadcast hint: the static planner broadcasts only sides whose
estimated size is under ``spark.sql.autoBroadcastJoinThreshold``, and AQE decides
again from the measured shuffle size. Above both a join stays a shuffle join, with
AQE splitting skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assert_unique_key(df: DataFrame, *keys: str) -> DataFrame:
    """Fail fast if ``keys`` repeat (a repeated key would multiply join rows)."""
    dup = df.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate key {tuple(dup[0])[:-1]} for {keys}")
    return df


def unmatched_keys(fact_keys: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Keys present in ``fact_keys`` but missing in ``dim`` (left anti join).

    Used to report what an inner join silently drops.
    """
    return fact_keys.select(key).distinct().join(dim.select(key), key, "left_anti")
