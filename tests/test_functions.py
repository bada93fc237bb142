import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casegrid import schema as S
from casegrid.functions import (band, count_when, in_regions, pct, pct_change, round_half_away,
                                safe_div)

ROUND_CASES = [1.005, 2.675, 0.285, 1.255, -1.005, -0.125]
ROUND_EXPECTED_2 = [1.0, 2.68, 0.28, 1.25, -1.0, -0.13]


def test_round_cases_match_expected(spark):
    df = spark.createDataFrame([(x,) for x in ROUND_CASES], "x double")
    got = [r[0] for r in df.select(round_half_away("x", 2)).collect()]
    assert got == ROUND_EXPECTED_2


def test_round_matches_duckdb_on_many_ratios(spark):
    import random
    rnd = random.Random(7)
    vals = ROUND_CASES + [rnd.randint(0, 9999) * 100.0 / rnd.randint(1, 9999) for _ in range(20000)]
    vals += [rnd.uniform(-50, 50) for _ in range(20000)]
    vals += [-0.004, -0.04, -0.4, -0.0049, 0.004, 0.0, -0.5, -0.05, -0.005]   # signs of zero
    pdf = pd.DataFrame({"i": range(len(vals)), "x": vals})
    con = duckdb.connect()
    con.register("t", pdf)
    dd = con.execute("SELECT round(x,0), round(x,1), round(x,2) FROM t ORDER BY i").fetchall()
    sp = (spark.createDataFrame(pdf)
          .select("i", *[round_half_away("x", n).alias(f"r{n}") for n in (0, 1, 2)])
          .orderBy("i").collect())
    def signed(row):                      # -0.0 and 0.0 compare equal: keep the sign too
        return tuple((v, math.copysign(1.0, v)) for v in row)
    assert [signed(tuple(r)[1:]) for r in sp] == [signed(tuple(r)) for r in dd]


def test_safe_div_and_pct(spark):
    df = spark.createDataFrame([(5, 0), (1, 3), (None, 2)], "a long, b long")
    rows = df.select(safe_div("a", "b").alias("d"), pct("a", "b", 1).alias("p"),
                     pct_change("a", "b", 1).alias("g")).collect()
    assert rows[0].d is None and rows[0].p is None and rows[0].g is None
    assert rows[1].p == 33.3 and rows[1].g == -66.7
    assert rows[2].d is None
    assert dict(df.select(pct("a", "b").alias("p")).dtypes)["p"] == "double"


def test_band_labels_and_null(spark):
    df = spark.createDataFrame([(2.5,), (2.0,), (1.5,), (0.5,), (0.0,), (-0.5,), (-1.0,), (None,)],
                               "z double")
    got = [r[0] for r in df.select(band("z", S.RISK_CUTS, S.RISK_LABELS, S.RISK_DEFAULT)).collect()]
    assert got == ["Critical", "Elevated", "Elevated", "Moderate", "Low", "Low", "Very Low",
                   "Very Low"]


def test_band_rejects_mismatched_labels():
    with pytest.raises(ValueError):
        band("z", [1, 2], ["a"], "d")


def test_in_regions_and_count_when(spark):
    df = spark.createDataFrame([("TX",), ("CA",), (None,), ("AP",), ("DC",), ("MO",)], "state string")
    kept = sorted(r[0] for r in df.filter(in_regions("state", S.US_STATE_CODES)).collect())
    assert kept == ["CA", "DC", "MO", "TX"]
    assert len(S.US_STATE_CODES) == 51 and len(set(S.US_STATE_CODES)) == 51
    n = df.agg(count_when(F.col("state") == "TX").alias("n")).first().n
    assert n == 1


def test_population_fixed_values():
    assert len(S.POPULATION_STATES) == len(S.POPULATION_VALUES) == 49
    missing = set(S.US_STATE_CODES) - set(S.POPULATION_STATES)
    assert missing == {"MO", "WI"}


def test_shuffle_partitions_sized_from_input(spark, tmpdir_path):
    import os
    from casegrid.session import input_bytes, partitions_for, size_shuffle_partitions
    os.makedirs(tmpdir_path)
    with open(os.path.join(tmpdir_path, "f.csv"), "w") as f:
        f.write("x" * 1000)
    assert input_bytes(spark, tmpdir_path) == 1000
    assert partitions_for(1000, target_bytes=10) == 200          # never below the default
    assert partitions_for(1000, target_bytes=1) == 1000
    assert partitions_for(None) == 200
    # The test session sets the value in its builder: an explicit choice is kept.
    assert size_shuffle_partitions(spark, tmpdir_path, target_bytes=1) == \
        int(spark.conf.get("spark.sql.shuffle.partitions"))
