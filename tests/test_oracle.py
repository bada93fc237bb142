"""Every registered query against its DuckDB SQL twin (the driver's gate, locally).

Runs at sf0.001 by default; set CASEGRID_ORACLE_SF=/root/testdata/sf0.01 for
the driver's scale.
"""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from casegrid.plans.registry import ingest_queries, report_queries
from casegrid.sources.testdata_sql import oracle_sql

SF = os.environ.get("CASEGRID_ORACLE_SF", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


CORE = {**report_queries(), **ingest_queries()}


def test_every_query_has_an_oracle():
    assert set(CORE) == set(oracle_sql())
    assert set(CORE) <= set(E.queries()) and set(oracle_sql()) <= set(E.oracle_sql())
    assert ORDERED <= set(CORE)


# Queries whose Spark plan and SQL text both end in a total ORDER BY (key
# columns break every tie): their row *sequence* must match too, which checks
# NULL placement and tie-breaks of the exported reports.
ORDERED = {
    "profile_top_products", "profile_responses", "q1_state_share", "q2_mom_growth",
    "q3_rate_per_100k", "q4_product_resolution", "q5_top5_per_state", "q5_sample_states",
    "q6_quarter_rolling", "q6_last12", "q7_national_trend", "q8_zscore_band", "q8b_band_counts",
    "q9_rolling_90", "q9b_latest_top15", "q10_trend_class", "q10_top20", "q10b_accelerating", "q10c_trend_counts", "q8c_per_capita_z", "q9_range_90", "q4_excluding_products",
    "e1_month_with_rate", "k1_state_risk_summary", "k2_state_month", "k3_product_state_relief",
    "k4_quarter_rate", "e2_merge_categories", "e2_product_ranking", "q1_from_daily",
    "q7_from_daily", "k3_from_daily", "q1_from_case_table",
}


def _seq(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(_norm(r[i]) for i in order) for r in rows]


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, got) == _rows(ocols, want)
    if name in ORDERED:
        assert _seq(df.columns, got) == _seq(ocols, want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 20
    assert df.columns == ["state", "total_complaints", "pct_of_total", "z_score", "risk_level"]
