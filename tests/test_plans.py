"""Plan checks: the physical plans have the shape the design relies on."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from casegrid.plans import reports as R
from casegrid.plans.registry import mapped_inputs
from casegrid.sources import testdata as TD

SF = "/root/testdata/sf0.001"


def _explain(df, mode: str = "formatted") -> str:
    """The text of ``df.explain(mode)`` (public API; it prints to stdout)."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def _plan(df) -> str:
    return _explain(df, "simple")


@pytest.fixture(scope="module")
def inputs(spark):
    return mapped_inputs(spark, SF)


def test_date_filter_and_columns_reach_the_scan(spark, inputs):
    text = _explain(R.q1_state_share(inputs, TD.TESTDATA_CONFIG))
    assert "GreaterThanOrEqual(l_shipdate,1998-01-01T00:00)" in text
    # Only the used lineitem columns are read.
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_shipdate:timestamp_ntz>" in text


def test_top_k_uses_take_ordered(spark, inputs):
    assert "TakeOrderedAndProject" in _plan(R.q1_state_share(inputs, TD.TESTDATA_CONFIG))


def test_top_n_per_group_pre_limits(spark, inputs):
    assert "WindowGroupLimit" in _plan(R.q5_top5_per_state(inputs, TD.TESTDATA_CONFIG))


def test_population_is_broadcast_after_aggregation(spark, inputs):
    plan = _plan(R.q3_rates(inputs, TD.TESTDATA_CONFIG))
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_windows_run_on_aggregates_not_raw_rows(spark, inputs):
    """Every Window operator sits above a final HashAggregate."""
    for name in R.REPORTS:
        text = _explain(R.REPORTS[name](inputs, TD.TESTDATA_CONFIG))
        tree = text.split("\n\n")[0]
        lines = tree.splitlines()
        for i, line in enumerate(lines):
            if "Window " in line and "WindowGroupLimit" not in line:
                below = "\n".join(lines[i + 1:])
                assert "HashAggregate" in below, name


def test_entry_has_stable_schema(spark):
    assert E.entry(spark).schema == E.entry(spark).schema


def test_case_table_write_rebalances_only_under_aqe(spark):
    """With AQE the write is rebalanced by year (hot years split); without AQE
    the hint is ignored and the write has no shuffle at all."""
    from pyspark.sql import functions as F

    from casegrid.plans.catalog import case_table_layout
    df = spark.range(50).select(
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date_received"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for aqe, want in (("true", True), ("false", False)):
            spark.conf.set("spark.sql.adaptive.enabled", aqe)
            assert ("Exchange" in _plan(case_table_layout(df))) is want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_nation_key_moves_customer_rows_only(spark):
    """Without broadcasts the 25-value nation key is shuffled for customers, not for
    orders or lineitem, and no exchange carries a column that the mapping does not use."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = _plan(TD.case_fact(spark, SF)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sum("Exchange" in line for line in lines) >= 8      # four sort-merge joins
    for i, line in enumerate(lines):
        if "Exchange" in line and "c_nationkey" in line:
            scan = next(x for x in lines[i:] if "FileScan" in x)
            assert "c_custkey" in scan and not any("Join" in x for x in lines[i:lines.index(scan)])
    read = " ".join(x for x in lines if "FileScan" in x)
    for unused in ("l_comment", "l_extendedprice", "o_totalprice", "c_name", "p_name", "n_regionkey"):
        assert unused not in read.split("ReadSchema")[0]
