"""Unit fixtures for the composite metrics (FIXTURES.md section 3)."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from casegrid import schema as S
from casegrid.config import DEFAULT
from casegrid.operators import metrics as M
from casegrid.operators.joins import assert_unique_key, unmatched_keys
from casegrid.plans import reports as R
from casegrid.plans.daily import daily_table, with_unit_measures
from casegrid.sources.dims import population_table

D = dt.date


def cases(spark, rows):
    """rows: (date, state, product, response, timely)."""
    ordered = [(d, p, s, r, t) for d, s, p, r, t in rows]   # schema order
    return with_unit_measures(spark.createDataFrame(ordered, S.CASE_SCHEMA))


def counts_frame(spark, pairs, key="state", value="complaints"):
    return spark.createDataFrame(pairs, f"{key} string, {value} long")


# states_mixed ------------------------------------------------------------------

def test_states_mixed_whitelist_and_dimension(spark):
    rows = [(D(2023, 2, 1), s, "P", None, True) for s in ["TX", "TX", "CA", None, "AP", "DC", "MO"]]
    inp = R.ReportInputs(cases=cases(spark, rows), population=population_table(spark))
    q1 = {r.state: (r.total_complaints, r.pct_of_total) for r in R.q1_state_share(inp).collect()}
    assert q1 == {"TX": (2, 40.0), "CA": (1, 20.0), "DC": (1, 20.0), "MO": (1, 20.0)}
    q3 = {r.state for r in R.q3_rates(inp).collect()}
    assert q3 == {"TX", "CA", "DC"}           # MO has no population row; AP / NULL never match
    assert [r.state for r in R.q3_unmatched_keys(inp).collect()] == ["MO"]


# z-score ------------------------------------------------------------------------

def _z_edge_counts():
    """Counts where one value's raw z lies in (2.000, 2.005): rounded 2.0 vs raw > 2."""
    base = list(range(1000, 20000, 1000))      # wide spread: z moves ~0.0002 per unit of x
    for x in range(20000, 80000):
        vals = base + [x]
        z = (x - statistics.mean(vals)) / statistics.stdev(vals)
        if 2.0 < z < 2.005:
            return vals
    raise AssertionError("no edge case found")


def test_z_edges_rounded_vs_raw_band(spark):
    vals = _z_edge_counts()
    df = counts_frame(spark, [(f"S{i}", v) for i, v in enumerate(vals)])
    kw = dict(cuts=S.RISK_CUTS, labels=S.RISK_LABELS, default=S.RISK_DEFAULT)
    rounded = M.zscore(df, "complaints", band_out="risk", band_on="rounded", **kw)
    raw = M.zscore(df, "complaints", band_out="risk", band_on="raw", **kw)
    top = f"S{len(vals) - 1}"
    r1 = rounded.filter(F.col("state") == top).first()
    r2 = raw.filter(F.col("state") == top).first()
    assert r1.z_score == 2.0 and r1.risk == "Elevated"
    assert r2.z_score == 2.0 and r2.risk == "Critical"


def test_z_five_bands_and_mean_zero(spark):
    vals = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 60]
    df = counts_frame(spark, [(f"S{i:02d}", v) for i, v in enumerate(vals)])
    out = M.zscore(df, "complaints", band_out="risk", cuts=S.RISK_CUTS, labels=S.RISK_LABELS,
                   default=S.RISK_DEFAULT, mean_out="mean")
    rows = out.collect()
    assert {r.risk for r in rows} >= {"Critical", "Moderate", "Low"}
    zs = [(v - statistics.mean(vals)) / statistics.stdev(vals) for v in vals]
    assert abs(sum(zs)) < 1e-9
    got = {r.state: r.z_score for r in rows}
    for i, z in enumerate(zs):
        assert abs(got[f"S{i:02d}"] - z) <= 0.005 + 1e-9
    five = [0, 0, 0, 0, 0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 110, 120, 130, 140, 150,
            160, 170, 180, 190, 200, 260, 300, 420]
    full = counts_frame(spark, [(f"S{i:02d}", v) for i, v in enumerate(five)])
    labels = {r.risk for r in M.zscore(full, "complaints", band_out="risk", cuts=S.RISK_CUTS,
                                       labels=S.RISK_LABELS, default=S.RISK_DEFAULT).collect()}
    assert labels == set(S.RISK_LABELS) | {S.RISK_DEFAULT}


def test_z_flat_and_single_state_fall_to_default(spark):
    for pairs in ([("A", 5), ("B", 5), ("C", 5)], [("A", 7)]):
        out = M.zscore(counts_frame(spark, pairs), "complaints", band_out="risk",
                       cuts=S.RISK_CUTS, labels=S.RISK_LABELS, default=S.RISK_DEFAULT).collect()
        assert all(r.z_score is None and r.risk == "Very Low" for r in out)


# lags, growth, trend --------------------------------------------------------------

def _months(spark, state, values, start=(2022, 1), skip=()):
    rows, y, m = [], *start
    for v in values:
        while (y, m) in skip:
            y, m = (y + (m == 12), m % 12 + 1)
        rows.append((state, D(y, m, 1), v))
        y, m = (y + (m == 12), m % 12 + 1)
    return rows


def test_months_full_lag_1_and_12(spark):
    rows = _months(spark, "TX", list(range(100, 116)))
    df = spark.createDataFrame(rows, "state string, month date, complaints long")
    out = M.growth_vs_lag(df, "month", "complaints", lag=12, prev_out="ly", pct_out="yoy", scale=1)
    got = [(r.complaints, r.ly, r.yoy) for r in out.orderBy("month").collect()]
    assert all(ly is None and y is None for _, ly, y in got[:12])
    assert got[12] == (112, 100, 12.0)


def test_months_gap_lags_by_row_and_stays_in_state(spark):
    rows = _months(spark, "TX", [10, 20, 30], skip={(2022, 2)}) + _months(spark, "CA", [1000, 2000])
    df = spark.createDataFrame(rows, "state string, month date, complaints long")
    out = M.growth_vs_lag(df, "month", "complaints", partition=["state"], prev_out="prev")
    got = {(r.state, r.month): r.prev for r in out.collect()}
    assert got[("TX", D(2022, 3, 1))] == 10        # Feb missing: compares with Jan
    assert got[("CA", D(2022, 1, 1))] is None       # never another state's value


def test_min_base_filter_and_zero_base(spark):
    df = spark.createDataFrame([("A", D(2022, 1, 1), 0), ("A", D(2022, 2, 1), 5),
                                ("A", D(2022, 3, 1), 150), ("A", D(2022, 4, 1), 300)],
                               "state string, month date, complaints long")
    g = M.growth_vs_lag(df, "month", "complaints", partition=["state"], prev_out="p",
                        pct_out="g", scale=2)
    got = {r.month: r.g for r in g.collect()}
    assert got[D(2022, 2, 1)] is None             # previous value 0 -> NULL, not an error
    kept = M.growth_vs_lag(df, "month", "complaints", partition=["state"], prev_out="p",
                           pct_out="g", min_base=100).collect()
    assert [(r.month, r.g) for r in kept] == [(D(2022, 4, 1), 100.0)]


def test_trend_cases(spark):
    rows = (_months(spark, "UP", [1, 2, 3, 4]) + _months(spark, "DOWN", [9, 5, 3, 2])
            + _months(spark, "MIX", [5, 1, 7, 6]) + _months(spark, "EQ", [2, 2, 2, 3])
            + _months(spark, "DN2", [1, 9, 5, 3]))
    df = spark.createDataFrame(rows, "state string, month date, complaints long")
    out = M.trend_class(df, "month", "complaints", partition=["state"])
    last = {r.state: (r.trend, r.growth_vs_3mo_ago_pct)
            for r in M.at_latest_period(out, "month", F.col("m3").isNotNull()).collect()}
    assert last["UP"] == ("Accelerating", 300.0)
    assert last["DOWN"][0] == "Decelerating"
    assert last["DN2"][0] == "Decelerating"        # two falls are enough
    assert last["MIX"][0] == "Mixed" and last["EQ"][0] == "Mixed"


def test_months_short_and_last_month_absent(spark):
    rows = (_months(spark, "SHORT", [1, 2, 3]) + _months(spark, "EARLY", [1, 2, 3, 4])
            + _months(spark, "FULL", [1, 2, 3, 4, 5]))
    df = spark.createDataFrame(rows, "state string, month date, complaints long")
    out = M.trend_class(df, "month", "complaints", partition=["state"])
    latest = M.at_latest_period(out, "month", F.col("m3").isNotNull()).collect()
    assert [(r.state, r.month) for r in latest] == [("FULL", D(2022, 5, 1))]


# rolling ----------------------------------------------------------------------------

def test_days_95_rolling_90_rows(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(96) if i != 40]
    df = spark.createDataFrame([("TX", d, i + 1) for i, d in enumerate(days)],
                               "state string, day date, n long")
    out = M.rolling(df, "day", "n", 90, partition=["state"], out="r").orderBy("day").collect()
    vals = [r.n for r in out]
    for i, r in enumerate(out):
        assert r.r == sum(vals[max(0, i - 89): i + 1])   # rows, not calendar days
    assert out[0].r == 1                                   # short frame, no NULL padding


def test_rolling_equals_self_join_brute_force(spark):
    rows = [(s, D(2024, 1, 1) + dt.timedelta(days=3 * i + (s == "B")), (i * 7) % 11)
            for s in "AB" for i in range(30)]
    df = spark.createDataFrame(rows, "state string, day date, n long")
    got = {(r.state, r.day): r.r for r in
           M.rolling(df, "day", "n", 5, partition=["state"], out="r").collect()}
    for s in "AB":
        seq = sorted((d, n) for st, d, n in rows if st == s)
        for i, (d, _) in enumerate(seq):
            assert got[(s, d)] == sum(n for _, n in seq[max(0, i - 4): i + 1])


# top-n, latest, ties ----------------------------------------------------------------

def test_ties_top_n_deterministic(spark):
    df = spark.createDataFrame([("TX", p, 5) for p in "FEDCBA"] + [("CA", "Z", 1)],
                               "state string, product string, complaints long")
    out = M.top_n_per_group(df, ["state"], [F.col("complaints").desc(), F.col("product").asc()],
                            3, rank_out="rk").collect()
    tx = sorted((r.rk, r.product) for r in out if r.state == "TX")
    assert tx == [(1, "A"), (2, "B"), (3, "C")]
    assert [(r.state, r.rk) for r in out if r.state == "CA"] == [("CA", 1)]


def test_latest_per_group(spark):
    df = spark.createDataFrame([("A", D(2024, 1, 1), 1), ("A", D(2024, 1, 3), 3),
                                ("B", D(2024, 1, 2), 2)], "state string, d date, v long")
    got = {r.state: r.v for r in M.latest_per_group(df, ["state"], "d").collect()}
    assert got == {"A": 3, "B": 2}


# rates -------------------------------------------------------------------------------

def test_rates_null_response_counts_as_no(spark):
    rows = [(D(2023, 1, 1), "TX", "Card", S.RELIEF_RESPONSE, True),
            (D(2023, 1, 1), "TX", "Card", None, None),
            (D(2023, 1, 1), "TX", "Card", "Closed with explanation", False),
            (D(2023, 1, 1), "TX", "Card", None, True)]
    out = R.q4_product_resolution(R.ReportInputs(cases=cases(spark, rows))).first()
    assert (out.total_complaints, out.resolved_with_relief) == (4, 1)
    assert (out.relief_rate_pct, out.timely_response_pct, out.pct_of_total) == (25.0, 50.0, 100.0)


# series ------------------------------------------------------------------------------

def test_series_gap_left_inner_and_duplicates(spark):
    periods = spark.createDataFrame([(D(2020, 1, 1), 10), (D(2020, 2, 1), 20), (D(2020, 4, 1), 30)],
                                    "period date, complaints long")
    series = spark.createDataFrame([(D(2020, 1, 1), 3.5)], "date date, delinquency_rate double")
    left = {r.period: r.delinquency_rate for r in M.attach_series(periods, "period", series).collect()}
    assert left == {D(2020, 1, 1): 3.5, D(2020, 2, 1): 3.5, D(2020, 4, 1): None}
    inner = M.attach_series(periods, "period", series, how="inner").collect()
    assert len(inner) == 2
    dup = spark.createDataFrame([(D(2020, 1, 1), 3.5), (D(2020, 2, 15), 3.6)],
                                "date date, delinquency_rate double")
    with pytest.raises(ValueError):
        assert_unique_key(dup.withColumn("q", F.trunc("date", "quarter")), "q")


# merge -------------------------------------------------------------------------------

def test_merge_null_keys_and_names(spark):
    df = spark.createDataFrame(
        [("Credit reporting or other personal consumer reports", "TX", 10, 1.0),
         ("Credit reporting, credit repair services, or other personal consumer reports", "TX", 30, 2.0),
         ("Mortgage", "TX", 5, 4.0), (None, "TX", 7, 1.0), ("Mortgage", None, 2, 1.0)],
        "product string, state string, complaints long, relief_rate double")
    out = {(r.product, r.state): (r.complaints, r.relief_rate)
           for r in R.e2_merge_categories(df, DEFAULT).collect()}
    assert out == {("Credit Reporting", "TX"): (40, 1.5), ("Mortgage", "TX"): (5, 4.0)}


# daily table parity --------------------------------------------------------------------

def test_daily_table_sums_to_base_count(spark):
    rows = [(D(2023, 1, 1 + i % 3), ["TX", "CA", None][i % 3], ["A", "B"][i % 2],
             [S.RELIEF_RESPONSE, None][i % 2], [True, False, None][i % 3]) for i in range(40)]
    base = cases(spark, rows)
    daily = daily_table(base)
    tot = daily.agg(*[F.sum(m).alias(m) for m in ("n", "n_relief", "n_timely")]).first()
    assert (tot.n, tot.n_relief, tot.n_timely) == (40, 20, 14)


def test_unmatched_keys(spark):
    a = spark.createDataFrame([("A",), ("B",), ("B",)], "state string")
    b = spark.createDataFrame([("A", 1)], "state string, population long")
    assert [r.state for r in unmatched_keys(a, b, "state").collect()] == ["B"]


def _plan(df, adaptive=True):
    """Physical plan text via the public ``explain``; ``adaptive=False`` turns
    off Spark's own size-based broadcast so only explicit hints remain."""
    import contextlib
    import io
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if not adaptive:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        return buf.getvalue()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_q4_counts_all_states_including_null_and_territories(spark):
    rows = [(D(2022, 3, 1), s, "Card", None, True) for s in ["TX", None, "AP", "GU"]]
    rows.append((D(2021, 12, 31), "TX", "Card", None, True))    # before the floor
    out = R.q4_product_resolution(R.ReportInputs(cases=cases(spark, rows))).first()
    assert out.total_complaints == 4 and out.pct_of_total == 100.0
    q1 = R.q1_state_share(R.ReportInputs(cases=cases(spark, rows)),
                          DEFAULT.with_(baseline_since="2022-01-01")).collect()
    assert [(r.state, r.total_complaints) for r in q1] == [("TX", 1)]


def test_unmatched_keys_with_and_without_whitelist(spark):
    rows = [(D(2023, 2, 1), s, "P", None, True) for s in ["TX", "MO", "AP", None]]
    inp = R.ReportInputs(cases=cases(spark, rows), population=population_table(spark))
    assert [r.state for r in R.q3_unmatched_keys(inp).collect()] == ["MO"]
    got = sorted(r.state for r in R.q3_unmatched_keys(inp, whitelist=False).collect())
    assert got == ["AP", "MO"]
