"""Properties: parity of the daily table with base rows for
every report, and composites against brute force on random small inputs."""

import datetime as dt
import math
import random
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casegrid import schema as S
from casegrid.operators import metrics as M
from casegrid.plans import reports as R
from casegrid.plans.daily import daily_table
from casegrid.plans.registry import mapped_inputs
from casegrid.sources import testdata as TD

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def both(spark):
    base = mapped_inputs(spark, SF)
    daily = R.ReportInputs(cases=daily_table(base.cases).cache(), population=base.population,
                           series=base.series)
    return base, daily


@pytest.mark.parametrize("name", sorted(set(R.REPORTS) - {"profile_responses"}))
def test_daily_table_parity(spark, both, name):
    base, daily = both
    fn = R.REPORTS[name]
    assert _rows(fn(base, TD.TESTDATA_CONFIG)) == _rows(fn(daily, TD.TESTDATA_CONFIG))


def test_shares_sum_to_100_and_z_mean_zero(spark, both):
    base, _ = both
    k1 = R.k1_state_risk_summary(base, TD.TESTDATA_CONFIG).collect()
    assert abs(sum(r.pct_of_total for r in k1) - 100.0) <= 0.005 * len(k1)
    assert abs(sum(r.z_score for r in k1)) <= 0.005 * len(k1)


def test_top_n_has_at_most_n_rows_per_state(spark, both):
    base, _ = both
    rows = R.q5_top5_per_state(base, TD.TESTDATA_CONFIG).collect()
    per = {}
    for r in rows:
        per.setdefault(r.state, []).append(r)
    assert all(len(v) <= 5 for v in per.values())
    for v in per.values():
        counts = [r.complaints for r in sorted(v, key=lambda r: r.rank_in_state)]
        assert counts == sorted(counts, reverse=True)


counts_strategy = st.lists(st.integers(min_value=0, max_value=500), min_size=1, max_size=25)


@settings(max_examples=15, deadline=None)
@given(counts_strategy)
def test_share_and_zscore_brute_force(spark, counts):
    df = spark.createDataFrame([(f"S{i:02d}", c) for i, c in enumerate(counts)],
                               "state string, complaints long")
    out = {r.state: r for r in M.zscore(M.share_of_total(df, "complaints"), "complaints",
                                        z_out="z", scale=2, band_out="b", band_on="raw",
                                        cuts=S.RISK_CUTS, labels=S.RISK_LABELS,
                                        default=S.RISK_DEFAULT).collect()}
    total = sum(counts)
    sd = statistics.stdev(counts) if len(counts) > 1 else None
    mean = statistics.mean(counts)
    for i, c in enumerate(counts):
        r = out[f"S{i:02d}"]
        if total == 0:
            assert r.pct_of_total is None
        else:
            assert abs(r.pct_of_total - c * 100.0 / total) <= 0.005 + 1e-9
        if not sd:
            assert r.z is None and r.b == S.RISK_DEFAULT
        else:
            z = (c - mean) / sd
            assert abs(r.z - z) <= 0.005 + 1e-9
            if not any(math.isclose(z, cut, abs_tol=1e-9) for cut in S.RISK_CUTS):
                want = next((lab for cut, lab in zip(S.RISK_CUTS, S.RISK_LABELS) if z > cut),
                            S.RISK_DEFAULT)
                assert r.b == want


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("AB"), st.integers(0, 60), st.integers(0, 9)),
                min_size=1, max_size=60, unique_by=lambda t: (t[0], t[1])),
       st.integers(min_value=1, max_value=8))
def test_rolling_and_lag_brute_force(spark, rows, width):
    start = dt.date(2024, 1, 1)
    data = [(s, start + dt.timedelta(days=d), v) for s, d, v in rows]
    df = spark.createDataFrame(data, "state string, day date, n long")
    got = {(r.state, r.day): (r.r, r.prev) for r in
           M.growth_vs_lag(M.rolling(df, "day", "n", width, partition=["state"], out="r"),
                           "day", "n", partition=["state"], prev_out="prev").collect()}
    for s in "AB":
        seq = sorted((d, v) for st_, d, v in data if st_ == s)
        for i, (d, _) in enumerate(seq):
            want_r = sum(v for _, v in seq[max(0, i - width + 1): i + 1])
            want_prev = seq[i - 1][1] if i else None
            assert got[(s, d)] == (want_r, want_prev)


def test_round_half_away_random_against_python_formula(spark):
    rnd = random.Random(3)
    vals = [rnd.randint(0, 10**6) / rnd.randint(1, 10**4) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    from casegrid.functions import round_half_away
    got = [r[0] for r in df.select(round_half_away("x", 1)).collect()]
    want = [math.floor(v * 10.0 + 0.5) / 10.0 for v in vals]   # positive values: half up
    assert got == want
