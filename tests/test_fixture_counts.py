"""Row counts listed in FIXTURES.md section 2 (measured there independently of
this code), checked before LIMIT on the mapped sf0.001 and sf0.01 tables."""

import pytest
from pyspark.sql import functions as F

from casegrid.plans import reports as R
from casegrid.plans.daily import daily_table
from casegrid.plans.registry import mapped_inputs
from casegrid.sources import testdata as TD

CFG = TD.TESTDATA_CONFIG
# sf -> expected counts (FIXTURES.md, "Row counts to expect")
EXPECTED = {
    "/root/testdata/sf0.001": dict(states=20, q2=0, q3=24, q3_unmatched=0, q4=6, q5=100, q6=27,
                                   q7=59, q9=1950, q10=4, e1=83, e1_no_rate=2,
                                   k2=1288, k3=120, e2=100, daily=5940, null_state=222, rows=6000),
    "/root/testdata/sf0.01": dict(states=20, q2=1047, q3=24, q3_unmatched=0, q4=6, q5=100, q6=27,
                                  q7=59, q9=12573, q10=19, e1=83, e1_no_rate=2,
                                  k2=1419, k3=120, e2=100, daily=55418, null_state=2468,
                                  rows=60000),
}


@pytest.mark.parametrize("sf", sorted(EXPECTED))
def test_fixture_row_counts(spark, sf):
    want = EXPECTED[sf]
    inp = mapped_inputs(spark, sf)
    got = dict(
        states=R.k1_state_risk_summary(inp, CFG).count(),
        q2=R.q2_monthly(inp, CFG).count(),
        q3=R.q3_rates(inp, CFG).count(),
        q3_unmatched=R.q3_unmatched_keys(inp, CFG).count(),
        q4=R.q4_product_resolution(inp, CFG).count(),
        q5=R.q5_rows(inp, CFG).count(),
        q6=R.q6_rows(inp, CFG).count(),
        q7=R.q7_national_trend(inp, CFG, k=10_000).count(),
        q9=R.q9_rows(inp, CFG).count(),
        q10=R.q10_rows(inp, CFG).count(),
        e1=R.e1_month_with_rate(inp, CFG).count(),
        e1_no_rate=R.e1_month_with_rate(inp, CFG)
                    .filter(F.col("delinquency_rate").isNull()).count(),
        k2=R.k2_state_month(inp, CFG).count(),
        k3=R.k3_rows(inp, CFG).count(),
        e2=R.e2_merge_categories(R.k3_rows(inp, CFG), CFG).count(),
        daily=daily_table(inp.cases).count(),
        null_state=R.profile_null_states(inp, CFG).first().null_states,
        rows=R.profile_range(inp, CFG).first().total_complaints,
    )
    assert got == want


def test_fixture_band_facts(spark):
    """FIXTURES.md: sf0.001 reaches all five bands (highest z 2.50); sf0.01 has no
    'Critical' state (highest z 1.53) and no 'Accelerating' state in its partial last month."""
    small = R.q8_rows(mapped_inputs(spark, "/root/testdata/sf0.001"), CFG).collect()
    assert len({r.risk_level for r in small}) == 5
    assert max(r.z_score for r in small) == 2.5
    inp = mapped_inputs(spark, "/root/testdata/sf0.01")
    mid = R.q8_rows(inp, CFG).collect()
    assert "Critical" not in {r.risk_level for r in mid}
    assert max(r.z_score for r in mid) == 1.53
    assert R.q10b_accelerating(inp, CFG).count() == 0
    assert {r.trend: r.states for r in R.q10c_trend_counts(inp, CFG).collect()}["Accelerating"] == 0
