from casegrid.functions.columns import (
    asc_nl,
    band,
    before,
    count_when,
    desc_nl,
    in_regions,
    month_of,
    pct,
    pct_change,
    quarter_of,
    round_half_away,
    safe_div,
    since,
)

__all__ = [
    "asc_nl", "desc_nl", "band", "before", "count_when", "in_regions", "month_of", "pct", "pct_change",
    "quarter_of", "round_half_away", "safe_div", "since",
]
