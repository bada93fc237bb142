"""Report parameters.

The published reports hard-code their date floors, whitelist and thresholds.
Here they are one immutable object, so the same report code runs on the real
complaint table (``DEFAULT``) and on re-mapped test tables (see
``casegrid.sources.testdata.TESTDATA_CONFIG``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from casegrid import schema as S


@dataclass(frozen=True)
class ReportConfig:
    regions: tuple[str, ...] = S.US_STATE_CODES
    history_since: str = S.HISTORY_SINCE      # quarterly / monthly series reports
    monthly_since: str = S.MONTHLY_SINCE      # state x month export
    recent_since: str = S.RECENT_SINCE        # product and growth reports
    baseline_since: str = S.BASELINE_SINCE    # share, per-capita, z-score
    current_since: str = S.CURRENT_SINCE      # rolling and trend reports
    min_base: int = S.MIN_BASE_MONTH
    top_n: int = S.TOP_PRODUCTS_PER_STATE
    rolling_quarters: int = S.ROLLING_QUARTERS
    rolling_day_rows: int = S.ROLLING_DAY_ROWS
    relief_response: str = S.RELIEF_RESPONSE
    sample_states: tuple[str, ...] = S.SAMPLE_STATES
    # Category merge as (old name, new name) pairs; ``merge_map`` gives the dict.
    product_merge: tuple[tuple[str, str], ...] = tuple(S.PRODUCT_MERGE.items())
    # Products that no report counts (none by default); cases without a product stay.
    exclude_products: tuple[str, ...] = ()
    # Export CSV files with the extract's header names (``State``, ``Product``).
    source_headers: bool = False
    # Optional exclusive upper bound on the received date for the trend report
    # (None = keep the last, possibly partial, month, as the published report does).
    trend_until: str | None = None

    # Growth and trend by calendar month: a state's months without cases count as 0
    # (False = by row, as the published reports do).
    calendar_months: bool = False

    @property
    def merge_map(self) -> dict[str, str]:
        return dict(self.product_merge)

    def with_(self, **kw) -> "ReportConfig":
        return replace(self, **kw)


DEFAULT = ReportConfig()
